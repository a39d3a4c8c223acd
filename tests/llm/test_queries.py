"""Registered queries, and the pipeline, against brute force on small tables."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lexitide.llm import decontaminate, near_dup, packing, quality_model, queries, sharding, token_count, url_filter
from lexitide.llm.common import hot_buckets, row_key, split_by_key, spread_join, without_rows
from tests.llm.test_corpus_ops import EDGE, RULES, brute_groups, brute_lines, table, words

KINDS = (
    ("assign", r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
    ("access", r"(AKIA[A-Z0-9]+)"),
    ("hex", r"([0-9a-f]+)"),
)
LEAST = {"assign": 6, "access": 20, "hex": 24}


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """A folder with documents that hold secrets, odd characters, long texts and repeats."""
    rng = np.random.default_rng(11)
    vocabulary = [f"w{i}" for i in range(300)] + ["the", "of", "and", "é日本", "☃"] * 15
    secret = lambda: rng.choice(["password = 'hunter2222'", "AKIA" + "ABCD1234EFGH5678IJ", "deadbeef" * 4, "Token: aB3dE5fG7hJ9kL1mN2pQ4rS6", "api_key=short", "xY9" * 10])
    rows = [(i, " ".join(rng.choice(vocabulary, int(rng.integers(1, 90)))) + ("\n" + secret() + " ok" if i % 3 == 0 else "")) for i in range(80)]
    rows += [(200 + i, rows[i][1]) for i in range(10)] + [(300, None), (301, ""), (302, " ".join(rng.choice(vocabulary, 9000)))]
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame([(i, t, "en", f"s{i % 4}", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    return path, rows


def test_op2_through_its_query(spark, corpus):
    path, rows = corpus
    got = {r.doc_id: r for r in queries.op2_secret_scan(spark, path).collect()}
    for i, t in rows:
        found = [(m.start(), n, kind, m.end()) for n, (kind, p) in enumerate(KINDS) for m in re.finditer(p, t or "") if len(m[1]) >= LEAST[kind]]
        base = [f"{k}:{a}:{b}" for a, _, k, b in sorted(found)]
        r = got[i]
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == kind for _, _, k, _ in found) for kind, _ in KINDS)
        spans = r.spans.split(",") if r.spans else []
        assert [s for s in spans if not s.startswith("mixed")] == base
        assert len(spans) == len(r.owners.split(",") if r.owners else []) == len(r.repos.split(",") if r.repos else [])
        assert [int(s.split(":")[1]) for s in spans] == sorted(int(s.split(":")[1]) for s in spans)


def test_op2_repositories_make_an_example(spark):
    docs = spark.createDataFrame([(i, "token = 'aB3dE5fG7hJ9'", "one owner", f"r{i % n}") for i, n in enumerate([3] * 3)], "doc_id long, text string, source string, lang string")
    from lexitide.llm.secrets import scan_secrets

    assert {(s["class"], s.n_owners, s.n_repos) for r in scan_secrets(docs).collect() for s in r.spans} == {("example", 1, 3)}
    assert {s["class"] for r in scan_secrets(docs.limit(2)).collect() for s in r.spans} == {"live"}


def test_op3_through_its_query(spark, corpus):
    import public_tokenizers

    path, rows = corpus
    scores = dict(token_count.zipf_vocabulary(public_tokenizers.path("piece_bpe_32k.model")))
    longest, lost = max(map(len, scores)), min(scores.values()) - 10

    def best(word):
        """(score, pieces, ends in an unknown character) at each position."""
        at = [(0.0, 0, False)]
        for end in range(1, len(word) + 1):
            top = None
            for start in range(max(0, end - longest), end):
                if (piece := word[start:end]) in scores and (top is None or at[start][0] + scores[piece] > top[0]):
                    top = (at[start][0] + scores[piece], at[start][1] + 1, False)
            if word[end - 1] not in scores and (top is None or at[end - 1][0] + lost > top[0]):
                top = (at[end - 1][0] + lost, at[end - 1][1] + (not at[end - 1][2]), True)
            at.append(top)
        return at[-1]

    known = {}
    for r in queries.op3_token_counts(spark, path).collect():
        t = dict(rows)[r.doc_id]
        parts = [] if not t else t.removeprefix(" ").split(" ")
        for w in parts:
            known.setdefault(w, best("▁" + w))
        assert (r.n_words, r.n_tokens) == (len(parts), sum(known[w][1] for w in parts))
        assert r.best_score == pytest.approx(sum(known[w][0] for w in parts), abs=1e-5)


def test_op6_through_its_query(spark, corpus):
    import public_tokenizers
    from tokenizers import Tokenizer

    path, rows = corpus
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    own, sequences = defaultdict(list), defaultdict(list)
    for p in queries.op6_packing(spark, path).collect():
        own[p.doc_id].append(p)
        sequences[p.sequence_id].append((p.offset, p.length))
    for i, t in rows:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4")
        at = 0
        for p in sorted(own[i], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    for held in sequences.values():
        held.sort()
        assert all(o == sum(n for _, n in held[:j]) for j, (o, _) in enumerate(held)) and sum(n for _, n in held) <= 2048
    assert set(sequences) == set(range(len(sequences)))


def test_encoder_agrees_on_runs():
    import public_tokenizers
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    fast = packing.encoder(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    for c in [*map(chr, range(1, 128)), "é", "ß", packing.LAST_FAST]:
        for n in (7, 300):
            t = c * n + " a" + c * n + "\n" + (c + " ") * n
            assert slow.encode(t, add_special_tokens=False).ids == fast(t).tolist()
    for t in ("a" * 20_000, " " * 20_000, "\n" * 20_000, "=" * 20_000, "ab1 " * 20_000, "aé" * 10_000):
        assert slow.encode(t, add_special_tokens=False).ids == fast(t).tolist()


def least_capacity(sizes, shards):
    best = [0] + [math.inf] * len(sizes)
    total = [0, *np.cumsum(sizes).tolist()]
    for _ in range(shards):
        best = [0] + [min(max(best[j], total[i] - total[j]) for j in range(i)) for i in range(1, len(sizes) + 1)]
    return best[-1]


@pytest.mark.parametrize(("shards", "bits", "split"), [(24, 13, 6), (5, 1, 1), (7, 2, 3)])
def test_op10_capacity_is_that_of_the_groups(spark, corpus, shards, bits, split):
    path, rows = corpus
    docs = queries.table(spark, path, "documents")
    got = (queries.op10_sharding(spark, path) if shards == 24 else sharding.shard_groups(docs, shards=shards, bin_bits=bits, split_bits=split)).collect()
    keys = {r.doc_id: r.u for r in docs.select("doc_id", F.shiftrightunsigned(F.xxhash64(F.coalesce("text", F.lit(""))), 1).alias("u")).collect()}
    groups, filled, slots = Counter(), Counter(), defaultdict(list)
    for r in got:
        assert r.size == len((dict(rows)[r.doc_id] or "").encode()) + 8 and r.law == "bytes" and r.grown_shard is None
        groups[keys[r.doc_id]] += r.size
        filled[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert max(filled.values()) <= least_capacity([groups[u] for u in sorted(groups)], shards)
    assert set(slots) <= set(range(shards)) and all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert len({(keys[r.doc_id], r.shard) for r in got}) == len(groups)


def test_cells_settle_on_the_exact_capacity():
    rng = np.random.default_rng(5)
    for trial in range(40):
        groups = {int(u): int(s) for u, s in zip(rng.integers(0, 2**63, int(rng.integers(1, 150)), dtype=np.uint64), rng.integers(1, 400, 150), strict=False)}
        if trial % 4 == 0:
            groups[int(rng.integers(0, 2**62))] = sum(groups.values()) // 2 + 1
        shards, split = int(rng.integers(1, 12)), int(rng.integers(1, 4))

        def cells(keys, bits):
            held = defaultdict(list)
            for u in keys:
                held[u >> (63 - bits)].append(u)
            return [sharding.Cell(i << (63 - bits), bits, sum(groups[u] for u in v), len(v) == 1) for i, v in sorted(held.items())]

        now = cells(groups, 2)
        while at := sharding.unsettled(now, shards):
            parts = [x for i in at for x in cells([u for u in groups if u >> (63 - now[i].bits) == now[i].key >> (63 - now[i].bits)], min(63, now[i].bits + split))]
            now = sorted([c for i, c in enumerate(now) if i not in set(at)] + parts, key=lambda c: c.key)
        assert sharding.minimax_capacity([c.size for c in now], shards) == least_capacity([groups[u] for u in sorted(groups)], shards)


def test_op8_fit_equals_direct_normal_equations(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(120, quality_model.N_STATS))
    y = (x[:, 0] + 0.3 * rng.normal(size=120) > 0).astype(int)
    rows = spark.createDataFrame([(i, r.tolist(), int(v)) for i, (r, v) in enumerate(zip(x, y, strict=True))], "rk long, x array<double>, y int")
    model = quality_model.fit(rows, features=24, ridge=0.3)
    assert np.allclose(model.mean, x.mean(axis=0)) and np.allclose(model.scale, x.std(axis=0))
    z = np.concatenate([np.cos(np.clip((x - x.mean(0)) / x.std(0), -6, 6) @ model.w + model.phase) * np.sqrt(2 / 24), np.ones((120, 1))], axis=1)
    penalty = np.diag([0.3] * 24 + [0.0]) + 1e-9 * np.eye(25)
    assert np.allclose(model.beta, np.linalg.solve(z.T @ z + penalty, z.T @ y), atol=1e-6)
    score = model.score(x)
    assert ((score >= 0.5) == (y == 1)).mean() > 0.7 and (np.diff(score[np.argsort(model.raw(x))]) >= -1e-12).all()


def test_random_features_approximate_the_kernel():
    rng = np.random.default_rng(0)
    x, width, n = rng.normal(size=(30, quality_model.N_STATS)), 3.0, 20_000
    w, phase = rng.normal(size=(quality_model.N_STATS, n)) / width, rng.uniform(0, 2 * np.pi, n)
    z = quality_model.Model(np.zeros(16), np.ones(16), w, phase, np.zeros(n + 1), np.zeros(1), np.zeros(1)).features(x)[:, :-1]
    real = np.exp(-((x[:, None] - x[None]) ** 2).sum(axis=2) / (2 * width**2))
    assert np.abs(z @ z.T - real).max() < 0.05


def test_isotonic_equals_the_min_max_formula():
    rng = np.random.default_rng(6)
    for n in (1, 2, 7, 30):
        score, label = rng.permutation(n).astype(float), rng.integers(0, 2, n)
        knots, levels = quality_model.isotonic(score, label)
        y = label[np.argsort(score)]
        want = [max(min(y[j : k + 1].mean() for k in range(i, n)) for j in range(i + 1)) for i in range(n)]
        runs = [w for i, w in enumerate(want) if i == 0 or w != want[i - 1]]
        assert np.allclose(levels, runs) and (np.diff(knots) > 0).all()


def test_op8_with_one_class_and_through_its_query(spark, corpus, tmp_path):
    path, rows = corpus
    docs = queries.table(spark, path, "documents")
    one = spark.createDataFrame([(i, 1) for i in range(40)], "doc_id long, quality int")
    assert {round(r.score, 6) for r in quality_model.score_ids(docs, one).collect()} == {1.0}
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2) for i in range(80)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.doc_id: r for r in queries.op8_quality_classifier(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    flipped = spark.createDataFrame([(i, i % 2 if zlib.crc32(str(i).encode()) % 5 else 1 - i % 2) for i in range(80)], "doc_id long, quality int")
    remainder = F.crc32(F.col("id").cast("string").cast("binary")) % 5
    again = {r.doc_id: r.score for r in quality_model.score_ids(docs, flipped, learn=remainder != 0).collect()}
    assert again == {i: r.score for i, r in got.items()}  # held-out labels are not learnt


PUNCT = "".join(map(chr, [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]))


def brute_tokens(text):
    """(template code, lowered word) of each token, and the token numbers of each line."""
    out, lines, opens = [], [], True
    for line in (text or "").split("\n"):
        own, opens = [], True
        for raw in words(line):
            bare = raw.strip(PUNCT)
            if bare:
                low = bare.lower()
                code = low
                if len(bare) > 1 and "A" <= bare[0] <= "Z" and "a" <= bare[1] <= "z" and not opens:
                    code = "<name>"
                if low in decontaminate.UNITS:
                    code = "<unit>"
                if low[0].isdigit() and low[0].isascii():
                    code = "<number>"
                own.append(len(out))
                out.append((code, low))
            opens = raw[-1] in ".!?:"
        lines.append(own)
    return out, lines


def brute_leak(doc, item, k=5, literals=3, coverage=0.8, run_words=13):
    """(covered, exact) if the document is contaminated by the item."""
    (a, _), (d, lines) = brute_tokens(item), brute_tokens(doc)
    if not a:
        return None
    if len(a) < k:
        units = [[d[i] for i in line] for line in lines] + [d]
        return (1.0, True) if [w for _, w in a] in [[w for _, w in u] for u in units] else None
    plain = lambda i: sum(c[0] != "<" for c, _ in a[i : i + k])
    spots = range(len(a) - k + 1)
    usable = {i for i in spots if plain(i) >= literals}
    lined = defaultdict(dict)
    for j in range(len(d) - k + 1):
        for i in spots:
            by_words = [w for _, w in a[i : i + k]] == [w for _, w in d[j : j + k]] and (plain(i) < k)
            by_template = i in usable and [c for c, _ in a[i : i + k]] == [c for c, _ in d[j : j + k]]
            if by_words or by_template:
                pairs = {(a[i + x][1], d[j + x][1]) for x in range(k) if a[i + x][0][0] == "<"}
                lined[j - i].setdefault(i, set()).update(pairs)
    covered, best, exact = set(), 0, True
    for at in lined.values():
        pairs = set().union(*at.values())
        if len(pairs) != len({x for x, _ in pairs}):
            kept = {i for i, p in at.items() if all(x == y for x, y in p)}
        else:
            kept = set(at)
        if not kept:
            continue
        covered |= kept
        exact &= all(x == y for x, y in pairs)
        run = 0
        for i in spots:
            run = run + 1 if i in kept else 0
            best = max(best, run)
    share = max(len(covered) / len(spots), len(covered & usable) / len(usable) if usable else 0)
    return (share, exact) if covered and (share >= coverage or best + k - 1 >= run_words) else None


def test_op5_matches_brute_force(spark, tmp_path):
    rng = np.random.default_rng(8)
    names, plain_ = ["Alice", "Bob", "Carol", "Dave"], ["has", "gives", "apples", "how", "many", "then", "walks", "reads", "home", "books", "km", "days", "of", "the"]

    def sentence(n):
        return " ".join(str(rng.choice(names)) if rng.random() < 0.2 else str(rng.integers(1, 60)) if rng.random() < 0.2 else str(rng.choice(plain_)) for _ in range(n))

    phrase = "this phrase is in every item and text"
    items = [(i, sentence(int(rng.integers(6, 40))) + ("? " + phrase + "." if i % 2 else ".")) for i in range(30)]
    items += [(40, "too short"), (41, "Yes"), (42, ""), (43, items[0][1]), (44, items[3][1].replace("Alice", "Bob"))]
    texts = []
    for i in range(120):
        own = str(items[int(rng.integers(30))][1]).split(" ")
        kind = i % 6
        if kind == 0:
            own = [str(rng.integers(1, 60)) if w.isdigit() else w for w in own]
        elif kind == 1:
            own = own[int(rng.integers(0, 4)) :]
        elif kind == 2:
            own[int(rng.integers(len(own)))] = "other"
        elif kind == 3:
            own = own[: int(rng.integers(8, 16))]
        elif kind == 4:
            own = sentence(30).split(" ")
        texts.append(f"{sentence(5)}. {' '.join(own)} {sentence(4)} {phrase if i % 3 else ''}")
    texts += ["so\nToo short!\nend", "it is too short for that", "yes", "Yes, yes", "", None, phrase]
    docs = table(spark, list(enumerate(texts)))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: (r.contaminated, r.n_items, r.item_ids, r.covered, r.exact) for r in queries.op5_decontamination(spark, str(tmp_path)).collect()}
    hit = 0
    for i, t in enumerate(texts):
        found = {j: x for j, item in items if (x := brute_leak(t, item))}
        hit += bool(found)
        want = (bool(found), len(found), ",".join(map(str, sorted(found))), round(max((c for c, _ in found.values()), default=0.0), 4), any(e for _, e in found.values()))
        assert got[i] == want, (i, t)
    assert 40 < hit < 120 and got[120][2] == "40" and got[121][0] is False and got[122][2] == "41" and got[123][0] is False


def test_op5_common_phrases_pair_nobody(spark):
    """A phrase that every item and text holds finds no candidates: probes are other windows."""
    phrase = "one phrase that all of them hold"
    items = spark.createDataFrame([(i, " ".join(f"item{i}x{j}" for j in range(12)) + " " + phrase) for i in range(300)], "item_id long, text string")
    docs = table(spark, [(i, " ".join(f"doc{i}x{j}" for j in range(9)) + " " + phrase) for i in range(300)])
    assert decontaminate.find_leaks(docs, items).count() == 0
    assert decontaminate.judge_documents(docs, items).filter("contaminated").count() == 0


def test_op4_matches_brute_force_on_a_thousand(spark, tmp_path):
    rng = np.random.default_rng(4)
    vocabulary = [f"w{i}" for i in range(2000)]
    base = [list(rng.choice(vocabulary, 60)) for _ in range(60)]
    rows = []
    for i in range(1000):
        own = list(base[0 if i % 3 == 0 else int(rng.integers(60))])
        for _ in range(int(rng.integers(0, 4))):
            own[int(rng.integers(60))] = str(rng.choice(vocabulary))
        rows.append((i, " ".join(own)))
    table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    want = brute_groups(rows, 3, 85)
    got = {r.doc_id: r for r in queries.op4_near_dup(spark, str(tmp_path)).collect()}
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == want and all(r.kept == (i == r.component_id) for i, r in got.items())
    again = near_dup.near_duplicates(queries.table(spark, str(tmp_path), "documents"), k=3, percent=85, block=8).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in again} == want


def test_rows_that_share_an_id_are_grouped_by_themselves(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(1, a), (1, b), (2, b + " more"), (3, c), (3, c), (4, a + " end"), (None, c), (None, a)]
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in near_dup.near_duplicates(table(spark, rows)).collect())
    assert got == Counter({(1, 36, 1): 2, (2, 37, 1): 1, (3, 36, 3): 2, (4, 37, 1): 1, (None, 36, 3): 1, (None, 36, 1): 1})
    groups = {(r.id, r.n, r.group) for r in near_dup.near_groups(table(spark, rows)).collect() if r.id in (1, 2, 4)}
    assert len({g for _, _, g in groups}) == 2  # texts a and b are apart, though they share an id
    kept = Counter((r.doc_id, r.text) for r in near_dup.keep_one(table(spark, rows)).collect())
    assert kept == Counter({(1, a): 1, (1, b): 1, (3, c): 1, (None, c): 1, (None, a): 1})


@pytest.mark.parametrize("as_table", [False, True])
def test_op7_rules_by_join(spark, as_table):
    urls = ["https://WWW.Example.com/en/1?x", "http://a.example.com/en", "http://notexample.com/en/", "http://x.net/es/1", "http://x.net/espana", "http://x.net/fr", "http://com#a/b", "http://b.org?q=/x", "no host", None, "http:///en/", "http://x.net/es/1", "http://user@x.net:80/es/", "http://..com/a", "http://com/"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)] + [(100 + i, f"http://h{i}.com/p/{i}") for i in range(200)], "page_id long, url string")
    rules = [*RULES, ("block", "NET", "/es/"), ("allow", "com", "/p/1"), ("block", "com", "/p/1"), ("allow", "", "/")]
    plain = {r.page_id: tuple(r) for r in url_filter.judge_urls(pages, rules).collect()}
    given = spark.createDataFrame(rules, "verdict string, host string, path string") if as_table else rules
    assert {r.page_id: tuple(r) for r in url_filter.judge_urls(pages, given, max_rules=2).collect()} == plain
    assert url_filter.judge_urls(pages, spark.createDataFrame([], "verdict string, host string, path string")).count() == len(plain)


def test_joins_that_deal_hot_keys(spark):
    left = spark.createDataFrame([(7 if i % 2 else i, i) for i in range(4000)], "k long, v long")
    right = spark.createDataFrame([(i, i * 10) for i in range(0, 3000, 3)] + [(7, 70), (7, 71)], "k long, w long")
    assert hot_buckets(left.select(F.xxhash64("k"))).filter("__bucket >= 0").count() == 1
    for how in ("inner", "left"):
        got, want = spread_join(left, right, ["k"], ["v"], how=how), left.join(right, "k", how)
        assert sorted(map(tuple, got.select("k", "v", "w").collect()), key=str) == sorted(map(tuple, want.select("k", "v", "w").collect()), key=str)
    some, rest = split_by_key(left, F.xxhash64("v"), left.filter("v % 5 = 0").select(F.xxhash64("v")))
    assert some.filter("v % 5 = 0").count() == 800 and some.count() + rest.count() == 4000 and rest.count() > 3100
    docs = table(spark, [(i, f"t{i % 50}") for i in range(100)] + [(None, None)])
    lost = docs.filter("doc_id % 3 = 0 or doc_id is null").select(row_key(F.col("doc_id"), F.col("text")).alias("rk"))
    kept = without_rows(docs, row_key(F.col("doc_id"), F.col("text")), lost)
    assert sorted(r.doc_id for r in kept.collect()) == [i for i in range(100) if i % 3] and kept.columns == docs.columns


def test_plans_hold_hot_tables_and_not_their_making(spark):
    left = spark.createDataFrame([(7 if i % 2 else i, i) for i in range(4000)], "k long, v long")
    right = spark.createDataFrame([(i, i * 10) for i in range(50)], "k long, w long")
    plan = spread_join(left, right, ["k"], ["v"])._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "subquery" not in plan and "LocalRelation" in plan
    none = hot_buckets(spark.createDataFrame([], "h long"))
    assert [tuple(r) for r in none.collect()] == [(-1, 1)] and none.dtypes == [("__bucket", "int"), ("__salts", "int")]


def test_near_dup_keeps_few_plan_metrics_on_the_driver(spark):
    text = " ".join(f"w{i}" for i in range(200))
    rows = [(1, text), (1, text), (3, text + " more"), (3, text + " more"), (4, None), (4, None), (5, "other words that stand alone")]
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    assert sorted(r.doc_id for r in near_dup.keep_one(table(spark, rows)).collect()) == [1, 4, 4, 5]
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    done = [store.executionsList().apply(i) for i in range(before, store.executionsCount())]
    # Each round of adaptive execution adds the metrics of its plan again: 4,477 in one query where plans made their hot tables.
    assert max(x.metrics().size() for x in done) < 3000


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, h int, rk string, pos int, kept boolean"


def folder(spark, path, rows, labels, items):
    spark.createDataFrame([(i, t, "en", None, len(t or ""), "x", 1, "r", 2, True) for i, t in rows], SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_pipeline_stages_match_brute_force(spark, tmp_path):
    """Each stage on all that its predecessor kept, run() the same in one go."""
    rng = np.random.default_rng(9)
    vocabulary = [f"word{i}" for i in range(400)] + ["the", "of", "and", "in"] * 30
    prose = lambda n: " ".join(rng.choice(vocabulary, n)) + "."
    items = [(i, prose(25)) for i in range(3)]
    rows = [(i, prose(70) + "\nA closing line that many share.") for i in range(50)]
    rows += [(100 + i, " ".join(x.upper() + "!! |" for x in rng.choice(vocabulary, 60))) for i in range(40)]
    rows += [(200 + i, rows[i][1].replace(".", ". more words", 1)) for i in range(10)] + [(300 + i, prose(40) + " " + items[i][1] + " " + prose(30)) for i in range(3)]
    rows += [(400, rows[0][1]), (401, "\n".join(prose(9) for _ in range(4000)))] + [(500 + i, t) for i, (_, t) in enumerate(EDGE[:3])]
    path = folder(spark, tmp_path, rows, [(i, int(i < 100), 0) for i, _ in rows if i % 3], items)
    docs, kept = spark.read.parquet(f"{path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        before = [(r.doc_id, r.text) for r in docs.collect()]
        out = stage(spark, docs, path)
        out.write.parquet(f"{tmp_path}/{name}")
        out = spark.read.parquet(f"{tmp_path}/{name}")
        after = [(r.doc_id, r.text) for r in out.collect()] if name != "pack" else []
        if name == "quality":
            score = {r.doc_id: r.score for r in quality_model.score_ids(docs, spark.read.parquet(f"{path}/labels.parquet")).collect()}
            assert sorted(after, key=str) == sorted(((i, t) for i, t in before if score[i] >= 0.3), key=str) and not {i for i, _ in after} & set(range(100, 140))
        if name == "line_dedup":
            want = brute_lines(before)
            assert {i: hashlib.sha256((t or "").encode()).hexdigest() for i, t in after} == {i: x[2] for i, x in want.items()}
        if name == "near_dup":
            group = brute_groups(before, 5, 80)
            assert sorted(after, key=str) == sorted(((i, t) for i, t in before if group[i][1] == i), key=str)
        if name == "decontaminate":
            assert sorted(after, key=str) == sorted(((i, t) for i, t in before if not any(brute_leak(t, x) for _, x in items)), key=str)
            assert not {i for i, _ in after} & {300, 301, 302}
        if name != "pack":
            assert out.columns == docs.columns
            kept[name] = {i for i, _ in after}
        docs = out
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = defaultdict(list)
    for p in docs.collect():
        pieces[p.doc_id].append((p.start, p.ids))
    for i, t in before:
        assert np.frombuffer(b"".join(x for _, x in sorted(pieces[i])), "<u4").tolist() == [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
    columns = ["doc_id", "start", "length", "ids_crc32", "sequence_id", "offset"]
    whole = corpus_pipeline.run(spark, path)
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32) for r in whole.collect()) == Counter((r.doc_id, r.start, r.length, r.ids_crc32) for r in docs.select(*columns).collect())


def test_pipeline_at_the_edges(spark, tmp_path):
    empty = folder(spark, tmp_path / "empty", [], [], [])
    assert corpus_pipeline.run(spark, empty).collect() == []
    odd = folder(spark, tmp_path / "odd", [*EDGE, (None, None), (None, "")], [(None, 1, 0), (4, None, 0)], [(None, "x"), (1, None)])
    out = corpus_pipeline.run(spark, odd).collect()
    # Without a usable label every score is 0.5. Of the two rows with id 4 one stays; 5 has lost its line and is empty.
    assert Counter(r.doc_id for r in out if r.start == 0) == Counter({1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 1, 7: 1, 8: 1, 9: 1, None: 3})
