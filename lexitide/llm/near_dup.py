"""Operator 4: near-duplicate grouping by SuperMinHash, banding, verification and union-find.

A document's set holds its distinct k-word shingles (words `[^\\x20\\x09-\\x0D]+`, A-Z lower-cased) as 64-bit
hashes. Documents with equal sets form a class at once, and its smallest id stands for it from then on. A
SuperMinHash signature of each class is cut into bands, and the smallest id of each band's bucket is its pivot.
Members are verified against their pivots on full sets; a large group of copies is linked by one test per member.
Groups come from distributed star contraction: each node hangs itself under the smallest node it sees, as union-find does.

Two members may be linked although one of them misses the pivot. A member of a pivot goes on only while it may have
such a partner in another group: Jaccard distance is a metric, so partners' distances to the pivot differ by no more
than the threshold's. What stays is dealt into blocks of about `block` documents by a hash, and two blocks meet in one
bounded group, where a matrix product over shared shingles gives every intersection size exactly; what leaves it is a
spanning forest of the links found, never the pairs. The members of a pivot's largest group meet the others only. Where
the others fill more than one block, members without a rare shingle in common with another group drop out first (a
prefix filter), so that texts which merely follow one template cost time in proportion to their number. No bucket is
capped, and no link is lost beyond the chance of the bands. Keys that very many rows share are dealt over several tasks.

With 40 bands of 6 the chance that a pair at similarity 0.85 shares no bucket is about 6e-9, at 0.8 5e-6.

Edge cases: a null or empty text, or one of spaces only, has no shingles and stands alone; with fewer than k
words the whole sequence is one shingle; repeated rows share a class; a null id counts as the largest id and
comes back as null; where rows share an id each text is compared and grouped by itself; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexitide.llm.common import bitmap_of, in_bitmap, row_key, split_by_key, spread_join, without_rows, written
from lexitide.llm.textvec import chunks, mix, shingle_sets, words_of

LAST_ID = 2**63 - 1
BITMAP_BITS = 26
_STEP = np.uint64(0x9E3779B97F4A7C15)


def super_minhash(hashes: np.ndarray, first: np.ndarray, m: int, most: int = 1 << 15) -> np.ndarray:
    """Signatures (texts x m): the minimum over elements of j + r_j at slot p_j, with p a random permutation and
    r_j uniform, both from the element's hash. Elements are taken `most` at a time, as permutations need m bytes or more
    for each of them; a text's minimum is carried on, so its signature is the same however it is cut. Empty texts keep inf."""
    docs = len(first) - 1
    out = np.full((docs, m), np.inf)
    doc = np.repeat(np.arange(docs), np.diff(first))
    for low in range(0, len(hashes), most):
        own = doc[low : low + most]
        _lower(out[own[0] : own[-1] + 1], hashes[low : low + most], own - own[0])
    return out


def _lower(out: np.ndarray, hashes: np.ndarray, doc: np.ndarray) -> None:
    """Lowers signatures, in place, by elements and the text of each. Rank j is drawn for all elements of a text at once,
    and a text stops when every slot is below the next rank."""
    m = out.shape[1]
    state = None
    for j in range(m):
        x = mix(hashes + np.uint64(int(_STEP) * (2 * j + 1) % 2**64))
        r = (x >> np.uint64(11)).astype(np.float64) * 2.0**-53 + j
        k = j + (mix(x + _STEP) % np.uint64(m - j)).astype(np.int64)
        if j == 0:
            slot = k
        else:
            rows = np.arange(len(hashes))
            slot = state[rows, k].astype(np.int64)
            state[rows, k] = state[:, j]
        np.minimum.at(out, (doc, slot), r)
        live = out.max(axis=1) >= j + 1
        go_on = live[doc]
        if not go_on.any():
            break
        if j == 0:
            kept = k[go_on]
            state = np.tile(np.arange(m, dtype=np.uint8 if m <= 256 else np.uint16), (len(kept), 1))
            state[np.arange(len(kept)), kept] = 0
        else:
            state = state[go_on]
        hashes, doc = hashes[go_on], doc[go_on]


def band_keys(signatures: np.ndarray, bands: int) -> np.ndarray:
    docs, m = signatures.shape
    bits = np.ascontiguousarray(signatures).view(np.uint64).reshape(docs, bands, m // bands)
    keys = np.tile(np.arange(1, bands + 1, dtype=np.uint64) * _STEP, (docs, 1))
    for i in range(m // bands):
        keys = mix(keys + bits[:, :, i]) * _STEP
    return mix(keys)


def _lists(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values.view(np.int64)))


def _prints(sets: np.ndarray, first: np.ndarray) -> list[pa.Array]:
    """Two 64-bit fingerprints of each set."""
    out = []
    for seed in (11, 13):
        s = np.zeros(len(sets) + 1, dtype=np.uint64)
        np.cumsum(mix(sets + np.uint64(seed)), out=s[1:])
        out.append(pa.array(mix(s[first[1:]] - s[first[:-1]]).view(np.int64)))
    return out


def _sketcher(k: int, bands: int, rows: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in chunks(batch.column(1)):
                part = batch.slice(a, b - a)
                sets, first = shingle_sets(words_of(part.column(1)), k)
                n = np.diff(first)
                some = n > 0
                keys = band_keys(super_minhash(sets, first, bands * rows), bands)[some]
                lists = _lists(keys.reshape(-1), np.concatenate([[0], np.cumsum(np.where(some, bands, 0))]))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(n.astype(np.int64)), *_prints(sets, first), lists], names=["id", "rk", "n", "f1", "f2", "bands"])

    return run


def _setter(k: int, wanted: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(in_bitmap(wanted.value, batch.column(2).to_numpy(), BITMAP_BITS)))
            for a, b in chunks(batch.column(1)):
                part = batch.slice(a, b - a)
                sets, first = shingle_sets(words_of(part.column(1)), k)
                yield pa.RecordBatch.from_arrays([part.column(0), *_prints(sets, first), _lists(sets, first)], names=["id", "f1", "f2", "s"])

    return run


def _settled(edges: DataFrame) -> bool:
    """Whether each node hangs under one node, which hangs under none: then that is its group's smallest."""
    ends = edges.select(F.col("u").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("id"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up + down > 1").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(u, v) links of ids -> (id, c): each linked id with the smallest id that it reaches.

    Alternating large-star and small-star contraction; every step works by grouped minima and joins, so a node
    with very many links is never gathered anywhere. One table is written a round, and none where links are stars."""
    edges = written(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    while not _settled(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        edges = written(small.distinct(), "stars")
    return edges.select(F.col("u").alias("id"), F.col("v").alias("c"))


def _forest(percent: int) -> Callable[[pa.Table], pa.Table]:
    """Links between the groups c of members (c, s), as a spanning forest."""

    def run(group: pa.Table) -> pa.Table:
        ids = group.column("c").to_numpy()
        lists = group.column("s").combine_chunks()
        n = np.diff(lists.offsets.to_numpy()).astype(np.int64)
        row = np.repeat(np.arange(len(ids)), n)
        _, code, seen = np.unique(lists.flatten().to_numpy(), return_inverse=True, return_counts=True)
        shared = seen[code] > 1
        row, code = row[shared], code[shared]
        names = np.cumsum(seen > 1) - 1
        code = names[code]
        order = np.argsort(code, kind="stable")
        row, code = row[order], code[order]
        common = np.zeros((len(ids), len(ids)), dtype=np.float32)
        width = 2048
        for low in range(0, int(code[-1]) + 1 if len(code) else 0, width):
            a, b = np.searchsorted(code, [low, low + width])
            part = np.zeros((len(ids), width), dtype=np.float32)
            part[row[a:b], code[a:b] - low] = 1
            part = part[:, : int(code[b - 1]) - low + 1] if b > a else part[:, :0]
            common += part @ part.T  # whole numbers below 2**24: exact
        linked = 100 * common.astype(np.int64) >= percent * (n[:, None] + n[None, :] - common.astype(np.int64))
        linked &= ids[:, None] != ids[None, :]
        root = {i: i for i in ids.tolist()}

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        u, v = [], []
        for i, j in zip(*(x.tolist() for x in np.nonzero(np.triu(linked, 1))), strict=True):
            a, b = find(int(ids[i])), find(int(ids[j]))
            if a != b:
                root[max(a, b)] = min(a, b)
                u.append(a)
                v.append(b)
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return run


def _members(tested: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """(p, u, c, n) of members of a pivot that may have a partner in another group c, by their distance to the pivot."""
    width = (100 - percent) / 100 * 1.0001 + 1e-6  # partners are at most one bin apart
    rows = tested.join(groups.select(F.col("id").alias("u"), "c"), "u", "left")
    rows = written(rows.select("p", "u", "n", F.coalesce("c", "u").alias("c"), F.floor((1 - F.col("j")) / width).cast("int").alias("bin")), "members")
    bins = rows.groupBy("p", "bin").agg(F.min("c").alias("lo"), F.max("c").alias("hi"))
    near = bins.withColumn("bin", F.explode(F.array(*(F.col("bin") + i for i in (-1, 0, 1))))).groupBy("p", "bin").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).filter("lo <> hi")
    return written(spread_join(rows, near.select("p", "bin"), ["p", "bin"], ["u"]).select("p", "u", "c", "n"), "near-members")


def _sizes(members: DataFrame, block: int) -> DataFrame:
    """Per pivot its largest group `main`, and blocks for its members (n_main) and for the others (n_odd), bounded in
    documents and in shingles."""
    by_group = members.groupBy("p", "c").agg(F.count("*").alias("of"), F.sum("n").alias("size"))
    by_pivot = by_group.groupBy("p").agg(F.max_by("c", F.struct("of", "c")).alias("main"), F.sum("of").alias("of"), F.sum("size").alias("size"), F.max(F.struct("of", "c", "size")).alias("m"))
    blocks = lambda of, size: F.ceil(F.greatest(of / block, size / (1000 * block))).cast("int")
    n_odd, n_all = blocks(F.col("of") - F.col("m.of"), F.col("size") - F.col("m.size")), blocks(F.col("of"), F.col("size"))
    return by_pivot.select("p", "main", F.when(n_all > 1, blocks(F.col("m.of"), F.col("m.size"))).otherwise(0).alias("n_main"), F.greatest(n_odd, F.lit(1)).alias("n_odd"))


def _with_rare_partner(members: DataFrame, sets: DataFrame, percent: int, sample: int = 64, most: int = 4096) -> DataFrame:
    """Members that share a shingle of their prefix with a member of another group, as near enough sets must.

    A prefix holds the first shingles of a set by some order that all members of a pivot share, as many as leave too few
    for a partner. Any order is exact; this one puts shingles last that are frequent among about `sample` members of the
    pivot, so that what all members have in common joins nobody."""
    of = members.groupBy("p").agg(F.count("*").alias("of"))
    some = spread_join(members, of, ["p"], ["u"]).filter(F.pmod(F.xxhash64("u", F.lit(9)), F.ceil(F.col("of") / sample)) == 0)
    full = sets.select(F.col("node").alias("u"), "s")
    seen = some.join(full, "u").select("p", F.explode("s").alias("x")).groupBy("p", "x").agg(F.count("*").alias("f")).filter("f > 1")
    order = seen.groupBy("p").agg(F.slice(F.sort_array(F.collect_list(F.struct("f", "x")), asc=False), 1, most).alias("fx")).select("p", F.transform(F.sort_array("fx"), lambda y: y["x"]).alias("last"))
    own = spread_join(members, order, ["p"], ["u"], how="left").join(full, "u").withColumn("last", F.coalesce("last", F.expr("cast(array() as array<long>)")))
    length = (F.col("n") - F.ceil(F.col("n") * percent / 100) + 1).cast("int")
    prefix = F.slice(F.concat(F.array_sort(F.array_except("s", "last")), F.array_intersect("last", "s")), F.lit(1), length)
    rows = written(own.select("p", "u", "c", "n", F.explode(prefix).alias("x"), F.pmod(F.xxhash64("u", F.lit(2)), F.lit(16)).alias("salt")), "prefixes")
    shared = rows.groupBy("p", "x").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo <> hi")
    shared = shared.select("p", "x", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(15).cast("long"))).alias("salt"))
    return rows.join(shared, ["p", "x", "salt"], "left_semi").select("p", "u", "c", "n").distinct()


def _block_links(members: DataFrame, sets: DataFrame, percent: int, block: int) -> DataFrame:
    """Links (u, v) between groups of the members of a pivot. Members of its largest group meet the others only, so each
    is copied once for each block of others."""
    sizes = _sizes(members, block)
    dealt = spread_join(members, sizes, ["p"], ["u"]).withColumn("odd", (F.col("c") != F.col("main")) | (F.col("n_main") == 0))
    place = lambda n: F.pmod(F.xxhash64("u", F.lit(5)), F.greatest(n, F.lit(1))).cast("int")
    dealt = dealt.withColumn("own", F.when(F.col("odd"), place(F.col("n_odd"))).otherwise(F.col("n_odd") + place(F.col("n_main"))))
    last = F.when(F.col("odd"), F.col("n_odd") + F.col("n_main")).otherwise(F.col("n_odd")) - 1
    dealt = dealt.select("p", "u", "c", "own", F.explode(F.sequence(F.lit(0), last)).alias("other"))
    dealt = dealt.select("p", F.col("u").alias("node"), "c", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    return dealt.join(sets, "node").select("p", "i", "j", "c", "s").groupBy("p", "i", "j").applyInArrow(_forest(percent), "u long, v long")


def _named_nodes(classes: DataFrame) -> tuple[DataFrame, bool]:
    """classes with `node`: their id, or a hash where texts of one id form several classes; and whether there are such."""
    shared = classes.groupBy("id").agg(F.count("*").alias("of")).filter("of > 1").select("id")
    if shared.isEmpty():
        return classes.withColumn("node", F.col("id")), False
    some, rest = split_by_key(classes, F.xxhash64("id"), shared.select(F.xxhash64("id")))
    marked = spread_join(some, shared, ["id"], ["f1"]).withColumn("node", F.xxhash64("f1", "f2"))
    alone = some.join(shared, "id", "left_anti").unionByName(rest).withColumn("node", F.col("id"))
    return written(alone.unionByName(marked), "nodes"), True


def near_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80, bands: int = 40, rows: int = 6, block: int = 128) -> DataFrame:
    """Per row: rk (row_key), id (null as the largest), n, group (the same for rows of one group), c (its smallest id)."""
    text = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)).alias("id"), F.col(text_col).cast("string").alias("text"), row_key(F.col(id_col), F.col(text_col)).alias("rk"))
    sketch = written(text.mapInArrow(_sketcher(k, bands, rows), "id long, rk struct<a:long,b:long>, n long, f1 long, f2 long, bands array<long>"), "sketches")
    some = sketch.filter("n > 0")
    classes = written(some.groupBy("f1", "f2", "n").agg(F.min(F.struct("id", "bands")).alias("x")).select("f1", "f2", "n", "x.id", "x.bands"), "classes")
    classes, shared_ids = _named_nodes(classes)

    keys = classes.select(F.explode("bands").alias("b"), F.col("node").alias("u"))
    pivots = written(keys.groupBy("b").agg(F.min("u").alias("p"), F.max("u").alias("q")).filter("p <> q").select("b", "p"), "pivots")
    keys, _ = split_by_key(keys, F.col("b"), pivots.select("b"))
    pairs = written(spread_join(keys, pivots, ["b"], ["u"]).filter("u <> p").select("p", "u").distinct(), "pairs")

    # Full sets of documents that share a bucket.
    near = pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("p").alias("node"))).distinct()
    near = written(classes.select("node", "id", "f1", "f2", "n").join(near, "node", "left_semi"), "near")
    wanted = docs.sparkSession.sparkContext.broadcast(bitmap_of(near.select(F.xxhash64("id")), BITMAP_BITS))  # 8 MB
    sets = text.select("id", "text", F.xxhash64("id").alias("h")).mapInArrow(_setter(k, wanted), "id long, f1 long, f2 long, s array<long>")
    sets = written(sets.join(near, ["id", "f1", "f2"]).dropDuplicates(["id", "f1", "f2"]).select("node", "n", "s"), "sets")
    both = pairs.join(sets.select(F.col("node").alias("u"), "n", F.col("s").alias("su")), "u")
    both = spread_join(both, sets.select(F.col("node").alias("p"), F.col("s").alias("sp")), ["p"], ["u"], counted=pairs)
    both = both.withColumn("common", F.size(F.array_intersect("su", "sp"))).withColumn("union", F.col("n") + F.size("sp") - F.col("common"))
    tested = written(both.select("p", "u", "n", (F.col("common") / F.col("union")).alias("j"), (100 * F.col("common") >= percent * F.col("union")).alias("linked")), "compared")

    first = components(tested.filter("linked").select("u", F.col("p").alias("v")))
    members = _members(tested, first, percent)
    crowded = written(_sizes(members, block).filter("n_odd > 1").select("p"), "crowded")
    if not crowded.isEmpty():
        rare = _with_rare_partner(written(spread_join(members, crowded, ["p"], ["u"]), "crowd"), sets, percent)
        members = written(members.join(crowded, "p", "left_anti").unionByName(rare), "block-members")
    second = components(_block_links(members, sets.select("node", "s"), percent, block))
    named = classes.select("f1", "f2", "n", "id", "node").join(first.select(F.col("id").alias("node"), "c"), "node", "left").withColumn("c", F.coalesce("c", "node"))
    named = spread_join(named, second.select(F.col("id").alias("c"), F.col("c").alias("last")), ["c"], ["node"], counted=first.select("c"), how="left").withColumn("c", F.coalesce("last", "c")).drop("last")
    named = named.select("f1", "f2", "n", "id", F.col("c").alias("group"))
    smallest = F.col("group").alias("c")
    if shared_ids:
        named = written(named, "grouped")
        named = spread_join(named, named.groupBy("group").agg(F.min("id").alias("c")), ["group"], ["f1"])
        smallest = F.col("c")
    own = spread_join(sketch.filter("n > 0").select("rk", "id", "n", "f1", "f2"), named.select("f1", "f2", "n", "group", smallest), ["f1", "f2", "n"], ["rk"])
    bare = sketch.filter("n = 0").select("rk", "id", "n", F.xxhash64("rk").alias("group"), F.col("id").alias("c"))
    return own.select("rk", "id", "n", "group", "c").unionByName(bare)


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (the smallest doc_id reachable over links at percent or more). Options: near_groups."""
    null_if_last = lambda c: F.when(F.col(c) != LAST_ID, F.col(c))
    return near_groups(docs, **options).select(null_if_last("id").alias("doc_id"), F.col("n").alias("n_shingles"), null_if_last("c").alias("component_id"))


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with one row of each group: of its smallest id, and of several such rows one. Rows without words or
    without an id all stay."""
    groups = near_groups(docs, id_col=id_col, text_col=text_col, **options).filter((F.col("n") > 0) & (F.col("id") != LAST_ID))
    groups = written(groups.select("rk", "id", "group"), "near-groups")
    heads = groups.groupBy("group").agg(F.min(F.struct("id", "rk")).alias("head"))
    marked = spread_join(groups, heads, ["group"], ["rk"]).withColumn("first", F.col("rk") == F.col("head.rk"))
    by_row = marked.groupBy("rk").agg(F.min("first").alias("again"), F.count("*").alias("of"))  # equal rows are all first, or none
    gone = written(by_row.filter("not again or of > 1").select("rk", "again"), "near-lost")
    key = row_key(F.col(id_col), F.col(text_col))
    kept = without_rows(docs, key, gone.select("rk"))
    twice = gone.filter("again").select("rk")
    if twice.isEmpty():
        return kept
    some, _ = split_by_key(docs.withColumn("__rk", key), F.col("__rk.a"), twice.select("rk.a"))
    again = some.join(twice.select(F.col("rk").alias("__rk")), "__rk", "left_semi").dropDuplicates(["__rk"])
    return kept.unionByName(again.select(*docs.columns))
