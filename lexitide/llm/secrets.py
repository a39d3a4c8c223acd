"""Operator 2: secret scan with corpus-wide ownership frequency.

Candidates of a text: assignments to secret-like names, access ids, long hex runs, and long mixed tokens with
high entropy. Each candidate value is hashed and counted corpus-wide by distinct owners and distinct
(owner, repository) pairs. Values that `example_owners` owners or `example_repos` repositories hold are `example`s,
copied widely; other values that look live are `live`; the rest are `local`. Assignments, access ids and hex runs are spans in any case;
a mixed token becomes a span only if it is live.

Edge cases: a null or empty text has no spans; spans are in code points, end exclusive; very long texts are read
whole; rows repeated exactly share their spans; null owners and repositories count as one value each; a null id
is scanned like any other; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexitide.llm.common import row_key, spread_join, written
from lexitide.llm.textvec import chunks

#: Kinds in the order in which spans that start together are listed.
KINDS = ("assign", "access", "hex", "mixed")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_MIXED = re.compile(r"[A-Za-z0-9+/_=-]{24,}")
_PLACEHOLDER = re.compile(r"example|changeme|placeholder|your|dummy|sample|redacted|xxxx|1234567", re.IGNORECASE)


def entropy(value: str) -> float:
    """Bits a character."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def looks_live(kind: str, value: str) -> bool:
    """Random enough, long enough, and no placeholder."""
    if _PLACEHOLDER.search(value):
        return False
    if kind == "hex":
        return entropy(value) >= 2.5
    if kind == "mixed":
        classes = sum(bool(re.search(x, value)) for x in ("[a-z]", "[A-Z]", "[0-9]"))
        return classes == 3 and entropy(value) >= 3.5
    return len(value) >= 8 and entropy(value) >= 2.5


def candidates(text: str) -> list[tuple[int, int, int, str]]:
    """(kind, start, end, value) by start, then kind."""
    found = []
    low = text.encode().lower()  # ASCII letters only
    if any(name.encode() in low for name in _NAMES):
        found += [(0, m.start(), m.end(), m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(1, m.start(), m.end(), m[0]) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(2, m.start(), m.end(), m[0]) for m in _HEX.finditer(text)]
    found += [(3, m.start(), m.end(), m[0]) for m in _MIXED.finditer(text) if looks_live("mixed", m[0])]
    return sorted(found, key=lambda x: (x[1], x[0]))


_CANDIDATE = pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("hash", pa.int64()), ("live", pa.bool_())])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in chunks(batch.column(1), 1 << 22):
            part = batch.slice(a, b - a)
            found = [
                [{"kind": k, "start": s, "end": e, "hash": xxhash.xxh64_intdigest(v) - 2**63, "live": looks_live(KINDS[k], v)} for k, s, e, v in candidates(t)] if t else []
                for t in part.column(1).to_pylist()
            ]
            keep = [i for i in range(part.num_columns) if i != 1]
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in keep), pa.array(found, pa.list_(_CANDIDATE))], names=[*(part.schema.names[i] for i in keep), "found"])


def scan_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str | None = "lang", example_owners: int = 2, example_repos: int = 3) -> DataFrame:
    """Per row: doc_id and spans, an array of (kind, start, end, class, n_owners, n_repos) by start, then kind.

    repo_col names repositories within an owner; without it each owner is one repository."""
    as_text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c else F.lit("")
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), as_text(owner_col).alias("owner"), as_text(repo_col).alias("repo"), row_key(F.col(id_col), F.col(text_col)).alias("rk"))
    found = "array<struct<kind:int,start:long,end:long,hash:long,live:boolean>>"
    rows = written(rows.mapInArrow(_scan, f"doc_id {id_type}, owner string, repo string, rk struct<a:long,b:long>, found {found}"), "candidates")
    each = rows.filter(F.size("found") > 0).select("rk", "owner", "repo", F.explode("found").alias("f")).select("rk", "owner", "repo", "f.*")
    # One row per value, owner and repository first, so that a value that very many rows hold is summed where it lies.
    places = each.groupBy("hash", "owner", "repo").agg(F.lit(1).alias("one"))
    owners = places.groupBy("hash", "owner").agg(F.count("*").alias("repos"))
    values = owners.groupBy("hash").agg(F.count("*").alias("n_owners"), F.sum("repos").alias("n_repos"))
    kind = F.element_at(F.array(*(F.lit(k) for k in KINDS)), F.col("kind") + 1)
    label = F.when((F.col("n_owners") >= example_owners) | (F.col("n_repos") >= example_repos), "example").when(F.col("live"), "live").otherwise("local")
    spans = spread_join(each.dropDuplicates(["rk", "kind", "start", "end", "hash"]), values, ["hash"], ["rk"], counted=each).withColumn("class", label)
    spans = spans.filter((F.col("kind") < 3) | (F.col("class") == "live"))
    span = F.struct("start", F.col("kind").alias("order"), "end", kind.alias("kind"), "class", "n_owners", "n_repos")
    by_row = spans.groupBy("rk").agg(F.sort_array(F.collect_list(span)).alias("spans"))
    empty = F.expr("cast(array() as array<struct<start:long,order:int,end:long,kind:string,class:string,n_owners:long,n_repos:long>>)")
    return rows.select("doc_id", "rk").join(by_row, "rk", "left").select("doc_id", F.coalesce("spans", empty).alias("spans"))
