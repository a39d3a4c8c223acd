"""Operator 10: minimax contiguous partition of atomic groups into shards.

Rows with the same text form one atomic group. Groups are ordered by the hash of their text. The smallest feasible
shard capacity over the ordered group sizes is found by binary search with a greedy check. The driver never holds
the groups: it starts from 2**bin_bits cells of neighbouring groups, bounds the capacity from both sides, and splits
only cells in which the greedy check may cut at a capacity between the bounds, 2**split_bits parts at a time, until
those are single groups. Then the capacity is exact, as if every group had been seen. Cells are re-counted by a pass
over slim rows a round; a round shrinks them by 2**split_bits, so rounds grow with the logarithm of the group count.

Every shard keeps within that capacity. Cuts lie near the mean of what remains rather than where the greedy check fills
a shard to the brim, as the check would leave the last shards empty when one group is larger than a fair share.

Edge cases: a null text counts as empty (one group with the empty texts); repeated rows keep one slot each; a
null id is an ordinary value; an empty table gives an empty result; columns other than id and text are ignored.
A group larger than a shard's fair share stays whole and sets the capacity.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexitide.llm.common import written

KEY_BITS = 63


def greedy_shards(sizes: list[int], capacity: int) -> int:
    """Shards that a left-to-right fill needs at this capacity."""
    shards, used = 1, 0
    for size in sizes:
        if used + size > capacity:
            shards, used = shards + 1, 0
        used += size
    return shards


def minimax_capacity(sizes: list[int], shards: int) -> int:
    """The smallest capacity with which the ordered sizes fit into so many contiguous shards."""
    low, high = max([*sizes, -(-sum(sizes) // shards), 0]), max(sum(sizes), 0)
    while low < high:
        middle = (low + high) // 2
        if greedy_shards(sizes, middle) <= shards:
            high = middle
        else:
            low = middle + 1
    return low


@dataclass
class Cell:
    """Neighbouring groups: their first possible key, the bits of it that they share, bytes, and whether they are one group."""

    key: int
    bits: int
    size: int
    single: bool


def _reach(cells: list[Cell], capacity: int, shards: int, whole: bool) -> list[int]:
    """Cells in which a greedy fill cuts, first cut first: with cells that are never cut (whole), a cut falls no later than
    the real one, with cells of many groups cut anywhere no earlier. The last entry is where the last shard ends."""
    ends, i, part = [], 0, 0  # part: bytes of cell i that are placed
    for _ in range(shards):
        room = capacity
        while i < len(cells):
            left = cells[i].size - part
            if left <= room:
                room -= left
                i, part = i + 1, 0
            else:
                if not whole and not cells[i].single:
                    part += room
                break
        ends.append(i)
    return ends


def unsettled(cells: list[Cell], shards: int) -> list[int]:
    """Cells of many groups in which the greedy check may cut at a capacity that may be the smallest."""
    if not cells:
        return []
    high = minimax_capacity([c.size for c in cells], shards)
    low = max([-(-sum(c.size for c in cells) // shards), *(c.size for c in cells if c.single)])
    top = high
    while low < top:  # the smallest capacity that would do if cells of many groups could be cut anywhere
        middle = (low + top) // 2
        if _reach(cells, middle, shards, False)[-1] >= len(cells):
            top = middle
        else:
            low = middle + 1
    found: set[int] = set()
    if low == high:
        return []
    for a, b in zip(_reach(cells, low, shards, True)[:-1], _reach(cells, high, shards, False)[:-1], strict=True):
        found |= {i for i in range(a, min(b + 1, len(cells))) if not cells[i].single}
    return sorted(found)


def cut_points(sizes: list[int], shards: int) -> list[int]:
    """First index of shards 1, 2, ...: each shard within the minimax capacity and near the mean of what remains."""
    capacity = minimax_capacity(sizes, shards)
    need = [0] * (len(sizes) + 1)  # shards that the suffix from here needs
    end, used = len(sizes), 0
    for i in range(len(sizes) - 1, -1, -1):
        used += sizes[i]
        while used > capacity:
            end -= 1
            used -= sizes[end]
        need[i] = need[end] + 1
    cuts, used, left = [], 0, sum(sizes)
    for i, size in enumerate(sizes):
        open_shards = shards - len(cuts)
        goal = (used + left) / open_shards
        if open_shards > 1 and used and need[i] < open_shards and (used + size > capacity or used + size / 2 > goal):
            cuts.append(i)
            used = 0
        used += size
        left -= size
    return cuts


def _cells(rows: DataFrame, bits: int) -> list[Cell]:
    """Cells of rows (u, size) by the first bits of u, by u; one row a cell reaches the driver."""
    shift = KEY_BITS - bits
    found = rows.groupBy(F.shiftright("u", shift).alias("i")).agg(F.sum("size").alias("size"), F.min("u").alias("low"), F.max("u").alias("high")).collect()
    return sorted((Cell(r["i"] << shift, bits, r["size"], r["low"] == r["high"]) for r in found), key=lambda c: c.key)


def refined_cells(rows: DataFrame, shards: int, bin_bits: int, split_bits: int) -> list[Cell]:
    """Cells of written rows (u, size) whose minimax capacity is that of the groups themselves."""
    cells = _cells(rows, bin_bits)
    while split := unsettled(cells, shards):
        parts: list[Cell] = []
        for bits in sorted({cells[i].bits for i in split}):
            wanted = [cells[i].key for i in split if cells[i].bits == bits]  # about shards * shards / 2, however many groups there are
            own = rows.filter((F.shiftright("u", KEY_BITS - bits) * F.lit(1 << (KEY_BITS - bits))).isin(wanted))
            parts += _cells(own, min(KEY_BITS, bits + split_bits))
        gone = set(split)
        cells = sorted([*(c for i, c in enumerate(cells) if i not in gone), *parts], key=lambda c: c.key)
    return cells


def shard_groups(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shards: int = 24, overhead: int = 8, bin_bits: int = 13, split_bits: int = 6, salts: int = 64
) -> DataFrame:
    """Per row: id, size (UTF-8 bytes plus overhead), text_crc32, law, shard, slot (gapless in its shard).

    Writes slim rows and counts them (a pass over docs, then passes over slim rows) when called."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).select(
        "doc_id",
        (F.octet_length("text").cast("long") + overhead).alias("size"),
        F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
        F.shiftrightunsigned(F.xxhash64("text"), 64 - KEY_BITS).alias("u"),
    )
    rows = written(rows, "shard-rows")
    cells = refined_cells(rows.select("u", "size"), shards, bin_bits, split_bits)
    cuts = [cells[i].key for i in cut_points([c.size for c in cells], shards)]
    shard = F.lit(0)
    for cut in cuts:
        shard = shard + (F.col("u") >= cut).cast("int")
    rows = rows.withColumn("shard", shard).withColumn("bin", F.shiftright("u", KEY_BITS - bin_bits).cast("int")).withColumn("salt", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(salts)).cast("int"))
    part = ["shard", "bin", "salt"]
    counts = written(rows.groupBy(*part).agg(F.count("*").alias("n")), "shard-counts")  # at most (2**bin_bits + shards) * salts rows
    before = Window.partitionBy("shard").orderBy("bin", "salt").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(*part, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    rank = F.row_number().over(Window.partitionBy(*part).orderBy("u", "doc_id", "text_crc32", "size"))
    return rows.withColumn("rank", rank.cast("long")).join(base, part).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("base") + F.col("rank") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
