"""Sharding by minimax contiguous partition: DataFrame operations only.

Groups of equal texts are atomic and stay in the order of their smallest ids.
The smallest feasible shard capacity is found by binary search with a greedy
check. The check needs only "the last group end at or before x" of the running
totals of group sizes, which stay distributed: the driver holds a summary of
bounded size (the first and last group end in each of some thousand ranges), on
which the check gives a lower and an upper bound, and asks for a finer summary
of just those ranges in which the two differ.

Rows are put in order once. Their running totals serve the search (at the last
rows of groups), and the shards and slots alike.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webloom.operators.ordered import PART, range_parts, running_totals
from webloom.runtime import materialize

#: Rows of one summary that the driver asks for, at most.
SUMMARY_ROWS = 40_000


class _Ends:
    """What the driver knows of the sorted group ends: disjoint ranges (first end, last end)."""

    def __init__(self, groups: DataFrame, total: int) -> None:
        self.groups, self.total = groups, total
        self.ranges: list[tuple[int, int]] = [(1, total)]
        self.refine([(1, total)])

    def refine(self, coarse: list[tuple[int, int]]) -> None:
        """Replace these ranges by the ends found in each of their pieces."""
        pieces = max(2, SUMMARY_ROWS // len(coarse))
        starts = F.array(*[F.lit(a).cast("long") for a, _ in coarse])
        lasts = F.array(*[F.lit(b).cast("long") for _, b in coarse])
        steps = F.array(*[F.lit(-(-(b - a + 1) // pieces)).cast("long") for a, b in coarse])
        at = F.array_position(F.transform(F.arrays_zip(starts.alias("a"), lasts.alias("b")), lambda r: (F.col("upto") >= r["a"]) & (F.col("upto") <= r["b"])), True).cast("int")
        low, high = min(a for a, _ in coarse), max(b for _, b in coarse)
        inside = self.groups.filter(F.col("upto").between(low, high)).select("upto", at.alias("k")).filter("k > 0")
        piece = F.floor((F.col("upto") - F.element_at(starts, F.col("k"))) / F.element_at(steps, F.col("k")))
        found = inside.groupBy("k", piece.alias("piece")).agg(F.min("upto").alias("a"), F.max("upto").alias("b")).collect()
        gone = set(coarse)
        self.ranges = sorted([r for r in self.ranges if r not in gone] + [(r["a"], r["b"]) for r in found])
        self.firsts = [a for a, _ in self.ranges]

    def at(self, x: int) -> tuple[int, int, tuple[int, int] | None]:
        """Bounds of the last group end at or before x, and the range that leaves them apart."""
        k = bisect_right(self.firsts, x) - 1
        if k < 0:
            return 0, 0, None
        first, last = self.ranges[k]
        return (last, last, None) if last <= x else (first, x, (first, last))

    def cuts(self, capacity: int, shards: int) -> tuple[list[int], list[int], set[tuple[int, int]]]:
        """Greedy cuts for a capacity: lower and upper bounds, and the ranges that leave them apart."""
        lows, highs, apart, low, high = [], [], set(), 0, 0
        for _ in range(shards):
            low, _, one = self.at(low + capacity)
            _, high, two = self.at(high + capacity)
            apart |= {r for r in (one, two) if r}
            lows.append(low)
            highs.append(high)
        return lows, highs, apart


def minimax_cuts(ends: DataFrame, shards: int, total: int, largest: int) -> list[int]:
    """The group ends at which to cut so that the largest shard is as small as can be.

    ends has upto, the running total of positive group sizes in their order;
    total is the last of them and largest the largest group.
    """
    if not total:
        return [0] * shards
    least = max(largest, -(-total // shards))
    found, low, high = _Ends(ends, total), least, total
    while True:
        a, b = low, high
        while a < b:  # the smallest capacity that is surely enough
            mid = (a + b) // 2
            a, b = (a, mid) if found.cuts(mid, shards)[0][-1] >= total else (mid + 1, b)
        high = b
        a, b = low, high
        while a < b:  # the smallest that may be enough
            mid = (a + b) // 2
            a, b = (a, mid) if found.cuts(mid, shards)[1][-1] >= total else (mid + 1, b)
        low = a
        lows, highs, apart = found.cuts(high, shards)
        if low == high and lows == highs:
            return lows
        apart |= found.cuts(low, shards)[2]
        found.refine(sorted(r for r in apart if r[0] < r[1]))


def shard_by_bytes(
    docs: DataFrame, shards: int = 40, overhead: int = 16, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Put documents into shards 0 to shards - 1 of near equal bytes, equal texts together.

    Returns doc_id, size (UTF-8 bytes plus overhead), text_crc32, shard, slot
    (from 0 without gaps in each shard, in order of groups and then ids) and
    group_first (the smallest id with this text), a row per input row. No other
    split of the ordered groups into so many runs has a smaller largest shard.
    A null text counts as an empty one. Null ids come last in their group, a
    group of only such ids last of all. Repeated rows are separate rows of one
    group. An empty table gives an empty result; other columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    light = materialize(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.octet_length(text) + F.lit(overhead)).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.unhex(F.sha2(text, 256)).alias("same"),
        ),
        "sizes",
    )
    # written, so that the join has plain exchanges and the rows of one text can be split
    groups = materialize(light.groupBy(F.col("same").alias("_same")).agg(F.sum("size").alias("whole"), F.min("doc_id").alias("group_first")), "groups")
    about = groups.agg(F.sum("whole").alias("total"), F.max("whole").alias("largest")).first()
    rows = light.join(groups, light["same"] == groups["_same"]).select("doc_id", "size", "text_crc32", "same", "group_first")
    order = [F.col(c) for c in ("group_first", "same", "doc_id")]
    order = [order[0].isNull(), order[0], order[1], order[2].isNull(), order[2]]
    totals = running_totals(range_parts(rows, order, "rows"), order, {"upto": F.col("size"), "nth": F.lit(1).cast("long")})
    following = F.lead("same").over(Window.partitionBy(PART).orderBy(*order))
    ranked = materialize(totals.withColumn("following", following), "ranked")
    ends = _group_ends(ranked)
    cuts = minimax_cuts(ends, shards, int(about["total"] or 0), int(about["largest"] or 0))
    past = F.size(F.filter(F.array(*[F.lit(c).cast("long") for c in cuts]), lambda c: c < F.col("upto")))
    placed = ranked.withColumn("shard", past.cast("int"))
    # a row a shard
    begins = placed.groupBy(F.col("shard").alias("_shard")).agg(F.min("nth").alias("begin"))
    numbered = placed.join(F.broadcast(begins), placed["shard"] == begins["_shard"])
    return numbered.select("doc_id", "size", "text_crc32", "group_first", "shard", (F.col("nth") - F.col("begin")).alias("slot"))


def _group_ends(ranked: DataFrame) -> DataFrame:
    """The last row of each group: what follows it has another text, in its own range or at the start of the next one."""
    # a row a range
    begins = ranked.groupBy(F.col(PART).alias("_p")).agg(F.min_by("same", "upto").alias("begin"))
    begins = begins.select("_p", F.lead("begin").over(Window.orderBy("_p")).alias("after"))
    joined = ranked.join(F.broadcast(begins), ranked[PART] == begins["_p"])
    return joined.filter(~F.coalesce("following", "after").eqNullSafe(F.col("same"))).select("upto")
