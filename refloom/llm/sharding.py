"""Sharding by a minimax contiguous partition, with DataFrame functions only.

Documents of equal text form one atomic group. Groups are ordered by the SHA-256 of their text and cut into at most
`n_shards` runs so that the largest run is as small as it can be: a binary search finds the smallest capacity with which a
greedy walk (fill a shard until the next group would not fit) needs no more shards than there are.

The walk asks for the last group that ends within `place + capacity`, 24 times a probe. The driver holds a bounded
outline of the group ends only: some known ends, and for each gap between two of them whether it is empty. In a gap that is
not, the walk may hope to reach the very place, so the search gives a lower bound; the gaps that the walk at this bound
went through are outlined more finely by one query, until it met none. Then the bound is reached and the walk is exact.

The size of a document is the UTF-8 bytes of its text plus 8; null texts are empty. Repeated rows are rows of their own,
in one group. Slots go by parts of a shard and then by text and id; rows that agree in both take theirs in any order. An empty table gives no
rows. Extra columns are not looked at.
"""

from __future__ import annotations

from bisect import bisect_right
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from refloom.sources.shared import stored

N_SHARDS = 24
#: Rows that one query sends to the driver at most, about.
OUTLINE = 8192
#: Rows of a shard that one task numbers, about.
PART_ROWS = 250_000
#: Groups whose running sums one task works out, about.
BUCKET_GROUPS = 50_000


def group_ends(base: DataFrame) -> DataFrame:
    """(key, bytes, ends): ends is the sum of the bytes of this group and of those before it."""
    groups = base.groupBy("key").agg(F.sum("size").alias("bytes"))
    groups = stored(groups, "groups")
    n = max(1, min(65536, -(-groups.count() // BUCKET_GROUPS)))
    # Keys are hex digests: a run of keys holds a like number of them wherever it starts.
    lead = F.conv(F.substring("key", 1, 4), 16, 10).cast("int")
    groups = groups.withColumn("bucket", F.floor(lead * n / 65536).cast("int"))
    within = Window.partitionBy("bucket").orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    # At most 65536 rows, so one task may order them.
    totals = groups.groupBy("bucket").agg(F.sum("bytes").alias("all"))
    before = totals.select("bucket", (F.sum("all").over(Window.orderBy("bucket")) - F.col("all")).alias("before"))
    ends = groups.withColumn("inside", F.sum("bytes").over(within)).join(F.broadcast(before), "bucket")
    return stored(ends.select("key", "bytes", (F.col("inside") + F.col("before")).alias("ends")), "ends")


class Outline:
    """Known ends, in order, and whether the gap before each is empty."""

    def __init__(self, total: int):
        self.total, self.ends, self.solid = total, [0, total], [True, False]

    def walk(self, capacity: int, most: int) -> tuple[list[int], list[int]] | None:
        """The cuts that the greedy walk would like to make, and the numbers of the gaps it took on trust; None if it needs more shards."""
        place, cuts, trusted = 0, [], []
        while place < self.total:
            if len(cuts) == most:
                return None
            to = min(place + capacity, self.total)
            k = bisect_right(self.ends, to) - 1
            reached = self.ends[k]
            if reached < to and not self.solid[k + 1]:
                reached, _ = to, trusted.append(k + 1)
            if reached <= place:
                return None
            place = reached
            cuts.append(place)
        return cuts, trusted

    def least(self, low: int, most: int) -> int:
        """The smallest capacity from low on that the walk is content with."""
        high = self.total
        while low < high:
            mid = (low + high) // 2
            low, high = (low, mid) if self.walk(mid, most) else (mid + 1, high)
        return low

    def refine(self, ends: DataFrame, gaps: list[int], rows: int) -> None:
        """Learn about `rows` ends inside these gaps by one query."""
        each = max(2, rows // len(gaps))
        spans = [(self.ends[k - 1], self.ends[k]) for k in gaps]
        e = F.col("ends")
        inside = [(e > a) & (e < b) for a, b in spans]
        part = [F.struct(F.lit(i).alias("gap"), F.expr(f"((ends - {a}) * {each}) div {b - a}").alias("part")) for i, (a, b) in enumerate(spans)]
        which = reduce(lambda acc, x: acc.when(*x), zip(inside[1:], part[1:], strict=True), F.when(inside[0], part[0]))
        found = ends.where(reduce(Column.__or__, inside)).groupBy(which.alias("at")).agg(F.max("ends").alias("end"), F.count("*").alias("n")).collect()
        known = dict(zip(self.ends, self.solid, strict=True))
        by_gap: dict[int, list] = {}
        for r in found:
            by_gap.setdefault(r["at"]["gap"], []).append(r)
        for i, (_, b) in enumerate(spans):
            rows_here = sorted(by_gap.get(i, []), key=lambda r: r["end"])
            known |= {r["end"]: r["n"] == 1 for r in rows_here}
            known[b] = True  # its last part ends at the last end before b
        self.ends = sorted(known)
        self.solid = [known[x] for x in self.ends]


def minimax_cuts(ends: DataFrame, n_shards: int = N_SHARDS, outline: int = OUTLINE) -> tuple[int, list[int]]:
    """The smallest capacity, and the ends after which the greedy walk cuts."""
    about = ends.agg(F.max("ends").alias("total"), F.max("bytes").alias("largest")).first()
    if not about.total:
        return 0, []
    view = Outline(about.total)
    view.refine(ends, [1], outline)
    low = max(about.largest, -(-about.total // n_shards))
    while True:
        low = view.least(low, n_shards)
        cuts, trusted = view.walk(low, n_shards)
        if not trusted:
            return low, cuts
        view.refine(ends, sorted(set(trusted)), outline)


def shard_documents(docs: DataFrame, n_shards: int = N_SHARDS, outline: int = OUTLINE) -> DataFrame:
    """A row for each document: doc_id, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null: not of this law)."""
    body = F.coalesce(docs["text"], F.lit("")).cast("binary")
    base = docs.select(
        docs["doc_id"], (F.octet_length(body) + 8).cast("long").alias("size"), F.crc32(body).alias("text_crc32"), F.sha2(body, 256).alias("key"),
    )
    base = stored(base, "sizes")
    n_parts = max(1, -(-base.count() // PART_ROWS))
    ends = group_ends(base)
    _, cuts = minimax_cuts(ends, n_shards, outline)
    keys = [r.key for r in ends.where(F.col("ends").isin(cuts[:-1])).select("key").collect()] if cuts[:-1] else []  # fewer than n_shards
    shard = reduce(Column.__add__, [(F.col("key") > k).cast("int") for k in keys], F.lit(0))
    # Parts by a hash of id and text are alike in size whatever copies there are, and don't depend on how the table was split.
    placed = base.withColumn("shard", shard).withColumn("part", F.pmod(F.xxhash64("doc_id", "key"), F.lit(n_parts)))
    parts = placed.groupBy("shard", "part").agg(F.count("*").alias("n"))
    first = parts.select("shard", "part", (F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n")).alias("first"))
    inside = F.row_number().over(Window.partitionBy("shard", "part").orderBy("key", "doc_id"))
    return placed.withColumn("inside", inside).join(first, ["shard", "part"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first") + F.col("inside") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
