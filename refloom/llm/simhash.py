"""SimHash near-duplicates by a Gray-order hierarchical index.

A fingerprint has a bit set where over half of the XXH64 hashes (seed 42) of the text's word shingles have it. Documents
whose fingerprints differ in at most `most` bits are linked, and a component is what links reach.

Distinct fingerprints are dealt to tasks by pigeonhole: of `most` + 1 blocks of bits, linked fingerprints agree in one, so
each fingerprint goes to one group for each block. Within a group the fingerprints are sorted by Gray rank, which puts those that
share leading bits side by side, and stacked into a tree whose nodes hold the bits that all below them agree in; an upper node holds
the shared pattern, a lower one what it adds. Pairs of nodes are walked from the roots down. The differences in the patterns
are summed on the way, and a pair is dropped with everything below it as soon as the sum passes `most`, or if links already
connect all of both. A group hands on links from its members to the least of each component, never all pairs. A group too large for
one task is dealt again by blocks of its remaining bits.

Texts without words, null ones too, have fingerprint zero and are linked like any other. Repeated rows are rows with equal
fingerprints. A null id is a member but is no component's id unless all of a component's ids are null. An empty table gives
no rows. Extra columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refloom.llm.common import same_key
from refloom.sources.shared import stored

SHINGLE, MOST = 3, 3
#: Rows of one group that one task takes; larger groups are dealt again.
GROUP_ROWS = 4096
#: Leaves and nodes of the tree have so many children.
FANOUT = 16
#: Pairs of leaves that are compared at once.
LEAF_PAIRS = 4096


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The fingerprint of a UTF-8 text; bytes.lower and bytes.split know ASCII only, as asked."""
    words = text.lower().split()
    n = len(words) - shingle + 1
    if not words:
        return 0
    if n < 1:
        n, parts = 1, [b" ".join(words)]
    else:
        parts = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(p, 42) for p in parts), np.uint64, n)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 16384):
        bits = np.unpackbits(hashes[at : at + 16384].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(k_id, k_text, fp): a row for each document; fp is the fingerprint's 64 bits as a signed number."""
    body = F.coalesce(docs["text"], F.lit(""))
    texts = docs.select(docs["doc_id"].alias("k_id"), F.xxhash64(body).alias("k_text"), body.cast("binary").alias("body"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(x.as_py(), shingle) for x in b.column(2)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps.view(np.int64))], names=["k_id", "k_text", "fp"])

    schema = texts.select("k_id", "k_text").schema.add("fp", "long")
    return texts.mapInArrow(task, schema)


def gray_rank(fps: np.ndarray) -> np.ndarray:
    """The place of each value in the reflected Gray sequence; a column of words, the highest first, gives a column of ranks."""
    rank = fps.copy()
    for by in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(by)
    for word in range(1, rank.shape[1] if rank.ndim > 1 else 0):
        # The lowest bit of a rank is the parity of all bits above: an odd one turns what follows round.
        rank[:, word] ^= np.uint64(0) - (rank[:, word - 1] & np.uint64(1))
    return rank


def gray_order(group: np.ndarray, fps: np.ndarray) -> np.ndarray:
    """The order by group, then Gray rank."""
    rank = gray_rank(fps.reshape(len(fps), -1))
    return np.lexsort((*rank.T[::-1], group))


def _bits(words: np.ndarray) -> np.ndarray:
    """How many bits each row of words has set."""
    return np.bitwise_count(words).sum(axis=1, dtype=np.int64)


def _least_labels(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the components of a[i] and b[i]; a label is the least row number of a component."""
    while True:
        la, lb = labels[a], labels[b]
        apart = la != lb
        if not apart.any():
            return
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(labels, np.maximum(la, lb), np.minimum(la, lb))
        while not np.array_equal(up := labels[labels], labels):
            labels[:] = up


def _spanning(labels: np.ndarray, a: np.ndarray, b: np.ndarray, diffs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs, those that span what all of them connect, fewest differences first; the labels are joined."""
    order = np.argsort(diffs, kind="stable")
    a, b, found = a[order], b[order], [np.zeros((2, 0), np.int64)]
    while True:
        apart = labels[a] != labels[b]
        if not apart.any():
            return tuple(np.concatenate(found, axis=1))
        a, b = a[apart], b[apart]
        # Each component's first pair to another one; the order is total, so these make no circle.
        places = np.arange(len(a))
        _, at = np.unique(np.stack([labels[a], labels[b]], axis=1).ravel(), return_index=True)
        pick = np.unique(places[at // 2])
        found.append(np.stack([a[pick], b[pick]]))
        _least_labels(labels, a[pick], b[pick])


class GrayIndex:
    """The trees of many groups at once; rows are sorted by group and Gray rank. A fingerprint is a word or a row of words."""

    def __init__(self, group: np.ndarray, fps: np.ndarray, fanout: int = FANOUT):
        fps = fps.reshape(len(fps), -1)
        self.fps, self.group = fps, group
        self.levels: list[dict] = []
        start, of = np.arange(len(fps)), group
        pattern, mask = fps, np.full(fps.shape, ~np.uint64(0))
        while True:
            # Children of one parent: up to `fanout` neighbours of one group.
            head = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
            place = np.arange(len(of)) - np.repeat(head, np.diff(np.r_[head, len(of)]))
            first = np.flatnonzero(place % fanout == 0)
            n = np.diff(np.r_[first, len(of)])
            ones, zeros = np.bitwise_and.reduceat(pattern, first, axis=0), np.bitwise_and.reduceat(mask & ~pattern, first, axis=0)
            pattern, mask, of = ones, ones | zeros, of[first]
            start = start[first]
            self.levels.append({"first": first, "n": n, "pattern": pattern, "mask": mask, "row": start, "rows": np.diff(np.r_[start, len(fps)])})
            if (np.diff(np.flatnonzero(np.r_[True, of[1:] != of[:-1], True])) == 1).all():
                return

    def close(self, most: int, labels: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(rows, rows, differences) of the pairs that differ in at most `most` bits, neighbours first, but for those below nodes
        that the labels connect wholly; whoever takes the pairs may join labels on the way."""
        near = np.flatnonzero(self.group[1:] == self.group[:-1])
        diffs = _bits(self.fps[near] ^ self.fps[near + 1])
        yield near[diffs <= most], near[diffs <= most] + 1, diffs[diffs <= most]
        a = np.flatnonzero(self.levels[-1]["rows"] > 1)
        b, so_far = a, np.zeros(len(a), np.int64)
        for level in range(len(self.levels) - 1, 0, -1):
            a, b, so_far = self._down(level, a, b, so_far, most)
            a, b, so_far = self._open(level - 1, labels, a, b, so_far)
        order = np.argsort(b - a, kind="stable")
        a, b = a[order], b[order]
        for at in range(0, len(a), LEAF_PAIRS):
            x, y, _ = self._open(0, labels, a[at : at + LEAF_PAIRS], b[at : at + LEAF_PAIRS], None)
            x, y = self._children(0, x, y)[:2]
            diffs = _bits(self.fps[x] ^ self.fps[y])
            few = (diffs <= most) & (labels[x] != labels[y])
            yield x[few], y[few], diffs[few]

    def components(self, most: int = MOST) -> np.ndarray:
        """For each row the least row of its component; groups are apart."""
        labels = np.arange(len(self.fps))
        for a, b, _ in self.close(most, labels):
            _least_labels(labels, a, b)
        return labels

    def forest(self, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of rows, the closest first, that span the components."""
        labels = np.arange(len(self.fps))
        found = [_spanning(labels, a, b, diffs) for a, b, diffs in self.close(most, labels)]
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def _children(self, level: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each pair of a child of a[i] and a child of b[i], the same pair once, and i."""
        at = self.levels[level]
        na, nb = at["n"][a], at["n"][b]
        i = np.repeat(np.arange(len(a)), na * nb)
        k = np.arange(len(i)) - np.repeat(np.cumsum(na * nb) - na * nb, na * nb)
        x, y = at["first"][a[i]] + k // nb[i], at["first"][b[i]] + k % nb[i]
        once = x <= y if level else x < y
        return x[once], y[once], i[once]

    def _down(self, level: int, a: np.ndarray, b: np.ndarray, diffs: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The pairs a level lower whose differences so far are few enough."""
        upper, lower = self.levels[level], self.levels[level - 1]
        kept: list[tuple] = [(a[:0], b[:0], diffs[:0])]
        for at in range(0, len(a), LEAF_PAIRS):
            pa_, pb_, d = a[at : at + LEAF_PAIRS], b[at : at + LEAF_PAIRS], diffs[at : at + LEAF_PAIRS]
            x, y, i = self._children(level, pa_, pb_)
            added = lower["mask"][x] & lower["mask"][y] & ~(upper["mask"][pa_[i]] & upper["mask"][pb_[i]])
            so_far = d[i] + _bits((lower["pattern"][x] ^ lower["pattern"][y]) & added)
            few = so_far <= most
            kept.append((x[few], y[few], so_far[few]))
        return tuple(np.concatenate(z) for z in zip(*kept, strict=True))

    def _open(self, level: int, labels: np.ndarray, a: np.ndarray, b: np.ndarray, diffs: np.ndarray | None) -> tuple:
        """The pairs that links don't connect wholly yet."""
        at = self.levels[level]
        if not len(a):
            return a, b, diffs
        low, high = np.minimum.reduceat(labels, at["row"]), np.maximum.reduceat(labels, at["row"])
        still = (low[a] != high[a]) | (low[b] != high[b]) | (low[a] != low[b])
        return a[still], b[still], None if diffs is None else diffs[still]


def _group_links(most: int):
    """Of rows sorted by group: (fp, least) for each member of a component but the least itself."""

    def links(group: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        order = gray_order(group, fps)
        group, fps = group[order], fps[order]
        labels = GrayIndex(group, fps).components(most) if len(fps) else np.arange(0)
        other = np.flatnonzero(labels != np.arange(len(labels)))
        return pa.RecordBatch.from_arrays([pa.array(fps[other].view(np.int64)), pa.array(fps[labels[other]].view(np.int64))], names=["a", "b"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, fps = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for b in batches:
            group = np.r_[group, b.column(0).to_numpy(zero_copy_only=False)]
            fps = np.r_[fps, b.column(1).to_numpy(zero_copy_only=False).view(np.uint64)]
            if len(group):
                done = int(np.searchsorted(group, group[-1]))  # the last group may go on in the next batch
                yield links(group[:done], fps[:done])
                group, fps = group[done:], fps[done:]
        yield links(group, fps)

    return task


def _blocks(free: int, most: int) -> list[int]:
    """`free` bits as most + 1 masks of neighbouring bits."""
    places = [i for i in range(64) if free >> i & 1]
    cuts = [len(places) * i // (most + 1) for i in range(most + 2)]
    return [sum(1 << p for p in places[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def links(fps: DataFrame, most: int = MOST, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(a, b): links between distinct fingerprints that connect all that differ in at most `most` bits. fps: distinct (fp)."""
    waiting, found = [(0, fps)], []
    while waiting:
        fixed, rows = waiting.pop()
        masks = [fixed | block for block in _blocks(~fixed & (1 << 64) - 1, most)]
        # A group is (the fixed bits, their values); its hash names it, and equal hashes of unlike groups only put more in one.
        deals = F.array(*(F.struct(F.lit(i).alias("deal"), F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(_signed(m)))).alias("grp")) for i, m in enumerate(masks)))
        dealt = rows.select("fp", F.inline(deals)).select("grp", "deal", "fp")
        if bin(fixed).count("1") < 48:  # with more fixed bits, few distinct values are left
            sizes = dealt.groupBy("grp").count().where(F.col("count") > group_rows).select("grp")
            if sizes.take(1):
                large = stored(dealt.join(sizes, "grp", "left_semi"), "large-groups")
                waiting += [(m, large.where(F.col("deal") == i).select("fp").distinct()) for i, m in enumerate(masks)]
                dealt = dealt.join(sizes, "grp", "left_anti")
        found.append(dealt.select("grp", "fp").repartition("grp").sortWithinPartitions("grp").mapInArrow(_group_links(most), "a long, b long"))
    out = found[0]
    for part in found[1:]:
        out = out.union(part)
    return out.distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): every node of the links with the least node that links reach; by alternating large and small stars."""
    now = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    measure = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    before = measure(now)
    while before[0]:
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("least"))
        large = both.where("b > a").join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()
        least = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("least"))
        small = large.join(least, F.col("a") == F.col("u"))
        small = small.where("b != least").select(F.col("b").alias("a"), F.col("least").alias("b")).union(least.select(F.col("u").alias("a"), F.col("least").alias("b")))
        now = stored(small.distinct(), "links")
        after = measure(now)
        if after == before:
            break
        before = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, most: int = MOST, group_rows: int = GROUP_ROWS) -> DataFrame:
    """A row for each document: k_id, k_text, fp, first (the least (k_id, k_text) of its component; ids that are null come last)."""
    rows = stored(fingerprints(docs, shingle), "fingerprints")
    least = F.min(F.struct(F.col("k_id").isNull().alias("no_id"), "k_id", "k_text"))
    fps = stored(rows.groupBy("fp").agg(least.alias("first")), "distinct-fingerprints")
    return first_of_component(rows, fps, components(links(fps.select("fp"), most, group_rows)), "fp")


def first_of_component(rows: DataFrame, units: DataFrame, rooted: DataFrame, unit: str) -> DataFrame:
    """The rows with `first`, the least of those of the units in the row's component. units: (unit, first); rooted: as from components()."""
    rooted = rooted.union(rooted.select("root", "root").distinct())
    member = rooted.join(units, rooted["node"] == units[unit]).select("node", "root", "first")
    first = member.groupBy("root").agg(F.min("first").alias("least"))
    linked = member.join(first, "root").select("node", "least")
    whole = units.join(linked, units[unit] == linked["node"], "left").select(units[unit].alias("of"), F.coalesce("least", "first").alias("first"))
    # Both sides are plain tables now, so a unit that many documents share can be split between tasks.
    whole = stored(whole, "firsts")
    return rows.join(whole, rows[unit] == whole["of"]).select("k_id", "k_text", unit, "first")


def keep_one(docs: DataFrame, shingle: int = SHINGLE, most: int = MOST) -> DataFrame:
    """The documents, with all their columns, of which each is the first of its component; of rows that agree in id and text one stays."""
    return firsts_only(docs, near_duplicates(docs, shingle, most))


def firsts_only(docs: DataFrame, out: DataFrame) -> DataFrame:
    """The documents that are the first of their component, with their columns, whatever their names. out: (k_id, k_text, first) for each document."""
    kept = out.where(F.col("k_id").eqNullSafe(F.col("first.k_id")) & (F.col("k_text") == F.col("first.k_text"))).groupBy("k_id", "k_text").agg(F.count("*").alias("k_n"))
    kept = stored(kept, "kept")
    key = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    once, often = kept.where("k_n = 1"), kept.where("k_n > 1")
    match = lambda k: docs["doc_id"].eqNullSafe(k["k_id"]) & (key == k["k_text"])
    rows = docs.join(once, match(once), "left_semi")
    if often.take(1):
        # Whole rows in one struct, so that no name of theirs meets one of ours.
        again = docs.join(often, match(often), "left_semi").select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row"), docs["doc_id"].alias("k_id"), key.alias("k_text"))
        rows = rows.unionByName(again.dropDuplicates(["k_id", "k_text"]).select("row.*"))
    return rows
