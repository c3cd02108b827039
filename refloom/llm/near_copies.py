"""SimHash near-duplicates at a stated similarity: wide fingerprints in the Gray-order index propose pairs, and shingle sets decide.

Two texts are near copies if the Jaccard similarity of their sets of `SHINGLE`-word shingles is `SIMILAR` tenths or more; a component is what
near copies reach. Words are those of the SimHash fingerprint: ASCII case is folded, ASCII white space parts them. A text of fewer words
is one shingle, and texts without words, null ones too, are copies of each other.

Texts with the same shingles are one unit, and a unit has a SimHash fingerprint of `WORDS` * 64 bits. Sets of similarity s differ in about the share
acos(2s / (1 + s)) / pi of the bits, 15 % at 0.8, so blocks of neighbouring bits would have to be too short to group by. Units are dealt by
`MASKS` masked patterns of `BITS` bits instead: those that agree in one meet in a group, whose Gray tree finds the pairs that differ in at most `MOST` bits.
Each group proposes a forest, the closest pairs first, that spans what its close pairs connect; these pairs are compared
shingle by shingle and make components. So a group of near copies costs a bounded number of comparisons for each member, never all pairs. A group's rows are
read in order, at most `GROUP_ROWS` at a time with its first `SHARED_ROWS`.

That leaves out pairs: those that meet in no group, differ in more bits, lie in two parts of a large group, or that the forest passes over. An exact join finds
all of them that would connect two components, so the components are those of all pairs, whatever the bounds above. Of sets that are similar enough each has
0.8 of the other's shingles or more, so in any order of all shingles they share one of the first fifth of each and one more, and as many as are added to these.
First the order is that of hashes (`_suspects`): a tenth is added, and units that share fewer with other components are done. Then, for the whole sets of those left, it is by frequency, where
a shingle of one component only comes first and proposes nothing (`_rest`). What shares a shingle there is compared if sizes, places in the order and bitmaps of the sets' parities allow
the similarity; all three are bounds, not estimates. Shingles that more than `LIST_ROWS` sets begin with are dealt to cells of two parts of their list, so that every pair meets in one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from refloom.llm.common import lean
from refloom.llm.simhash import GrayIndex, components, first_of_component, firsts_only, gray_order
from refloom.sources.shared import stored

SHINGLE, SIMILAR = 5, 8
WORDS, BITS, MASKS = 4, 16, 32
#: Bits of two fingerprints that differ, at the most, in a pair that is compared.
MOST = 56
#: Rows of a group that are held at once, and those of them that all parts of the group share.
GROUP_ROWS, SHARED_ROWS = 8192, 128
#: Rows of whole groups that are worked on at once.
BATCH_ROWS = 65_536
#: Sets that share a shingle and are compared in one cell, about.
LIST_ROWS = 1024
#: Words of a set's bitmap, and pairs of sets whose bitmaps are compared at once.
PARITY_WORDS, PARITY_PAIRS = 16, 1 << 16
#: Texts that are read at once.
TEXT_ROWS = 512


def _masks() -> np.ndarray:
    """MASKS rows of WORDS words with BITS bits set, drawn once and for all."""
    bits = np.zeros((MASKS, WORDS * 64), np.uint8)
    rng = np.random.default_rng(42)
    for row in bits:
        row[rng.permutation(WORDS * 64)[:BITS]] = 1
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)


_MASKS = _masks()
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ x >> np.uint64(29)


def shingles(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """The hashes of a UTF-8 text's shingles, sorted, each once."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    n = max(1, len(words) - shingle + 1)
    parts = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)) if len(words) >= shingle else [b" ".join(words)]
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, parts), np.uint64, n))


def fingerprint(hashes: np.ndarray) -> bytes:
    """A bit for each of WORDS * 64 places: whether over half of the hashes, and of what is mixed from them, have it."""
    words = [hashes]
    for _ in range(WORDS - 1):
        words.append(_mixed(words[-1] + _MIX))
    each = np.stack(words, axis=1).view(np.uint8)
    counts = np.zeros(WORDS * 64, np.int64)
    for at in range(0, len(each), 255):
        # Ones are added a byte to a bit, eight bytes at a time; 255 rows don't overflow a byte.
        ones = np.unpackbits(each[at : at + 255], axis=1, bitorder="little").view(np.uint64)
        counts += ones.sum(axis=0, dtype=np.uint64).view(np.uint8)
    return np.packbits(2 * counts > len(hashes), bitorder="little").tobytes()


def _bodies(docs: DataFrame) -> DataFrame:
    body = F.coalesce(docs["text"], F.lit(""))
    return docs.select(docs["doc_id"].alias("k_id"), F.xxhash64(body).alias("k_text"), body.cast("binary").alias("body"))


def least_shared(n):
    """Of n shingles, those at least that a similar enough set has, too."""
    return (SIMILAR * n + 9) // 10


def shared_early(n):
    """With so many more leading shingles than it takes to share one, similar enough sets share as many of them; sets of up to n shingles, if they differ in size."""
    return n // 10 + 1


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *arrays])))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(k_id, k_text, unit, fp, early, leading): a row for each document; texts with the same shingles have the same unit. leading: shingles, least hashes first; any
    similar enough set leads with `early` of them."""
    texts = _bodies(docs)
    schema = texts.select("k_id", "k_text").schema.add("unit", "long").add("fp", "binary").add("early", "integer").add("leading", ArrayType(LongType()))

    @lean
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, TEXT_ROWS):
                b = batch.slice(at, TEXT_ROWS)
                units, fps, early, leading = [], [], [], []
                for x in b.column(2):
                    hashes = shingles(x.as_py(), shingle)
                    units.append(xxhash.xxh64_intdigest(hashes.tobytes()))
                    fps.append(fingerprint(hashes))
                    n = len(hashes)
                    early.append(shared_early(least_shared(n)))
                    leading.append(hashes[: n - least_shared(n) + shared_early(n)].view(np.int64))
                columns = [b.column(0), b.column(1), pa.array(np.array(units, np.uint64).view(np.int64)), pa.array(fps, pa.binary()), pa.array(early, pa.int32()), _lists(leading)]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return texts.mapInArrow(task, schema)


def _words(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, WORDS)


def _dealt(units: DataFrame) -> DataFrame:
    """(grp, unit, fp) once for each mask; units: (unit, fp)."""

    @lean
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                b = batch.slice(at, 1024)
                masked = _words(b.column(1))[None, :, :] & _MASKS[:, None, :]
                group = np.zeros(masked.shape[:2], np.uint64) + np.arange(1, MASKS + 1, dtype=np.uint64)[:, None] * _MIX
                for word in range(WORDS):
                    group = _mixed(group ^ masked[:, :, word] * _MIX)
                index = pa.array(np.tile(np.arange(b.num_rows), MASKS))
                yield pa.RecordBatch.from_arrays([pa.array(group.ravel().view(np.int64)), *(c.take(index) for c in b.columns)], names=["grp", *b.schema.names])

    return units.select("unit", "fp").mapInArrow(task, "grp long, unit long, fp binary")


def _proposed(groups: DataFrame) -> DataFrame:
    """(a, b): pairs of units to compare, a < b. groups: (grp, unit, fp)."""

    def pairs(group: np.ndarray, units: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        a = b = np.zeros(0, np.int64)
        if len(group):
            order = gray_order(group, fps)
            units = units[order]
            a, b = (units[x] for x in GrayIndex(group[order], fps[order]).forest(MOST))
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    @lean
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [np.zeros(0, np.int64)] * 2 + [np.zeros((0, WORDS), np.uint64)]
        for b in batches:
            if not b.num_rows:
                continue
            more = [b.column(0).to_numpy(), b.column(1).to_numpy(), _words(b.column(2))]
            rows = [np.concatenate(x) for x in zip(rows, more, strict=True)]
            last = int(np.searchsorted(rows[0], rows[0][-1]))  # the last group may go on in the next batch
            if last >= BATCH_ROWS or last and len(rows[0]) - last >= GROUP_ROWS:
                yield pairs(*(x[:last] for x in rows))
                rows = [x[last:] for x in rows]
            elif not last and len(rows[0]) >= GROUP_ROWS:
                yield pairs(*rows)
                rows = [x[:SHARED_ROWS] for x in rows]
        yield pairs(*rows)

    rows = groups.select("grp", "unit", "fp").repartition("grp").sortWithinPartitions("grp", "fp")
    return rows.mapInArrow(task, "a long, b long").distinct()


def _parities(sets: list[np.ndarray]) -> list[bytes]:
    """For each set a bit for each place that an odd number of its hashes have. Two sets have at least as many shingles apart as their bitmaps have bits."""
    width = PARITY_WORDS * 64
    of = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    odd = np.bincount(of * width + (np.concatenate([np.zeros(0, np.int64), *sets]) & (width - 1)), minlength=len(sets) * width) & 1
    return [x.tobytes() for x in np.packbits(odd.reshape(len(sets), width).astype(np.uint8), axis=1, bitorder="little")]


def _shingle_sets(docs: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """(of, parity, hashes) for the units of wanted (of, first)."""
    texts = _bodies(docs)
    wanted = wanted.select("of", F.col("first.k_id").alias("w_id"), F.col("first.k_text").alias("w_text"))
    rows = texts.join(wanted, texts["k_id"].eqNullSafe(wanted["w_id"]) & (texts["k_text"] == wanted["w_text"])).select("of", "body")

    @lean
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, TEXT_ROWS):
                part = b.slice(at, TEXT_ROWS)
                found = [shingles(x.as_py(), shingle).view(np.int64) for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(_parities(found), pa.binary()), _lists(found)], names=["of", "parity", "hashes"])

    # Rows that agree in id and text give the same set.
    return rows.mapInArrow(task, "of long, parity binary, hashes array<long>").dropDuplicates(["of"])


def _near(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough; all in whole numbers."""
    one, other = sets.select(F.col("of").alias("a"), F.col("hashes").alias("x")), sets.select(F.col("of").alias("b"), F.col("hashes").alias("y"))
    both = pairs.join(one, "a").join(other, "b")
    shared = F.size(F.array_intersect("x", "y"))
    return both.where((10 + SIMILAR) * shared >= SIMILAR * (F.size("x") + F.size("y"))).select("a", "b")


def _suspects(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """(unit, label) of the units that lead with `early` shingles with which units of other labels lead, too. rows: (unit, early, leading); labels: (unit, label)."""
    each = rows.select("unit", "early", F.explode("leading").alias("hash"))
    # Most shingles stand in one unit only; labels are looked up for the others.
    shared = each.groupBy("hash").agg(F.min("unit").alias("least"), F.max("unit").alias("most")).where("least != most").select("hash")
    held = stored(each.join(shared, "hash", "left_semi").distinct().join(labels, "unit"), "shared-shingles")
    apart = held.groupBy("hash").agg(F.min("label").alias("least"), F.max("label").alias("most")).where("least != most").select("hash")
    return held.join(apart, "hash", "left_semi").groupBy("unit", "label", "early").agg(F.count("*").alias("n")).where("n >= early").select("unit", "label")


def _rest(sets: DataFrame) -> DataFrame:
    """(a, b): pairs of units of different labels, a < b, among which are all that are similar enough. sets: (unit, label, parity, hashes)."""
    each = sets.select("unit", F.col("label"), F.explode("hashes").alias("hash"))
    shared = each.groupBy("hash").agg(F.count("*").alias("often"), F.min("label").alias("least"), F.max("label").alias("most")).where("least != most").select("hash", "often")
    ranked = each.select("unit", "hash").join(shared, "hash").groupBy("unit").agg(F.array_sort(F.collect_list(F.struct("often", "hash"))).alias("ranked"))
    # The shingles of one label come first, and of what follows those that are left of the leading ones.
    n, own = F.size("hashes"), F.size("hashes") - F.size("ranked")
    leading = n - F.expr(f"({SIMILAR} * size(hashes) + 9) div 10").cast("int") + 1
    found = sets.join(ranked, "unit").where(leading > own)
    found = found.select("unit", "label", "parity", n.alias("n"), own.alias("own"), F.posexplode(F.slice("ranked", 1, leading - own)).alias("place", "shingle"))
    lists = stored(found.select("unit", "label", "parity", "n", (F.col("own") + F.col("place")).alias("at"), F.col("shingle.hash").alias("hash")), "lists")
    # A list of many sets is dealt in parts; a cell is two of them, or one with itself.
    parts = lists.groupBy(F.col("hash").alias("of")).agg(F.ceil(F.count("*") / LIST_ROWS).cast("int").alias("parts")).where("parts > 1")
    dealt = lists.join(parts, F.col("hash") == F.col("of"), "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("unit"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("hash", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "unit", "label", "n", "at", "parity")

    def pairs(hash_: np.ndarray, i: np.ndarray, j: np.ndarray, part: np.ndarray, unit: np.ndarray, label: np.ndarray, n: np.ndarray, at: np.ndarray, parity: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Of sorted rows of whole cells."""
        rows = np.arange(len(unit))
        head = np.flatnonzero(np.r_[True, (hash_[1:] != hash_[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])
        after = np.repeat(np.r_[head[1:], len(rows)], np.diff(np.r_[head, len(rows)])) - rows - 1  # rows of the cell that follow
        upto = np.r_[0, np.cumsum(after)]
        start = 0
        while start < len(rows):
            stop = max(start + 1, int(np.searchsorted(upto, upto[start] + PARITY_PAIRS, "right")) - 1)
            x = np.repeat(rows[start:stop], after[start:stop])
            y = x + 1 + np.arange(len(x)) - (upto[x] - upto[start])
            start = stop
            keep = (label[x] != label[y]) & ((i[x] == j[x]) | (part[x] != part[y]))
            x, y = x[keep], y[keep]
            both = n[x] + n[y]
            least = -(-SIMILAR * both // (10 + SIMILAR))  # shingles that similar enough sets share
            keep = (np.minimum(n[x], n[y]) >= least) & (np.minimum(n[x] - at[x], n[y] - at[y]) >= least)
            x, y, apart = x[keep], y[keep], (both - 2 * least)[keep]
            keep = np.bitwise_count(parity[x] ^ parity[y]).sum(axis=1, dtype=np.int64) <= apart
            x, y = unit[x[keep]], unit[y[keep]]
            if len(x):
                a, b = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    @lean
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[np.ndarray] = []
        for b in batches:
            if not b.num_rows:
                continue
            more = [b.column(c).to_numpy().astype(np.int64) for c in range(8)] + [np.frombuffer(b"".join(b.column(8).to_pylist()), np.uint64).reshape(-1, PARITY_WORDS)]
            rows = [np.concatenate(x) for x in zip(rows, more, strict=True)] if rows else more
            differs = np.flatnonzero((rows[0] != rows[0][-1]) | (rows[1] != rows[1][-1]) | (rows[2] != rows[2][-1]))
            last = int(differs[-1]) + 1 if len(differs) else 0  # the last cell may go on in the next batch
            yield from pairs(*(x[:last] for x in rows))
            rows = [x[last:] for x in rows]
        if rows:
            yield from pairs(*rows)

    cells = dealt.repartition("hash", "i", "j").sortWithinPartitions("hash", "i", "j")
    return cells.mapInArrow(task, "a long, b long").distinct()


def near_copies(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """A row for each document: k_id, k_text, unit, first (the least (k_id, k_text) of its component; ids that are null come last)."""
    rows = stored(fingerprints(docs, shingle), "fingerprints")
    least = F.min(F.struct(F.col("k_id").isNull().alias("no_id"), "k_id", "k_text"))
    units = stored(rows.groupBy("unit").agg(least.alias("first"), F.max("fp").alias("fp")), "units")
    of = units.select(F.col("unit").alias("of"), "first")

    tried = stored(_proposed(_dealt(units)), "pairs")
    ends = tried.select(F.col("a").alias("end")).union(tried.select("b")).distinct()
    near = stored(_near(tried, stored(_shingle_sets(docs, of.join(ends, F.col("of") == F.col("end"), "left_semi"), shingle), "shingle-sets")), "near")
    linked = components(near).select("node", F.col("root").alias("label"))
    labels = stored(units.select("unit").join(linked, F.col("unit") == F.col("node"), "left").select("unit", F.coalesce("label", "unit").alias("label")), "labelled-units")

    suspects = stored(_suspects(rows, labels), "suspects")
    sets = _shingle_sets(docs, of.join(suspects, F.col("of") == F.col("unit"), "left_semi"), shingle)
    sets = stored(sets.join(suspects, F.col("of") == F.col("unit")).select("unit", "label", "parity", "hashes"), "suspects-sets")
    more = stored(_rest(sets), "pairs")
    near = near.union(_near(more, sets.withColumnRenamed("unit", "of")))
    return first_of_component(rows.select("k_id", "k_text", "unit"), units.select("unit", "first"), components(near), "unit")


def keep_one(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """The documents, with all their columns, of which each is the first of its component; of rows that agree in id and text one stays."""
    return firsts_only(docs, near_copies(docs, shingle))
