"""Line deduplication by content-defined chunks of lines.

A window is a shortest run of lines with `CHUNK_WORDS` words: without its first or its last line it has fewer. It has a rolling hash over the hashes of
its lines, and of the windows in each run of lines that has `RUN_WORDS` words the one with the least hash is a chunk. Whether a window is a chunk depends on the
lines about it only, so that the boundaries of chunks move with the text; and any `RUN_WORDS` words or more of lines that stand in two places hold a
chunk that both places have.

A chunk whose hash stands earlier in the corpus, by (doc_id, place), leads to that earlier place. From there both texts are followed to both
sides as long as their lines have equal hashes; these runs are compared byte by byte and their lines removed. So a repeated passage is
found whatever its lines are and whatever stands around it, but where another text holds one of its chunks earlier still, it is followed as far as that
one agrees. A line only goes where an earlier one equals it, and the first of equal lines never does. Passages of fewer than `RUN_WORDS` words may be left.

Null texts stay null. Rows that agree in id and text are one document, of which each row gets the same text; null ids come last in the order.
Empty texts and empty tables have no chunks. Columns other than text and n_chars are passed on as they are, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refloom.llm.common import broadcast_if_small, keyed, lean
from refloom.sources.shared import stored

CHUNK_WORDS, RUN_WORDS = 20, 30
#: Characters of text whose lines are worked on at once.
PART_CHARS = 1 << 19
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def _powers(base: int, n: int) -> np.ndarray:
    return np.r_[np.uint64(1), np.cumprod(np.full(n, base, np.uint64), dtype=np.uint64)]


def window_hashes(hashes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Equal for equal lines, wherever they stand: a polynomial in the lines' hashes, from sums up to each line."""
    n = len(hashes)
    sums = np.r_[np.uint64(0), np.cumsum(hashes * _powers(_BASE, n)[:n], dtype=np.uint64)]
    raw = (sums[b] - sums[a]) * _powers(_INVERSE, n)[a] + (b - a).astype(np.uint64) * np.uint64(_BASE)
    raw = (raw ^ raw >> np.uint64(32)) * _MIX  # so that the least hash has nothing to do with the number of lines
    return raw ^ raw >> np.uint64(29)


def chunks(hashes: np.ndarray, words: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first line, line after the last, hash) of each chunk, of the lines of several texts; `ends` is where the text of each line ends."""
    n = len(words)
    upto, at = np.r_[0, np.cumsum(words)], np.arange(n)
    first_after = lambda least: np.searchsorted(upto, upto[:-1] + least)
    after = first_after(CHUNK_WORDS)
    inside = after <= ends
    # Of the runs that end together the last to start is shortest.
    shortest = inside & np.r_[after[1:] != after[:-1], np.ones(min(n, 1), bool)]
    a, b = at[shortest], after[shortest]
    g = window_hashes(hashes, a, b)
    run = first_after(RUN_WORDS)
    starts = at[run <= ends]
    low, high = np.searchsorted(a, starts), np.searchsorted(b, run[starts], "right")
    best = low.copy()
    for more in range(1, int((high - low).max(initial=1))):
        other = np.minimum(low + more, high - 1)
        best = np.where(g[other] <= g[best], other, best)
    chosen = np.unique(best)
    return a[chosen], b[chosen], g[chosen]


def _read_lines(bodies: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, words) of each line of the texts, and how many lines each text has."""
    lines = [body.encode().split(b"\n") for body in bodies]
    sizes = np.fromiter(map(len, lines), np.int64, len(lines))
    flat = [line for of in lines for line in of]
    hashes = np.fromiter((xxhash.xxh64_intdigest(line, 7) for line in flat), np.uint64, len(flat))
    return hashes, np.fromiter((len(line.split()) for line in flat), np.int64, len(flat)), sizes


def _parts(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Slices of about PART_CHARS characters, a row at the least."""
    at, held = 0, 0
    for i, body in enumerate(batch.column(column)):
        held += len(body.as_buffer() or b"")
        if held >= PART_CHARS or i + 1 == batch.num_rows:
            yield batch.slice(at, i + 1 - at)
            at, held = i + 1, 0


def chunk_rows(texts: DataFrame) -> DataFrame:
    """A row for each chunk: k_id, k_text, hash, line, after, n_lines (of its text)."""
    schema = texts.select("k_id", "k_text").schema.add("hash", "long").add("line", "integer").add("after", "integer").add("n_lines", "integer")

    @lean
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch, 2):
                hashes, words, sizes = _read_lines(part.column(2).to_pylist())
                upto = np.cumsum(sizes)
                of = np.repeat(np.arange(len(sizes)), sizes)
                a, b, g = chunks(hashes, words, upto[of])
                of, start = of[a], (upto - sizes)[of[a]]
                index = pa.array(of)
                columns = [part.column(0).take(index), part.column(1).take(index), pa.array(g.view(np.int64)), *(pa.array(x.astype(np.int32)) for x in (a - start, b - start, sizes[of]))]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return texts.mapInArrow(task, schema)


def _followed(rows: DataFrame) -> DataFrame:
    """(k_id, k_text, f_id, f_text, by, line, after): the runs of lines about the seeds in which the texts agree. rows: (k_id, k_text, f_id, f_text, by, seeds, own, other), the last two
    the hashes of the lines of one text, and of those lines of the other that are `by` lines further; null where it has none."""
    keep = ["k_id", "k_text", "f_id", "f_text", "by"]
    schema = rows.select(*keep).schema.add("line", "integer").add("after", "integer")

    @lean
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index, starts, stops = [], [], []
            for i in range(batch.num_rows):
                seeds, own, other = (batch.column(c)[i].values for c in (5, 6, 7))
                seeds, own = seeds.to_numpy(zero_copy_only=False), own.to_numpy(zero_copy_only=False)
                there = ~other.is_null().to_numpy(zero_copy_only=False)
                same = there & (own == other.fill_null(0).to_numpy(zero_copy_only=False))
                edges = np.flatnonzero(np.diff(np.r_[False, same, False]))
                for run in np.unique(np.searchsorted(edges[::2], seeds, "right") - 1):
                    index.append(i)
                    starts.append(edges[2 * run])
                    stops.append(edges[2 * run + 1])
            at = pa.array(index, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in range(5)), pa.array(starts, pa.int32()), pa.array(stops, pa.int32())], names=schema.names)

    return rows.select(*keep, "seeds", "own", "other").mapInArrow(task, schema)


def _merged(spans: Column) -> Column:
    """Sorted (line, after) spans, those that touch or overlap made one."""

    def step(done: Column, s: Column) -> Column:
        last = F.element_at(done, -1)
        longer = F.struct(last["line"].alias("line"), F.greatest(last["after"], s["after"]).alias("after"))
        return F.when((F.size(done) > 0) & (F.get(done, F.size(done) - 1)["after"] >= s["line"]), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(longer))).otherwise(F.concat(done, F.array(s)))

    return F.aggregate(spans, F.array().cast("array<struct<line:int,after:int>>"), step)


def _of(rows: DataFrame, key: DataFrame, k_id: str, k_text: str) -> Column:
    return rows["k_id"].eqNullSafe(key[k_id]) & (rows["k_text"] == key[k_text])


def _agreeing(texts: DataFrame) -> DataFrame:
    """(k_id, k_text, f_id, f_text, by, line, after): runs of lines that an earlier place holds, by the hashes of lines."""
    rows = stored(chunk_rows(texts), "chunks")
    place = F.struct(F.col("k_id").isNull().alias("no_id"), "k_id", "k_text", "line")
    repeated = rows.groupBy(F.col("hash").alias("of")).agg(F.min(place).alias("first"), F.max(place).alias("last")).where(~F.col("first").eqNullSafe(F.col("last")))
    repeated = broadcast_if_small(stored(repeated.select("of", "first"), "repeated-hashes"))
    found = rows.join(repeated, F.col("hash") == F.col("of")).where(~place.eqNullSafe(F.col("first")))
    found = found.select("k_id", "k_text", "n_lines", F.col("first.k_id").alias("f_id"), F.col("first.k_text").alias("f_text"), (F.col("first.line") - F.col("line")).alias("by"), "line")
    pairs = stored(found.groupBy("k_id", "k_text", "n_lines", "f_id", "f_text", "by").agg(F.array_sort(F.collect_set("line")).alias("seeds")), "seeds")
    touched = pairs.select(F.col("k_id").alias("t_id"), F.col("k_text").alias("t_text")).union(pairs.select("f_id", "f_text")).distinct()
    touched = broadcast_if_small(stored(touched, "touched"))
    line_hashes = F.transform(F.split("body", "\n"), lambda x: F.xxhash64(x)).alias("lines")
    lines = stored(texts.join(touched, _of(texts, touched, "t_id", "t_text"), "left_semi").select("k_id", "k_text", line_hashes).dropDuplicates(["k_id", "k_text"]), "line-hashes")
    first = lines.select(F.col("k_id").alias("g_id"), F.col("k_text").alias("g_text"), F.col("lines").alias("there"))
    rows = pairs.join(first, pairs["f_id"].eqNullSafe(first["g_id"]) & (pairs["f_text"] == first["g_text"]))
    # Only those lines of the earlier text go on that lie beside the later one.
    start, n = F.greatest(F.col("by"), F.lit(0)), F.col("n_lines")
    lead = F.array_repeat(F.lit(None).cast("long"), F.greatest(-F.col("by"), F.lit(0)))
    beside = F.slice("there", start + 1, F.greatest(n - F.greatest(-F.col("by"), F.lit(0)), F.lit(0)))
    padded = F.concat(lead, beside)
    padded = F.slice(F.concat(padded, F.array_repeat(F.lit(None).cast("long"), F.greatest(n - F.size(padded), F.lit(0)))), 1, n)
    rows = rows.select("k_id", "k_text", "f_id", "f_text", "by", "seeds", padded.alias("other"))
    own = lines.select(F.col("k_id").alias("h_id"), F.col("k_text").alias("h_text"), F.col("lines").alias("own"))
    return _followed(rows.join(own, _of(rows, own, "h_id", "h_text")).select("k_id", "k_text", "f_id", "f_text", "by", "seeds", "own", "other"))


def repeated_chunks(docs: DataFrame) -> DataFrame:
    """(k_id, k_text, line, after): the runs of lines that equal an earlier one, byte by byte."""
    texts = keyed(docs)
    runs = stored(_agreeing(texts).distinct(), "repeated-runs")
    # What repeats and what is repeated are cut from the texts in one pass, and meet by the hash of the earlier place and the length.
    n, f_line = F.col("after") - F.col("line"), F.col("line") + F.col("by")
    runs = runs.withColumn("n", n).withColumn("f_line", f_line).withColumn("pair", F.xxhash64("f_id", "f_text", "f_line", "n"))
    later = runs.select("k_id", "k_text", F.lit(False).alias("is_first"), "line", "n", "pair")
    first = runs.select(F.col("f_id").alias("k_id"), F.col("f_text").alias("k_text"), F.lit(True).alias("is_first"), F.col("f_line").alias("line"), "n", "pair")
    wanted = later.union(first.distinct()).groupBy(F.col("k_id").alias("w_id"), F.col("k_text").alias("w_text"))
    wanted = broadcast_if_small(stored(wanted.agg(F.collect_list(F.struct("is_first", "line", "n", "pair")).alias("wanted")), "wanted"))
    rows = texts.join(wanted, _of(texts, wanted, "w_id", "w_text"))
    cut = rows.select("k_id", "k_text", F.split("body", "\n").alias("lines"), "wanted")
    content = lambda w: F.array_join(F.slice("lines", w["line"] + 1, w["n"]), "\n")
    cut = cut.select("k_id", "k_text", F.inline(F.transform("wanted", lambda w: F.struct(*(w[c].alias(c) for c in ("is_first", "line", "n", "pair")), content(w).alias("content")))))
    cut = stored(cut, "repeated-chunks")
    # Rows that agree in id and text give the first one more than once, and places whose hashes agree give several; what is cut has to equal one of them.
    as_first = cut.where("is_first").select(F.col("pair").alias("a_pair"), F.col("content").alias("as")).distinct()
    return cut.where("not is_first").join(as_first, (F.col("pair") == F.col("a_pair")) & (F.col("content") == F.col("as"))).select("k_id", "k_text", "line", (F.col("line") + F.col("n")).alias("after"))


def without(docs: DataFrame, gone: DataFrame, count: str | None) -> DataFrame:
    """The documents without the spans of lines in gone, with the new n_chars and, if named, how many lines went."""
    spans = gone.groupBy(F.col("k_id").alias("g_id"), F.col("k_text").alias("g_text")).agg(_merged(F.array_sort(F.collect_set(F.struct("line", "after")))).alias("spans"))
    spans = broadcast_if_small(stored(spans, "removed-lines"))
    key = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    rows = docs.join(spans, docs["doc_id"].eqNullSafe(spans["g_id"]) & (key == spans["g_text"]), "left")
    # What stays lies between the spans: from the end of one to the start of the next.
    lines, s = F.split(docs["text"], "\n"), spans["spans"]
    starts = F.concat(F.array(F.lit(0)), F.transform(s, lambda g: g["after"]))
    stops = F.concat(F.transform(s, lambda g: g["line"]), F.array(F.size(lines)))
    left = F.flatten(F.zip_with(starts, stops, lambda a, b: F.slice(lines, a + 1, F.greatest(b - a, F.lit(0)))))
    text = F.when(s.isNull(), docs["text"]).otherwise(F.array_join(left, "\n"))
    removed = F.aggregate(F.coalesce(s, F.array().cast("array<struct<line:int,after:int>>")), F.lit(0), lambda n, g: n + g["after"] - g["line"])
    own = {"text": text, "n_chars": F.coalesce(F.length(text), F.lit(0)).cast("long")}
    return rows.select(*(own.get(c, docs[f"`{c}`"]).alias(c) for c in docs.columns), *([removed.alias(count)] if count else []))


def dedup_lines(docs: DataFrame, count: str | None = None) -> DataFrame:
    """The documents without repeated passages; n_chars, if it is there, is the length of the new text. `count` names a column for the number of lines removed."""
    if count in docs.columns:
        raise ValueError(f"the documents have a column {count!r} of their own")
    return without(docs, repeated_chunks(docs), count)
