"""Benchmark decontamination by spaced-seed hashing.

A mask selects 6 of 7 to 10 consecutive words; the hash of the selected words doesn't see the others, so a hit survives
substituted words. Training positions whose hash meets a benchmark hash are aligned with the item, without gaps, and
words around the hit are compared: a document is contaminated by an item if some stretch of the alignment of at least
LEAST words (the whole item if shorter) has SHARE equal words or more.

The benchmark comes in blocks of a fixed number of words, so what a task holds is bounded whatever the benchmark's
size; each block meets all documents in one scan, with no shuffle of texts. Items of fewer than ten words are sought
whole, all words equal; items of fewer than five are no evidence and are ignored.

Null and empty texts and items match nothing; a null item_id counts as the largest number. Repeated rows are each judged; the report has one row for a doc_id. Empty
tables give empty results; extra columns are ignored (report) or kept (clean)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import load
from .shingles import chunks, mixed, word_hashes

#: Of each mask: which consecutive words it selects. Chosen by enumeration so that any stretch of SPAN to 25 words with SHARE
#: equal words is hit, wherever the others stand; a longer one holds such a stretch of LEAST words or more in one of its halves.
MASKS = ("1111011", "110010111", "1110100011", "1011111", "1110111", "111100101")
SPAN, LEAST, SHARE, SHORTEST = 10, 13, 0.8, 5
#: Words of the benchmark that a task holds at once.
BLOCK = 500_000
BITS = 20
#: Hits of a mask that are expanded at once, about.
HITS = 1 << 20
#: What a null id counts as.
LAST = (1 << 63) - 1


class Seeds:
    """The benchmark's hashes of one block, sorted, with where they come from."""

    def __init__(self, items: list[tuple[int, np.ndarray]]):
        self.items = [(i, w) for i, w in items if len(w) >= SHORTEST]
        every = [w for _, w in self.items]
        self.tables = {}
        for key in [*MASKS, *sorted({"1" * len(w) for w in every if len(w) < SPAN})]:
            own = [(n, w) for n, w in enumerate(every) if (len(w) >= SPAN if key in MASKS else len(w) == len(key))]
            if not own:
                continue
            h = [seeds(w, key) for _, w in own]
            all_h = np.concatenate(h)
            item = np.concatenate([np.full(len(x), n) for (n, _), x in zip(own, h, strict=True)])
            at = np.concatenate([np.arange(len(x)) for x in h])
            order = np.argsort(all_h, kind="stable")
            sieve = np.zeros(1 << BITS, bool)
            sieve[all_h >> np.uint64(64 - BITS)] = True
            self.tables[key] = (all_h[order], item[order], at[order], sieve)

    def hits(self, words: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Distinct (text, item number, first word of the item in words) of hits within one text, texts ending at ends; the
        item may begin and end outside its text."""
        found = []
        for key, (table, item, at, sieve) in self.tables.items():
            h = seeds(words, key)
            every = np.flatnonzero(sieve[h >> np.uint64(64 - BITS)])
            every = every[every + len(key) <= ends[np.searchsorted(ends, every, "right")]]
            lows, n = np.searchsorted(table, h[every], "left"), np.searchsorted(table, h[every], "right")
            n -= lows
            every, lows, n = every[n > 0], lows[n > 0], n[n > 0]
            cuts = np.flatnonzero(np.diff((np.cumsum(n) - n) // HITS)) + 1  # a seed of many items: some positions at a time
            for pos, lo, m in zip(np.split(every, cuts), np.split(lows, cuts), np.split(n, cuts), strict=True):
                pos, lo = np.repeat(pos, m), np.repeat(lo, m)
                entry = lo + np.arange(len(lo)) - np.repeat(np.cumsum(m) - m, m)
                found.append(np.unique(np.stack([np.searchsorted(ends, pos, "right"), item[entry], pos - at[entry]], 1), axis=0))
        return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 3), int)


def seeds(words: np.ndarray, mask: str) -> np.ndarray:
    """The mask's hash at each start."""
    n = len(words) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(n, np.uint64(len(mask)))
    for j, c in enumerate(mask):
        if c == "1":
            h = (h + words[j : j + n]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
    return mixed(h)


def overlap(item: np.ndarray, words: np.ndarray, start: int) -> tuple[int, float]:
    """The longest stretch of the alignment with SHARE equal words that begins and ends with one: (words, share); 0 if none
    is long enough. Each stretch of LEAST words is tried, and those that pass are joined as long as the whole passes."""
    lo, hi = max(0, -start), min(len(item), len(words) - start)
    least = min(LEAST, len(item))
    if hi - lo < least:
        return 0, 0.0
    same = np.concatenate([[0], np.cumsum(item[lo:hi] == words[start + lo : start + hi])])
    if len(item) < SPAN:
        return (len(item), 1.0) if same[-1] == len(item) else (0, 0.0)
    n = hi - lo
    for length in range(n, least - 1, -1):  # an item's own length bounds this
        share = (same[length:] - same[: n - length + 1]).max() / length
        if share >= SHARE:
            return length, float(share)
    return 0, 0.0


def judge(texts: list[str | None], found: Seeds) -> list[list[tuple[int, int, float]]]:
    """For each text: (item_id, words, share) of each item that contaminates it."""
    out: list[dict[int, tuple[int, float]]] = [{} for _ in texts]
    for first, words, counts in chunks(texts):
        ends = np.cumsum(counts)
        for doc, n, start in found.hits(words, ends):
            item_id, item = found.items[n]
            lo, hi = ends[doc] - counts[doc], ends[doc]
            length, share = overlap(item, words[lo:hi], int(start - lo))
            if length and (length, share) > out[first + doc].get(item_id, (0, 0.0)):
                out[first + doc][item_id] = (length, share)
    return [[(i, *x) for i, x in sorted(d.items())] for d in out]


def blocks(benchmark: DataFrame, id_col: str = "item_id", text: str = "text", block: int = BLOCK) -> Iterator[list[tuple[int, np.ndarray]]]:
    """The benchmark in runs of about block words; the driver holds one at a time."""
    own, total = [], 0
    for r in benchmark.select(id_col, text).toLocalIterator(prefetchPartitions=False):
        own.append((LAST if r[0] is None else r[0], word_hashes(r[1])))
        total += len(own[-1][1])
        if total >= block:
            yield own
            own, total = [], 0
    if own:
        yield own


def report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each contaminated document: id_col, n_items, item_ids, longest (words) and share (of that stretch)."""
    spark, out = docs.sparkSession, None
    kind = dict(docs.dtypes)[id_col]
    for own in blocks(benchmark):
        found = spark.sparkContext.broadcast(Seeds(own))  # BLOCK words at most

        def scan(batches: Iterator[pa.RecordBatch], found=found) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows = [(x, *y) for x, ys in zip(b.column(0).to_pylist(), judge(b.column(1).to_pylist(), found.value), strict=True) for y in ys]
                if rows:
                    ids, items, words, share = map(list, zip(*rows, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(ids, b.schema.field(0).type), pa.array(items, pa.int64()), pa.array(words, pa.int64()), pa.array(share)], names=[id_col, "item_id", "words", "share"])

        part = docs.select(id_col, text).mapInArrow(scan, f"`{id_col}` {kind}, item_id long, words long, share double")
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = docs.select(id_col, F.lit(0).cast("long").alias("item_id"), F.lit(0).cast("long").alias("words"), F.lit(0.0).alias("share")).limit(0)
    best = F.max(F.struct("words", "share"))
    return out.groupBy(id_col).agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"), best.alias("best")).select(id_col, F.size("item_ids").cast("long").alias("n_items"), "item_ids", F.col("best.words").alias("longest"), F.col("best.share").alias("share"))


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The documents that no item contaminates, whole, with all their columns."""
    spark = docs.sparkSession
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))  # any names
    for own in blocks(benchmark):
        found = spark.sparkContext.broadcast(Seeds(own))  # BLOCK words at most

        def keep(batches: Iterator[pa.RecordBatch], found=found) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield b.filter(pa.array([not x for x in judge(b.column(0).field(text).to_pylist(), found.value)], pa.bool_()))

        rows = rows.mapInArrow(keep, rows.schema)
    return rows.select("row.*")


def op1_spaced_seeds(spark, sf_dir: str) -> DataFrame:
    return report(load(spark, sf_dir, "documents", "doc_id", "text"), load(spark, sf_dir, "benchmark"))
