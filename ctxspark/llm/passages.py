"""Near-duplicate passages by MinHash banding of paragraphs.

Paragraphs are of two kinds. Each line with a word is one, whatever its length, and so is a whole text of several lines
that is too short for the second kind. Copied passages also begin anywhere in a line and run over line ends, so WINDOW words from an anchor are one
too: the place of the least shingle hash among REACH places. Any WINDOW + REACH - 1 words in a row hold an anchor with
its whole window, the same one wherever they stand; shorter passages within lines are met by chance. A window is a node
by its words, so windows link where they are equal: one with a changed word beyond its outer two falls short of the
threshold anyway, and its unchanged part holds shorter windows.

Lines are banded: BANDS bands of ROWS MinHash values (two values, four bands: a pair of Jaccard similarity 0.8 meets with
probability 0.98, one of 0.9 with 0.999) deal different lines to buckets, near_dup.linked verifies exact Jaccard
similarity, and components are the classes. Nothing is left out before the bands. Of a class that occurs in two or more
documents, the document with the smallest id keeps its paragraph and the others lose theirs.

Up to the verification only hashes and places move: texts are shuffled once, for lines that share a bucket with another
line. Null text counts as empty; a line of fewer than K words is one shingle. Rows with one id are one document; a class
within one document is no repeat across documents and stays. A null id counts as the largest number. Empty tables give
empty results; extra columns are ignored."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import load, materialize
from .near_dup import _number, linked, sketches
from .shingles import CHUNK, GOLDEN, MIX_1, MIX_2, WORDS, first_least, mixed, shingles, step, word_hashes
from .substring_dedup import removed

K, WINDOW, REACH = 5, 20, 31
BANDS, ROWS = 4, 2
#: MinHash values of sketches, and agreement that makes a link likely (short ones) or below which there is none (long ones,
#: four deviations).
COORDS, FINE, SURE, LIKELY, CUT, THRESHOLD = 64, 400, 0.76, 0.79, 0.72, 0.8


def lines(texts: list[str]) -> Iterator[tuple[int, np.ndarray, list[list[int]]]]:
    """Runs of texts as (first text, all word hashes, word counts of each text's lines)."""
    first, own, counts, total = 0, [], [], 0
    for i, t in enumerate(texts):
        hashes = [word_hashes(x) for x in t.split("\n")]
        own += hashes
        counts.append([len(x) for x in hashes])
        total += sum(counts[-1])
        if total >= CHUNK:
            yield first, np.concatenate(own), counts
            first, own, counts, total = i + 1, [], [], 0
    if own:
        yield first, np.concatenate(own), counts


def anchors(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text number, first word, hash of all) of each window of texts given as word hashes."""
    at = np.cumsum([0, *counts])
    start = np.concatenate([np.arange(a, b - WINDOW - REACH + 2) for a, b in zip(at[:-1], at[1:], strict=True)] or [np.zeros(0)]).astype(np.int64)
    if not len(start):
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),)
    h = _grams(hashes)
    place = np.unique(first_least(h, start, REACH))
    of = np.searchsorted(at, place, "right") - 1
    node = np.zeros(len(place), np.uint64)
    for j in range(0, WINDOW - K + 1, K):
        node = mixed(node * MIX_1 + h[place + j])
    return of, place - at[of], node


def _grams(hashes: np.ndarray) -> np.ndarray:
    """Hashes of the shingles of K words at each place."""
    n = max(len(hashes) - K + 1, 0)
    h = np.zeros(n, np.uint64)
    for j in range(K):
        h = mixed(h * MIX_1 + hashes[j : j + n] + step(j + 1))
    return h


def whole(by_line: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, first word, words) of each line with a word, and of short texts of several lines."""
    of, start, n = [], [], []
    for i, counts in enumerate(by_line):
        total, at = sum(counts), 0
        if max(counts) < total < WINDOW + REACH - 1:
            of.append(i), start.append(0), n.append(total)
        for c in counts:
            if c:
                of.append(i), start.append(at), n.append(c)
            at += c
    return np.array(of, np.int64), np.array(start, np.int64), np.array(n, np.int64)


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The places of paragraphs: windows, and lines with their bands."""
    for b in batches:
        for first, words, by_line in lines(b.column(1).to_pylist()):
            counts = np.array([sum(x) for x in by_line])
            of, at, node = anchors(words, counts)
            if len(of):
                yield _places(b, first + of, at, np.full(len(of), WINDOW), node, pa.nulls(len(of), pa.list_(pa.int64())))
            of, at, n = whole(by_line)
            if len(n):
                start = at + (np.cumsum(counts) - counts)[of]
                own = np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())
                least, node = minima(words[own], n, BANDS * ROWS)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * BANDS), pa.array(bands(least).view(np.int64).ravel()))
                yield _places(b, first + of, at, n, node, lists)


def _places(b: pa.RecordBatch, of: np.ndarray, at: np.ndarray, n: np.ndarray, node: np.ndarray, lists: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([b.column(0).take(pa.array(of)), pa.array(at.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(node.view(np.int64)), lists], names=["_id", "at", "n", "node", "bands"])


def minima(hashes: np.ndarray, counts: np.ndarray, coords: int) -> tuple[np.ndarray, np.ndarray]:
    """((paragraphs, coords) MinHash values, hash of all) for paragraphs of one word or more, given as word hashes one after
    another; repeats of a shingle count as others, as in the similarity."""
    of, h = shingles(hashes, counts, K)
    starts = np.searchsorted(of, np.arange(len(counts)))
    place = (np.arange(len(h)) - starts[of]).astype(np.uint64)
    node = mixed(np.add.reduceat(mixed(h ^ mixed(place + GOLDEN)), starts) + counts.astype(np.uint64))
    order = np.lexsort((h, of))
    of, h = of[order], h[order]
    new = np.concatenate([[True], (of[1:] != of[:-1]) | (h[1:] != h[:-1])])
    run = np.flatnonzero(new)
    earlier = (np.arange(len(h)) - np.repeat(run, np.diff(np.append(run, len(h))))).astype(np.uint64)
    h = mixed(h + earlier * GOLDEN)
    return np.column_stack([np.minimum.reduceat(mixed(h ^ step(1000 + j)), starts) for j in range(coords)]), node


def bands(least: np.ndarray) -> np.ndarray:
    """(paragraphs, BANDS) bucket hashes of the first MinHash values."""
    out = np.broadcast_to(np.arange(BANDS, dtype=np.uint64) + np.uint64(77), (len(least), BANDS)).copy()
    for j in range(ROWS):
        out = mixed(out * MIX_2 + least[:, j : BANDS * ROWS : ROWS])
    return out


def _paragraphs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each (text, [(at, node)]): the nodes' words."""
    for b in batches:
        for text, places in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            words = WORDS.findall(text.lower())
            yield pa.RecordBatch.from_arrays([pa.array([p["node"] for p in places], pa.int64()), pa.array([" ".join(words[p["at"] : p["at"] + p["n"]]) for p in places])], names=["node", "text"])


def _least(texts: list[str], coords: int) -> np.ndarray:
    """(paragraphs, coords) MinHash values of paragraphs' words."""
    own = [word_hashes(t) for t in texts]
    return minima(np.concatenate(own), np.array([len(x) for x in own]), coords)[0]


def _sketched(batches: Iterator[pa.RecordBatch], coords: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, 1000):
            part = b.slice(at, 1000)
            yield pa.RecordBatch.from_arrays([part.column(0), sketches(_least(part.column(1).to_pylist(), coords))], names=["node", "sketch"])


def sketched(paragraphs: DataFrame, coords: int = FINE) -> DataFrame:
    """(node, sketch) of so many values for paragraphs(node, text)."""
    return paragraphs.select("node", "text").mapInArrow(partial(_sketched, coords=coords), "node long, sketch binary")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words that repeated and removed paragraphs cover, as runs."""
    for b in batches:
        out = []
        for found in b.column(1).to_pylist():
            runs = []
            for some in (found, [x for x in found if x["gone"]]):
                at = np.array([x["at"] for x in some], np.int64)
                runs.append(removed(at, at + np.array([x["n"] for x in some], np.int64)) if some else [])
            out.append((sum(e - s for s, e in runs[0]), sum(e - s for s, e in runs[1]), [{"lo": s, "end": e} for s, e in runs[0]], sorted({x["head"] for x in found})))
        many, gone, spans, heads = map(list, zip(*out, strict=True)) if out else ([],) * 4
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(many, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.list_(pa.struct([("lo", pa.int64()), ("end", pa.int64())]))), pa.array(heads, pa.list_(pa.int64()))], names=[b.schema.names[0], "n_repeated_words", "n_removed_words", "spans", "first_docs"])


def repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each document with a passage that another one has too: id_col, words in such passages, words removed, the
    passages' places (in words) and the documents that keep them. Of rows with one id, a row each."""
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(_number(id_col).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    places = materialize(rows.mapInArrow(_scanned, "_id long, at int, n int, node long, bands array<long>"))
    windows, own_lines = places.where("bands IS NULL").drop("bands"), places.where("bands IS NOT NULL")
    comp = materialize(_classes(rows, own_lines))
    joined = own_lines.drop("bands").join(comp, "node", "left").withColumn("node", F.coalesce("comp", "node")).drop("comp")
    placed = windows.unionByName(joined)
    several = placed.groupBy("node").agg(F.min("_id").alias("head"), F.max("_id").alias("last")).where("head < last").drop("last")
    several = materialize(several)  # a table of its own: the join on a hot paragraph can be split
    by_id = placed.join(several, "node").select("_id", "at", "n", "head").distinct().groupBy("_id").agg(F.collect_list(F.struct("at", "n", "head")).alias("found"))  # a text's own length bounds the list
    own = docs.select(F.col(id_col), _number(id_col).alias("_id"))
    marked = own.join(by_id, "_id").select(id_col, F.transform("found", lambda x: F.struct(x["at"].alias("at"), x["n"].alias("n"), x["head"].alias("head"), (x["head"] != F.col("_id")).alias("gone"))).alias("found"))
    return marked.mapInArrow(_runs, f"`{id_col}` {kind}, n_repeated_words long, n_removed_words long, spans array<struct<lo long, end long>>, first_docs array<long>")


def _classes(rows: DataFrame, own_lines: DataFrame) -> DataFrame:
    """(node, comp) of lines that are near another line."""
    banded = own_lines.select("node", F.explode("bands").alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi").select("bucket")
    members = materialize(banded.join(shared, "bucket").select("bucket", "node").distinct())
    wanted = own_lines.select("_id", "at", "n", "node").join(members.select("node").distinct(), "node")
    need = wanted.groupBy("node").agg(F.min(F.struct("_id", "at", "n")).alias("p")).select("p._id", F.struct("p.at", "p.n", "node").alias("place"))
    need = need.groupBy("_id").agg(F.collect_list("place").alias("places"))  # a text's own length bounds the list
    texts = materialize(rows.join(need, "_id").select("_text", "places").mapInArrow(_paragraphs, "node long, text string").dropDuplicates(["node"]))
    return linked(members.join(sketched(texts, COORDS), "node"), texts, sketched, K, THRESHOLD, SURE, LIKELY, CUT)


def op6_paragraph_minhash(spark, sf_dir: str) -> DataFrame:
    return repeats(load(spark, sf_dir, "documents", "doc_id", "text"))
