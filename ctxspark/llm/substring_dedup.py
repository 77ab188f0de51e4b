"""Exact duplicate substrings by prefix-free parsing.

A rolling hash of TRIGGER bytes is a trigger where it is the smallest among the next REACH positions; triggers cut texts
into phrases, and equal passages are cut alike. Every string of WIDTH bytes has a first trigger within REACH bytes, and
is a phrase's suffix (before the trigger) followed by the parse (after it): two strings are equal if and only if these
are. The parse is a table with a row for each phrase: the hash of the bytes that all strings of the phrase share after
the trigger (its parse suffix), and the hash of all bytes of all its strings.

Sorting real suffixes would write hundreds of bytes for each phrase. Here the order of parse suffixes, then of phrase
suffixes, is that of their hashes: strings with equal WIDTH bytes, the only neighbours that matter, are adjacent in
either order, and a hash has 8 bytes. Only phrases whose parse suffix repeats go on; those that repeat as a whole
(nearly all, in repetitive text) are settled at once; for the others, the dictionary, their strings are ordered one by
one. Hashes have 64 bits.

Null text counts as empty; texts shorter than WIDTH lose nothing; equal texts of WIDTH bytes or more lose everything.
Matches never cross documents, a text may match itself, overlaps count. Repeated rows count as repeats. Empty tables
give empty results; extra columns are ignored."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import load, materialize
from .shingles import first_least, mixed

WIDTH, REACH, TRIGGER = 400, 160, 24
CORE = WIDTH - REACH + 1
#: Bytes that a task hashes at once; a longer text is a chunk of its own.
CHUNK = 1 << 20
BASE = 0x5851F42D4C957F2D
_RNG = np.random.default_rng(20240)
BYTES = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    """Powers 0 to n of the base and of its inverse, modulo 2^64."""
    if not _POWERS or len(_POWERS[0]) <= n:
        size = max(n, CHUNK + 200_000) + 1
        _POWERS[:] = []
        for x in (BASE, pow(BASE, -1, 1 << 64)):
            p = np.full(size, np.uint64(x))
            p[0] = 1
            _POWERS.append(np.cumprod(p, dtype=np.uint64))
    return _POWERS


class Rolled:
    """Hashes of substrings of some bytes, equal for equal strings wherever they are."""

    def __init__(self, data: np.ndarray):
        up, self.down = _powers(len(data))
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTES[data] * up[: len(data)], dtype=np.uint64)])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.down[start])


def _chunks(texts: list[bytes]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """Texts of WIDTH bytes or more in runs: (numbers, bytes, start of each and the end)."""
    own, total = [], 0
    for n, t in enumerate(texts):
        if len(t) >= WIDTH:
            own.append(n)
            total += len(t)
        if own and (total >= CHUNK or n == len(texts) - 1):
            yield own, np.frombuffer(b"".join(texts[i] for i in own), np.uint8), np.cumsum([0, *(len(texts[i]) for i in own)])
            own, total = [], 0
    if own:
        yield own, np.frombuffer(b"".join(texts[i] for i in own), np.uint8), np.cumsum([0, *(len(texts[i]) for i in own)])


def parse(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """The phrases of texts: text number, parse-suffix hash, whole hash, first and last start of its strings."""
    out: list[tuple[np.ndarray, ...]] = []
    for own, data, at in _chunks(texts):
        rolled = Rolled(data)
        pos = np.arange(len(data) - TRIGGER + 1)
        start = np.concatenate([np.arange(a, b - WIDTH + 1) for a, b in zip(at[:-1], at[1:], strict=True)])
        trigger = first_least(rolled.hash(pos, pos + TRIGGER), start, REACH)
        first = np.flatnonzero(np.concatenate([[True], trigger[1:] != trigger[:-1]]))
        lo, hi, b = start[first], start[np.append(first[1:], len(start)) - 1], trigger[first]
        of = np.searchsorted(at, lo, "right") - 1
        whole = rolled.hash(lo, hi + WIDTH) ^ mixed((b - lo).astype(np.uint64) << np.uint64(20) | (hi - lo).astype(np.uint64))
        out.append((np.array(own)[of], rolled.hash(b, b + CORE), whole, lo - at[of], hi - at[of]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else tuple(np.zeros(0, np.int64) for _ in range(5))


def _bytes(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def _phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        of, core, whole, lo, hi = parse(_bytes(b.column(1)))
        if len(of):
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(of)), pa.array(core.view(np.int64)), pa.array(whole.view(np.int64)), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32))], names=["_key", "core", "whole", "lo", "hi"])


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each (key, text, spans): the hash of each string that starts in a span, with its place where the span is open."""
    for b in batches:
        for key, text, spans in zip(b.column(0).to_pylist(), _bytes(b.column(1)), b.column(2).to_pylist(), strict=True):
            rolled = Rolled(np.frombuffer(text, np.uint8))
            at = np.concatenate([np.arange(s["lo"], s["hi"] + 1) for s in spans])
            open_ = np.concatenate([np.full(s["hi"] + 1 - s["lo"], s["open"]) for s in spans])
            yield pa.RecordBatch.from_arrays([pa.array(rolled.hash(at, at + WIDTH).view(np.int64)), pa.array(np.full(len(at), key, np.int64), mask=~open_), pa.array(at.astype(np.int32), mask=~open_)], names=["string", "_key", "at"])


def removed(lo: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
    """The maximal runs that intervals [lo, end) cover."""
    order = np.argsort(lo, kind="stable")
    lo, end = lo[order], np.maximum.accumulate(end[order])
    new = np.concatenate([[True], lo[1:] > end[:-1]])
    first = np.flatnonzero(new)
    return list(zip(lo[first].tolist(), end[np.append(first[1:], len(lo)) - 1].tolist(), strict=True))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for text, spans in zip(_bytes(b.column(1)), b.column(2).to_pylist(), strict=True):
            runs = removed(np.array([s["lo"] for s in spans]), np.array([s["end"] for s in spans])) if spans else []
            kept, at = hashlib.sha256(), 0
            for lo, end in runs:
                kept.update(text[at:lo])
                at = end
            kept.update(text[at:])
            rows.append((len(text), sum(e - s for s, e in runs), len(runs), kept.hexdigest(), runs))
        n, gone, k, sha, runs = map(list, zip(*rows, strict=True)) if rows else ([],) * 5
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(k, pa.int64()), pa.array(sha, pa.string()), pa.array([[{"lo": s, "end": e} for s, e in r] for r in runs], pa.list_(pa.struct([("lo", pa.int64()), ("end", pa.int64())])))], names=[b.schema.names[0], "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])


def spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """(_key, spans): for each text's 64-bit hash, intervals [lo, end) of bytes whose union is what goes."""
    rows = docs.select(F.xxhash64(F.col(text)).alias("_key"), F.col(text).alias("_text")).where(F.octet_length("_text") >= WIDTH)
    # parsed twice, for the counts and for the rows: cheaper than a table of all phrases
    phrases = rows.mapInArrow(_phrases, "_key long, core long, whole long, lo int, hi int")
    again = phrases.groupBy("core").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("core")
    again = materialize(again, free=False)  # a table of its own: the join on a hot core can be split
    table = materialize(phrases.join(again, "core"), free=False)
    count = table.groupBy("core", "whole").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("_key", "lo", "hi")).alias("one"))
    count = materialize(count, free=False)
    settled = table.join(count.where("n > 1").select("core", "whole"), ["core", "whole"], "left_semi").select("_key", "lo", (F.col("hi") + WIDTH).alias("end")).distinct()
    alone = count.where("n = 1").select("core", "one.*", F.lit(True).alias("open"))
    others = count.where("n > 1").join(alone.select("core"), "core", "left_semi").select("core", "one.*", F.lit(False).alias("open"))
    need = alone.unionByName(others).groupBy("_key").agg(F.collect_list(F.struct("lo", "hi", "open")).alias("spans"))
    strings = materialize(rows.join(need, "_key").mapInArrow(_strings, "string long, _key long, at int"), free=False)
    twice = strings.groupBy("string").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("string")
    found = strings.where("at IS NOT NULL").join(twice, "string", "left_semi").select("_key", F.col("at").alias("lo"), (F.col("at") + WIDTH).alias("end"))
    return settled.unionByName(found).groupBy("_key").agg(F.collect_list(F.struct("lo", "end")).alias("spans"))  # a text's own length bounds the list


def dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id_col, n_bytes, n_removed, n_spans, kept_sha256 and the removed spans for every row of docs."""
    kind = dict(docs.dtypes)[id_col]
    own = docs.select(id_col, F.col(text).alias("_text"), F.xxhash64(F.col(text)).alias("_key"))
    cut = own.join(spans(docs, text), "_key", "left").select(id_col, "_text", "spans")
    return cut.mapInArrow(_cut, f"`{id_col}` {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<lo long, end long>>")


def op5_pfp_substrings(spark, sf_dir: str) -> DataFrame:
    return dedup(load(spark, sf_dir, "documents", "doc_id", "text")).drop("spans")
