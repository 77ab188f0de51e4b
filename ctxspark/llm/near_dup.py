"""MinHash near-duplicates with DartMinHash signatures.

A unit (a text) is the weighted set of its shingles of K words, weights being their counts. Each unit of weight of a
shingle is a strip of the plane, in which hashed darts of rate 1 fall along the rank axis; a text sees the darts of its
own strips up to rank DARTS / weight, some DARTS darts whatever its length, each of which belongs to one coordinate.
The earliest dart of each coordinate is the signature; a coordinate without one looks twice as far. Two texts agree in
a coordinate with probability equal to their weighted Jaccard similarity.

Equal texts are one node. BANDS bands of ROWS coordinates deal nodes to buckets: a pair of similarity 0.8 shares none
with probability 7e-6. Within a bucket, sketches (a byte of each coordinate) pick the pairs to compare exactly, on whole
texts. The first round takes a spanning tree of likely links, which joins groups of copies of any size in as many pairs
as they have members; the second, with longer sketches of what is left, takes a spanning tree over the components that
still share a bucket; the third all links between such components that the longer sketches don't rule out. So no group's pairs are listed, and a link between
components is lost only if the sketches or bands fail, see SURE and CUT.

Null texts count as empty. Texts without words have no shingles: they are duplicates only of equal texts. Repeated rows
and equal texts share a class, whose id is its smallest document id; ties don't arise. Empty tables give empty results;
extra columns are ignored (classes) or kept (first_of_each)."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import load, materialize, ranked
from .components import components
from .shingles import GOLDEN, chunks, mixed, overlap, shingles, step, weighted

K, THRESHOLD = 5, 0.8
BANDS, ROWS = 30, 5
COORDS = BANDS * ROWS
#: Nodes of a bucket that a task holds at once, about; larger buckets are dealt into blocks that meet pair by pair.
BLOCK = 1024
#: Agreement of two sketches (a byte of each coordinate) that makes a link likely, short and long ones, and below which long
#: ones rule it out: a pair of similarity 0.8 agrees in 0.8 of 1,000 coordinates with a standard deviation of 0.013, so in
#: 0.755 but for one in 5,000, and links by others too.
SURE, LIKELY, CUT, FINE = 0.78, 0.79, 0.755, 1000


def signatures(texts: list[str | None], k: int = K, coords: int = COORDS) -> np.ndarray:
    """The signature of each text: coords hashes; all 0 for texts without words."""
    out = np.zeros((len(texts), coords), np.uint64)
    for first, words, counts in chunks(texts):
        of, h = shingles(words, counts, k)
        if len(h):
            of, h, c = weighted(of, h)
            out[first : first + len(counts)] = _darts(of, h, c, len(counts), coords)
    return out


def _darts(of: np.ndarray, h: np.ndarray, weight: np.ndarray, n: int, coords: int) -> np.ndarray:
    """Signatures of n sets given by (set, element hash, weight); weights may be fractions: a strip's last part is thinned."""
    total = np.bincount(of, weight, n)
    cells = np.ceil(weight).astype(np.int64)
    of, h, weight = np.repeat(of, cells), np.repeat(h, cells), np.repeat(weight, cells)
    strip = np.arange(len(of)) - np.repeat(np.cumsum(cells) - cells, cells)
    part = np.minimum(weight - strip, 1.0)
    cell = mixed(h + GOLDEN * (strip + 1).astype(np.uint64))
    limit = np.divide(darts(coords), total, out=np.zeros(n), where=total > 0)
    best, out = np.full(n * coords, np.inf), np.zeros(n * coords, np.uint64)
    todo = total > 0
    while todo.any():
        live = np.flatnonzero(todo[of])
        rank, seed, count = np.zeros(len(live)), cell[live], 0
        while len(live):
            count += 1
            dart = mixed(seed + step(count))
            rank = rank - np.log(((dart >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53))
            seen = rank <= limit[of[live]]
            live, rank, seed, dart = live[seen], rank[seen], seed[seen], mixed(dart[seen] + GOLDEN)
            inside = ((dart >> np.uint64(11)).astype(np.float64) / (1 << 53)) < part[live]
            use, r, d = live[inside], rank[inside], mixed(dart[inside])
            slot = of[use] * coords + (d % np.uint64(coords)).astype(np.int64)
            np.minimum.at(best, slot, r)
            won = best[slot] == r
            out[slot[won]] = d[won]
        todo &= np.isinf(best.reshape(n, coords)).any(1)
        limit = limit * 2
    return out.reshape(n, coords)


def band_hashes(sig: np.ndarray) -> np.ndarray:
    """(texts, BANDS) hashes of the bands' coordinates."""
    h = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (len(sig), BANDS)).copy()
    rows = sig.reshape(len(sig), BANDS, ROWS)
    for j in range(ROWS):
        h = mixed(h * GOLDEN + rows[:, :, j])
    return h


def darts(coords: int) -> float:
    """Darts that a text sees at first: enough that a coordinate is empty once in some seven texts."""
    return coords * (np.log(coords) + 2)


def sketches(sig: np.ndarray) -> pa.Array:
    """A byte of each coordinate."""
    return pa.array([x.tobytes() for x in (sig & np.uint64(255)).astype(np.uint8)], pa.binary())


def _finer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, 200):
            part = b.slice(at, 200)
            yield pa.RecordBatch.from_arrays([part.column(0), sketches(signatures(part.column(1).to_pylist(), K, FINE))], names=["node", "sketch"])


def finer(texts: DataFrame) -> DataFrame:
    """(node, sketch) of FINE coordinates for texts(node, text)."""
    return texts.mapInArrow(_finer, "node long, sketch binary")


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 1000):
            b = whole.slice(at, 1000)
            sig = signatures(b.column(2).to_pylist())
            bands = band_hashes(sig).astype(np.int64)
            have = sig.any(1)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(have * BANDS)]).astype(np.int32)), pa.array(bands[have].ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), lists, sketches(sig)], names=["_key", "_id", "_bands", "_sketch"])


def _compared(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """The similarity of each pair; a text is cut into shingles once a batch."""
    for whole in batches:
        for first in range(0, whole.num_rows, 500):
            b = whole.slice(first, 500)
            a_ids, b_ids = (b.column(c).to_numpy() for c in ("a", "b"))
            ids, place = np.unique(np.concatenate([a_ids, b_ids]), return_index=True)
            a_text, b_text = b.column("text_a"), b.column("text_b")
            texts = [(a_text[i] if i < b.num_rows else b_text[i - b.num_rows]).as_py() for i in place.tolist()]
            own: list[tuple[np.ndarray, np.ndarray]] = []
            for _, words, counts in chunks(texts):
                of, h, c = weighted(*shingles(words, counts, k))
                at = np.searchsorted(of, np.arange(len(counts) + 1))
                own += [(h[i:j], c[i:j]) for i, j in zip(at[:-1], at[1:], strict=True)]
            sims = [overlap(own[i], own[j]) for i, j in zip(np.searchsorted(ids, a_ids), np.searchsorted(ids, b_ids), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(sims, pa.float64())], names=["a", "b", "sim"])


def _promising(batches: Iterator[pa.RecordBatch], cut: float, tree: bool) -> Iterator[pa.RecordBatch]:
    """Pairs of different components whose sketches agree in cut of their bytes or more, from rows (bucket, i, j, own,
    node, comp, sketch) that come group by group, (bucket, i, j) being a group of two blocks at most; with tree, only
    pairs that join what the group's better pairs haven't joined, else (with their buckets in order as column shared) each
    pair from its first bucket alone."""
    tail: pa.Table | None = None

    def groups(t: pa.Table) -> pa.RecordBatch:
        bucket, i, j, own, node, comp = (t.column(c).to_numpy() for c in ("bucket", "i", "j", "own", "node", "comp"))
        sketch = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint8).reshape(t.num_rows, -1)
        new = np.flatnonzero(np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]))
        out: list[tuple[int, int]] = []
        shared = [] if tree else t.column("shared").to_pylist()

        def first(x: list[int], y: list[int]) -> int:
            return min({*x}.intersection(y))

        for lo, hi in zip(new.tolist(), [*new[1:].tolist(), t.num_rows], strict=True):
            s, c, o, n = sketch[lo:hi], comp[lo:hi], own[lo:hi], node[lo:hi]
            m, alone = hi - lo, i[lo] == j[lo]
            need = cut * s.shape[1]
            found: list[np.ndarray] = []
            for x in range(m - 1):
                same = np.count_nonzero(s[x + 1 :] == s[x], axis=1)
                ok = (same >= need) & (c[x + 1 :] != c[x])
                if not alone:
                    ok &= o[x + 1 :] != o[x]
                y = np.flatnonzero(ok)
                if len(y):
                    found.append(np.column_stack([np.full(len(y), x), y + x + 1, same[y]]))
            if not found:
                continue
            pairs = np.concatenate(found)
            if tree:
                root = {v: v for v in c.tolist()}

                def top(v: int, root=root) -> int:
                    while root[v] != v:
                        root[v] = v = root[root[v]]
                    return v

                left = len(root) - 1
                for x, y, _ in pairs[np.argsort(-pairs[:, 2], kind="stable")].tolist():
                    u, v = top(int(c[x])), top(int(c[y]))
                    if u != v:
                        root[u] = v
                        out.append((int(n[x]), int(n[y])))
                        left -= 1
                        if not left:
                            break
            else:
                b = int(bucket[lo])
                out += [(int(n[x]), int(n[y])) for x, y, _ in pairs.tolist() if first(shared[lo + x], shared[lo + y]) == b]
        a = np.array(out, np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(a.min(1)), pa.array(a.max(1))], names=["a", "b"])

    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        t = t if tail is None else pa.concat_tables([tail, t])
        last = [t.column(c).to_numpy() for c in ("bucket", "i", "j")]
        cut_at = int(np.flatnonzero(np.any([x != x[-1] for x in last], 0))[-1]) + 1 if any((x != x[-1]).any() for x in last) else 0
        tail = t.slice(cut_at)
        if cut_at:
            yield groups(t.slice(0, cut_at).combine_chunks())
    if tail is not None:
        yield groups(tail.combine_chunks())


def linked(members: DataFrame, texts: DataFrame, fine: Callable[[DataFrame], DataFrame] = finer, k: int = K, threshold: float = THRESHOLD, sure: float = SURE, likely: float = LIKELY, cut: float = CUT) -> DataFrame:
    """(node, comp): the components of the graph that links texts(node, text) of similarity threshold or more which share
    a bucket of members(bucket, node, sketch); fine makes longer sketches; nodes without a link may be missing."""
    compared = partial(_compared, k=k)
    blocks = members.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("nb"))
    dealt = members.join(blocks, "bucket").withColumn("own", F.pmod(F.xxhash64("node"), F.col("nb")).cast("int"))
    dealt = materialize(dealt)

    def pairs(rows: DataFrame, at_least: float, tree: bool) -> DataFrame:
        """rows: of dealt, with comp. Each block meets each block of its bucket in a group of their own."""
        more = [] if tree else ["shared"]
        each = F.explode(F.transform(F.sequence(F.lit(0), F.col("nb") - 1), lambda x: F.struct(F.least(x, F.col("own")).alias("i"), F.greatest(x, F.col("own")).alias("j"))))
        met = rows.select("bucket", "own", "node", "comp", "sketch", *more, each.alias("g")).select("bucket", "g.i", "g.j", "own", "node", "comp", "sketch", *more)
        met = met.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
        return met.mapInArrow(partial(_promising, cut=at_least, tree=tree), "a long, b long").distinct()

    def compare(some: DataFrame) -> DataFrame:
        one = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
        two = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
        return materialize(some.join(one, "a").join(two, "b").mapInArrow(compared, "a long, b long, sim double"))

    def component(sims: DataFrame) -> DataFrame:
        return components(sims.where(F.col("sim") >= threshold), "a", "b")

    def left(comp: DataFrame) -> DataFrame:
        """The rows of buckets that mix components."""
        placed = dealt.drop("sketch").join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        several = placed.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("bucket")
        return placed.join(several, "bucket", "left_semi")

    sims = compare(pairs(dealt.withColumn("comp", F.col("node")), sure, True))
    rest = materialize(left(component(sims)))
    better = materialize(fine(texts.join(rest.select("node").distinct(), "node").select("node", "text")))
    more = compare(pairs(rest.join(better, "node"), likely, True).join(sims, ["a", "b"], "left_anti"))
    sims = materialize(sims.unionByName(more))
    rest = materialize(left(component(sims)))
    buckets = rest.groupBy("node").agg(F.collect_set("bucket").alias("shared"))  # at most as many as bands
    more = compare(pairs(rest.join(better, "node").join(buckets, "node"), cut, False).join(sims, ["a", "b"], "left_anti"))
    return component(sims.unionByName(more))


def classes(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(_key, _rep, class_id, is_head) for each different text of docs: its hash, its smallest id, its class's smallest id
    and whether it is the text of that. A null id counts as the largest number."""
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.unhex(F.md5(t)).alias("_key"), _number(id_col).alias("_id"), t.alias("_text"))
    schema = "_key binary, _id long, _bands array<long>, _sketch binary"
    nodes = rows.mapInArrow(_signed, schema).groupBy("_key").agg(F.min("_id").alias("_rep"), F.first("_bands").alias("_bands"), F.first("_sketch").alias("sketch"))
    nodes = materialize(ranked(nodes, [F.col("_key")]).withColumnRenamed("_rank", "node"))

    banded = nodes.select("node", F.explode("_bands").alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket")
    members = materialize(banded.join(shared, "bucket"))
    used = materialize(nodes.join(members.select("node").distinct(), "node").select("node", F.col("_key").alias("k"), F.col("_rep").alias("r"), "sketch"))
    wanted = used.select("node", "k", "r")
    texts = rows.join(wanted, (F.col("_key") == F.col("k")) & (F.col("_id") == F.col("r"))).groupBy("k", "r", "node").agg(F.first("_text").alias("text"))
    texts = materialize(texts.select("node", "text"))

    comp = linked(members.join(used.select("node", "sketch"), "node"), texts)
    found = nodes.join(comp, "node", "left").select("_key", "_rep", F.coalesce("comp", "node").alias("comp"))
    heads = found.groupBy("comp").agg(F.min(F.struct("_rep", "_key")).alias("head"))
    return materialize(found.join(heads, "comp").select("_key", "_rep", F.col("head._rep").alias("class_id"), (F.col("_key") == F.col("head._key")).alias("is_head")))


def _number(id_col: str) -> Column:
    return F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1))


def labelled(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id_col and class_id for every row of docs."""
    own = docs.select(F.col(id_col), F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")))).alias("_key"))
    return own.join(classes(docs, id_col, text), "_key").select(id_col, "class_id")


def first_of_each(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each class, the one with the smallest id, with all its columns; of repeated rows, one."""
    heads = classes(docs, id_col, text).where("is_head").select("_key", F.col("_rep").alias("_head"))
    key = F.unhex(F.md5(F.coalesce(F.col(text), F.lit(""))))
    own = [F.col(f"`{c}`") for c in docs.columns]
    kept = docs.select(F.struct(*own).alias("_row"), key.alias("_key"), _number(id_col).alias("_head")).join(heads, ["_key", "_head"])
    return kept.groupBy("_key", "_head").agg(F.first("_row").alias("_row")).select("_row.*")


def op10_dart_minhash(spark, sf_dir: str) -> DataFrame:
    return labelled(load(spark, sf_dir, "documents", "doc_id", "text"))
