"""Each operator on small tables: against brute force, and on nulls, empty and very long texts, ties, repeated rows, empty
tables and extra columns with clashing names."""

import collections
import hashlib
import heapq
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ctxspark.llm import common, components, decontamination, html, mixing, near_dup, passages, quality, sharding, substring_dedup, tokens, warc
from ctxspark.llm.shingles import overlap, shingles, similarity, weighted, word_hashes

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, shard int, slot long, _key string, node long, kept boolean"


def prose(r: random.Random, n: int) -> str:
    return " ".join("".join(r.choices("abcdefghijklmnop", k=r.randint(3, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    r = random.Random(4)
    base = [prose(r, r.randint(60, 200)) for _ in range(30)]
    out = list(base)
    for b in base[:6]:  # near copies, a chain of them
        w = b.split(" ")
        for _ in range(3):
            w[r.randrange(len(w))] = "changed"
            out.append(" ".join(w))
    out += base[6:9]  # equal texts
    passage = prose(r, 70)
    out += [f"{prose(r, 30)} {passage} {prose(r, 30)}" for _ in range(4)]
    out += [None, "", " \n\t ", "one", "a b c", "x" * 2000, "word " * 3000, "line one\nline one\nline two\n\nline one", "$$$ ### " * 40, prose(r, 6000), "é ü 日本語 " * 30]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", f"s{i % 3}" if i % 7 else None, None, 5, 1, 2, "k", 3, True) for i, t in enumerate(texts)]
    rows += [rows[0], rows[0], (None, "no id here " * 20, None, None, None, 1, 1, 1, None, 1, False)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).persist()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def rows(df):
    return [tuple(r) for r in df.collect()]


def brute_quality(t):
    w, lines = WORD.findall(t or ""), [x for x in (t or "").split("\n") if WORD.search(x)]
    c = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    cover = {j for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), sum((t or "").count(x) for x in "#*$%&|<>"), len(lines) - len(set(lines)), len(cover)


def test_quality_counts(docs, empty):
    got = quality.judged(docs).collect()
    have = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert len(got) == docs.count()
    for q in got:
        want = brute_quality(have[q["doc_id"]])
        assert (q["n_words"], q["word_chars"], q["n_symbols"], q["n_dup_lines"], q["n_repeat_words"]) == want
        assert q["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (q["base_failed"] and q["kept"])
    assert quality.judged(empty).count() == 0
    kept = quality.filter_quality(docs)
    assert kept.columns == docs.columns and kept.where("text LIKE '%$$$%'").isEmpty() and kept.where("doc_id = 0").count() == 3
    clash = docs.select("*", *[F.lit(1).alias(c) for c in ("_quality", "_votes", "row", "q", "v", "f", "a.b")])
    assert sorted(quality.filter_quality(clash).drop("a.b").select(docs.columns).collect(), key=repr) == sorted(kept.collect(), key=repr)


def patterns(k, *bad):
    return tuple(-1 if i in bad else 1 for i in range(k))


def test_quality_em(spark):
    k = len(quality.RULES)
    n = {patterns(k): 900, patterns(k, 0, 1): 80, (0,) * k: 5, (0, *[1] * (k - 1)): 7, patterns(k, 3): 20}
    post = {tuple(r["v"]): r["p_good"] for r in quality.posteriors(spark.createDataFrame(list(n.items()), "v array<int>, n long")).collect()}
    want = brute_em(n, k)
    assert all(abs(post[v] - want[v]) < 1e-9 for v in want) and post[patterns(k)] > 0.5 > post[patterns(k, 0, 1)]


def test_no_rule_is_turned_round(spark):
    """Defects that exclude one another, some of them common and correlated: a bad vote never speaks for a document, and
    those of a rule that votes alone are bad too."""
    k = len(quality.RULES)
    for scale in (1, 1000):
        n = {patterns(k): 8500, patterns(k, 0): 700, patterns(k, 1, 3, 4): 300, patterns(k, 1, 2, 3, 4): 200, patterns(k, 1): 250, patterns(k, 5): 40, patterns(k, 6): 30, patterns(k, 1, 2): 50}
        n = {v: c * scale for v, c in n.items()}
        post = {tuple(r["v"]): r["p_good"] for r in quality.posteriors(spark.createDataFrame(list(n.items()), "v array<int>, n long")).collect()}
        best = post.pop(patterns(k))
        assert best > 0.9 and max(post.values()) < 0.5, post


def test_quality_of_labelled_documents(spark):
    """Of the labelled documents of the small tables that pass the base rules, the bad ones go and the good ones stay."""
    sf = "/root/testdata/sf0.01"
    q = quality.judged(common.load(spark, sf, "documents", "doc_id", "text")).join(common.load(spark, sf, "labels"), "doc_id").where("NOT base_failed")
    n = {(r["quality"], r["kept"]): r["count"] for r in q.groupBy("quality", "kept").count().collect()}
    assert n.get((0, False), 0) >= 0.95 * sum(c for (y, _), c in n.items() if y == 0) and n.get((1, True), 0) >= 0.97 * sum(c for (y, _), c in n.items() if y == 1)


def brute_em(n, k):
    bad, good, own, others = quality.START
    first = np.array([[good] * k] + [[own if r == c else others for r in range(k)] for c in range(k)])
    share0 = np.array([1 - bad] + [bad / k] * k)
    v, count = np.array(list(n)), np.array(list(n.values()), float)
    q, share = first, share0
    for _ in range(quality.ROUNDS + 1):
        like = np.exp(np.log(share) + (v[:, None, :] == -1) @ np.zeros(k) + np.where(v[:, None, :] == -1, np.log(q), np.where(v[:, None, :] == 1, np.log(1 - q), 0)).sum(2))
        w = like / like.sum(1, keepdims=True)
        mass = w * count[:, None]
        share = (mass.sum(0) + quality.SHARES * count.sum() * share0 + share0) / ((1 + quality.SHARES) * count.sum() + 1)
        seen, hit = mass.T @ (v != 0), mass.T @ (v == -1)
        anchored = np.vstack([np.ones(k), np.eye(k)])
        trust = quality.PRIOR * seen * anchored + 1
        q = (hit + trust * first) / (seen + trust)
        q = np.maximum(q, q[0])
    return dict(zip(n, w[:, 0], strict=True))


def test_decontamination(spark, docs, empty, texts):
    r = random.Random(9)
    w = texts[0].split(" ")
    near = w[10:40]
    near[12] = "other"
    bench = spark.createDataFrame([(1, " ".join(w[5:30])), (2, " ".join(near)), (3, prose(r, 30)), (4, None), (5, ""), (6, " ".join(texts[1].split(" ")[:7])), (7, "a b c"), (8, texts[2].upper()), (None, texts[3])], "item_id long, text string")
    got = {x["doc_id"]: x["item_ids"] for x in decontamination.report(docs, bench).collect()}
    copies = lambda n: {i for i, t in enumerate(texts) if t and brute_leak(t, bench_rows[n])}
    bench_rows = {b["item_id"]: b["text"] for b in bench.collect()}
    bench_rows[decontamination.LAST] = texts[3]
    for item in (1, 2, 6, 8, decontamination.LAST):
        assert {d for d, items in got.items() if item in items} == copies(item), item
    assert not any({3, 4, 5, 7} & set(x) for x in got.values())
    clean = decontamination.clean(docs, bench)
    assert clean.columns == docs.columns and clean.where(F.col("doc_id").isin([d for d in got])).isEmpty()
    assert decontamination.clean(docs.withColumn("a.b", F.lit(1)), bench).count() == clean.count()
    assert decontamination.report(empty, bench).count() == 0 and decontamination.report(docs, bench.limit(0)).count() == 0
    one_by_one = list(decontamination.blocks(bench, block=1))
    assert sum(map(len, one_by_one)) == 9 and len(one_by_one) > 3


def brute_leak(text, item):
    """Whether any alignment holds a stretch of LEAST words (all, if the item is shorter) with SHARE (4 in 5) equal words."""
    t, b = (np.array(re.findall(r"\w+", x.lower()), object) for x in (text, item))
    least = min(decontamination.LEAST, len(b))
    for d in range(-len(b) + 1, len(t)):
        lo, hi = max(0, -d), min(len(b), len(t) - d)
        same = t[d + lo : d + hi] == b[lo:hi]
        if hi - lo < least or same.sum() < 0.8 * least:
            continue
        if len(b) < decontamination.SPAN:
            if same.all() and hi - lo == len(b):
                return True
            continue
        upto = np.concatenate([[0], np.cumsum(5 * same.astype(int) - 4)])  # 0 or more over a stretch: 4 in 5 or more are equal
        if (upto[least:] >= np.minimum.accumulate(upto)[: len(upto) - least]).any():
            return True
    return False


def test_token_counts(docs, empty, texts):
    from tokenizers import Tokenizer, models
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=tokens.MODEL)
    plain = lambda i: not (sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i))
    t = Tokenizer(models.Unigram([(sp.id_to_piece(i), sp.get_score(i) if plain(i) else 0.0) for i in range(sp.get_piece_size())], unk_id=0, byte_fallback=True))
    got = {r[0]: r[1] for r in rows(tokens.token_counts(docs)) if r[0] is not None}
    for i, x in enumerate(texts):
        assert got[i] == (len(t.encode("▁" + x.replace(" ", "▁")).ids) if x else 0), x and x[:40]
    assert tokens.token_counts(empty).count() == 0


def test_sharding(docs, empty, texts):
    got = sharding.shard(docs, shards=4).collect()
    assert len(got) == docs.count()
    home, groups = {}, collections.Counter()
    for r, t in [(r, texts[r["doc_id"]]) for r in got if r["doc_id"] is not None]:
        assert r["size"] == len((t or "").encode()) + 1 and r["text_crc32"] == zlib.crc32((t or "").encode())
        assert home.setdefault(t or "", r["shard"]) == r["shard"]
    for r in got:
        groups[texts[r["doc_id"]] or "" if r["doc_id"] is not None else "null"] += r["size"]
    heap = [(0, i) for i in range(4)]
    for s in sorted(groups.values(), reverse=True):
        x, i = heap[0]
        heapq.heapreplace(heap, (x + s, i))
    loads = collections.Counter()
    for r in got:
        loads[r["shard"]] += r["size"]
    assert sorted(loads.values()) == sorted(x for x, _ in heap if x)
    for s in loads:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    assert sharding.shard(empty).count() == 0
    plan = [(s, 3) for s in range(40, 0, -1)]
    parts = list(sharding.schedule(plan, 4, most=7))
    assert max(map(len, parts)) == 7 and [x for part in parts for x in part] == next(sharding.schedule(plan, 4))


def test_size_classes_are_the_plain_heap():
    r = random.Random(1)
    for _ in range(200):
        sizes = sorted(r.choices([r.randint(1, 60) for _ in range(5)], k=r.randint(1, 300)), reverse=True)
        heap, loads = [(0, i) for i in range(5)], [0] * 5
        for s in sizes:
            x, i = heap[0]
            heapq.heapreplace(heap, (x + s, i))
        for s, g in itertools.groupby(sizes):
            n = len(list(g))
            assert sum(sharding.deal(loads, s, n)) == n
        assert sorted(loads) == sorted(x for x, _ in heap)


def brute_spans(data, width):
    where = collections.Counter(b[i : i + width] for b in data for i in range(len(b) - width + 1))
    out = []
    for b in data:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - width + 1):
            if where[b[i : i + width]] > 1:
                gone[i : i + width] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out.append((len(b), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def test_substrings(docs, empty):
    have = docs.select("doc_id", "text").collect()
    want = sorted(zip([r["doc_id"] if r["doc_id"] is not None else -1 for r in have], brute_spans([(r["text"] or "").encode() for r in have], substring_dedup.WIDTH), strict=True))
    got = sorted((-1 if r[0] is None else r[0], tuple(r[1:5])) for r in rows(substring_dedup.dedup(docs)))
    assert got == want and any(w[1] for _, w in want) and any(not w[1] for _, w in want)
    assert substring_dedup.dedup(empty).count() == 0


def test_passages(docs, empty, texts):
    got = {r["doc_id"]: r for r in passages.repeats(docs).collect()}
    where = collections.defaultdict(set)
    for i, t in enumerate(texts):
        w = re.findall(r"\w+", (t or "").lower())
        for p in range(len(w) - passages.WINDOW - passages.REACH + 1):
            where[tuple(w[p : p + passages.WINDOW + passages.REACH])].add(i)
    must = {i for v in where.values() if len(v) > 1 for i in v}
    assert must <= set(got) and must
    short = collections.defaultdict(set)
    for i, t in enumerate(texts):
        w = re.findall(r"\w+", (t or "").lower())
        for p in range(len(w) - 19):
            short[tuple(w[p : p + 20])].add(i)
    assert set(got) - {0} <= {i for v in short.values() if len(v) > 1 for i in v}
    assert all((r["n_removed_words"] == 0) or min(r["first_docs"]) < d for d, r in got.items() if d)
    assert passages.repeats(empty).count() == 0


def test_merkle(spark):
    page = [(i, f"http://x/{i}", None if i == 3 else f"<p>{i}</p>" * (i % 5)) for i in range(70)] + [(5, "http://x/5", "")]
    p = spark.createDataFrame(page, "page_id long, url string, html string")

    def keyed(df):
        return warc.keyed(warc.hashed(df.select("page_id", warc.record(F.col("url"), F.col("html"), F.col("page_id")).alias("record")), "page_id"), "page_id")

    def differ(b, a=p):
        lost, ids = warc.compared(keyed(a), keyed(b))
        return sorted(r["id"] for r in lost.collect()), sorted(r["id"] for r in ids.collect())

    longer = p.withColumn("html", F.when(F.col("page_id").isin(2, 44), F.concat("html", F.lit("?"))).otherwise(F.col("html"))).where("page_id <> 33")
    more = spark.createDataFrame([(500, "u", "surplus"), (5, "http://x/5", "")], p.schema)
    assert differ(p.repartition(3)) == ([], [])
    assert differ(longer.unionByName(more)) == ([2, 33, 44], [2, 5, 33, 44, 500])  # other lengths, one missing in the middle, surplus
    assert len(differ(p.limit(0))[1]) == 70 and differ(p.limit(0), p.limit(0)) == ([], [])
    odd = spark.createDataFrame([(None, "u", "no id"), (-3, "u", "negative"), (7, "u", "seven")], p.schema)
    assert differ(odd.where("page_id = 7"), odd) == ([-3, (1 << 63) - 1],) * 2
    # a damage changes the nodes of its own branch only, also where it changes lengths
    both = [warc.tree(keyed(x), warc.depth(keyed(p))) for x in (p, longer)]
    assert [a.join(b, ["node", "hash"], "left_anti").count() for a, b in zip(*both, strict=True)] == [3, 2, 1]
    placed = sorted(warc.leaves(p.select("page_id", warc.record(F.col("url"), F.col("html"), F.col("page_id")).alias("record")), "page_id").collect(), key=lambda r: r["leaf"])
    assert [r["leaf"] for r in placed] == list(range(len(page))) and all(x["start"] + x["bytes"] == y["start"] for x, y in itertools.pairwise(placed))
    first = p.where("page_id = 1").select(warc.record(F.col("url"), F.col("html"), F.col("page_id")).alias("r")).first()["r"]
    head, body = first.split("\r\n\r\n", 1)
    n = int(re.search(r"Content-Length: (\d+)", head)[1])
    assert body[:n] == "<p>1</p>" and body[n:] == "\r\n\r\n"


def test_mixing(docs, empty, texts):
    got = mixing.mix(docs, carry=("source",)).collect()
    words = lambda t: len(WORD.findall(t or ""))
    size = collections.Counter()
    for r in docs.select("source", "text").collect():
        size[r["source"]] += words(r["text"])
    order = sorted((s for s in size if s is not None)) + ([None] if None in size else [])
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(order)}
    goal, left, rest = {}, set(order), sum(size.values())
    while left:
        share = {s: rest * weight[s] / sum(weight[x] for x in left) for s in left}
        over = {s for s in left if share[s] > 3 * size[s]}
        if not over:
            goal |= share
            break
        for s in over:
            goal[s] = 3.0 * size[s]
            rest -= goal[s]
        left -= over
    taken = collections.Counter()
    for r in got:
        assert abs(r["target"] - goal[r["source"]]) < 1e-6 * max(1, goal[r["source"]]) and r["source_size"] == size[r["source"]]
        assert r["taken"] in (0, r["size"], 2 * r["size"], 3 * r["size"])
        taken[r["source"]] += r["taken"]
    longest = max(words(t) for t in texts)
    assert all(abs(taken[s] - goal[s]) <= longest for s in order) and sum(taken.values()) <= sum(size.values())
    again = mixing.mix(docs.repartition(5), carry=("source",)).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))
    assert mixing.mix(empty).count() == 0
    copies = mixing.resample(docs)
    assert copies.columns == docs.columns and copies.count() == sum(r["taken"] // r["size"] if r["size"] else 1 for r in got)


PAGE = """<!DOCTYPE html><html><head><title>no</title><script>var x = "</p><p>no";</script></head><body><header><h1>no</h1></header><nav><ul><li><a href=x>no</a></li></ul></nav>
<div class="cookie-notice">no no</div><article><h1>A  title &amp; more</h1><p>First   paragraph, <b>bold <i>text</b> of some words.<p>Second&nbsp;one &lt;tag&gt; caf&eacute;<br>line.</p><div class="ad">no</div><ul><li>item</li></ul>
<section id="comments"><p>no, a reader's long comment with quite a few words that go on and on</p></section></article><aside><p>no</p></aside><form><input><button>no</button></form><footer>no</footer></body></html>"""


def test_html(spark):
    want = "A title & more\nFirst paragraph, bold text of some words.\nSecond one <tag> café line.\nitem"
    pages = spark.createDataFrame([(1, "u", PAGE, "x"), (2, None, None, "x"), (3, "u", "", "x"), (1, "u", PAGE, "x"), (4, "u", PAGE[: PAGE.index("Second") + 6], "x"), (5, "u", '<p <<>> "x', "x"), (6, "u", "<p>" * 20000 + "x", "x")], "page_id long, url string, html string, text string")
    got = rows(html.extract(pages))
    assert len(got) == 7 and [r for r in got if r[0] == 1] == [(1, "u", want, len(want))] * 2
    by = {r[0]: r[2] for r in got}
    assert by[2] == by[3] == "" and by[4] == want.split("\nSecond")[0] + "\nSecond"
    assert html.extract(pages.limit(0)).count() == 0


def test_html_tree_on_other_pages():
    found = [html.blocks(p) for p in html.labelled_pages(seed=99, pages=60)]
    y = np.array([b.label for f in found for b in f])
    assert (html.tree().predict(np.concatenate([html.features(f) for f in found])) == y).mean() > 0.97


def test_signature_estimates_similarity():
    r = random.Random(3)
    w = prose(r, 400).split(" ")
    v = list(w)
    for i in range(0, 400, 45):
        v[i] = "x"
    a, b = " ".join(w), " ".join(v)
    sig = near_dup.signatures([a, b, a, "", None, "one two"], coords=2000)
    assert abs((sig[0] == sig[1]).mean() - similarity(a, b, 5)) < 0.05
    assert (sig[0] == sig[2]).all() and not sig[3].any() and not sig[4].any() and sig[5].all()


def test_fractional_weights():
    h = np.random.default_rng(1).integers(0, 1 << 63, 400, dtype=np.uint64)
    x, y = np.full(400, 1.5), np.full(400, 0.5)
    sig = near_dup._darts(np.repeat([0, 1], 400), np.concatenate([h, h]), np.concatenate([x, y]), 2, 2000)
    assert abs((sig[0] == sig[1]).mean() - 1 / 3) < 0.05


def brute_classes(have):
    texts = collections.defaultdict(list)
    for i, t in have:
        texts[t or ""].append(i if i is not None else (1 << 63) - 1)
    keys = list(texts)
    parent = list(range(len(keys)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = []
    for t in keys:
        w = word_hashes(t)
        _, h, c = weighted(*shingles(w, np.array([len(w)]), 5))
        sets.append((h, c))
    for i, j in itertools.combinations(range(len(keys)), 2):
        if overlap(sets[i], sets[j]) >= 0.8:
            parent[top(i)] = top(j)
    out = collections.defaultdict(list)
    for n, t in enumerate(keys):
        out[top(n)] += texts[t]
    return {i: min(v) for v in out.values() for i in v}


def test_near_duplicates(docs, empty):
    want = brute_classes([(r["doc_id"], r["text"]) for r in docs.collect()])
    got = {(1 << 63) - 1 if r[0] is None else r[0]: r[1] for r in rows(near_dup.labelled(docs))}
    assert got == want and len(set(want.values())) < len(want)
    first = near_dup.first_of_each(docs)
    assert first.columns == docs.columns and sorted((1 << 63) - 1 if r["doc_id"] is None else r["doc_id"] for r in first.collect()) == sorted(set(want.values()))
    assert near_dup.labelled(empty).count() == 0 and near_dup.first_of_each(empty).count() == 0


def test_blocks_of_a_large_bucket(spark, monkeypatch):
    r = random.Random(8)
    w = prose(r, 120).split(" ")
    rows_ = []
    for i in range(60):
        v = list(w)
        v[i] = "y"
        rows_.append((i, " ".join(v)))
    df = spark.createDataFrame(rows_, "doc_id long, text string")
    monkeypatch.setattr(near_dup, "BLOCK", 7)
    assert {r[1] for r in rows(near_dup.labelled(df))} == {0}


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (200, 200)]
    got = dict(rows(components.components(spark.createDataFrame(chain, "a long, b long"), "a", "b")))
    assert {got[i] for i in range(41)} == {got[0]} and got[100] == got[101] != got[0]
    assert components.components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_ranked(spark):
    df = spark.createDataFrame([(i % 3, i, i) for i in range(50)], "k int, v long, w long")
    got = common.ranked(df, [F.col("k"), F.col("v")], ["w"]).orderBy("_rank").collect()
    assert [r["_rank"] for r in got] == list(range(50))
    assert [r["_before_w"] for r in got] == list(itertools.accumulate([0, *(r["w"] for r in got)]))[:-1]


def test_pipeline(spark, docs, tmp_path):
    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    leak = docs.where("doc_id = 12").first()["text"]
    spark.createDataFrame([(1, " ".join(leak.split(" ")[:30]))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out, at = corpus_pipeline.run(spark, str(tmp_path)).collect(), common.load(spark, str(tmp_path), "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = common.materialize(stage(spark, at, str(tmp_path)))
        assert at.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    ids = collections.Counter(r["doc_id"] for r in at.collect())
    assert collections.Counter(r["doc_id"] for r in out) == ids
    assert 12 not in ids and 30 not in ids and max(ids.values()) <= 3
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(out)
