"""Cases that the review of round 1 named: each failed before its finding was settled."""

import collections
import itertools
import random

import numpy as np

from ctxspark.llm import decontamination, html, passages
from ctxspark.llm.shingles import similarity, word_hashes


def prose(r: random.Random, n: int) -> list[str]:
    return ["".join(r.choices("abcdefghijklmnop", k=r.randint(3, 8))) for _ in range(n)]


def test_lines_are_paragraphs(spark):
    """Every pair of lines of similarity 0.8 or more, short ones included, against brute force."""
    r = random.Random(5)
    docs = [[prose(r, r.choice([3, 8, 20, 45])) for _ in range(3)] for _ in range(160)]
    for n in (1, 2, 4, 5, 9, 24, 30, 40):  # exact copies
        line = prose(r, n)
        for d in r.sample(docs, 2):
            d.insert(1, line)
    for n in (46, 50, 55, 60, 80, 120):  # a word changed, anywhere
        for _ in range(12):
            line = prose(r, n)
            other = list(line)
            other[r.randrange(n)] = "changed"
            for d, x in zip(r.sample(docs, 2), (line, other), strict=True):
                d.insert(1, x)
    lines = [(i, " ".join(x)) for i, d in enumerate(docs) for x in d]
    have = collections.defaultdict(set)
    for i, x in lines:
        for g in {x, *(" ".join(x.split()[k : k + 5]) for k in range(len(x.split()) - 4))}:
            have[g].add((i, x))
    pairs = {tuple(sorted(p)) for v in have.values() for p in itertools.combinations(sorted(v), 2)}
    want = {p for p in pairs if p[0][0] != p[1][0] and similarity(p[0][1], p[1][1], 5) >= passages.THRESHOLD}
    rows = [(i, "\n".join(" ".join(x) for x in d)) for i, d in enumerate(docs)]
    got = {x["doc_id"]: x for x in passages.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}

    def marked(i: int, line: str) -> bool:
        at = [" ".join(x) for x in docs[i]].index(line)
        lo = sum(len(x) for x in docs[i][:at])
        return i in got and any(s["lo"] <= lo and lo + len(line.split()) <= s["end"] for s in got[i]["spans"])

    met = [marked(*a) and marked(*b) for a, b in want]
    assert len(want) > 60 and np.mean(met) >= 0.97
    assert all(m for m, (a, b) in zip(met, want, strict=True) if a[1] == b[1])
    clean = {i for i, _ in lines} - {x[0] for p in pairs if p[0][0] != p[1][0] for x in p}
    assert clean and not clean & set(got)


def test_short_documents_between_an_items_probes():
    """A document that holds part of an item is judged on its own, whatever stands beside it in the batch."""
    r = random.Random(1)
    item = prose(r, 59)
    found = decontamination.Seeds([(7, word_hashes(" ".join(item)))])
    for lo in range(0, 40):
        part = " ".join(item[lo : lo + 20])
        texts = [" ".join(prose(r, 30)), part, " ".join(prose(r, 30)), None, part]
        assert decontamination.judge(texts, found) == [[], [(7, 20, 1.0)], [], [], [(7, 20, 1.0)]]
        assert decontamination.judge([part], found) == [[(7, 20, 1.0)]]
    # words of an item that go on in the next document are no copy
    assert decontamination.judge([" ".join(item[:7]), " ".join(item[7:14])], found) == [[], []]


def test_names_around_the_main_text():
    """Names of outer and earlier elements don't mark the article bad; what they name themselves stays bad."""
    long = " ".join(["some words of a long paragraph"] * 8)
    article = f"<article><h1>A title of words</h1><p>{long} one</p><p>{long} two</p></article>"
    side = f'<div class="sidebar"><p>{long} no</p></div>'
    for page in (
        f'<html class="no-footer"><body class="has-sidebar">{side}{article}</body></html>',
        f'<body class="single comments-open">{side}{article}</body>',
        f'<body><div class="page no-footer">{article}</div>{side}</body>',
        f'<body><div class="sidebar-layout sidebar">{article}</div>{side}</body>',
        f'<body><article><h1>A title of words</h1><p class="share">{long} no</p><p>{long} one</p><p>{long} two</p></article></body>',
        f'<body><article><h1>A title of words</h1><p class="share">{long} no<p>{long} one<p>{long} two</article></body>',
        f'<body><article><h1>A title of words</h1><p class="share">{long} no<div>{long} one</div><hr class="footer"><p>{long} two</p></article></body>',
    ):
        assert html.main_texts([page], html.tree()) == [f"A title of words\n{long} one\n{long} two"], page
    for page in (f'<main><p>{long} yes</p><div class="related"><article><p>{long} no</p></article></div></main>', f"<main><p>{long} yes</p></main><aside><article><p>{long} no</p></article></aside>", f'<main><p>{long} yes</p></main><div hidden><article><p>{long} no</p></article></div>'):
        assert html.main_texts([page], html.tree()) == [f"{long} yes"], page


def test_masks_hit_all_that_the_verifier_accepts():
    """Every way to change a fifth of 10 to 25 words leaves a hit of some mask; of longer stretches,
    one half of 13 words or more has its share."""
    masks = [(len(m), sum(1 << i for i, c in enumerate(m) if c == "1")) for m in decontamination.MASKS]
    for n in range(decontamination.SPAN, 26):
        gone = [c for c in itertools.combinations(range(n), n // 5)]
        clean = np.array([((1 << n) - 1) ^ sum(1 << i for i in c) for c in gone])
        hit = np.zeros(len(clean), bool)
        for span, m in masks:
            for at in range(n - span + 1):
                hit |= (clean >> at) & m == m
        assert hit.all(), n
