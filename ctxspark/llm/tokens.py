"""Token counts of a unigram tokenizer without building tokens.

The vocabulary (piece, score) is that of a public SentencePiece file, read as a unigram model with byte fallback. An
Aho-Corasick automaton enumerates the pieces that occur in a segment; dynamic programming carries the best score and its
piece count to each position. Tie rule of the tokenizer: candidates come by start, then by length, and only a strictly
better score replaces one, so the longest piece wins a tie. A character that no one-character piece covers costs the
lowest score less 10 and becomes as many tokens as it has UTF-8 bytes.

Spaces are written as the mark U+2581 and, as the tokenizer does, one is put in front of a text that isn't empty. No piece
has the mark after another character, so the best path breaks before each run of marks, and a segment's count can be
remembered. Null and empty texts have 0 tokens; other white space (newlines) is an ordinary character. Ties and
repeated rows need no care: a row depends on its own text. Empty tables give empty results; extra columns are ignored."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import load

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK, PENALTY = "▁", 10.0
SEGMENTS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
#: Segments remembered by a worker; then it starts anew.
REMEMBERED = 400_000


def vocabulary(path: str = MODEL) -> list[tuple[str, float]]:
    """The ordinary pieces of a SentencePiece file with their scores."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size()) if not (sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i) or sp.is_unused(i))]


class Counter:
    """count(text): the tokens of the best segmentation."""

    def __init__(self, pieces: list[tuple[str, float]]):
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            if MARK in piece.lstrip(MARK):
                raise ValueError(f"a piece with a mark inside: {piece!r}")
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(s for _, s in pieces) - PENALTY
        self.seen: dict[str, int] = {}

    def segment(self, s: str) -> int:
        """Tokens of one segment. Matches come by end, which is all that the recursion needs; among candidates for an end
        the earliest start is the first, so a later one must be strictly better."""
        n = len(s)
        score, count = [0.0] * (n + 1), [0] * (n + 1)
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        for end, match in self.automaton.iter(s):
            ends[end].append(match)
        for i in range(1, n + 1):
            best, pieces, single = None, 0, False
            for size, own in sorted(ends[i - 1], reverse=True):
                x = score[i - size] + own
                single |= size == 1
                if best is None or x > best:
                    best, pieces = x, count[i - size] + 1
            if not single:
                x = score[i - 1] + self.unknown
                if best is None or x > best:
                    best, pieces = x, count[i - 1] + len(s[i - 1].encode("utf-8", "surrogatepass"))
            score[i], count[i] = best, pieces
        return count[n]

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        seen, total = self.seen, 0
        for s in SEGMENTS.findall(MARK + text.replace(" ", MARK)):
            c = seen.get(s)
            if c is None:
                c = self.segment(s)
                if len(s) <= 64:  # longer ones hardly come again and would make the memory's size depend on the text
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen[s] = c
            total += c
        return total


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(vocabulary(path))


def token_counts(docs: DataFrame, id_col: str = "doc_id", text: str = "text", model: str = MODEL) -> DataFrame:
    """id_col and n_tokens for every row of docs; model: a path that every executor has."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(model).count
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([count(t) for t in b.column(1).to_pylist()], pa.int64())], names=[id_col, "n_tokens"])

    return docs.select(id_col, text).mapInArrow(run, f"`{id_col}` {kind}, n_tokens long")


def op3_viterbi_counts(spark, sf_dir: str) -> DataFrame:
    return token_counts(load(spark, sf_dir, "documents", "doc_id", "text"))
