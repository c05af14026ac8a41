"""Token counts under a unigram vocabulary, without making the tokens.

An Aho-Corasick automaton lists every vocabulary piece that ends at each character of a word;
dynamic programming carries the best score and its number of pieces. Ties go as in the
tokenizers library's unigram model: starts are visited from left to right and a later path must
be strictly better, so of equal paths into a character the one with the longest last piece stays.
"""

from __future__ import annotations

from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_batches
from .subwords import Table

_MARK = "\N{LOWER ONE EIGHTH BLOCK}"
#: What the library subtracts from the lowest score for an unknown character (fixed value).
UNKNOWN_PENALTY = 10.0


def vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a SentencePiece file, as they stand."""
    from sentencepiece import SentencePieceProcessor

    p = SentencePieceProcessor(model_file=path)
    return [(p.id_to_piece(i), p.get_score(i)) for i in range(p.get_piece_size())]


class Counter:
    """Piece count and best score of single words (with their leading mark)."""

    def __init__(self, vocab: list[tuple[str, float]]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        self.unknown = min(s for _, s in vocab) - UNKNOWN_PENALTY
        for piece, score in vocab:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        known = {p for p, _ in vocab}
        #: Unknown characters become one piece a byte, if the vocabulary has all of these.
        self.bytes = {b for b in range(256) if f"<0x{b:02X}>" in known}

    def __call__(self, word: bytes) -> tuple[int, float]:
        text = _MARK + word.decode()
        n = len(text)
        score, count, single = [None] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        ends: list[list] = [[] for _ in range(n + 1)]
        for end, (length, s) in self.automaton.iter(text):
            ends[end + 1].append((end + 1 - length, s))
            if length == 1:
                single[end + 1] = True
        score[0] = 0.0
        run = [0] * (n + 1)  # unknown characters in a row before this end, of the best path
        for e in range(1, n + 1):
            options = ends[e]
            if not single[e]:
                options = [*options, (e - 1, None)]
            best = None
            for start, s in sorted(options, key=lambda o: o[0]):
                value = score[start] + (self.unknown if s is None else s)
                if best is None or value > best:
                    best, at, piece = value, start, s
            score[e] = best
            if piece is None:
                raw = text[e - 1].encode()
                covered = all(b in self.bytes for b in raw)
                # Without byte pieces a run of unknown characters is one unknown piece.
                count[e] = count[at] + (len(raw) if covered else 0 if run[at] else 1)
                run[e] = 0 if covered else 1
            else:
                count[e], run[e] = count[at] + 1, 0
        return count[n], score[n]


@cache
def _table(path: str) -> Table:
    """Counts of words, one table for each process: Python workers run many tasks."""
    return Table(Counter(vocabulary(path)))


def words(text: str | None) -> list[bytes]:
    """The text cut before each space, as the mark that replaces spaces does; each without its mark."""
    if not text:
        return []
    raw = text.encode().replace(_MARK.encode(), b" ")
    return (raw[1:] if raw[:1] == b" " else raw).split(b" ")


def count(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, n_tokens, score (sum of the chosen pieces' scores) for each row.

    The text is marked and cut at every single space, the first word included, and words are
    counted one by one, so each distinct word runs through the automaton once a worker. Cases: a
    null or empty text has no tokens; other white space is part of its word; repeated rows each
    give a row; a long text without spaces is one word, counted in linear time; other columns are
    not read.
    """

    def make():
        table = _table(vocabulary_path)

        def each(batch):
            texts = batch.column(1).to_pylist()
            pairs = [[table[w] for w in words(t)] for t in texts]
            yield {"doc_id": batch.column(0).to_pylist(), "n_chars": [len(t or "") for t in texts], "n_tokens": [sum(c for c, _ in p) for p in pairs], "score": [float(sum(s for _, s in p)) for p in pairs]}

        return each

    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("n_tokens", pa.int64()), ("score", pa.float64())])
    return map_batches(docs.selectExpr(f"cast(`{id_col}` as bigint) doc_id", f"`{text_col}` text"), make, schema, "doc_id bigint, n_chars bigint, n_tokens bigint, score double")
