"""Token counts by a count-only Viterbi search over a unigram vocabulary.

An Aho-Corasick automaton lists the vocabulary entries that end at each character; the
dynamic program carries only the best score and the number of pieces of the best path, not
the path.  Tie rules are those of the Unigram model of the public ``tokenizers`` library: candidates
are met in order of their start, and a later one wins only with a strictly higher score; a character that no
one-character entry covers also offers an unknown piece with the lowest score less 10, and an
unknown piece on the best path counts as its UTF-8 bytes where the vocabulary has byte pieces,
else neighbouring unknown pieces count as one.

No entry holds the space mark after another character, so paths never cross the beginning of
a word, and words are counted once and remembered.  Scores add up in doubles, as in that library.

Defined results: null and empty texts have 0 tokens; one row per input row; byte, control and
unknown entries never match text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from siltstone.llm.common import Memo, map_rows

MARK = "▁"
UNKNOWN_PENALTY = 10.0


def read_pieces(path: str) -> tuple[list[tuple[str, float]], bool]:
    """Ordinary pieces with scores, and whether unknown characters fall back to bytes."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    pieces = [(model.id_to_piece(i), model.get_score(i)) for i in ids if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    return pieces, any(map(model.is_byte, ids))


class Counter:
    """Counts the pieces of the best segmentation."""

    def __init__(self, pieces: list[tuple[str, float]], byte_fallback: bool, most: int = 400_000):
        self.byte_fallback = byte_fallback
        self.unknown = min((score for _, score in pieces), default=0.0) - UNKNOWN_PENALTY
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        if pieces:
            self.automaton.make_automaton()
        # A path can be cut where no entry crosses: before a mark that follows something else.
        inner = any(MARK in piece.lstrip(MARK) for piece, _ in pieces)
        self.split = (lambda text: [text]) if inner else re.compile(f"{MARK}*[^{MARK}]+|{MARK}+").findall
        self.words = Memo(self.count_word, most)

    def count_word(self, word: str) -> int:
        size = len(word)
        ends: list[list[tuple[int, float]]] = [[] for _ in range(size + 1)]
        if len(self.automaton):
            for end, found in self.automaton.iter(word):
                ends[end + 1].append(found)
        best, count, loose = [0.0] * (size + 1), [0] * (size + 1), [False] * (size + 1)
        for end in range(1, size + 1):
            matches = sorted(ends[end], reverse=True)
            top, pieces, unknown = None, 0, False
            for length, score in matches:
                total = best[end - length] + score
                if top is None or total > top:
                    top, pieces, unknown = total, count[end - length] + 1, False
            if not matches or matches[-1][0] != 1:
                total = best[end - 1] + self.unknown
                if top is None or total > top:
                    own = len(word[end - 1].encode()) if self.byte_fallback else int(not loose[end - 1])
                    top, pieces, unknown = total, count[end - 1] + own, True
            best[end], count[end], loose[end] = top, pieces, unknown
        return count[size]

    def count(self, text: str) -> int:
        """Tokens of a text as the tokenizer normalises it: a mark in front, marks for spaces."""
        if not text:
            return 0
        return sum(map(self.words.__getitem__, self.split(MARK + text.replace(" ", MARK))))


_counters: dict[bytes, Counter] = {}


def count_tokens(docs: DataFrame, model_path: str) -> DataFrame:
    """Tokens and characters of ``text`` in every row, by the vocabulary at ``model_path``."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(read_pieces(model_path))
    key = hashlib.sha256(repr(vocabulary.value).encode()).digest()

    def start():
        if key not in _counters:
            _counters[key] = Counter(*vocabulary.value)
        own = _counters[key]

        def run(rows: Iterator[tuple]) -> Iterator[tuple]:
            for doc_id, text in rows:
                yield doc_id, len(text or ""), own.count(text or "")

        return run

    arrow = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("n_tokens", pa.int64())])
    return map_rows(docs, "doc_id long, n_chars long, n_tokens long", arrow, ("doc_id", "text"), start)
