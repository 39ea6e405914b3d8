"""Byte-level BPE encoding and decoding by dynamic programming over prefixes.

For every prefix of a byte string exactly one token can end its BPE encoding, and the
encoding of the prefix that this token leaves is stored already.  So one token a
prefix describes the encodings of all prefixes: appending bytes only adds entries, and an
edit in the middle recomputes from the edit on and stops needing anything before it.

The token that ends a prefix is found among the vocabulary entries ending there
(Aho-Corasick): it is the one that is *compatible* with the token stored where it begins.
Two tokens are compatible if BPE, run on their joined bytes, gives those two again, that is
if no merge across the border would come before the merges inside them.

Defined results: null and empty texts have no tokens; text beyond 7-bit characters is
encoded as UTF-8; special-token strings in a text are ordinary text; one row per input row.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from siltstone.llm.common import Memo, map_rows

_END = 1 << 60


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Token bytes to rank, from the lines ``base64 rank`` of a rank file."""
    pairs = (line.split() for line in data.splitlines() if line.strip())
    return {base64.b64decode(token): int(rank) for token, rank in pairs}


class Vocabulary:
    """Ranks with what the compatibility test and the prefix search need."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), (rank, len(token)))
        self.automaton.make_automaton()
        self._spines: dict[int, tuple] = {}
        self._fits: dict[int, bool] = {}

    def merge(self, data: bytes, below: int = _END) -> list[bytes]:
        """Plain BPE with the ranks under ``below``: for short strings and for tests."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(a + b, _END), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank >= below:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _spine(self, token: int) -> tuple:
        """Along the token's left and right edge: (bytes, rank of the merge that absorbs them)."""
        found = self._spines.get(token)
        if found is None:
            edges = []
            for side in (0, -1):
                edge, part, until = [], self.tokens[token], _END
                while True:
                    edge.append((part, until))
                    if len(part) == 1:
                        break
                    until = self.ranks[part]
                    part = self.merge(part, below=until)[side]
                edges.append(edge)
            found = self._spines[token] = tuple(edges)
        return found

    def fits(self, left: int, right: int) -> bool:
        """Whether BPE keeps ``left`` and ``right`` as neighbours.

        A merge across the border happens before what absorbs its left part (at equal ranks
        the left one goes first) and not after what absorbs its right part.
        """
        key = left << 32 | right
        known = self._fits.get(key)
        if known is None:
            if len(self._fits) >= 1_000_000:
                self._fits.clear()
            rank = self.ranks.get
            starts = self._spine(right)[0]
            known = self._fits[key] = not any(
                (crossing := rank(a + b)) is not None and crossing < a_until and crossing <= b_until
                for a, a_until in self._spine(left)[1]
                for b, b_until in starts
            )
        return known


class PrefixEncoder:
    """The encoding of a growing or edited byte string (one match of the split pattern)."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary = vocabulary
        self.data = bytearray()
        self.last = array("q", [-1])
        self.append(data)

    def append(self, data: bytes) -> None:
        """Add bytes; entries of the old prefixes stay as they are."""
        begin = len(self.data)
        self.data += data
        last, fits = self.last, self.vocabulary.fits
        last.extend([-1] * len(data))
        longest = max(0, begin - 2 * max_token(self.vocabulary))
        text = self.data[longest:].decode("latin-1")
        for end, (token, size) in self.vocabulary.automaton.iter(text):
            end += longest + 1
            if end <= begin or last[end] >= 0 or end - size < longest:
                continue
            if end == size or fits(last[end - size], token):
                last[end] = token

    def edit(self, start: int, stop: int, data: bytes) -> None:
        """Replace ``[start, stop)``; prefixes that end before ``start`` are kept.

        Right of the edit an old entry holds again as soon as a run of entries as long as the
        longest token comes out unchanged, for each entry depends on no more than that.
        """
        tail, old = bytes(self.data[stop:]), self.last[stop + 1 :]
        del self.data[start:], self.last[start + 1 :]
        self.append(data)
        reach, same, at = max_token(self.vocabulary), 0, 0
        while at < len(tail):
            if same >= reach:
                self.data += tail[at:]
                self.last.extend(old[at:])
                return
            step = tail[at : at + reach]
            self.append(step)
            for i, token in enumerate(self.last[-len(step) :]):
                same = same + 1 if token == old[at + i] else 0
            at += len(step)

    def ids(self) -> list[int]:
        out, at = [], len(self.data)
        while at:
            token = self.last[at]
            out.append(token)
            at -= len(self.vocabulary.tokens[token])
        return out[::-1]


def max_token(vocabulary: Vocabulary) -> int:
    """Bytes of the longest token."""
    if not hasattr(vocabulary, "_longest"):
        vocabulary._longest = max(map(len, vocabulary.ranks))
    return vocabulary._longest


class Codec:
    """Whole texts to ids and back."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.vocabulary = Vocabulary(ranks)
        self.pieces = regex.compile(pattern).findall
        self.cache = Memo(self._piece)

    def _piece(self, piece: str) -> bytes:
        data = piece.encode()
        whole = self.vocabulary.ranks.get(data)
        ids = [whole] if whole is not None else PrefixEncoder(self.vocabulary, data).ids()
        return array("I", ids).tobytes()

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.cache.__getitem__, self.pieces(text)))

    def decode(self, ids: bytes | Iterable[int]) -> bytes:
        if isinstance(ids, bytes):
            ids = array("I", ids)
        return b"".join(map(self.vocabulary.tokens.__getitem__, ids))


_codecs: dict[tuple, Codec] = {}


def codec(data: bytes, pattern: str) -> Codec:
    """One codec a process for each rank file and pattern."""
    key = (hashlib.sha256(data).digest(), pattern)
    if key not in _codecs:
        _codecs[key] = Codec(read_ranks(data), pattern)
    return _codecs[key]


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, keep_ids: bool = False) -> DataFrame:
    """Encode ``text`` of every row, decode the ids again, and return counts and digests.

    ``keep_ids`` adds the ids themselves (array of int) and the decoded text.  The rank file
    is read on the driver and sent to the executors (its size is that of the file, under 1 MB).
    """
    with open(ranks_path, "rb") as f:
        data = docs.sparkSession.sparkContext.broadcast(f.read())
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    if keep_ids:
        fields += [("ids", pa.list_(pa.int32())), ("decoded", pa.string())]
        schema += ", ids array<int>, decoded string"

    def start():
        own = codec(data.value, pattern)

        def run(rows: Iterator[tuple]) -> Iterator[tuple]:
            for doc_id, text in rows:
                ids = own.encode(text or "")
                back = own.decode(ids)
                row = (doc_id, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(back).hexdigest())
                yield (*row, array("I", ids).tolist(), back.decode()) if keep_ids else row

        return run

    return map_rows(docs, schema, pa.schema(fields), ("doc_id", "text"), start)
