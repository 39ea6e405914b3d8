"""Byte-level BPE against the public library, and unigram counts against the public tokenizer."""

import base64
import hashlib
import random
import struct

import public_tokenizers as P
import pytest
import sentencepiece
import tiktoken
from tokenizers import Tokenizer, models

from siltstone.llm import bpe, unigram

RANKS = bpe.read_ranks(open(P.path("byte_bpe_50k.tiktoken"), "rb").read())
ENC = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
CODEC = bpe.Codec(RANKS, P.PATTERN)
HARD = ["", "aaaaaaaaaaaaaaaaaaaaaaa", "don't  stop\n\n now", "ünïcödé ☃ 𝄞 日本語テキスト", "<|endoftext|>", "x" * 5000, "\x00\x01\x7f", "1234567 89²½", "        ", "ababababcabcabc" * 40]


def ids(data):
    return list(struct.unpack(f"<{len(data) // 4}I", data))


@pytest.mark.parametrize("text", HARD)
def test_encoding_is_the_librarys(text):
    assert ids(CODEC.encode(text)) == ENC.encode_ordinary(text)
    assert CODEC.decode(CODEC.encode(text)) == text.encode()


def test_random_texts_encode_and_decode():
    r = random.Random(5)
    for _ in range(300):
        alphabet = r.choice(["ab ", "the and ing er\n", "aéß☃ 12", "".join(map(chr, range(32, 1500)))])
        text = "".join(r.choice(alphabet) for _ in range(r.randrange(120)))
        assert ids(CODEC.encode(text)) == ENC.encode_ordinary(text)


def test_every_token_is_its_own_encoding():
    for token, rank in random.Random(1).sample(sorted(RANKS.items()), 3000):
        assert bpe.PrefixEncoder(CODEC.vocabulary, token).ids() == [rank]


def test_appends_and_edits_equal_encoding_afresh():
    r = random.Random(9)
    vocabulary = CODEC.vocabulary
    for _ in range(60):
        text = bytes(r.choice(b"the anding of errrs") for _ in range(r.randrange(1, 400)))
        cut = r.randrange(len(text) + 1)
        grown = bpe.PrefixEncoder(vocabulary, text[:cut])
        grown.append(text[cut:])
        assert grown.last == bpe.PrefixEncoder(vocabulary, text).last
        a, b = sorted((r.randrange(len(text) + 1), r.randrange(len(text) + 1)))
        new = bytes(r.choice(b"xing the") for _ in range(r.randrange(6)))
        grown.edit(a, b, new)
        fresh = bpe.PrefixEncoder(vocabulary, text[:a] + new + text[b:])
        assert grown.data == fresh.data and grown.last == fresh.last and grown.ids() == fresh.ids()


def test_plain_merges_agree():
    for word in (b" international", b"mississippi", b"  aaaa", b"\xff\xfe\xe2\x98"):
        assert [RANKS[x] for x in CODEC.vocabulary.merge(word)] == bpe.PrefixEncoder(CODEC.vocabulary, word).ids()


def test_encode_documents_on_awkward_rows(odd_docs, no_docs):
    path = P.path("byte_bpe_50k.tiktoken")
    rows = bpe.encode_documents(odd_docs, path, P.PATTERN, keep_ids=True).collect()
    texts = [r.text or "" for r in odd_docs.collect()]
    assert sorted(r.ids_sha256 for r in rows) == sorted(hashlib.sha256(struct.pack(f"<{len(x)}I", *x)).hexdigest() for x in map(ENC.encode_ordinary, texts))
    assert sorted(r.decoded for r in rows) == sorted(texts)
    assert all(len(r.ids) == r.n_tokens for r in rows)
    assert bpe.encode_documents(no_docs, path, P.PATTERN).count() == 0


def library_unigram():
    """The public vocabulary in the public library's unigram model."""
    own = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    vocabulary = [(own.id_to_piece(i), own.get_score(i)) for i in range(own.get_piece_size())]
    return Tokenizer(models.Unigram(vocabulary, own.unk_id(), True))


def test_unigram_counts_equal_the_tokenizers():
    own = library_unigram()
    marked = lambda text: unigram.MARK + text.replace(" ", unigram.MARK)
    counter = unigram.Counter(*unigram.read_pieces(P.path("piece_bpe_32k.model")))
    r = random.Random(3)
    words = ["Hello", "thhehesh", "leoneç", "international", "a", "the", "...", "x1y2", "Ünderstanding", "and", "", "\U0001f600", "日本語", "a\nb"]
    for _ in range(1500):
        text = " ".join(r.choice(words) for _ in range(r.randrange(1, 12)))
        if text:
            assert counter.count(text) == len(own.encode(marked(text)).ids), text
    for word in {"".join(r.choice("thanderingoucé.,\U0001f600") for _ in range(r.randrange(1, 14))) for _ in range(1500)}:
        assert counter.count(word) == len(own.encode(marked(word)).ids), word
    assert counter.count("") == 0


def test_unigram_small_vocabulary_by_brute_force():
    pieces = [("a", -1.0), ("b", -1.0), ("ab", -2.0), ("aba", -2.5), (unigram.MARK, -1.0)]
    counter = unigram.Counter(pieces, byte_fallback=False)
    scores = dict(pieces)

    def best(word):
        if not word:
            return 0.0, 0
        options = []
        for n in range(1, len(word) + 1):
            if word[:n] in scores:
                s, c = best(word[n:])
                options.append((s + scores[word[:n]], c + 1))
        return max(options, key=lambda o: o[0])

    for word in ("ab", "aba", "abab", "bababa", "aabba"):
        assert best(word)[0] <= 0
        counted = counter.count_word(word)
        ways = {c for s, c in all_ways(word, scores) if abs(s - best(word)[0]) < 1e-9}
        assert counted in ways
    assert counter.count("zz") == 2  # the mark, then unknowns that join
    # Equal scores: the candidate that starts first, here the longer piece, is kept.
    assert counter.count_word("ab") == 1


def all_ways(word, scores):
    if not word:
        return [(0.0, 0)]
    return [(s + scores[word[:n]], c + 1) for n in range(1, len(word) + 1) if word[:n] in scores for s, c in all_ways(word[n:], scores)]


def test_count_documents_on_awkward_rows(odd_docs, no_docs):
    path = P.path("piece_bpe_32k.model")
    rows = {(r.doc_id, r.n_chars): r.n_tokens for r in unigram.count_tokens(odd_docs, path).collect()}
    assert rows[(2, 0)] == 0 and rows[(3, 0)] == 0 and rows[(7, 150000)] >= 30000
    assert unigram.count_tokens(odd_docs, path).count() == odd_docs.count()
    assert unigram.count_tokens(no_docs, path).count() == 0


def test_rank_file_lines():
    line = base64.b64encode(b"ab") + b" 7\n\n"
    assert bpe.read_ranks(line) == {b"ab": 7}
