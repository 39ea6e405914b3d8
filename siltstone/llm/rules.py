"""Quality rules: text statistics, and tokeniser fertility against bands of each language.

Fertility is measured with the pieces of a public vocabulary: characters per token, the share of
tokens that are single fallback bytes, and the entropy of the token distribution.  Bands come from all
documents of a language and size class (powers of 4 of the token count, as entropy grows with
length): a measure more than ``fence`` interquartile ranges outside the quartiles is
rejected.  A class of fewer than ``min_class`` documents takes the first of these bands that has as many: the
language over neighbouring size classes, the language, the size class over all languages; else that of all
documents.  Texts of fewer than ``min_tokens`` tokens are too small to judge and pass.

Defined results: null and empty texts have zero counts and fail the base rule (under 10 words);
a null language is a language of its own; equal rows get equal results, one for each row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import Memo, Workspace, map_rows

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
WINDOW = 5
MEASURES = ("chars_per_token", "byte_share", "entropy")


def repeated_words(ids: list[int]) -> int:
    """Words covered by a window of five that occurs at least twice in the text."""
    n = len(ids) - WINDOW + 1
    base = max(ids, default=0) + 1
    if n < 2 or base == len(ids):
        return 0
    word = np.array(ids, dtype=np.int64)
    code, size = word[:n], base
    for k in range(1, WINDOW):
        if size > (1 << 62) // base:
            values, code = np.unique(code, return_inverse=True)
            size = len(values)
        code, size = code * base + word[k : k + n], size * base
    _, inverse, counts = np.unique(code, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(counts[inverse] > 1)
    edges = np.zeros(len(ids) + 1, dtype=np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + WINDOW, -1)
    return int(np.count_nonzero(np.cumsum(edges)[:-1]))


def repeated_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [line for line in text.split("\n") if line.strip(SPACES)]
    return len(lines) - len(set(lines))


def base_counts(text: str) -> tuple[list[bytes], tuple[int, int, int, int, int]]:
    """The words, and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = text.encode().split()
    number: dict[bytes, int] = {}
    ids = [number.setdefault(w, len(number)) for w in words]
    chars = len(text) - sum(map(text.count, SPACES))
    return words, (len(words), chars, sum(map(text.count, SYMBOLS)), repeated_lines(text), repeated_words(ids))


class Fertility:
    """Token measures of a list of words."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.byte_ids = np.array([self.model.is_byte(i) for i in range(self.model.get_piece_size())])
        self.tokens = Memo(lambda w: np.array(self.model.encode(w.decode(errors="replace")), dtype=np.int32).tobytes())

    def measure(self, words: list[bytes], chars: int) -> tuple[int, float, float, float]:
        """Tokens, characters per token, share of byte tokens, entropy in bits."""
        ids = np.frombuffer(b"".join(map(self.tokens.__getitem__, words)), dtype=np.int32)
        if not len(ids):
            return 0, 0.0, 0.0, 0.0
        counts = np.bincount(ids)
        used = np.flatnonzero(counts)
        share = counts[used] / len(ids)
        entropy = float(-(share * np.log2(share)).sum())
        return len(ids), chars / len(ids), float(share[self.byte_ids[used]].sum()), max(entropy, 0.0)


_measures: dict[int, Fertility] = {}


def measures(docs: DataFrame, model_path: str) -> DataFrame:
    """Base counts and token measures of every row, with its language."""
    with open(model_path, "rb") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())

    def start():
        key = hash(model.value)
        if key not in _measures:
            _measures[key] = Fertility(model.value)
        own = _measures[key]

        def run(rows: Iterator[tuple]) -> Iterator[tuple]:
            for doc_id, lang, text in rows:
                words, counts = base_counts(text or "")
                yield doc_id, lang, *counts, *own.measure(words, counts[1])

        return run

    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_tokens")
    arrow = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), *((n, pa.int64()) for n in names), *((n, pa.float64()) for n in MEASURES)])
    schema = "doc_id long, lang string, " + ", ".join(f"{n} long" for n in names) + ", " + ", ".join(f"{n} double" for n in MEASURES)
    return map_rows(docs, schema, arrow, ("doc_id", "lang", "text"), start)


def bands(measured: DataFrame, fence: float = 3.0, min_class: int = 50) -> DataFrame:
    """Rejection bands for each language and size class; small classes take those of wider groups.

    Measures are rounded to hundredths first, so exact percentiles keep few distinct values.
    """
    quartiles = F.array(*(F.percentile(F.round(m, 2), F.array(F.lit(0.25), F.lit(0.75))) for m in MEASURES))
    grouped = lambda df, name, *keys: df.groupBy(*(F.col(k).alias(f"{name}_{k}") for k in keys)).agg(F.count("*").alias(f"n_{name}"), quartiles.alias(f"q_{name}"))
    around = measured.select("lang", *MEASURES, F.explode(F.array(*(F.col("size_class") + i for i in (-1, 0, 1)))).alias("size_class"))
    same_lang = lambda name: F.col("own_lang").eqNullSafe(F.col(f"{name}_lang"))
    same_class = lambda name: F.col("own_size_class") == F.col(f"{name}_size_class")
    own = grouped(measured, "own", "lang", "size_class")
    own = own.join(grouped(around, "near", "lang", "size_class"), same_lang("near") & same_class("near"), "left")
    own = own.join(grouped(measured, "lang", "lang"), same_lang("lang"), "left")
    own = own.join(grouped(measured, "class", "size_class"), same_class("class"), "left").crossJoin(grouped(measured, "all"))
    q = F.col("q_all")
    for name in ("class", "lang", "near", "own"):
        q = F.when(F.col(f"n_{name}") >= min_class, F.col(f"q_{name}")).otherwise(q)
    out = [F.col("own_lang").alias("band_lang"), F.col("own_size_class").alias("band_class")]
    for i, m in enumerate(MEASURES):
        low, high = F.col("q")[i][0], F.col("q")[i][1]
        spread = F.greatest(high - low, F.lit(0.05)) * fence
        out += [(low - spread).alias(f"low_{m}"), (high + spread).alias(f"high_{m}")]
    return own.withColumn("q", q).select(*out)


def judge(docs: DataFrame, model_path: str, min_tokens: int = 32, fence: float = 3.0, min_class: int = 50) -> DataFrame:
    """Counts, measures, ``base_failed`` and ``kept`` for every row of ``docs``."""
    size_class = F.floor(F.log2(F.greatest("n_tokens", F.lit(1))) / 2)
    measured = Workspace(docs.sparkSession, "rules").write(measures(docs, model_path).withColumn("size_class", size_class), "measured")
    joined = measured.join(bands(measured, fence, min_class), F.col("lang").eqNullSafe(F.col("band_lang")) & (F.col("size_class") == F.col("band_class")), "left")
    outside = F.lit(False)
    for m in MEASURES:
        outside = outside | F.coalesce((F.col(m) < F.col(f"low_{m}")) | (F.col(m) > F.col(f"high_{m}")), F.lit(False))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    rejected = (F.col("n_tokens") >= min_tokens) & outside
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & ~rejected).alias("kept"), "n_tokens", *MEASURES,
    )
