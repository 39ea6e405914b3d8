"""Column functions on text, with Unicode white space and code point positions throughout."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Every character that Unicode counts as white space in a text split (a Java character class, in the form that is tested fastest).
SPACE = r"[\x1c\x1d\x1e\x1f\p{IsWhite_Space}]"


def strip(c: Column) -> Column:
    """Remove Unicode white space from both ends (``trim`` removes blanks only)."""
    # Between printable ASCII there is nothing to remove, which is seen without a search.
    clean = lambda x: F.substring(x, 1, 1).between("!", "~") & F.substring(x, -1, 1).between("!", "~")
    # The look-behind makes a run of blanks inside cost its length and not the square of it.
    return once(c, lambda x: F.when(clean(x), x).otherwise(F.regexp_replace(x, rf"\A{SPACE}++|(?<!{SPACE}){SPACE}++\z", "")))


def tokens(c: Column) -> Column:
    """Lower-cased words between white space; punctuation stays attached."""
    return F.filter(F.split(F.lower(c), f"{SPACE}+"), lambda x: x != "")


def slug(c: Column) -> Column:
    """File name for a display name: lower case, blanks to ``_``, no parentheses."""
    return F.translate(F.lower(c), " ()", "_")


def preview(c: Column, size: int = 300) -> Column:
    """The first characters on one line."""
    return F.translate(F.left(c, F.lit(size)), "\n", " ")


def zero_padded(c: Column, width: int = 10) -> Column:
    """Zeros in front up to ``width``; longer values stay whole."""
    return F.when(F.length(c) >= width, c).otherwise(F.lpad(c, width, "0"))


def replaced(c: Column, pairs: list[tuple[str, str]]) -> Column:
    """Literal replacements, one after the other."""
    return reduce(lambda x, pair: F.replace(x, F.lit(pair[0]), F.lit(pair[1])), pairs, c)


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value evaluated once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def is_wide(text: Column) -> Column:
    """Whether a text has characters beyond the basic plane."""
    return text.rlike(r"[\x{10000}-\x{10FFFF}]")


def match_start(text: Column, pattern: str, wide: Column | None = None) -> Column:
    """Code points before the first match, null without one.

    ``regexp_instr`` counts UTF-16 units, so texts beyond the basic plane take a slower way.
    """
    pattern = f"(?Us){pattern}"
    units = F.regexp_instr(text, F.lit(pattern)) - 1
    points = F.when(text.rlike(pattern), F.length(F.regexp_extract(text, rf"(?Us)\A(.*?)(?:{pattern})", 1)))
    return F.when(is_wide(text) if wide is None else wide, points).otherwise(F.get(F.array_remove(F.array(units), F.lit(-1)), F.lit(0)))
