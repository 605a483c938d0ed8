"""Text normalisation, set and sequence scoring as Column expressions.

Column functions stay in the JVM. Unicode compatibility forms and full case folding
have no built-in, so texts outside ``SIMPLE`` go through the ICU library that Spark
ships, by ``reflect``; which way a text goes is told row by row.
"""

from __future__ import annotations

import re
import unicodedata
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: characters for which the built-in path gives exactly what ``normalize_python`` gives
SIMPLE = "^[\\x00-\\x7F\\u00C0-\\u00FF\\u2010-\\u2027]*$"


def strip(c: Column) -> Column:
    """Without leading and trailing white space; the ends alone are looked at, no pattern is tried at every character."""
    return F.btrim(c, F.lit(" \t\n\x0b\f\r"))


def optional(c: Column) -> Column:
    """Stripped text, null where nothing is left."""
    return F.nullif(strip(c), F.lit(""))


def cleaned(values: Column) -> Column:
    """Stripped items without blanks; null counts as empty."""
    return F.filter(F.transform(F.coalesce(values, F.array().cast("array<string>")), strip), lambda x: x != "")


def let(value: Column, body) -> Column:
    """``body`` of a value that is made once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _folded(c: Column) -> Column:
    """Compatibility form (NFKC) and full case folding; a null, which the library would fail on, stays null."""
    icu = lambda cls, method, x: F.reflect(F.lit(f"com.ibm.icu.{cls}"), F.lit(method), x, F.lit(True))
    plain = F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))
    return F.when(c.rlike(SIMPLE), plain).when(c.isNotNull(), icu("lang.UCharacter", "foldCase", icu("text.Normalizer", "compose", c)))


def normalize(c: Column) -> Column:
    """Folded, every run of non-word characters one space, trimmed."""
    return F.trim(F.regexp_replace(_folded(c), r"[^\p{L}\p{N}_]+", " "))


def normalize_python(value: str) -> str:
    folded = unicodedata.normalize("NFKC", value).casefold()
    return re.sub(r"\s+", " ", re.sub(r"[^\w]+", " ", folded)).strip()


def normalize_all(values: Column) -> Column:
    """Each item normalised, all of a list in one go: items joined by NUL, which joins with no letter, and cut apart again."""
    cut = lambda joined: F.split(F.trim(F.regexp_replace(F.regexp_replace(_folded(joined), r"[^\p{L}\p{N}_\x00]+", " "), r" ?\x00 ?", "\0")), "\0")
    # an item that is null or holds NUL itself makes the count differ
    parts = let(let(F.array_join(values, "\0"), cut), lambda p: F.when(F.size(p) == F.size(values), p).otherwise(F.transform(values, normalize)))
    return F.when(F.size(values) == 0, values).otherwise(parts)


def normal_forms(values: Column, known: Column) -> Column:
    """Each item normalised; one that stands in ``known``, pairs (k, v) of normal form and text, letter by letter takes its form from there."""
    return F.transform(values, lambda x: F.coalesce(F.get(F.filter(known, lambda p: p.v == x), F.lit(0)).k, normalize(x)))


def first_words(c: Column, count: int) -> Column:
    """The first words of a text's normal form, as many as there are; the text is searched no further than to the last of them."""
    word, gap = r"([\p{L}\p{N}_]++)", r"[^\p{L}\p{N}_]"
    found = lambda folded: F.array(*[F.regexp_extract(folded, f"^{gap}*+" + f"{gap}++".join([word] * n), n) for n in range(1, count + 1)])
    return F.when(c.isNotNull(), F.filter(let(_folded(c), found), lambda x: x != ""))


def unique_keys(norms: Column, values: Column) -> Column:
    """[(k, v)] of the first item for each non-empty key, in order."""

    def firsts(n: Column) -> Column:
        pairs = F.zip_with(n, values, lambda k, v: F.struct(k.alias("k"), v.alias("v")))
        return F.filter(pairs, lambda p, i: (p.k != "") & (F.array_position(n, p.k) == i + 1))

    return let(norms, firsts)


def texts(pairs: Column) -> Column:
    return F.transform(pairs, lambda p: p.v)


def held(expected: Column, keys: Column) -> Column:
    """Expected pairs whose key is among ``keys``."""
    return F.filter(expected, lambda p: F.array_contains(keys, p.k))


def lacking(expected: Column, keys: Column) -> Column:
    return F.filter(expected, lambda p: ~F.array_contains(keys, p.k))


def share(found: Column, expected: Column) -> Column:
    """|found| / |expected|, 1 where nothing is expected."""
    return F.when(F.size(expected) == 0, F.lit(1.0)).otherwise(F.size(found) / F.size(expected))


def lcs_places(expected: Column | str, actual: Column | str) -> Column:
    """0-based places of ``expected`` in one longest common subsequence; on a tie the shorter prefix of ``expected`` wins.

    One row of the table is folded for each expected item; a cell holds the places
    themselves, so nothing is traced back."""
    e, a = (F.col(x) if isinstance(x, str) else x for x in (expected, actual))

    def next_row(row: Column, at: Column) -> Column:
        def cell(acc: Column, j: Column) -> Column:
            up, left = F.get(row, j + 1), F.element_at(acc, -1)
            longer = F.when(F.size(up) >= F.size(left), up).otherwise(left)
            return F.concat(acc, F.array(F.when(F.get(e, at) == F.get(a, j), F.concat(F.get(row, j), F.array(at))).otherwise(longer)))

        return F.aggregate(F.sequence(F.lit(0), F.size(a) - 1), F.array(F.array().cast("array<int>")), cell)

    empty = F.array().cast("array<int>")
    table = F.aggregate(F.sequence(F.lit(0), F.size(e) - 1), F.array_repeat(empty, F.size(a) + 1), next_row)
    # most answers keep the order: then all places are taken as they are
    return F.when((F.size(e) == 0) | (F.size(a) == 0), empty).when(e == a, F.sequence(F.lit(0), F.size(e) - 1)).otherwise(F.element_at(table, -1))


def lcs_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence."""
    return F.size(lcs_places(a, b))


def similarity(a: Column | str, b: Column | str) -> Column:
    """Ratcliff-Obershelp ratio of two texts."""

    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([SequenceMatcher(None, u or "", v or "").ratio() for u, v in zip(x, y, strict=True)])

    return F.pandas_udf(ratio, DoubleType())(a, b)


def phrases_in(expected: Column, searched: Column) -> Column:
    """Expected pairs whose key stands in the normalised text as whole words."""
    padded = F.concat(F.lit(" "), searched, F.lit(" "))
    return F.filter(expected, lambda p: F.contains(padded, F.concat(F.lit(" "), p.k, F.lit(" "))))


def phrases_in_text(expected: Column, text: Column) -> Column:
    """``phrases_in`` of a text not normalised yet.

    What stands in the first words stands in the text, since neither forms nor folding reach
    over a space; so the rest is normalised only where they lack a phrase."""
    inside = lambda part: let(normalize(part), lambda searched: phrases_in(expected, searched))
    return let(inside(F.substring_index(text, " ", 16)), lambda found: F.when(F.size(found) == F.size(expected), found).otherwise(inside(text)))


def slug(c: Column, prefix: str = "") -> Column:
    """``prefix`` and the text's letters and digits with single hyphens; null where nothing is left (``required_slug`` raises)."""
    body = F.regexp_replace(F.regexp_replace(F.lower(strip(c)), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.concat(F.lit(prefix), F.nullif(body, F.lit("")))


def required(c: Column, what: str, of: Column | None = None) -> Column:
    """Stripped text; a null or blank one is an error that names what is missing."""
    whose = F.lit("") if of is None else F.concat(F.lit(" of "), F.coalesce(of.cast("string"), F.lit("a record without id")))
    return F.coalesce(optional(c), F.raise_error(F.concat(F.lit(f"missing or blank {what}"), whose)).cast("string"))


def required_slug(c: Column, prefix: str = "") -> Column:
    """``slug`` of an id, where an id of no letter or digit is an error; a null stays null."""
    failed = F.raise_error(F.concat(F.lit("no letter or digit in the id "), c)).cast("string")
    return F.when(c.isNotNull(), F.coalesce(slug(c, prefix), failed))


def short_number(c: Column) -> Column:
    """Six significant digits without trailing zeros, as ``%.6g`` writes values in [0, 1]; halves go to the even digit."""
    exact = c.cast("decimal(38,30)")
    cut = lambda x: F.regexp_replace(F.regexp_replace(x, "0+$", ""), r"\.$", "")
    power = F.floor(F.log10(c)).cast("int")
    small = F.round(c / F.pow(F.lit(10.0), power), 5)  # below 1e-4
    out = F.when(c == 0, "0")
    for least, digits in ((0.1, 6), (0.01, 7), (0.001, 8), (0.0001, 9)):
        out = out.when(c >= least, cut(F.bround(exact, digits).cast(f"decimal(38,{digits})").cast("string")))
    return out.otherwise(F.concat(cut(F.format_string("%.5f", small)), F.lit("e-"), F.lpad(F.abs(power).cast("string"), 2, "0")))


def digest(c: Column, length: int | None = None) -> Column:
    full = F.sha2(c.cast("binary"), 256)
    return full if length is None else F.substring(full, 1, length)


def joined_by_nul(*parts: Column) -> Column:
    out: list = []
    for p in parts:
        out += [p, F.char(F.lit(0))]
    return F.concat(*out[:-1])
