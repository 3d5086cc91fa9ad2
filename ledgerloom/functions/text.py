"""Column functions on text: titles, ids, regular-expression chains and string similarities."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructType


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)``, with ``value`` computed once however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def title(x: Column) -> Column:
    """Upper-case each letter after a non-letter and lower-case the rest (``O'NEIL`` gives ``O'Neil``)."""
    runs = F.regexp_extract_all(x, F.lit(r"([A-Za-z]+|[^A-Za-z]+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda r: F.initcap(F.lower(r))), "")


def round_binary(x: Column, digits: int) -> Column:
    """``x`` to so many decimal places by its exact binary value, ties to even, as printing does: 3.55 is a little less and gives 3.5.

    The value is split in two parts whose products with the power of ten are exact, for sizes under 1e13.
    """
    k = float(10**digits)
    size = F.abs(x)
    high = size * 134217729.0 - (size * 134217729.0 - size)
    low = F.floor(size * k).cast("double")
    beyond = (high * k - (low + 0.5)) + (size - high) * k
    up = F.when(beyond == 0, F.pmod(low, F.lit(2.0)) == 1).otherwise(beyond > 0)
    return F.when(size < 1e13, F.signum(x) * (low + F.when(up, 1.0).otherwise(0.0)) / k).otherwise(F.bround(x, digits))


def alnum_id(x: Column) -> Column:
    """Lower-case letters and digits only."""
    return F.regexp_replace(F.lower(x), "[^a-z0-9]", "")


def squeeze(x: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def first_match(x: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match, null where there is none."""
    return F.when(F.rlike(x, F.lit(pattern)), F.regexp_extract(x, pattern, group))


def contains_any(x: Column, words: list[str] | tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(x, F.lit(w))
    return out


def chain(x: Column, rules: list[tuple[str, str]]) -> Column:
    """Regular-expression replacements, one after the other."""
    for pattern, into in rules:
        x = F.regexp_replace(x, pattern, into)
    return x


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, with a row of the table as the bits of one integer."""
    where: dict[str, int] = {}
    for k, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << k
    open_ = full = (1 << len(a)) - 1
    for c in b:
        hit = open_ & where.get(c, 0)
        open_ = ((open_ + hit) | (open_ - hit)) & full
    return len(a) - open_.bit_count()


def indel(a: str, b: str) -> float:
    """Twice the common subsequence over both lengths; 1 for two empty strings."""
    total = len(a) + len(b)
    return 2 * common_subsequence(a, b) / total if total else 1.0


def token_set(a: str, b: str) -> float:
    """Best indel ratio of the shared words and each side's words; 1 where one side's words are all shared."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, left, right = sorted(x & y), sorted(x - y), sorted(y - x)
    if both and (not left or not right):
        return 1.0
    core, one, two = " ".join(both), " ".join(both + left), " ".join(both + right)
    return max(indel(one, two), *((indel(core, one), indel(core, two)) if both else (0.0,)))


def token_sort(a: str, b: str) -> float:
    return indel(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


@F.pandas_udf(DoubleType())
def indel_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Normalised indel similarity, 0 to 1; null or empty on either side gives 0."""
    return pd.Series([indel(x, y) if x and y else 0.0 for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(DoubleType())
def token_set_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Token-set similarity, 0 to 1; null or empty on either side gives 0."""
    return pd.Series([token_set(x, y) if x and y else 0.0 for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(StructType().add("s1", DoubleType()).add("s2", DoubleType()).add("s3", DoubleType()))
def name_ratios(t1: pd.Series, d1: pd.Series, t2: pd.Series, d2: pd.Series, t3: pd.Series,
    d3: pd.Series) -> pd.DataFrame:
    """Indel ratio of the first pair of names, token-set ratio of the second, indel ratio of the third; null or empty on either side gives 0."""
    each = lambda f, a, b: [f(x, y) if x and y else 0.0 for x, y in zip(a, b, strict=True)]
    return pd.DataFrame({"s1": each(indel, t1, d1), "s2": each(token_set, t2, d2), "s3": each(indel, t3, d3)},
        dtype="float64")


@F.pandas_udf(DoubleType())
def name_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """The best of plain, token-sort and token-set similarity, 0 to 1."""
    return pd.Series([max(indel(x, y), token_sort(x, y), token_set(x, y)) if x and y
        else 0.0 for x, y in zip(a, b, strict=True)], dtype="float64")


def forms(name: str) -> list[str]:
    """What the three similarities compare where no word is shared: the name, its sorted words and its sorted distinct words."""
    words = name.split()
    return [name, " ".join(sorted(words)), " ".join(sorted(set(words)))]


def pair_grams(text: str) -> list[str]:
    """Neighbouring characters of a text with a space on both sides, so that the order of words does not matter; a repeated pair has its number behind it, so that none is equal."""
    seen: dict[str, int] = {}
    marked, out = f" {text} ", []
    for k in range(len(text) + 1):
        g = marked[k : k + 2]
        seen[g] = seen.get(g, 0) + 1
        out.append(f"{g}{seen[g]}")
    return out


@F.pandas_udf(ArrayType(StructType().add("form", IntegerType()).add("size", IntegerType())
    .add("grams", ArrayType(StringType()))))
def name_grams(a: pd.Series) -> pd.Series:
    """The pair grams of each form of a name."""
    return pd.Series([[{"form": k, "size": len(f), "grams": pair_grams(f)} for k, f in enumerate(forms(x))] for x in a])


@F.pandas_udf(ArrayType(StringType()))
def name_words(a: pd.Series) -> pd.Series:
    """The distinct words of a name, parted as the similarities part them."""
    return pd.Series([sorted(set(x.split())) for x in a])


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two numeric arrays, in double precision; null for a zero vector."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0),
        lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
