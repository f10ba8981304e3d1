"""Raw text values to typed, null-safe values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gazetteer import vocab


def num(c: Column) -> Column:
    """Text to a finite number; anything else, the empty text included, is null."""
    d = F.trim(c.cast("string")).try_cast("double")
    finite = ~F.isnan(d) & (F.abs(d) != F.lit(float("inf")))
    return F.when(finite, d)


def null_if(c: Column, sentinel: str = "NULL") -> Column:
    return F.nullif(c, F.lit(sentinel))


def blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def slug(c: Column, cut: int = 60) -> Column:
    dashed = F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-")
    return F.substring(F.regexp_replace(dashed, "^-|-$", ""), 1, cut)


def stable_id(name: Column, street: Column, zip_code: Column) -> Column:
    """Deep-link key that survives rebuilds: name, street and ZIP as slugs."""
    parts = F.concat(
        slug(F.coalesce(name, F.lit("site"))), F.lit("-"),
        slug(F.coalesce(street, F.lit(""))), F.lit("-"),
        F.coalesce(zip_code, F.lit("")),
    )
    return F.substring(F.regexp_replace(parts, "-+", "-"), 1, 100)


def serves_k5(grades: Column) -> Column:
    codes = "|".join(vocab.K5_GRADE_CODES)
    return F.coalesce(grades, F.lit("")).rlike(f"(^|,)({codes})(,|$)")


def literal_array(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def empty_strings() -> Column:
    return F.array().cast("array<string>")


def union_ordered(a: Column, b: Column) -> Column:
    """Distinct values of ``a`` then ``b``, first position kept."""
    return F.array_distinct(F.concat(a, b))


def intersect_vocab(claims: Column, vocabulary) -> Column:
    """Claims that are in the vocabulary, in claim order, copies kept."""
    allowed = literal_array(vocabulary)
    return F.filter(claims, lambda t: F.array_contains(allowed, t))


def is_definitive(ok: Column, status: Column, error: Column) -> Column:
    """Whether a fetch outcome will be the same tomorrow."""
    transient = status.isin(408, 425, 429) | (status >= 500)
    no_answer = F.coalesce(status, F.lit(0)) == 0
    final_error = F.coalesce(error.isin("robots", "bad url"), F.lit(False))
    return F.when(ok, True).when(final_error, True).when(no_answer, False).otherwise(~transient)
