"""Vector expressions on ``array<float>`` columns, computed in double precision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def inner_product(a: Column, b: Column) -> Column:
    """Inner product of two arrays; NULL if either is NULL, an error if their lengths differ."""
    product = F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0).cast("double"),
        lambda acc, x: acc + x,
    )
    differ = F.raise_error(
        F.concat(F.lit("vectors differ in length: "), F.size(a).cast("string"), F.lit(" and "), F.size(b).cast("string"))
    )
    return F.when(F.size(a) != F.size(b), differ.cast("double")).otherwise(product)


def negative_inner_product(a: Column, b: Column) -> Column:
    """Distance used by every similarity search: the smaller, the more alike."""
    return -inner_product(a, b)


def parse_vector(text: Column) -> Column:
    """Vector of text such as ``"[1,2.5, 3]"`` or ``"1,2"``; an element that is no number becomes NULL."""
    inner = F.regexp_replace(text, r"^\[(.*)\]$", "$1")
    return F.transform(F.split(inner, ","), lambda x: F.trim(x).try_cast("float"))


def format_vector(vector: Column) -> Column:
    """Text form ``"[v1,v2,...]"`` of a vector."""
    return F.concat(F.lit("["), F.array_join(F.transform(vector, lambda x: x.cast("string")), ","), F.lit("]"))


def has_bad_element(vector: Column) -> Column:
    """True for a vector with an element that is NULL, NaN or infinite; False for a NULL vector."""
    infinite = float("inf")
    return F.coalesce(
        F.exists(
            vector,
            lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == F.lit(infinite)),
        ),
        F.lit(False),
    )


def split_parsable(df: DataFrame, text_col: str, vector_col: str) -> tuple[DataFrame, DataFrame]:
    """Parse ``text_col`` over the whole table: (rows with a good vector or NULL text, rows to quarantine)."""
    parsed = df.withColumn(vector_col, parse_vector(F.col(text_col)))
    bad = has_bad_element(F.col(vector_col))
    return parsed.where(~bad).drop(text_col), parsed.where(bad).drop(vector_col)
