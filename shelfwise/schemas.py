"""Explicit schemas of the source tables and results; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType, ByteType, DataType, DateType, FloatType, IntegerType, LongType, ShortType, StringType, StructType,
    TimestampNTZType, TimestampType,
)

from shelfwise.functions.vectors import has_bad_element, parse_vector


def _schema(**columns) -> StructType:
    schema = StructType()
    for name, dtype in columns.items():
        schema.add(name, dtype)
    return schema


_TEXT, _INT, _LONG, _TIME = StringType(), IntegerType(), LongType(), TimestampType()

PRODUCT_IMPRESSION = _schema(member_id=_TEXT, product_id=_TEXT, created_at=_TIME)
PRODUCT_VIEW = _schema(id=_LONG, member_id=_TEXT, product_id=_TEXT, created_at=_TIME)
ACTION_LOG = _schema(member_id=_TEXT, product_id=_TEXT, event_name=_TEXT, created_at=_TIME)
PURCHASED_PRODUCT = _schema(customer_id=_TEXT, archived_id=_TEXT, created_at=_TIME)
PRODUCT_CATALOG = _schema(
    id=_LONG, main_image=_TEXT, status=_TEXT, primary_category_id=_INT, secondary_category_id=_INT
)
PRODUCT_EMBEDDINGS = _schema(
    id=_LONG, status=_TEXT, primary_category_id=_INT, secondary_category_id=_INT, image_vector=ArrayType(FloatType())
)
INTERACTIONS = _schema(member_id=_LONG, product_id=_LONG, interaction_type=_TEXT)

TABLES = {
    "product_impression": PRODUCT_IMPRESSION,
    "product_view": PRODUCT_VIEW,
    "action_log": ACTION_LOG,
    "purchased_product": PURCHASED_PRODUCT,
    "product_catalog": PRODUCT_CATALOG,
    "product_embeddings": PRODUCT_EMBEDDINGS,
}


# Types that stand for a declared one as they are, and types that fit into it without loss.
_STANDS_FOR = {_TIME: (TimestampNTZType(), DateType())}
_FITS_INTO = {
    _LONG: (ByteType(), ShortType(), _INT),
    _INT: (ByteType(), ShortType()),
    _TEXT: (ByteType(), ShortType(), _INT, _LONG),
}
REASON = "unfit_columns"


def _read_as(value: Column, found: DataType, declared: DataType, rule: str) -> tuple[Column, Column]:
    """The value as the declared type, and whether it cannot be that. ``rule`` is ``cast`` or a pattern of times."""
    if isinstance(declared, ArrayType) and found == _TEXT:
        vector = parse_vector(value)
        return vector, has_bad_element(vector)
    made = value.try_cast(declared) if rule == "cast" else F.try_to_timestamp(value, F.lit(rule))
    return made, value.isNotNull() & made.isNull()


def by_contract(
    df: DataFrame, schema: StructType, what: str, casts: dict[str, str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """``df`` in the columns and types of ``schema``, and the rows set aside.

    A column of the declared type, or of one that fits into it without loss, is taken as it is; a date or a time without
    a zone stands for a time. Any other type is an error, unless ``casts`` declares the column: ``cast``, or a
    pattern to read times by. A row with a value that its declared cast cannot read is set aside, as it was found,
    with the names of those columns in ``unfit_columns``. Vectors come as arrays or, by their cast, as text; an element
    that is no finite number sets the row aside. NULL fits everywhere.
    """
    df = require_columns(df, schema, what)
    casts = casts or {}
    unknown = sorted(set(casts) - set(schema.names))
    if unknown:
        raise ValueError(f"{what} has no columns to cast: {', '.join(unknown)}")
    good, unfit, wrong = [], [], []
    for field in schema.fields:
        found, value = df.schema[field.name].dataType, F.col(field.name)
        if found == field.dataType or found in _STANDS_FOR.get(field.dataType, ()):
            good.append(value)
        elif found in _FITS_INTO.get(field.dataType, ()):
            good.append(value.cast(field.dataType).alias(field.name))
        elif field.name in casts:
            made, bad = _read_as(value, found, field.dataType, casts[field.name])
            good.append(made.alias(field.name))
            unfit.append(F.when(bad, F.lit(field.name)))
        else:
            wrong.append(f"{field.name} is {found.simpleString()}, not {field.dataType.simpleString()}")
    if wrong:
        raise ValueError(f"{what} has columns of other types, to be read only by a declared cast: {'; '.join(wrong)}")
    if not unfit:
        return df.select(*good), df.limit(0).withColumn(REASON, F.lit("")).select(*schema.names, REASON)
    reason = F.concat_ws(",", *unfit)
    return df.where(reason == "").select(*good), df.where(reason != "").withColumn(REASON, reason)


def require_types(df: DataFrame, schema: StructType, what: str) -> DataFrame:
    """``require_columns`` with every column of the type in ``schema``."""
    df = require_columns(df, schema, what)
    wrong = [f"{f.name} is {df.schema[f.name].dataType.simpleString()}" for f in schema.fields
             if df.schema[f.name].dataType != f.dataType]
    if wrong:
        raise ValueError(f"{what} has columns of other types: {', '.join(wrong)}")
    return df


def require_columns(df: DataFrame, schema: StructType, what: str) -> DataFrame:
    """Narrow ``df`` to the columns of ``schema``; say which are missing instead of failing later."""
    missing = [name for name in schema.names if name not in df.columns]
    if missing:
        raise ValueError(f"{what} lacks columns: {', '.join(missing)}")
    return df.select(*schema.names)
