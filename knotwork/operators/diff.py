"""Differences between two copies of a keyed table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from knotwork.session import col

_JSON = {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def field_type(schema: T.StructType, path: str) -> T.DataType:
    kind: T.DataType = schema
    for part in path.split("."):
        kind = kind[part].dataType
    return kind


def encoded(df: DataFrame, path: str) -> Column:
    """One string per stored value and one stored value per string; null stays null."""
    kind = field_type(df.schema, path)
    if isinstance(kind, T.StringType):
        return col(path)
    if isinstance(kind, T.ArrayType | T.StructType | T.MapType):
        return F.to_json(col(path), _JSON)
    if isinstance(kind, T.BinaryType):
        return F.hex(col(path))
    return col(path).cast("string")


def diff_copies(
    first: DataFrame,
    second: DataFrame,
    key: str,
    fields: Sequence[str],
    latest_by: Sequence[str] = (),
    constants: Mapping[str, str] | None = None,
) -> DataFrame:
    """Rows ``key, difference, first_value, second_value`` for every record or field that differs.

    Both sides are unpivoted to key-field-value cells with counts +1 and -1; cells that do not
    cancel are the differences, and a presence cell that does not cancel is a record held on one
    side only (``only_first``, ``only_second``; its fields are then not compared).

    A record of a side is its row with the greatest ``latest_by`` values (null lowest), then the
    greatest encoded fields, so repeated rows and ties give one fixed row whatever their order.
    Values are compared as stored: arrays in order, null equal only to null, null unlike an empty
    array or text; a field of a null struct is null. Rows with a null key form one record whose
    key is null. Empty tables give ``only_...`` rows or none. Other columns are ignored, whatever
    their names.

    One shuffle, by key: ``max`` combines map-side, so a key that holds a third of all rows sends
    one row per task, and the later groupings keep the partitioning by key.
    """

    def tagged(df: DataFrame, sign: int) -> DataFrame:
        row = F.struct(
            F.struct(F.lit(0).alias("_"), *(col(c).alias(f"o{i}") for i, c in enumerate(latest_by))).alias("o"),
            *(encoded(df, f).alias(f"f{i}") for i, f in enumerate(fields)),
        )
        return df.select(col(key).alias("k"), row.alias("row"), F.lit(sign).alias("sign"))

    sides = (
        tagged(first, 1)
        .unionByName(tagged(second, -1))
        .groupBy("k")
        .agg(F.max(F.when(F.col("sign") == 1, F.col("row"))).alias("a"), F.max(F.when(F.col("sign") == -1, F.col("row"))).alias("b"))
    )

    def cells(side: str, sign: int) -> Column:
        each = [F.struct(F.lit(f).alias("field"), F.col(f"{side}.f{i}").alias("value"), F.lit(sign).alias("sign")) for i, f in enumerate(fields)]
        return F.array(*each)

    def presence(side: str, sign: int) -> Column:
        return F.array(F.struct(F.lit("").alias("field"), F.lit(None).cast("string").alias("value"), F.lit(sign).alias("sign")))

    both = F.concat(presence("a", 1), presence("b", -1), cells("a", 1), cells("b", -1))
    unpivoted = sides.select(
        "k", F.explode(F.when(F.col("b").isNull(), presence("a", 1)).when(F.col("a").isNull(), presence("b", -1)).otherwise(both)).alias("c")
    ).select("k", "c.field", "c.value", "c.sign")
    uncancelled = unpivoted.groupBy("k", "field", "value").agg(F.sum("sign").alias("net")).filter("net <> 0")
    out = uncancelled.groupBy("k", "field").agg(
        F.max(F.when(F.col("net") > 0, F.col("value"))).alias("first_value"),
        F.max(F.when(F.col("net") < 0, F.col("value"))).alias("second_value"),
        F.sum("net").alias("net"),
    )
    name = F.when(F.col("field") != "", F.col("field")).when(F.col("net") > 0, "only_first").otherwise("only_second")
    named = [F.lit(v).alias(n) for n, v in (constants or {}).items()]
    return out.select(*named, F.col("k").alias("record_id"), name.alias("difference"), "first_value", "second_value")
