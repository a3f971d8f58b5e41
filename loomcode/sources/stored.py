"""Columns that hold JSON as text: read by their schema, what does not fit it put aside."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What is kept as text, and its schema.
SCHEMAS = {
    "roles": "map<string,string>",
    "excluded_roles": "array<string>",
    "matched_expressions": "array<string>",
    "codebook": "array<struct<label:string,code_id:bigint,description:string,expressions:array<struct<lang:string,expression:string>>>>",
}
_BAD = "__malformed"


def read_json(rows: DataFrame, column: str, schema: str | None = None, keys: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(rows with the column read by its schema; keys and text of what is no such JSON).

    schema: of the value, that of SCHEMAS by the column's name if it is not given. A null or blank text is null. Malformed text is null in the rows and a row of its own
    in the side table; a value of another type anywhere in it makes it malformed. Fields that the schema has not are not read.
    """
    schema = schema or SCHEMAS[column]
    text = F.nullif(F.trim(F.col(column)), F.lit(""))
    # An object around the text gives every schema, lists and maps too, a place for the record that does not parse.
    parsed = F.from_json(F.concat(F.lit('{"v":'), text, F.lit("}")), f"struct<v:{schema},{_BAD}:string>", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BAD})
    both = rows.withColumn("__read", parsed)
    broken = F.col(f"__read.{_BAD}").isNotNull()
    good = both.withColumn(column, F.when(~broken, F.col("__read.v"))).drop("__read")
    return good, both.where(broken).select(*keys, F.col(column).alias("text"))


def as_json(rows: DataFrame, column: str) -> DataFrame:
    """rows with the column as text, as read_json() reads it."""
    return rows.withColumn(column, F.to_json(F.col(column)))
