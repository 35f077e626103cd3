"""Schema and data-quality checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telltale.functions import is_pinned_ref, parse_pin
from telltale.operators.ordered import row_index


def null_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """NULLs per column as (column, n_null, n_rows), in one pass."""
    counts = df.agg(
        F.count(F.lit(1)).alias("_rows"), *(F.count_if(F.col(c).isNull()).alias(c) for c in columns)
    )
    pairs = F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("n_null")) for c in columns))
    return counts.select(F.inline(pairs), F.col("_rows").alias("n_rows"))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Key values that occur more than once."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def surrogate_id(df: DataFrame, order: list[str], name: str = "surrogate_id") -> DataFrame:
    """Dense ids from 1 in ``order``, without gathering the table in one task."""
    return row_index(df, [], order, name)


def sparse_id(df: DataFrame, name: str = "surrogate_id") -> DataFrame:
    """Unique, increasing ids with gaps and no shuffle."""
    return df.withColumn(name, F.monotonically_increasing_id())


def validate_records(df: DataFrame, payload: str, schema: str, required: list[str]) -> DataFrame:
    """Parsed fields plus ``valid``: the text parses to the types and has every required field."""
    parsed = df.withColumn(
        "_p",
        F.from_json(
            F.col(payload),
            f"{schema}, _corrupt_record string",
            {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"},
        ),
    )
    complete = F.col("_p").isNotNull() & F.col("_p._corrupt_record").isNull()
    for name in required:
        complete = complete & F.col(f"_p.{name}").isNotNull()
    fields = [f for f in parsed.schema["_p"].dataType.fieldNames() if f != "_corrupt_record"]
    return parsed.withColumn("valid", complete).select(
        *df.columns, *(F.col(f"_p.{f}").alias(f) for f in fields), "valid"
    )


def dangling(df: DataFrame, parents: DataFrame, on: str) -> DataFrame:
    """Rows whose reference has no parent."""
    return df.join(parents.select(on), on, "left_anti")


def pinned_refs(df: DataFrame, ref: str) -> DataFrame:
    return df.withColumn("pinned", is_pinned_ref(ref))


def pin_inventory(df: DataFrame, line: str) -> DataFrame:
    """``name==version`` lines as an inventory; blank and comment lines are skipped."""
    pin = parse_pin(line)
    return (
        df.withColumn("_pin", pin)
        .filter(F.col("_pin.name") != "")
        .select(*df.columns, F.col("_pin.name").alias("package"), F.col("_pin.version").alias("version"))
    )
