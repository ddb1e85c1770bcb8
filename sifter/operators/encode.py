"""Categorical encoding and decoding.

The category map is a DataFrame ``(column, label, code)``: codes are the
0-based position of the label in code-point order, assigned per column by
``ordered_index`` (no single-partition window, whatever the cardinality).
Applying the map is a join per column; the map side is broadcast only when
its row count is below the limit.
"""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sifter.functions.broadcasting import broadcast_if_small
from sifter.functions.ordering import ordered_index


def categorical_columns(df: DataFrame) -> list[str]:
    """Columns that are neither numeric nor boolean (auto-detection of P7)."""
    return [f.name for f in df.schema.fields
            if not isinstance(f.dataType, (T.NumericType, T.BooleanType))]


def category_map(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``(column, label, code)`` for the distinct non-NULL labels of ``cols``."""
    parts = [df.select(F.lit(c).alias("column"), F.col(c).cast("string").alias("label"))
             .where(F.col("label").isNotNull()).distinct() for c in cols]
    labels = parts[0]
    for p in parts[1:]:
        labels = labels.unionByName(p)
    return ordered_index(labels, ["label"], name="code", group_cols=["column"]) \
        .withColumn("code", F.col("code").cast("int"))


def _small(df: DataFrame) -> DataFrame:
    return broadcast_if_small(df)


def encode_categoricals(df: DataFrame, cols: Sequence[str] | None = None
                        ) -> tuple[DataFrame, DataFrame]:
    """Replace labels by codes 0..k-1 (alphabetical); NULL -> -1."""
    cols = list(cols) if cols is not None else categorical_columns(df)
    if not cols:
        return df, df.sparkSession.createDataFrame([], "column string, label string, code int")
    maps = category_map(df, cols)
    out = df
    for c in cols:
        m = maps.where(F.col("column") == c).select(F.col("label").alias(f"_l_{c}"),
                                                    F.col("code").alias(f"_c_{c}"))
        out = out.join(_small(m), F.col(c).cast("string") == F.col(f"_l_{c}"), "left") \
            .withColumn(c, F.coalesce(F.col(f"_c_{c}"), F.lit(-1))).drop(f"_l_{c}", f"_c_{c}")
    return out, maps


def maps_to_dict(maps: DataFrame) -> dict[str, dict[str, int]]:
    """Collect a (small) category map to ``{column: {label: code}}``."""
    out: dict[str, dict[str, int]] = {}
    for r in maps.collect():
        out.setdefault(r["column"], {})[r["label"]] = int(r["code"])
    return out


def maps_from_dict(spark, maps: Mapping[str, Mapping[str, int]]) -> DataFrame:
    rows = [(c, str(lbl), int(code)) for c, m in maps.items() for lbl, code in m.items()]
    return spark.createDataFrame(rows, "column string, label string, code int")


def decode_categoricals(df: DataFrame, maps: DataFrame) -> DataFrame:
    """Codes back to labels; half-even rounding, unknown codes -> NULL.

    Columns of the map that are absent from ``df`` are skipped.
    """
    cols = [r[0] for r in maps.select("column").distinct().collect()]
    out = df
    for c in cols:
        if c not in df.columns:
            continue
        m = maps.where(F.col("column") == c).select(F.col("code").alias(f"_c_{c}"),
                                                    F.col("label").alias(f"_l_{c}"))
        code = F.bround(F.expr(f"try_cast(`{c}` AS DOUBLE)")).cast("int")
        out = out.join(_small(m), code == F.col(f"_c_{c}"), "left") \
            .withColumn(c, F.col(f"_l_{c}")).drop(f"_l_{c}", f"_c_{c}")
    return out.select(*df.columns)


def attach_fixed(df: DataFrame, fixed: Mapping[str, object]) -> DataFrame:
    """Fixed conditions as constant columns."""
    return df.withColumns({k: F.lit(v) for k, v in fixed.items()})


def rename_with_units(df: DataFrame, units: Mapping[str, str], decimals: int = 6) -> DataFrame:
    """P10: round numeric columns (half-even) and append ``(unit)`` to names."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = F.bround(c, decimals)
        unit = units.get(f.name)
        cols.append(c.alias(f"{f.name} ({unit})" if unit else f.name))
    return df.select(*cols)
