"""Sinks: suggestion/design CSV (S7), result store (S8), report tables.

The report is a set of tables, one folder per section, written by Spark
(Parquet by default, CSV on request); HTML/PDF rendering is out of scope.
"""

from __future__ import annotations

import os
from typing import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sifter.operators.encode import decode_categoricals, rename_with_units


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Header CSV (one file per partition, written in parallel)."""
    df.write.mode(mode).option("header", True).csv(path)


def write_result_store(rankings: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Long results partitioned by target and method."""
    rankings.write.mode(mode).partitionBy("target", "method").parquet(path)


def round_doubles(df: DataFrame, decimals: int = 6) -> DataFrame:
    return df.select(*[F.bround(F.col(f.name), decimals).alias(f.name)
                       if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name)
                       for f in df.schema.fields])


def dataset_summary(spark: SparkSession, df: DataFrame, file_name: str, feature_cols: Sequence[str],
                    target_cols: Sequence[str], replicate_strategy: str) -> DataFrame:
    """S9 section 1: one row describing the screened data set."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        F.lit(file_name).alias("file_name"), "n_rows",
        F.lit(len(feature_cols)).cast("long").alias("n_features"),
        F.lit(", ".join(target_cols)).alias("target_cols"),
        F.lit(replicate_strategy).alias("replicate_strategy"))


def report_sections(result, summary: DataFrame, bounds: DataFrame | None = None, suggestions: DataFrame | None = None,
                    pareto: DataFrame | None = None, units: Mapping[str, str] | None = None,
                    categorical_maps: DataFrame | None = None) -> dict[str, DataFrame]:
    """The report's sections from a ``ScreenResult``, in the report's order.

    The summary; a table per method that ran (best first) and its narrative; the consensus with labels; bounds; the
    suggestions and the current front with their categorical codes read back and units in the names.
    Sections without data are left out.
    """
    sections = {"summary": summary}
    for name, table in result.tables.items():
        keys = [c for c in ("target", "pc", "rank", "feature") if c in table.columns]
        sections[name] = table.orderBy(*keys)
    sections["consensus"] = result.consensus.orderBy("target", "consensus_rank")
    sections["narratives"] = result.narratives.orderBy("target", "method")
    if result.stability is not None:
        sections["stability"] = result.stability.orderBy("target", "method", "median_rank", "feature")
    if bounds is not None:
        sections["bounds"] = bounds.orderBy("feature")
    for name, table in (("suggestions", suggestions), ("pareto", pareto)):
        if table is not None:
            if categorical_maps is not None:
                table = decode_categoricals(table, categorical_maps)
            sections[name] = rename_with_units(table, dict(units or {}))
    return sections


def write_report(sections: Mapping[str, DataFrame], out_dir: str, fmt: str = "parquet",
                 decimals: int = 6, mode: str = "overwrite") -> list[str]:
    """Every section rounded and written under ``out_dir/<section>/``
    with a ``generated_at`` time stamp column."""
    written = []
    for name, df in sections.items():
        path = os.path.join(out_dir, name)
        out = round_doubles(df, decimals).withColumn("generated_at", F.current_timestamp())
        w = out.write.mode(mode)
        if fmt == "csv":
            w.option("header", True).csv(path)
        else:
            w.parquet(path)
        written.append(path)
    return written
