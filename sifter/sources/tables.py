"""The driver's parquet tables and the experiment views derived from them.

``lineitem`` becomes an experiment table: every line is one experiment with
inputs (quantity, discount, tax, extended price, flags) and responses.  Its
row order (``row_id``) is the order of the unique key below; the same
definition is used by the SQL oracle, so order-dependent results (first
value, group numbering, folds) are comparable.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sifter.functions.ordering import ordered_index

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

# unique at every scale factor of the test data
LINEITEM_KEY = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                "l_extendedprice", "l_shipdate")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def net_price():
    """A response with signal: extended price after discount and tax."""
    return F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))


def lineitem_experiments(spark: SparkSession, sf_dir: str, with_row_id: bool = True,
                         cols: list[str] | None = None, keep_key: bool = True) -> DataFrame:
    """lineitem as experiments: key columns, inputs, responses, ``row_id``.

    ``cols`` prunes the table before the row ids are assigned: the row-id
    step checkpoints its input, and Catalyst cannot prune through that.
    ``keep_key=False`` with ``cols``: only these and ``row_id`` are kept once the rows are in order.
    """
    li = table(spark, sf_dir, "lineitem").withColumn("net", net_price())
    if cols:
        li = li.select(*dict.fromkeys(list(LINEITEM_KEY) + [c for c in cols if c != "row_id"]))
    if with_row_id:
        keep = None if keep_key or not cols else [c for c in dict.fromkeys(cols) if c != "row_id"]
        li = ordered_index(li, list(LINEITEM_KEY), name="row_id", keep=keep)
    return li
