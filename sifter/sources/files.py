"""File scans: CSV (S1), Excel workbooks (S2, S3), transposed layout.

Columns are read as text, missing-value tokens become NULL, and a column is
restored to a numeric type only when every non-NULL value casts (one
aggregation job decides all columns).  This mirrors how a data-frame library
infers types and avoids Spark CSV leaving ``NA`` as a string.
"""

from __future__ import annotations

import io
import os
import re
import zipfile
from array import array
from itertools import islice
from typing import Iterable
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sifter.functions.ordering import ordered_index

# The tokens a CSV reader treats as missing (same set as the
# default NA list of pandas.read_csv).
NULL_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]

SUPPORTED_EXTENSIONS = {".csv", ".xlsx", ".xls"}


def _format_of(path: str) -> str:
    """The reader for a path by its ending; a local folder is read as CSV parts.

    Only plain local paths can be looked up here: a glob or a path with a scheme is left to Spark.
    """
    ending = os.path.splitext(path.rstrip("/"))[1].lower()
    if not re.match(r"\w[\w+.-]*:/", path) and not set("*?[") & set(path):
        if os.path.isdir(path):
            return ".csv"
        if not os.path.exists(path):
            raise FileNotFoundError(path)
    if ending not in SUPPORTED_EXTENSIONS:
        raise ValueError(f"Unsupported file extension {ending!r} (readable: {sorted(SUPPORTED_EXTENSIONS)})")
    return ending


def quoted(name: str) -> str:
    """A column name as an identifier; headers such as ``Temp. (C)`` hold dots, blanks and brackets."""
    return "`" + name.replace("`", "``") + "`"


def null_tokens(df: DataFrame, cols: Iterable[str] | None = None) -> DataFrame:
    """Replace missing-value tokens in string columns with NULL (rule R7)."""
    cols = list(cols) if cols is not None else [
        f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    tokens = F.array(*[F.lit(t) for t in NULL_TOKENS])
    return df.withColumns({
        c: F.when(~F.array_contains(tokens, F.trim(F.col(quoted(c)))), F.col(quoted(c))) for c in cols})


def restore_types(df: DataFrame, cols: Iterable[str] | None = None) -> DataFrame:
    """Cast text columns to long/double when every non-NULL value casts.

    One aggregate counts, per column, non-NULL values and successful casts;
    integral columns without missing values become ``long`` (like a data-frame
    library's int64), other numeric columns ``double``.
    """
    cols = list(cols) if cols is not None else [
        f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not cols:
        return df
    aggs = []
    for i, c in enumerate(cols):
        v = F.trim(F.col(quoted(c)))
        aggs += [F.count(v).alias(f"n{i}"),
                 F.count(F.expr(f"try_cast(trim({quoted(c)}) AS DOUBLE)")).alias(f"d{i}"),
                 F.count(F.when(v.rlike(r"^[+-]?\d+$"), 1)).alias(f"l{i}"),
                 F.count(F.lit(1)).alias(f"r{i}")]
    stats = df.agg(*aggs).first()
    casts = {}
    for i, c in enumerate(cols):
        n, d, lng, rows = stats[f"n{i}"], stats[f"d{i}"], stats[f"l{i}"], stats[f"r{i}"]
        if n == 0 or d != n:
            continue
        if lng == n and n == rows:
            casts[c] = F.expr(f"try_cast(trim({quoted(c)}) AS BIGINT)")
        else:
            casts[c] = F.expr(f"try_cast(trim({quoted(c)}) AS DOUBLE)")
    return df.withColumns(casts) if casts else df


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header row; types inferred as described in the module doc."""
    raw = (spark.read.option("header", True).option("inferSchema", False)
           .option("mode", "PERMISSIVE").csv(path))
    if not raw.columns:
        raise ValueError(f"File is empty (no columns found): {path}")
    return restore_types(null_tokens(raw))


def load_file(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """Load a CSV (file, directory or glob) or an .xlsx workbook."""
    suffix = _format_of(path)
    if suffix == ".csv":
        return read_csv(spark, path)
    if suffix == ".xls":
        raise ValueError("Legacy binary .xls workbooks are not supported; save as .xlsx")
    return read_xlsx(spark, path, sheet=sheet)


# ---------------------------------------------------------------------------
# Excel (.xlsx = zip of XML parts); parsed inside tasks, one workbook per row
# of the binaryFile source, so many workbooks load in parallel.
# ---------------------------------------------------------------------------

_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main",
       "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships"}

CELLS_SCHEMA = T.StructType([
    T.StructField("file", T.StringType()), T.StructField("sheet", T.StringType()),
    T.StructField("row_no", T.LongType()), T.StructField("col_no", T.IntegerType()),
    T.StructField("value", T.StringType())])


def _col_index(ref: str) -> int:
    letters = re.match(r"[A-Z]+", ref).group(0)
    idx = 0
    for ch in letters:
        idx = idx * 26 + (ord(ch) - 64)
    return idx - 1


CELL_ROWS = 20_000          # cells of a workbook that leave a task at once


class SharedStrings:
    """A workbook's shared strings by index: one buffer and where each string ends."""

    def __init__(self, zf: zipfile.ZipFile):
        self.ends, self.blob = array("Q"), bytearray()
        if "xl/sharedStrings.xml" in zf.namelist():
            with zf.open("xl/sharedStrings.xml") as part:
                for text in _texts(part, "si"):
                    self.blob += text.encode()
                    self.ends.append(len(self.blob))

    def __getitem__(self, i: int) -> str:
        return self.blob[self.ends[i - 1] if i else 0:self.ends[i]].decode()


def _events(part, keep: str):
    """The elements named ``keep`` of an XML part as they close, each dropped after use: memory does not grow with the part."""
    open_ = []
    for event, el in ET.iterparse(part, events=("start", "end")):
        if event == "start":
            open_.append(el)
            continue
        open_.pop()
        if el.tag == f"{{{_NS['m']}}}{keep}":
            yield el
            if open_:
                open_[-1].remove(el)


def _texts(part, element: str):
    for el in _events(part, element):
        yield "".join(t.text or "" for t in el.iter(f"{{{_NS['m']}}}t"))


def sheets_of(zf: zipfile.ZipFile) -> list[tuple[str, str]]:
    """(name, part) of a workbook's sheets, in their order."""
    wb, rels = (ET.fromstring(zf.read(p)) for p in ("xl/workbook.xml", "xl/_rels/workbook.xml.rels"))
    targets = {r.get("Id"): r.get("Target").lstrip("/") for r in rels}
    out = []
    for sh in wb.find("m:sheets", _NS):
        target = targets[sh.get(f"{{{_NS['r']}}}id")]
        out.append((sh.get("name"), target if target.startswith("xl/") else "xl/" + target))
    return out


def _sheet_cells(zf: zipfile.ZipFile, part: str, shared: SharedStrings):
    """(row, column, value) of a sheet's cells, read as a stream of XML events."""
    with zf.open(part) as stream:
        for row in _events(stream, "row"):
            at = int(row.get("r")) - 1
            for c in row.findall("m:c", _NS):
                kind = c.get("t")
                if kind == "inlineStr":
                    value = "".join(t.text or "" for t in c.iter(f"{{{_NS['m']}}}t"))
                else:
                    v = c.find("m:v", _NS)
                    if v is None:
                        continue
                    value = shared[int(v.text)] if kind == "s" else v.text
                    if kind == "b":
                        value = "True" if value == "1" else "False"
                yield at, _col_index(c.get("r")), value


def _unpack_workbooks(batches):
    """Cells in portions of ``CELL_ROWS``; a sheet is never held as a whole."""
    names = [f.name for f in CELLS_SCHEMA.fields]
    for pdf in batches:
        for path, content in zip(pdf["path"], pdf["content"]):
            zf = zipfile.ZipFile(io.BytesIO(content))
            shared = SharedStrings(zf)
            for sheet, part in sheets_of(zf):
                cells = _sheet_cells(zf, part, shared)
                while rows := list(islice(cells, CELL_ROWS)):
                    yield pd.DataFrame([(path, sheet, *r) for r in rows], columns=names)


def _listed_sheets(batches):
    for pdf in batches:
        for path, content in zip(pdf["path"], pdf["content"]):
            found = sheets_of(zipfile.ZipFile(io.BytesIO(content)))
            yield pd.DataFrame([(path, i, name) for i, (name, _) in enumerate(found)], columns=["file", "position", "sheet"])


def _workbooks(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile")
    if os.path.isdir(path):
        files = files.option("pathGlobFilter", "*.xlsx")
    return files.load(path).select("path", "content")


def workbook_cells(spark: SparkSession, path: str) -> DataFrame:
    """Long cell table ``(file, sheet, row_no, col_no, value)`` of workbooks."""
    return _workbooks(spark, path).mapInPandas(_unpack_workbooks, CELLS_SCHEMA)


def list_sheets(spark: SparkSession, path: str) -> DataFrame:
    """S3: ``(file, position, sheet)`` of the workbooks' sheets; only the workbooks' lists are read, no cells."""
    return _workbooks(spark, path).mapInPandas(_listed_sheets, "file string, position int, sheet string")


def read_xlsx(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """First sheet (or ``sheet``) of each workbook, header in row 1.

    Every workbook's cells go by its own header, so workbooks may order their columns differently; a
    column that a workbook lacks is NULL there.  A header that repeats inside a workbook gets ``.1``,
    ``.2``, ... in column order; cells under no header are left out.
    """
    cells = workbook_cells(spark, path)
    if sheet is None:
        cells = cells.join(list_sheets(spark, path).where("position = 0").drop("position"), ["file", "sheet"])
    else:
        cells = cells.where(F.col("sheet") == sheet)
    repeat = F.row_number().over(Window.partitionBy("file", "value").orderBy("col_no")) - 1
    header = cells.where(F.col("row_no") == 0).withColumn("_k", repeat).select(
        "file", "col_no", F.when(F.col("_k") == 0, F.col("value")).otherwise(F.concat_ws(".", "value", "_k")).alias("column"))
    # one entry per distinct column name: the schema of the result
    names = [r["column"] for r in header.groupBy("column").agg(F.min("col_no").alias("at")).orderBy("at", "column").collect()]
    if not names:
        raise ValueError(f"No header row in the sheet: {path}")
    body = cells.where(F.col("row_no") > 0).join(header, ["file", "col_no"])
    wide = body.groupBy("file", "row_no").pivot("column", names).agg(F.max("value")).orderBy("file", "row_no")
    return restore_types(null_tokens(wide.drop("file", "row_no")))


# ---------------------------------------------------------------------------
# Transposed layout (one row per variable, one column per experiment)
# ---------------------------------------------------------------------------


def untranspose(long_df: DataFrame, name_col: str = "variable", exp_col: str = "exp_no",
                value_col: str = "value") -> DataFrame:
    """Pivot a ``(variable, experiment, value)`` table to one row per experiment.

    Variable names become column names (as text), values are restored to
    numeric types column by column; columns that do not cast stay text.  The
    distinct variable list (small: one entry per variable) is collected to
    name the pivot columns.
    """
    # one entry per variable: small
    names = [r[0] for r in long_df.select(F.col(name_col).cast("string")).distinct().collect()]
    order = _variable_order(long_df, name_col, names)
    text = F.col(value_col).cast("string")
    # a variable listed twice: the first in the file counts, or the least value where no position is known
    value = F.min_by(text, F.col("_var_pos")) if "_var_pos" in long_df.columns else F.min(text)
    wide = (long_df.withColumn(name_col, F.col(name_col).cast("string"))
            .groupBy(exp_col).pivot(name_col, order).agg(value))
    return restore_types(null_tokens(wide, order), order).orderBy(exp_col)


def _variable_order(long_df: DataFrame, name_col: str, names: list[str]) -> list[str]:
    if "_var_pos" in long_df.columns:
        pos = {r[0]: r[1] for r in long_df.groupBy(name_col).agg(F.min("_var_pos")).collect()}
        return sorted(names, key=lambda n: pos.get(n, 0))
    return names


def read_transposed(spark: SparkSession, path: str) -> DataFrame:
    """S5 from a header-less CSV whose rows are variables.

    If the first column holds text it supplies the variable names, otherwise
    the names are "0", "1", ...  Rows keep file order (single file per path).
    """
    raw = spark.read.option("header", False).csv(path)
    if not raw.columns:
        raise ValueError(f"File is empty (no columns found): {path}")
    raw = null_tokens(raw).withColumn("_var_pos", F.monotonically_increasing_id())
    first = raw.columns[0]
    non_numeric = raw.where(F.col(first).isNotNull()
                            & F.expr(f"try_cast(`{first}` AS DOUBLE)").isNull()).limit(1).count()
    exp_cols = raw.columns[1:-1] if non_numeric else raw.columns[:-1]
    if non_numeric:
        named = raw.withColumn("variable", F.col(first))
    else:
        # variables are the file's rows, named "0", "1", ... in file order
        named = ordered_index(raw, ["_var_pos"], name="_nth").withColumn("variable", F.col("_nth").cast("string"))
    stack = ", ".join(f"{i}, `{c}`" for i, c in enumerate(exp_cols))
    long_df = named.selectExpr("variable", "_var_pos",
                               f"stack({len(exp_cols)}, {stack}) AS (exp_no, value)")
    return untranspose(long_df, "variable", "exp_no", "value").drop("exp_no")
