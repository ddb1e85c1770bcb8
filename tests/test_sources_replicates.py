"""Sources (CSV, xlsx, transposed) and replicate handling on the loader fixtures."""

import os
import zipfile

import pytest

from sifter.operators import replicates as rep
from sifter.sources import files as src


def _write(tmp_path, name, text):
    p = tmp_path / name
    p.write_text(text)
    return str(p)


SIMPLE = "temperature,pressure,catalyst,yield\n100,1.0,A,0.85\n100,1.0,A,0.87\n200,2.0,B,0.60\n300,1.5,C,0.72\n"


def test_csv_types_and_null_tokens(spark, tmp_path):
    df = src.load_file(spark, _write(tmp_path, "a.csv", "x,y,z\n1,NA,foo\n2,2.5,n/a\n3,,bar\n"))
    types = dict(df.dtypes)
    assert types == {"x": "bigint", "y": "double", "z": "string"}
    rows = df.orderBy("x").collect()
    assert rows[0]["y"] is None and rows[1]["z"] is None and rows[2]["y"] is None


def test_header_only_and_errors(spark, tmp_path):
    df = src.load_file(spark, _write(tmp_path, "h.csv", "temperature,pressure,yield\n"))
    assert df.count() == 0 and df.columns == ["temperature", "pressure", "yield"]
    with pytest.raises(FileNotFoundError):
        src.load_file(spark, str(tmp_path / "missing.csv"))
    with pytest.raises(ValueError):
        src.load_file(spark, _write(tmp_path, "a.txt", "x\n1\n"))
    with pytest.raises(ValueError):
        src.load_file(spark, _write(tmp_path, "a.XLS", "x"))


def _xlsx(path, rows):
    shared = []
    def idx(v):
        if v not in shared:
            shared.append(v)
        return shared.index(v)
    sheet_rows = []
    for r, row in enumerate(rows, start=1):
        cells = []
        for c, v in enumerate(row):
            ref = f"{chr(65 + c)}{r}"
            if isinstance(v, str):
                cells.append(f'<c r="{ref}" t="s"><v>{idx(v)}</v></c>')
            else:
                cells.append(f'<c r="{ref}"><v>{v}</v></c>')
        sheet_rows.append(f'<row r="{r}">{"".join(cells)}</row>')
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rns = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} {rns}><sheets><sheet name="Data" sheetId="1" r:id="rId1"/>'
                                      f'<sheet name="Other" sheetId="2" r:id="rId2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels",
                   '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
                   '<Relationship Id="rId1" Target="worksheets/sheet1.xml"/>'
                   '<Relationship Id="rId2" Target="worksheets/sheet2.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData>{"".join(sheet_rows)}</sheetData></worksheet>')
        z.writestr("xl/worksheets/sheet2.xml", f'<worksheet {ns}><sheetData><row r="1"><c r="A1"><v>1</v></c></row>'
                                               f'</sheetData></worksheet>')
        z.writestr("xl/sharedStrings.xml", f'<sst {ns}>' + "".join(f"<si><t>{s}</t></si>" for s in shared) + "</sst>")


def test_xlsx_first_sheet(spark, tmp_path):
    p = str(tmp_path / "book.xlsx")
    _xlsx(p, [["temperature", "pressure", "catalyst", "yield"], [100, 1.0, "A", 0.85], [100, 1.0, "A", 0.87],
              [200, 2.0, "B", 0.60], [300, 1.5, "C", 0.72]])
    df = src.load_file(spark, p)
    assert df.columns == ["temperature", "pressure", "catalyst", "yield"]
    assert df.count() == 4
    assert dict(df.dtypes)["yield"] == "double" and dict(df.dtypes)["catalyst"] == "string"
    sheets = sorted(r["sheet"] for r in src.list_sheets(spark, p).collect())
    assert sheets == ["Data", "Other"]


def test_a_long_sheet_is_read_as_a_stream(spark, tmp_path):
    import tracemalloc
    n = 150_000
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rns = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    p = str(tmp_path / "long.xlsx")
    with zipfile.ZipFile(p, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} {rns}><sheets><sheet name="Runs" sheetId="1" r:id="a"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="a" Target="/xl/worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst {ns}><si><t>x</t></si><si><r><t>y</t></r><r><t>é</t></r></si><si><t></t></si></sst>')
        rows = "".join(f'<row r="{i + 2}"><c r="A{i + 2}"><v>{i}</v></c><c r="B{i + 2}" t="s"><v>{i % 3}</v></c></row>' for i in range(n))
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="inlineStr"><is><t>id</t></is></c><c r="B1" t="s"><v>1</v></c></row>{rows}</sheetData></worksheet>')
    zf = zipfile.ZipFile(p)
    tracemalloc.start()
    count = sum(1 for _ in src._sheet_cells(zf, "xl/worksheets/sheet1.xml", src.SharedStrings(zf)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert count == 2 * n + 2 and peak < 8 << 20
    df = src.read_xlsx(spark, p)
    assert df.columns == ["id", "yé"] and df.count() == n
    assert df.agg({"id": "sum"}).first()[0] == n * (n - 1) // 2 and df.where("`yé` = 'yé'").count() == n // 3
    assert [tuple(r)[1:] for r in src.list_sheets(spark, p).collect()] == [(0, "Runs")]


def test_transposed_csv(spark, tmp_path):
    p = _write(tmp_path, "t.csv", "temperature,100,200,300\nyield,0.5,0.6,NA\ncat,A,B,C\n")
    df = src.read_transposed(spark, p)
    assert df.columns == ["temperature", "yield", "cat"]
    rows = df.collect()
    assert [r["temperature"] for r in rows] == [100, 200, 300]
    assert rows[2]["yield"] is None and rows[1]["cat"] == "B"


@pytest.fixture()
def simple(spark, tmp_path):
    df = src.load_file(spark, _write(tmp_path, "s.csv", SIMPLE))
    from sifter.functions.ordering import ordered_index
    from pyspark.sql import functions as F
    return df.withColumn("row_id", F.monotonically_increasing_id())


def test_average_and_std(simple):
    avg = rep.handle_replicates(simple, ["temperature", "pressure", "catalyst"], ["yield"], "average")
    got = {r["temperature"]: r["yield"] for r in avg.collect()}
    assert got[100] == pytest.approx(0.86) and len(got) == 3
    std = rep.handle_replicates(simple, ["temperature", "pressure", "catalyst"], ["yield"], "std_uncertainty")
    s = {r["temperature"]: r["yield_std"] for r in std.collect()}
    assert s[100] == pytest.approx(0.0141421, abs=1e-7) and s[200] is None
    assert std.columns[:5] == ["temperature", "pressure", "catalyst", "yield", "yield_std"]


def test_replicate_groups_in_first_appearance_order(spark):
    rows = [(0, 100, 1.0, .80), (1, 100, 1.0, .82), (2, 200, 2.0, .65), (3, 100, 1.0, .81),
            (4, 200, 2.0, .67), (5, 300, 3.0, .55)]
    df = spark.createDataFrame(rows, "row_id long, temperature long, pressure double, yield double")
    d = {r["row_id"]: r["replicate_group"] for r in rep.detect_replicates(df, ["temperature", "pressure"]).collect()}
    assert d == {0: 0, 1: 0, 3: 0, 2: 1, 4: 1}
    summ = rep.replicate_summary(df, ["temperature", "pressure"], ["yield"]).orderBy("replicate_group").collect()
    assert [r["n_replicates"] for r in summ] == [3, 2]
    assert summ[0]["yield_mean"] == pytest.approx(0.81)


def test_no_replicates_and_errors(spark):
    df = spark.createDataFrame([(0, 100, .8), (1, 200, .7)], "row_id long, temperature long, yield double")
    assert rep.detect_replicates(df, ["temperature"]).count() == 0
    assert "replicate_group" in rep.detect_replicates(df, ["temperature"]).columns
    with pytest.raises(ValueError):
        rep.handle_replicates(df, ["temperature"], ["yield"], "median")
    with pytest.raises(ValueError):
        rep.handle_replicates(df, ["temperature"], ["temperature"])
    with pytest.raises(ValueError):
        rep.detect_replicates(df, ["nope"])


def test_iqr_outlier_fixture(spark):
    vals = [1.0, 1.1, 0.9, 1.0, 9.0]
    df = spark.createDataFrame([(i, 1, v) for i, v in enumerate(vals)], "row_id long, x long, y double")
    out = [r["row_id"] for r in rep.iqr_outliers(df, ["x"], ["y"]).collect()]
    assert out == [4]
    assert rep.remove_rows(df, rep.iqr_outliers(df, ["x"], ["y"])).count() == 4


def test_stream_matches_batch(spark, tmp_path):
    from sifter.streaming.replicates import run_to_completion
    d = tmp_path / "incoming"
    d.mkdir()
    rows = [(100, 1.0, 0.85), (100, 1.0, 0.87), (200, 2.0, 0.60)]
    spark.createDataFrame(rows, "t long, p double, y double").write.parquet(str(d / "b1"))
    spark.createDataFrame([(100, 1.0, 0.86)], "t long, p double, y double").write.parquet(str(d / "b2"))
    schema = "t long, p double, y double"
    out = run_to_completion(spark, str(d) + "/*", schema, ["t", "p"], ["y"])
    got = {r["t"]: (r["n_replicates"], r["y_mean"]) for r in out.collect()}
    assert got[100][0] == 3 and got[100][1] == pytest.approx(0.86) and got[200][0] == 1
