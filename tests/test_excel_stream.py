import zipfile

from pyspark.sql import functions as F

from tessera.sources.excel import read_xlsx

_CT = ('<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/'
       'content-types"></Types>')
_WB = ('<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" '
       'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>'
       '<sheet name="S" sheetId="1" r:id="rId1"/></sheets></workbook>')
_RELS = ('<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
         '<Relationship Id="rId1" Type="worksheet" Target="worksheets/sheet1.xml"/></Relationships>')
_SS = ('<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><t>x</t></si><si><t>name</t></si>'
       '<si><t>NA</t></si><si><t>b</t></si></sst>')
_SHEET = ('<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>'
          '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row>'
          '<row r="2"><c r="A2"><v>1.5</v></c><c r="B2" t="s"><v>3</v></c></row>'
          '<row r="3"><c r="A3" t="s"><v>2</v></c></row>'
          '<row r="4"><c r="A4"><v>3</v></c><c r="B4" t="inlineStr"><is><t>c</t></is></c></row>'
          '</sheetData></worksheet>')


def test_read_xlsx(spark, tmp_path):
    p = tmp_path / "book.xlsx"
    with zipfile.ZipFile(p, "w") as z:
        z.writestr("[Content_Types].xml", _CT)
        z.writestr("xl/workbook.xml", _WB)
        z.writestr("xl/_rels/workbook.xml.rels", _RELS)
        z.writestr("xl/sharedStrings.xml", _SS)
        z.writestr("xl/worksheets/sheet1.xml", _SHEET)
    df = read_xlsx(spark, str(tmp_path))
    assert dict(df.dtypes) == {"x": "double", "name": "string"}
    rows = sorted(df.collect(), key=lambda r: (r["x"] is None, r["x"] or 0))
    assert [(r["x"], r["name"]) for r in rows] == [(1.5, "b"), (3.0, "c"), (None, None)]


def test_stream_scoring(spark, tmp_path):
    from tessera.operators.models import TrainConfig, compare_models
    from tessera.sources import sinks
    from tessera.streaming.scoring import start_scoring

    df = spark.range(200).select(F.col("id"), (F.col("id") % 10).cast("double").alias("x"),
                                 ((F.col("id") % 10) * 2.0).alias("y"))
    res = compare_models(df, TrainConfig("y", "regression", split_keys=("id",), models=("LinearRegression",)))
    pkg = sinks.save_package(res, str(tmp_path / "pkg"))
    src = str(tmp_path / "in")
    df.write.parquet(src)
    q = start_scoring(spark, pkg, src, df.schema, str(tmp_path / "out"), str(tmp_path / "ckpt"), keep=["id"])
    q.awaitTermination(120)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == 200
    assert out.where(F.abs(F.col("prediction") - (F.col("id") % 10) * 2.0) > 1e-6).count() == 0
