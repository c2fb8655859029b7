from tessera.functions.scalars import escape_html, split_percentages
from tessera.sources import readers


def test_allowed_file_is_case_insensitive():
    assert readers.allowed_file("X.CSV") and readers.allowed_file("a.xlsx") and not readers.allowed_file("a.txt")
    assert readers.file_extension("/d/X.CSV") == "csv"
    assert readers.validate_upload("", 3) == (False, "No file selected")
    assert readers.validate_upload("a.csv", 0) == (False, "File is empty.")


def test_csv_missing_tokens_and_inference(spark, tmp_path):
    p = tmp_path / "X.CSV"
    p.write_text("a,b,c,d,e\n1,NA,True,2020-01-01,x\n2,2.5,False,2020-01-02,null\nN/A,,True,,None\n")
    df = readers.read_table(spark, str(p))
    types = dict(df.dtypes)
    assert types == {"a": "bigint", "b": "double", "c": "boolean", "d": "string", "e": "string"}
    rows = df.orderBy("a").collect()
    assert [r["a"] for r in rows] == [None, 1, 2]
    assert sum(r["e"] is None for r in rows) == 2


def test_split_percentages_truncates(spark):
    df = spark.createDataFrame([(0.29,), (0.57,), (0.58,), (0.8,)], "r double")
    tr, te = split_percentages("r")
    got = [(r[0], r[1]) for r in df.select(tr, te).collect()]
    assert got == [(28, 72), (56, 44), (57, 43), (80, 20)]


def test_escape_html(spark):
    df = spark.createDataFrame([("<a href=\"x\">'&'</a>",), ("NaN",), (None,)], "s string")
    got = [r[0] for r in df.select(escape_html("s")).collect()]
    assert got == ["&lt;a href=&quot;x&quot;&gt;&#x27;&amp;&#x27;&lt;/a&gt;", "", ""]
