"""Files in and out: folders, CSV, NDJSON."""

from labelwright.operators import batch
from labelwright.sources import tables


def test_folder_is_numbered_by_path(spark, tmp_path):
    for name in ("b.png", "a.pdf", "c/d.png"):
        at = tmp_path / name
        at.parent.mkdir(exist_ok=True)
        at.write_bytes(b"%PDF")
    got = sorted((r.idx, r.filename) for r in tables.files(spark, str(tmp_path)).select("idx", "filename").collect())
    assert got == [(0, "a.pdf"), (1, "b.png"), (2, "d.png")]


def test_csv_and_ndjson(spark, tmp_path):
    field = "struct<field:string,label_value:string,application_value:string,outcome:string,reason:string,score:double>"
    rows = [("x", 2, None, [("brand_name", '=a "b", c', "d", "match", None, 99.96)]), ("y", 1, "no_text_found", None)]
    out = batch.export_rows(spark.createDataFrame(rows, f"item string, position int, error string, fields array<{field}>"))
    tables.write_csv(out, str(tmp_path / "csv"))
    text = b"".join(p.read_bytes() for p in sorted((tmp_path / "csv").glob("part-*")))
    assert text.split(b"\r\n") == [b"Item,Field,Label value,Application value,Score,Outcome,Reason,Error", b"y,,,,,,,no_text_found", b'x,brand_name,"\'=a ""b"", c",d,100.0,match,,', b""]
    tables.write_ndjson(out, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 2


def test_golden_csv(spark, tmp_path):
    (tmp_path / "said.csv").write_text('filename,brand_name,class_type,alcohol_content,net_contents,beverage_type\na.png,"One, Two",Gin,40%,,\n')
    (r,) = tables.csv(spark, str(tmp_path / "said.csv"), tables.APPLICATIONS).collect()
    assert (r.brand_name, r.alcohol_content, r.net_contents) == ("One, Two", "40%", None)
