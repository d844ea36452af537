"""Batches on their way: errors that stay with their rows, sinks that are written again, streams that are cut."""

import pytest
from pyspark.sql import functions as F

from labelwright.functions import verdict
from labelwright.operators import batch, guarded, progress
from labelwright.plans import batches

SF = "/root/testdata/sf0.001"


def test_each_row_has_its_own_error(spark):
    good = '{"file": "a.png", "type": "image/png", "size": "12", "words": [{"text": "x", "height": 3}, {"text": "y", "height": "4.5"}]}'
    rows = {
        good: ("a.png", None, "x y", 4.5), None: ("Label 1", "unreadable_line", None, None), "": ("Label 2", "unreadable_line", None, None), "[1]": ("Label 3", "unreadable_line", None, None), good[:40]: ("Label 4", "unreadable_line", None, None),
        good.replace('"a.png"', '" "'): ("Label 5", "no_name", None, None), good.replace('"12"', '"1e99"'): ("a.png", "unreadable_size", None, None), good.replace('"12"', "99000000"): ("a.png", "file_too_large", None, None),
        good.replace("image/png", "a/b"): ("a.png", "unsupported_media_type", None, None), good.replace("3}", "null}"): ("a.png", "unreadable_words", None, None), good.replace('[{"text"', '{"text"'): ("Label 10", "unreadable_line", None, None),
        '{"file": "b", "type": "image/png", "size": 1}': ("b", "unreadable_words", None, None), '{"file": "c", "type": "image/png", "size": 1, "words": []}': ("c", None, "", None), "{}": ("Label 13", "no_name", None, None),
    }
    raw = spark.createDataFrame([(7, i, k) for i, k in enumerate(rows)], "b int, position int, line string").withColumn("error", F.lit("mine"))
    got = sorted(guarded.lines(raw, "b").collect(), key=lambda r: r.position)
    assert [(r.name, r.error, r.text, r.height) for r in got] == list(rows.values())
    assert all((r.status == "ok") == (r.error is None) for r in got)


def test_stages_stop_at_the_first_error(spark):
    df = spark.createDataFrame([("1",), ("x",), (None,)], "t string")
    first = guarded.then(guarded.started(F.col("t")), lambda v: v.try_cast("int"), lambda v: F.when(v.try_cast("int").isNull(), "no_number"))
    second = guarded.then(first, lambda v: v + 1, lambda v: F.when(v.isNull(), "never"))
    assert [tuple(r.r) for r in df.select(second.alias("r")).collect()] == [(2, None), (None, "no_number"), (None, "no_number")]


def test_sink_has_each_line_once(spark, tmp_path):
    rows = progress.numbered(batches._lines(spark, SF)).select("batch_id", "position", "total", "name", "status", "error")
    want = sorted(map(tuple, rows.collect()), key=repr)
    path = str(tmp_path / "lines")
    half = rows.where("position % 2 = 0")
    assert progress.resumed(half, path).count() == half.count()
    cut = sorted(p for p in (tmp_path / "lines").glob("part-*") if p.stat().st_size)[0]
    data = cut.read_bytes()
    cut.write_bytes(data[: len(data) // 2])  # as a writer that was killed would leave it
    for crc in (tmp_path / "lines").glob(".*.crc"):
        crc.unlink()
    whole, broken = progress.read(spark, path)
    assert whole.count() < half.count() and broken.count() <= 1
    for _ in range(2):
        assert sorted(map(tuple, progress.resumed(rows, path).collect()), key=repr) == want


def test_counters_come_with_the_rows(spark):
    rows, seen = progress.observed(batches._lines(spark, SF), "test")
    rows.write.format("noop").mode("overwrite").save()
    want = batch.summary(batches._lines(spark, SF)).first()
    assert tuple(seen.get[c] for c in ("rows", "files", "failures", "artwork_sided")) == tuple(want)


def test_refused_batches(spark):
    files = spark.createDataFrame([(b, f"{i}.{e}") for b, n in ((1, 300), (2, 301)) for i in range(n) for e in ("png", "pdf")], "batch_id int, filename string")
    assert [tuple(r) for r in batch.refusals(files).collect()] == [(2, "batch_too_large", 301, 300)]
    assert batch.admitted(files).select("batch_id").distinct().first()[0] == 1
    with pytest.raises(ValueError):
        batch.refuse_oversized(files)


def test_tallies_of_every_level(spark):
    df = spark.createDataFrame([(1, 1, "match"), (1, 1, "present"), (1, 2, None), (2, None, "mismatch"), (2, None, "of tomorrow")], "batch int, item int, o string")
    got = {(r.level, r.batch, r.item): (r.n, r.match, r.worst, r.passed) for r in verdict.rolled_tallies(df, "o", "batch", "item").collect()}
    assert got == {(0, None, None): (5, 1, "mismatch", 2), (1, 1, None): (3, 1, "match", 2), (1, 2, None): (2, 0, "mismatch", 0), (2, 1, 1): (2, 1, "match", 2), (2, 1, 2): (1, 0, None, 0), (2, 2, None): (2, 0, "mismatch", 0)}
    assert verdict.rolled_tallies(df.limit(0), "o", "batch", "item").where("n > 0").count() == 0
