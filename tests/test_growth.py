"""Findings of larger tables: work that grew with copies, and figures whose last bit decided."""

import duckdb
from pyspark.sql import functions as F

from labelwright.operators import layout, quality
from labelwright.plans import catalog


def test_a_mean_between_two_tenths_rounds_as_its_sum_of_decimals(spark):
    rows = [(1, 52.69, None), (1, 2.41, None), (1, 99.0, "unread"), (2, 59.15, None), (2, 54.55, None), (3, 5.0, "unread"), (4, 1.25, None)]
    got = layout.item_confidence(spark.createDataFrame(rows, "item long, confidence double, error string"), "item").collect()
    assert {r.item: r.confidence for r in got} == {1: 27.6, 2: 56.9, 3: 0.0, 4: 1.3}  # 55.1 / 2 and 113.7 / 2 in doubles are below 27.55 and 56.85


def test_means_are_those_of_rows_in_order_however_they_are_dealt_out(spark, tmp_path):
    source = "/root/testdata/sf0.1/events.parquet"
    spark.read.parquet(source).repartition(7, "ts").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect(config={"threads": 1})
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{source}'")
    want = dict(con.execute(catalog.oracle_sql()["item_confidences"]).fetchall())
    got = catalog.queries()["item_confidences"](spark, str(tmp_path))
    assert {r.user_id: r.confidence for r in got.collect()} == want


def test_copies_of_a_file_name_are_not_paired(spark, tmp_path):
    types = F.when(F.col("id") % 3 == 0, "GIN").when(F.col("id") % 3 == 1, "RUM")  # else null
    part = spark.range(200_000).select(F.col("id").alias("p_partkey"), F.lit("oak").alias("p_name"), types.alias("p_type"), (F.col("id") % 50).alias("p_size"))
    part.unionByName(spark.createDataFrame([(-1, "ash", "GIN", 30), (-2, None, "GIN", 30)], "p_partkey long, p_name string, p_type string, p_size long")).write.parquet(f"{tmp_path}/part.parquet")
    got = {tuple(r) for r in catalog.queries()["golden_rows"](spark, str(tmp_path)).collect()}
    assert got == {("oak.png", 200_000 * 96_000, 2), ("ash.png", 1, 1)}  # 19,200,000,000 pairs


def test_cells_of_pages_are_neither_sorted_nor_held(spark):
    from labelwright.operators import ticks

    cells = spark.range(40).repartition(4, "id").select("id", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("x")).select("*", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("y"), (F.col("x") * 3 + F.col("id") % 2).cast("long").alias("luminance"))
    boxes = spark.createDataFrame([(0, "a", 1, 2, 4, 5), (1, "a", 1, 2, 4, 5), (1, "b", 2, 2, 5, 3), (1, "c", 3, 3, 3, 9), (2, "a", 50, 50, 60, 60)], "id long, option string, x0 int, y0 int, x1 int, y1 int")
    out = ticks.means(boxes, cells, "id")
    assert {(r.id, r.option): r.luminance for r in out.collect()} == {(0, "a"): 6.0, (1, "a"): 7.0, (1, "b"): 10.0, (1, "c"): None, (2, "a"): None}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "Window" not in plan


def test_the_index_of_words_is_made_once(spark):
    from labelwright.operators import search

    needles = spark.createDataFrame([("old oak",)], "needle string")
    texts = spark.createDataFrame([(1, "the old oak barrel"), (2, " - "), (3, None), (4, "")], "doc_id long, text string")
    out = search.reaching(needles, texts, "doc_id")
    assert [(r.doc_id, r.hit, r.score) for r in out.collect()] == [(1, "old oak", 100.0)]
    assert "InMemoryRelation" in out._jdf.queryExecution().executedPlan().toString()
