"""Native folds against Python's Unicode functions, over every assigned code point, and their use in items."""

import unicodedata
from dataclasses import replace

from pyspark.sql import functions as F

from labelwright.config import DEFAULT
from labelwright.functions import text as T
from labelwright.operators import item


def test_every_code_point_folds_as_in_python(spark):
    signs = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) not in ("Cn", "Cs")]
    df = spark.createDataFrame([(f"a{ch}b {ch}",) for ch in signs], "t string").repartition(4)
    python = T.strict_normalized(spark)
    assert df.where(~T.strict_folded(spark)(F.col("t")).eqNullSafe(python("t"))).count() == 0
    other = df.where(~T.strict_folded(spark, joined=False)(F.col("t")).eqNullSafe(python("t")))
    assert other.where(~F.col("t").rlike(T.JOINING)).count() == 0
    lower = {r.t: r.l for r in df.select("t", T.lower_same_length(F.col("t")).alias("l")).collect()}
    assert all(low == "".join(x.lower() if len(x.lower()) == 1 else x for x in t) and len(low) == len(t) for t, low in lower.items())


def test_composed_and_odd_texts(spark):
    rows = [("Café ﬁn ½ ß İ",), ("한국 한",), ("́",), ("",), (None,), ("ạ̇ Å",), (" ‘q’ — x y ",)]
    df = spark.createDataFrame(rows, "t string")
    got = df.select(T.strict_normalized(spark)("t").alias("p"), T.strict_folded(spark)(F.col("t")).alias("n"), T.folding(spark, True).fold(T.folding(spark, True).compose(F.col("t"))).alias("c")).collect()
    assert all(r.p == r.n == r.c for r in got) and got[0].n == "café fin 1⁄2 ss i̇"


def test_items_may_be_compared_strictly(spark):
    items = spark.createDataFrame([(1, "uploaded_photographs"), (2, "uploaded_photographs")], "item_id long, side string")
    declared = spark.createDataFrame([(1, "brand_name", "Straße Office", "typed"), (2, "class_type", "Café", "typed")], "item_id long, field string, declared string, source string")
    values = spark.createDataFrame([], "item_id long, field string, value string, sheet int, column int, block int, declined boolean")
    units = spark.createDataFrame([(1, 0, 0, 0, 1, "the STRASSE Oﬃce"), (2, 0, 0, 0, 1, "CAFÉ de")], "item_id long, sheet int, unit int, column int, block int, text string")
    of = lambda settings: {r.item_id: (r.outcome, r.label_value) for r in item.decided(items, declared, values, units, settings).where("field IN ('brand_name', 'class_type') AND declared IS NOT NULL").collect()}
    assert of(replace(DEFAULT, strict_text=True)) == {1: ("match", "STRASSE Oﬃce"), 2: ("match", "CAFÉ")}
    assert of(DEFAULT)[1][0] != "match"
