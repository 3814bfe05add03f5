"""Table functions against the array forms."""

import pytest
from pyspark.sql import functions as F

from bitloom.functions import tables
from bitloom.functions import text as T
from bitloom.operators import model_steps

TEXTS = ["It is 3.5 m. See Fig. 2 now! Is it? 好。是。", "see {v1} and <style id='2'>this</style>, ", "", None, "é" * 700 + ". end", "{ v 12 }"]


@pytest.fixture(scope="module")
def rows(spark):
    tables.register(spark)
    return spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "row_id int, source string")


def got(df):
    return sorted(map(tuple, df.collect()))


def test_text_functions_equal_their_arrays(spark, rows):
    told = spark.sql("SELECT row_id, s.* FROM {rows}, LATERAL sentences_of(source) s", rows=rows)
    assert got(told) == got(rows.select("row_id", F.posexplode(T.sentences(F.col("source")))))
    told = spark.sql("SELECT row_id, s.* FROM {rows}, LATERAL pieces_of(source, 1000) s", rows=rows)
    assert got(told) == got(rows.select("row_id", F.posexplode(T.split_utf8(F.col("source"), 1000))))
    told = spark.sql("SELECT row_id, s.* FROM {rows}, LATERAL slots_of(source) s", rows=rows)
    assert got(told) == got(model_steps.repair_slots(rows))


def test_batches_take_any_table(spark, rows):
    wide = 2**60 + 1
    made = spark.createDataFrame([(wide, i, s, None if i % 2 else wide + i) for i, s in enumerate([150, 60, None, 10, 10, 10, 10, 10, 300])] + [(None, 0, 5, None)], "doc long, i int, size int, other long")
    out = spark.sql("SELECT * FROM budget_batches(TABLE({made}) PARTITION BY doc ORDER BY (i), 'size', 200, 5)", made=made)
    assert out.columns == ["doc", "i", "size", "other", "batch"]
    assert [r["batch"] for r in out.where("doc is not null").orderBy("i").collect()] == [0, 0, 1, 1, 1, 1, 1, 1, 2]
    key = lambda df: sorted(map(tuple, df.select("doc", "i", "other").collect()), key=repr)
    assert key(out) == key(made)
    with pytest.raises(Exception, match="budget_batches takes a table"):
        spark.sql("SELECT * FROM budget_batches(TABLE({made}) PARTITION BY (doc), 'none', 200, 5)", made=made).collect()
