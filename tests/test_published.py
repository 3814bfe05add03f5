"""Tables that are published version by version."""

import json
import tempfile

import numpy as np

from bitloom.operators import evaluate
from bitloom.sources import published
from bitloom.streaming import streams as S


def content(df):
    return None if df is None else sorted(tuple(r) for r in df.collect())


def test_a_lost_write_is_never_seen(spark, tmp_path):
    table = f"{tmp_path}/t"
    rows = lambda *values: spark.createDataFrame([(v, f"x{v}") for v in values], "id long, text string")
    assert published.current_generation(spark, table) is None
    published.store_generation(rows(1, 2), table, "parser=1/é")
    published.store_generation(rows(3), table, "parser=2")
    assert content(published.current_generation(spark, table)) == [(3, "x3")]
    published.write(rows(9).withColumn("g", published.F.lit("parser=2")), table, 2, "g")  # the writer is lost before it publishes
    assert content(published.current_generation(spark, table)) == [(3, "x3")]
    published.store_generation(rows(4, 5), table, "parser=2")  # run again
    assert content(published.current_generation(spark, table)) == [(4, "x4"), (5, "x5")]
    published.switch_generation(spark, table, "parser=1/é")
    assert content(published.current_generation(spark, table)) == [(1, "x1"), (2, "x2")]
    published.switch_generation(spark, table, "parser=3")
    assert published.current_generation(spark, table) is None
    published.switch_generation(spark, table, "parser=2")
    assert content(published.current_generation(spark, table)) == [(4, "x4"), (5, "x5")] and published.versions(spark, table) == [4, 5]


def test_memory_stays_small_over_many_batches(spark):
    folder = tempfile.mkdtemp(prefix="spark-memory-")
    schema = "doc_fingerprint string, target_lang string, page int, paragraph_id string, source string, translation string, reading string, status string, quality string, seq long"
    base = {"target_lang": "fr", "page": 1, "reading": None, "status": "succeeded", "quality": None}
    n = 12
    for k in range(n):
        rows = [{**base, "doc_fingerprint": d, "paragraph_id": f"p{k % 3}", "source": f"source {k % 3}", "translation": f"t{k}", "seq": k} for d in "ab"]
        with open(f"{folder}/{k:03d}.json", "w") as f:
            f.write("\n".join(json.dumps(r) for r in rows))
    frame = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(f"{folder}/*.json")
    table, seen = f"{folder}/table", []

    def look(batch_id):
        seen.append(S.read_memory(spark, table).count())
        assert len(published._glob(spark, f"{table}/generation=*/part=*")) <= 2 * 2 and len(published.versions(spark, table)) <= 2

    S.sync_memory_stream(frame, table, f"{folder}/log", look).awaitTermination()
    assert seen == [2, 4] + [6] * (n - 2)
    assert {r["translation"] for r in S.read_memory(spark, table).collect()} == {"t9", "t10", "t11"}
    S.sync_memory_stream(frame, table, f"{folder}/again", look).awaitTermination()  # the same again changes nothing that counts
    assert S.read_memory(spark, table).count() == 6


def test_replicates_follow_their_distribution_and_a_plain_sum(spark):
    limits = evaluate.draw_limits()
    assert limits == sorted(limits) and limits[-1] < 2**32
    w = evaluate.replicate_weights(np.arange(50), 4000)
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.03 and abs(np.corrcoef(w)[0, 1:]).max() < 0.08
    rows = [(s, c, float((s * 7 + c * 3 + k) % 5 - 1)) for s in range(2) for c in range(6) for k in range(c + 1)] + [(0, 0, None)]
    got = evaluate.cluster_bootstrap(spark.createDataFrame(rows, "s int, c int, delta double"), "c", "s", "delta", 500).first()
    values = [d for _, _, d in rows if d is not None]
    assert abs(got["mean_delta"] - np.mean(values)) < 1e-12 and got["low"] < got["mean_delta"] < got["high"]
    none = evaluate.cluster_bootstrap(spark.createDataFrame([(1, 1, None)], "s int, c int, delta double"), "c", "s", "delta", 50).first()
    assert tuple(none) == (None, None, None)
