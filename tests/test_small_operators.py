"""Operators that no registered query calls, against hand-counted results."""

import hashlib

from pyspark.sql import functions as F

from meridia.operators import campaign as cp
from meridia.operators import integrity as ig
from meridia.operators import results as rs
from meridia.operators import retrieval as rt
from meridia.sources import trials
from meridia.streaming import windows as stream


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_subset_and_speculative_summaries(spark):
    df = spark.createDataFrame([("a", 100.0, 10, None), ("a", 300.0, 20, ""), ("a", 999.0, 99, "timeout"), ("b", 5.0, 1, "x")], "g string, ms double, n int, error string")
    found = {r["g"]: r for r in rs.subset_summary(df, "g", latency="ms", tokens="n", error="error").collect()}
    assert (found["a"]["n"], found["a"]["avg_latency"], found["a"]["avg_tokens"], round(found["a"]["error_rate"], 9), found["a"]["tokens_per_s"]) == (3, 200.0, 15.0, round(1 / 3, 9), 75.0)
    assert found["b"]["avg_latency"] is None and found["b"]["tokens_per_s"] is None
    steps = spark.createDataFrame([("a", 4, 3, 1.0), ("a", 4, 1, 2.0), ("b", 0, 0, 0.0)], "g string, d int, k int, r double")
    spec = {r["g"]: r for r in rs.speculative(steps, "g", draft="d", accepted="k", rollback="r").collect()}
    assert (spec["a"]["acceptance"], spec["a"]["rollback_ms"], spec["a"]["tokens_per_step"]) == (0.5, 3.0, 3.0) and spec["b"]["acceptance"] is None


def test_first_wins_and_open_questions(spark):
    df = spark.createDataFrame([("k", 2, "later"), ("k", 1, "first"), (None, 5, "none")], "key string, at int, x string")
    assert _rows(rt.first_wins(df, ["key"], ["at"])) == [("k", 1, "first"), (None, 5, "none")]
    raw = spark.createDataFrame([("1", "q", ["a", "b", "a"]), ("2", "q", [])], "id string, question string, answers array<string>")
    assert _rows(trials.open_questions(raw)) == [("1", "q", [], "a", ["a", "b"]), ("2", "q", [], "", [])]


def test_musique_hops(spark):
    kind = "id string, question string, answer string, paragraphs array<struct<title:string,paragraph_text:string,is_supporting:boolean>>"
    row = trials.musique(spark.createDataFrame([("1", "q", "a", [("T", "x", True), ("U", "y", False), ("T", "z", True)])], kind)).first()
    assert row["context"] == ["T: x", "U: y", "T: z"] and row["supporting_titles"] == ["T"] and row["hops"] == 2


def test_labels_ledgers_and_families(spark):
    keys = spark.createDataFrame([("m", "x", "1"), ("m", "y", None)], "model string, cache string, rate string")
    assert [r["label"] for r in ig.condensed(keys, ["model", "cache", "rate"]).orderBy("cache").collect()] == ["x|1", "y"]
    assert ig.seal({"b": "2", "a": "1"}) == hashlib.sha256(b"a\t1\nb\t2").hexdigest()
    families = spark.createDataFrame([("F1", "confirmatory"), ("F1", "secondary"), ("F2", "confirmatory")], "family_id string, tier string")
    assert _rows(cp.family_sizes(families)) == [("F1", 2, ["confirmatory", "secondary"]), ("F2", 1, ["confirmatory"])]


def test_reports_of_a_campaign(spark):
    rows = spark.createDataFrame([("old", "squad", 1, None), ("old", "squad", 1, "boom"), ("odd", "squad", 1, None)], "name string, dataset string, window int, error string")
    counted, unknown = cp.legacy_bridge(rows, spark.createDataFrame([("old", "C1")], "name string, row_key string"))
    assert _rows(counted) == [("C1", "squad", 1, 2, 1)] and _rows(unknown) == [("odd",)]
    cells = spark.createDataFrame([("b1", "f1"), ("b2", "f1"), ("b3", "f1")], "baseline string, metric string")
    marks = cp.significance(cells, spark.createDataFrame([("b1", "f1", 0.01), ("b2", "f1", 0.2)], "baseline string, metric string, p double"))
    assert _rows(marks.select("baseline", "mark")) == [("b1", "*"), ("b2", ""), ("b3", "")]
    assert cp.rows_per_cell(cells, "metric").first()["label"] == "3" and cp.rows_per_cell(rows, "name").first()["label"] == "1-2"
    files = spark.createDataFrame([("a.csv", 10, 5), ("b.csv", 20, 9)], "path string, n_rows int, modified int")
    assert tuple(cp.progress(files, 60).first()) == (2, 30, "b.csv", 0.5)
    tests = spark.createDataFrame([(1, "exploratory", 0.01), (2, "exploratory", 0.04), (3, "confirmatory", 0.0)], "seq int, tier string, p double")
    assert cp.exploratory(tests).count() == 2
    metrics = spark.createDataFrame([("a", 1.0, None), ("a", None, None)], "g string, f1 double, em double")
    assert {(r["metric"], r["n"]) for r in cp.metric_coverage(metrics, ["f1", "em"], "g").collect()} == {("f1", 1), ("em", 0)}


def test_declared_windows_and_trimming(spark):
    samples = spark.createDataFrame([(float(t),) for t in (0, 4, 5, 9, 10, 23, 30)], "ts_s double")
    windows = spark.createDataFrame([("w1", 0.0, 5.0), ("w2", 4.0, 10.0), ("w3", 22.0, 30.0)], "name string, t_start double, t_end double")
    found = stream.in_declared_windows(samples, windows, width=8.0).select("name", "ts_s")
    assert _rows(found) == [("w1", 0.0), ("w1", 4.0), ("w2", 4.0), ("w2", 5.0), ("w2", 9.0), ("w3", 23.0)]
    assert _rows(stream.trimmed(samples, F.lit(5), F.lit(10), arrival="ts_s")) == [(5.0,), (9.0,)]


def test_first_seen_drops_repeats_of_a_stream(spark, tmp_path):
    spark.sql("SELECT * FROM VALUES (1, TIMESTAMP '2024-01-01 00:00:00'), (1, TIMESTAMP '2024-01-01 00:00:30'), (2, TIMESTAMP '2024-01-01 00:00:10') AS t(id, ts)").coalesce(1).write.parquet(f"{tmp_path}/in")
    events = spark.readStream.schema("id int, ts timestamp").parquet(f"{tmp_path}/in")
    query = stream.first_seen(events, ["id"], ts="ts", ttl="1 hour").writeStream.format("memory").queryName("first_seen").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(r["id"] for r in spark.table("first_seen").collect()) == [1, 2]
