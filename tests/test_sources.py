"""Trial trees, JSON lines, QA sets, sinks and streams."""

import json

import pytest
from pyspark.sql import functions as F

from meridia.sources import sinks, trials
from meridia.streaming import windows as stream


def _tree(root):
    def put(path, text):
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)

    put("baselines/c1/trial_1/results.csv", 'example_id,answer,error,empty_generation\n1,"say ""hi""\nthere",,false\n2,,Timeout,False\n')
    put("baselines/c1/trial_1/x_results.csv", "example_id\n99\n")
    put("baselines/c1/trial_2/b_results.csv", "example_id,latency_ms,error\n1,None,None\n")
    put("baselines/c1/trial_2/metrics.json", json.dumps({"dataset": "d", "queries_per_second": "fast", "tokens_per_second": 7}))
    put("compression/c2/trial_a/results.csv", "example_id,answer,error,empty_generation\n1,NA,0,True\n")


def test_trial_tree(spark, tmp_path):
    _tree(tmp_path)
    long = trials.results_long(spark, str(tmp_path)).cache()
    got = sorted((r["tree"], r["cell"], r["trial"], r["example_id"], r["answer"], r["is_error_row"], r["is_empty_gen"]) for r in long.na.fill("∅", ["answer"]).collect())
    assert got == [("baselines", "c1", 1, "1", 'say "hi"\nthere', False, False), ("baselines", "c1", 1, "2", "", True, False), ("baselines", "c1", 2, "1", "∅", False, False), ("compression", "c2", 0, "1", "NA", False, True)]
    assert long.filter("trial = 2").first()["latency_ms"] == "None"
    scalar = trials.trial_scalars(spark, str(tmp_path)).first()
    assert (scalar["trial"], scalar["queries_per_second"], scalar["tokens_per_second"]) == (2, None, 7.0)
    with pytest.raises(FileNotFoundError):
        trials.results_long(spark, str(tmp_path / "none"))


def test_json_lines(spark, tmp_path):
    path = tmp_path / "r.jsonl"
    path.write_text('{"a": 1, "b": "x"}\nnot json\n[1]\n\n{"a": 2}\n')
    good, bad = trials.json_lines_lenient(spark, str(path), "a int, b string")
    assert sorted(r["a"] for r in good.collect() if r["a"] is not None) == [1, 2] and "not json" in [r["line"] for r in bad.collect()]
    with pytest.raises(Exception, match="(?i)malformed"):
        trials.json_lines(spark, str(path), "a int, b string").collect()


def test_telemetry_and_prometheus(spark, tmp_path):
    path = tmp_path / "t.jsonl"
    path.write_text('{"ts": 1, "kv_usage": 0.5}\n{"ts_s": 2, "kv_cache_usage": null, "kv_usage": 0.9, "preemptions_total": 3}\n')
    assert [tuple(r) for r in trials.telemetry(spark, str(path)).orderBy("ts_s").collect()] == [(1.0, 0.5, None), (2.0, None, 3)]
    (tmp_path / "bad.jsonl").write_text('{"kv_usage": 1}\n')
    with pytest.raises(Exception, match="time stamp"):
        trials.telemetry(spark, str(tmp_path / "bad.jsonl")).collect()
    (tmp_path / "m.txt").write_text('# HELP x\nreqs{a="1"} 2\nreqs{a="2"} 3.5 1700000000\nreqs_total 9\n')
    assert [tuple(r) for r in trials.prometheus(spark, str(tmp_path / "m.txt"), ["reqs"]).collect()] == [("reqs", 5.5)]


def test_qa_sets(spark):
    squad = spark.createDataFrame([("1", "q", "c", (["x", "x", "y"],)), ("2", "q", "c", ([],))], "id string, question string, context string, answers struct<text:array<string>>")
    assert [(r["answer"], r["all_answers"]) for r in trials.squad(squad).collect()] == [("x", ["x", "y"]), ("", [])]
    hotpot = spark.createDataFrame([("1", "q", (["T", "U"], [["a.", " b."], ["c."]]), "x", (["U"],))], "id string, question string, context struct<title:array<string>,sentences:array<array<string>>>, answer string, supporting_facts struct<title:array<string>>")
    row = trials.hotpot(hotpot).withColumn("gold", trials.gold_only(F.col("context"), F.col("supporting_titles"))).first()
    assert row["context"] == ["T: a. b.", "U: c."] and row["gold"] == ["U: c."]
    answer = "struct<unanswerable:boolean,yes_no:boolean,free_form_answer:string,extractive_spans:array<string>,evidence:array<string>>"
    qas = [("q1", "?", [(False, None, "", ["s1", "s2"], ["two"])]), ("q2", "?", [(False, None, " ", [], [])]), ("q3", "?", [(True, None, None, None, None)]), ("q4", "?", [(False, False, None, None, ["none"])])]
    got = trials.qasper(spark.createDataFrame([("p", ["one", "and two"], qas)], f"id string, paragraphs array<string>, qas array<struct<question_id:string,question:string,answers:array<{answer}>>>")).collect()
    assert [(r["id"], r["answer"], r["evidence_docs"]) for r in got] == [("q1", "s1; s2", [1]), ("q3", "", []), ("q4", "no", [])]
    turns = spark.createDataFrame([(1, 0, "assistant", "early"), (1, 1, "user", "u"), (1, 2, "assistant", "a"), (1, 3, "assistant", "b"), (2, 0, "user", "alone")], "conv_id int, turn int, role string, text string")
    assert [tuple(r) for r in trials.share_gpt(turns).collect()] == [(1, "u", "a")]
    sess = spark.createDataFrame([("s", "ctx", [("i1", "a1"), ("i2", "a2")])], "id string, context string, multi_turns array<struct<input:string,answer:string>>")
    assert [(r["turn_index"], r["num_turns"], r["answer"]) for r in trials.sessions(sess).collect()] == [(0, 2, "a1"), (1, 2, "a2")]


def test_needles(spark):
    for r in trials.needles(spark, 5, sentences=10, needles=2).collect():
        assert all(f"is {v}." in r["context"] for v in r["answer"].split(", ")) and r["context"].count("grass") == 10
    one, two = (trials.needles(spark, 5, sentences=10, needles=2, seed=s).collect() for s in (1, 2))
    assert one != two


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "q"\nb', [1, 2]), (2, None, None)], "id int, t string, xs array<int>")
    sinks.write_csv(df, f"{tmp_path}/csv")
    back = trials.csv_as_text(spark, f"{tmp_path}/csv").orderBy("id").collect()
    assert [tuple(r) for r in back] == [("1", 'a "q"\nb', "[1,2]"), ("2", "", "")]
    for _ in range(2):
        sinks.append_evidence(df, f"{tmp_path}/ev")
    assert spark.read.json(f"{tmp_path}/ev").count() == 4
    sinks.write_text(spark, f"{tmp_path}/x.json", '{"é": 1}')
    sinks.write_text(spark, f"{tmp_path}/x.json", '{"é": 2}')
    assert sinks.read_text(spark, f"{tmp_path}/x.json") == '{"é": 2}' and sinks.read_text(spark, f"{tmp_path}/none") is None


def test_campaign(spark, tmp_path):
    root = f"{tmp_path}/run"
    make = lambda window, n: spark.createDataFrame([("k|a", "squad", window, float(i)) for i in range(n)], "row_key string, dataset string, window int, x double")
    sinks.write_campaign(make(0, 3), root, {"run": 1})
    sinks.write_campaign(make(1, 2), root, {"run": 1})
    sinks.write_campaign(make(1, 4), root, {"run": 1})
    assert [tuple(r) for r in sinks.cells_index(spark, root).collect()] == [("k|a", "squad", 0, 3), ("k|a", "squad", 1, 4)]
    assert sinks.next_ordinal(spark, root, "k|a", "squad") == 2 and sinks.next_ordinal(spark, root, "other", "squad") == 0


def test_stream_of_goodput_and_held_gauge(spark, tmp_path):
    rows = [(f"2024-01-01 00:0{k % 6}:00", True, 0.5 if k % 2 else 2.0, 0.05, True) for k in range(12)]
    spark.createDataFrame(rows, "a string, ok boolean, ttft_s double, tpot_s double, veridical boolean").selectExpr("cast(a as timestamp) AS arrival", "ok", "ttft_s", "tpot_s", "veridical").write.parquet(f"{tmp_path}/r")
    source = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/r").schema).parquet(f"{tmp_path}/r")
    query = stream.goodput(source, base_ttft=0.1, base_tpot=0.02).writeStream.outputMode("complete").format("memory").queryName("goodput_test").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted((r["n_issued"], r["n_timely"]) for r in spark.table("goodput_test").collect()) == [(2, 2), (10, 4)]
    for k, part in enumerate([[(2.0, 0.5, 5), (6.0, 1.0, 5)], [(8.0, 0.8, 9)]]):
        spark.createDataFrame([("w", 0.0, 10.0, *p) for p in part], "key string, t_start double, t_end double, ts_s double, kv_cache_usage double, preemptions_total bigint").coalesce(1).write.parquet(f"{tmp_path}/s/{k}")
    schema = spark.read.parquet(f"{tmp_path}/s/0").schema
    held = stream.held_gauge(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/s/*"))
    query = held.writeStream.outputMode("update").format("memory").queryName("held_test").trigger(availableNow=True).start()
    query.awaitTermination()
    last = spark.table("held_test").orderBy(F.desc("n_samples")).first()
    assert (last["mean"], last["events"], last["n_samples"]) == (pytest.approx(0.7), 4, 3)
