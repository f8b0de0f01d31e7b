import json
from datetime import datetime, timedelta

from latticework.sources import readers as S
from latticework.sources import sinks as K
from latticework.streaming import queues as Q
from latticework.streaming import windows as W
from pyspark.sql import functions as F


def test_queue_drops_the_oldest(spark):
    ops = [("q", i, op, i) for i, op in enumerate(["get", "put", "put", "put", "get", "get", "get"])]
    log = spark.createDataFrame(ops, "queue string, t int, op string, item bigint")
    got = [(r.t, r.kind, r["item"]) for r in Q.replay(log, "queue", "t", 2).orderBy("t", "kind").collect()]
    assert got == [(0, "empty", None), (1, "put", 1), (2, "put", 2), (3, "dropped", 1), (3, "put", 3), (4, "got", 2), (5, "got", 3), (6, "empty", None)]
    assert tuple(Q.counters(Q.replay(log, "queue", "t", 2), "queue").first()) == ("q", 3, 2, 1)
    assert Q.replay(log.limit(0), "queue", "t", 2).count() == 0


def test_streamed_queue_keeps_its_state(spark, tmp_path):
    schema = "queue string, op string, item bigint"
    for i in range(3):
        spark.createDataFrame([("q", "put", i)], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    out = W.run_once(Q.stream(stream, "queue", 2), "queue-test")
    assert sorted(r.kind for r in out.collect()) == ["dropped", "put", "put", "put"]


def test_batches_leave_the_tail_out(spark):
    df = spark.range(10).select(F.lit("q").alias("queue"), F.col("id"))
    assert Q.assembled(df, "queue", "id", 4).count() == 8
    assert Q.staleness_budget(32, 0.5, 2) == 96


def test_streamed_windows_equal_the_batch(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    rows = [(i, t0 + timedelta(minutes=7 * i), i % 3, float(i)) for i in range(200)]
    spark.createDataFrame(rows, "event_id int, ts timestamp_ntz, user_id int, value double").write.parquet(f"{tmp_path}/e")
    batch = spark.read.parquet(f"{tmp_path}/e").withColumn("ts", F.col("ts").cast("timestamp"))
    stream = W.event_stream(spark, f"{tmp_path}/e", spark.read.parquet(f"{tmp_path}/e").schema)
    for f in (lambda e: W.windowed(e, "user_id", "value", "1 hour"), lambda e: W.sessions(e, "user_id", "10 minutes")):
        want = {tuple(r) for r in W.closed(f(batch), batch, "10 minutes").collect()}
        assert {tuple(r) for r in W.run_once(f(stream), "test").collect()} == want and want


def test_micro_batches_run_once(spark, tmp_path):
    spark.range(5).write.parquet(f"{tmp_path}/in")
    seen = []
    for _ in range(2):
        W.in_batches(spark.readStream.schema("id bigint").parquet(f"{tmp_path}/in"), lambda b, n: seen.append(b.count()), f"{tmp_path}/c")
    assert sum(seen) == 5


def test_json_lines_and_texts(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"id": "chart_1_1", "chart": "p.png", "text": "é"}\n\n{broken\n')
    rows = S.json_lines(spark, str(tmp_path / "c.jsonl"), S.CHARTS).collect()
    assert [r.id for r in rows] == ["chart_1_1", None] and rows[1]._corrupt_record == "{broken"
    for name, body in (("a.json", '{"x": "one", "y": "two"}'), ("b.json", '["three", "four"]'), ("c.txt", "five")):
        (tmp_path / name).write_text(body)
    got = S.whole_text(spark, [str(tmp_path / n) for n in ("a.json", "b.json", "c.txt")]).select(S.json_text(F.col("text")).alias("t")).collect()
    assert sorted(r.t for r in got) == ["five", "one\ntwo", "three\nfour"]


def test_task_csv_accepts_both_forms(spark, tmp_path):
    (tmp_path / "t.csv").write_text('query,answer,gt_sources,start_candidates\n"a\nb",x,"[""chart_1"", ""p""]",Vermont\nq,y,"chart_1,chart_2","[""A"", ""B""]"\nz,w,,\n')
    rows = {r["query"]: r for r in S.task_csv(spark, str(tmp_path / "t.csv")).collect()}
    assert rows["a\nb"].gt_sources == ["chart_1", "p"] and rows["a\nb"].start_candidates == ["Vermont"]
    assert rows["q"].gt_sources == ["chart_1", "chart_2"] and rows["q"].start_candidates == ["A", "B"]
    assert rows["z"].gt_sources == [] and rows["z"].start_candidates == [] and rows["z"].gt_entities == []


def test_images_and_arrow(spark, tmp_path):
    import pyarrow as pa

    (tmp_path / "i.PNG").write_bytes(b"\x89PNG")
    assert S.images(spark, str(tmp_path / "i.PNG")).first().url == "data:image/png;base64,iVBORw=="
    t = pa.table({"a": [1, 2], "b": ["x", None]})
    with pa.OSFile(str(tmp_path / "d.arrow"), "wb") as f, pa.ipc.new_stream(f, t.schema) as w:
        w.write_table(t)
    assert sorted((r.a, r.b) for r in S.arrow_dataset(spark, str(tmp_path)).collect()) == [(1, "x"), (2, None)]


def test_seeds_and_client(spark):
    specs = spark.createDataFrame([("one", 3, [7]), ("range", 2, [1, 9]), ("steps", 9, [0, 10, 4])], "name string, n_envs int, seed array<int>")
    got = {}
    for r in S.expanded_seeds(specs).collect():
        got.setdefault(r["name"], []).append(r.seed)
    assert got == {"one": [7, 7, 7], "range": [1, 2], "steps": [0, 4, 8]}
    df = spark.createDataFrame([("a",), ("b",)], "q string")
    assert sorted(r.result for r in S.Retrieval(lambda qs: [x + "!" for x in qs])(df, "q").collect()) == ["a!", "b!"]

    def broken(qs):
        raise OSError("down")

    assert [r.result for r in S.Retrieval(broken, 1, 0.0)(df, "q").collect()] == [None, None]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "é", 0), (2, None, 1)], "id int, t string, step int")
    K.save_snapshot({"entities": df}, str(tmp_path / "kg"))
    assert K.load_snapshot(spark, str(tmp_path / "kg"), ["entities"])["entities"].count() == 2
    work = lambda x: x.withColumn("n", F.lit(1))
    for want in (2, 0):
        assert K.process_incrementally(df, str(tmp_path / "done"), "id", work, str(tmp_path / "out")) == want
    assert K.process_incrementally(df.union(spark.createDataFrame([(3, "x", 1)], df.schema)), str(tmp_path / "done"), "id", work, str(tmp_path / "out")) == 1
    K.write_generations(df, str(tmp_path / "gen"))
    lines = [json.loads(x) for p in (tmp_path / "gen" / "step=0").glob("*.json") for x in p.read_text().splitlines()]
    assert lines == [{"id": 1, "t": "é"}]
    assert S.run_files(spark, str(tmp_path / "gen" / "step=0"), "id int, t string").count() == 1
    K.append_metrics(spark, {"loss": 1.0}, 3, str(tmp_path / "m"))
    assert spark.read.parquet(str(tmp_path / "m")).first().metric == "loss"
    assert S.flattened(spark.createDataFrame([((1, (2,)),)], "s struct<a:int,b:struct<c:int>>")).columns == ["s/a", "s/b/c"]
