"""Work that can be run again: pages by cursor, commits, embedding cache, concurrent calls, cut requests, the command line."""

import json
import os
import threading
import time

import pytest
from pyspark.sql import functions as F

from quarry.__main__ import main
from quarry.operators import providers, vectors
from quarry.sources import pages, sinks
from quarry.streaming import resume
from tests import page_stub


@pytest.fixture
def log(tmp_path, monkeypatch):
    path = str(tmp_path / "calls")
    monkeypatch.setenv("PAGE_LOG", path)
    open(path, "w").close()
    return path


def calls(log):
    return open(log).read().split()


def test_pages_in_partitions(spark, log, monkeypatch):
    monkeypatch.setattr(pages, "_provider", lambda name: page_stub.make())
    starts = json.dumps(["p0", "p12", "p20", "p12"])
    reader = pages.Pages({"provider": "tests.page_stub:make", "starts": starts}).reader(None)
    rows = [r for p in reader.partitions() for r in reader.read(p)]
    assert [r[2] for r in rows] == [f"p{k}" for k in range(30)] and len(reader.partitions()) == 3
    assert [(s, sum(r[0] == s for r in rows)) for s in ("p0", "p12", "p20")] == [("p0", 12), ("p12", 8), ("p20", 10)]
    assert sorted(calls(log)) == sorted(f"p{k}" for k in range(30))
    left = list(reader.pushFilters([pages.EqualTo(("start",), "p20"), pages.EqualTo(("pos",), 3)]))
    assert left == [pages.EqualTo(("pos",), 3)] and [p.start for p in reader.partitions()] == ["p20"]
    open(log + ".down", "w").close()
    assert [r[3] is None for r in reader.read(reader.partitions()[0])] == [False] * 5 + [True]


def test_pages_of_spark(spark, log):
    pages.register(spark)
    df = spark.read.format("quarry_pages").option("provider", "tests.page_stub:make").option("starts", '["p0", "p10"]').load()
    assert df.rdd.getNumPartitions() == 2
    got = {r.start: r.n for r in df.groupBy("start").agg(F.count("reply").alias("n")).collect()}
    assert got == {"p0": 10, "p10": 20}
    one = df.where("start = 'p10'")
    assert one.count() == 20 and one.rdd.getNumPartitions() == 1
    stream = df.sparkSession.readStream.format("quarry_pages").option("provider", "tests.page_stub:make").option("starts", '["p0"]').option("pages", "12").load()
    for _ in range(2):  # the second query finds nothing new
        stream.writeStream.format("parquet").option("path", f"{log}.out").option("checkpointLocation", f"{log}.check").trigger(once=True).start().awaitTermination()
    assert spark.read.parquet(f"{log}.out").select("request").distinct().count() == spark.read.parquet(f"{log}.out").count() > 0


def test_a_stream_of_pages_goes_on_where_it_stopped(log):
    make = lambda: pages._Stream({"provider": "tests.page_stub:make", "starts": '["p0"]', "pages": "8"})
    at, seen = make().initialOffset(), []
    open(log + ".down", "w").close()
    for turn in range(8):  # a new reader each time, as after a restart from the checkpoint
        before = at
        rows, at = make().read(before)
        rows = list(rows)
        seen += [r[1:3] for r in rows]
        assert [r[1:3] for r in make().readBetweenOffsets(before, at)] == [r[1:3] for r in rows]
        if turn == 4:
            assert seen[-1] == (24, "p24")
            os.remove(log + ".down")
    assert seen == [(k, f"p{k}") for k in range(30)] and at["next"] == ""


def test_commits_replace_themselves(spark, tmp_path):
    path = f"{tmp_path}/t"
    assert sinks.latest(spark, path, "k") is None and sinks.next_commit(spark, path) == 0
    make = lambda rows: spark.createDataFrame(rows, "k int, v string")
    sinks.commit(make([(1, "a"), (2, "b")]), path, 0)
    sinks.commit(make([(2, "c"), (3, "d")]), path, 1)
    for _ in range(2):
        sinks.commit(make([(3, "e")]), path, 1)
    assert sorted(map(tuple, sinks.latest(spark, path, "k").collect())) == [(1, "a"), (2, "b"), (3, "e")]
    assert sinks.next_commit(spark, path) == 2


def test_a_streams_batches_are_commits(spark, tmp_path):
    source, target, check = (f"{tmp_path}/{n}" for n in ("in", "out", "check"))
    spark.range(4).write.parquet(source)
    run = lambda: resume.commit_new(spark, source, "id long", lambda df: df.withColumn("twice", F.col("id") * 2), target, check)
    run()
    spark.range(3, 6).write.mode("append").parquet(source)
    run()
    run()
    assert sorted((r.id, r.twice) for r in sinks.latest(spark, target, "id").collect()) == [(k, 2 * k) for k in range(6)]
    assert spark.read.parquet(target).count() == 7


def test_the_cache_asks_for_new_texts_only(spark, tmp_path, log):
    def make():
        def encode(texts):
            with open(log, "a") as f:
                f.writelines(t + "\n" for t in texts)
            return [[float(len(t)), 1.0] for t in texts]

        return encode

    df = lambda texts: spark.createDataFrame([(t,) for t in texts], "t string")
    run = lambda texts, model: {r.t: r.embedding for r in vectors.embed_cached(df(texts), "t", make, model, f"{tmp_path}/cache").collect()}
    assert run(["aa", "b", "aa", None], "one") == {"aa": [2.0, 1.0], "b": [1.0, 1.0], None: None}
    assert sorted(calls(log)) == ["aa", "b"]
    assert run(["aa", "ccc"], "one") == {"aa": [2.0, 1.0], "ccc": [3.0, 1.0]}
    assert sorted(calls(log)) == ["aa", "b", "ccc"]
    assert run(["aa"], "two") == {"aa": [2.0, 1.0]} and sorted(calls(log)) == ["aa", "aa", "b", "ccc"]


def test_calls_side_by_side(spark, tmp_path):
    rows = spark.range(24).select(F.col("id").cast("string").alias("q")).coalesce(1)
    seen = str(tmp_path / "most")

    def make():
        lock, state = threading.Lock(), {"now": 0, "most": 0, "tries": {}}

        def reply(requests):
            (r,) = requests
            with lock:
                state["now"] += 1
                state["most"] = max(state["most"], state["now"])
                state["tries"][r] = state["tries"].get(r, 0) + 1
                open(seen, "w").write(str(state["most"]))
            time.sleep(0.05)
            with lock:
                state["now"] -= 1
            if r == "7" or r == "9" and state["tries"][r] < 3:
                raise RuntimeError(f"no {r}")
            return [f"r{r}"]

        return reply

    asked = rows.repartition(1)
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        got = {r.request: (r.reply, r.error) for r in providers.call_once(asked, "q", make, at_once=6, backoff=0.01).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == {str(k): (None, "RuntimeError: no 7") if k == 7 else (f"r{k}", None) for k in range(24)}
    assert 2 <= int(open(seen).read()) <= 6
    pace = providers._Pace(50)
    began = time.monotonic()
    for _ in range(6):
        pace.wait()
    assert time.monotonic() - began >= 0.09


def test_requests_that_are_refused_get_shorter():
    tried = []

    def make():
        def reply(requests):
            tried.append(len(requests[0]))
            if len(requests[0]) > 11:
                raise ValueError("too long")
            return [requests[0].upper()]

        return reply

    cut = providers.shrinking(make, list, "".join, (ValueError,), most=20, step=3)()
    assert cut(["abc"]) == ["ABC"] and tried == [3]
    tried.clear()
    assert cut(["x" * 40]) == ["X" * 11] and tried == [40, 20, 17, 14, 11]
    tried.clear()
    assert cut(["y" * 16]) == ["Y" * 10] and tried == [16, 16, 13, 10]
    with pytest.raises(ValueError, match="too long"):
        providers.shrinking(make, list, "".join, (ValueError,), most=20, step=20)()(["x" * 40])


def test_command_line_with_providers_and_a_killed_run(spark, tmp_path):
    (tmp_path / "e.json").write_text(json.dumps([{"index": "1", "explain": "a(id=\"n0\")", "dag": "", "raw_response": "", "answer": "so", "question": "why"}]))
    (tmp_path / "v.json").write_text(json.dumps([{"action": "a"}]))
    (tmp_path / "c.txt").write_text("{question} {answer} {completion}")
    main(["evaluate", "--truth", f"{tmp_path}/e.json", "--found", f"{tmp_path}/e.json", "--vocabulary", f"{tmp_path}/v.json", "--output", f"{tmp_path}/out", "--metrics", "syntax,argument_similarity,llm/correctness", "--encoder", "plain=tests.page_stub:encoder", "--judge", "tests.page_stub:judge", "--correctness-template", f"{tmp_path}/c.txt"])
    got = {r.metric: r.value for r in spark.read.parquet(f"{tmp_path}/out/metrics").collect()}
    assert got["syntax"] == 1 and got["argument_similarity/paragraph/plain"] == 1 and got["llm/correctness"] == 1
    for name, text in (("report", "R {treatment}"), ("explain", "{action_primitives} {report}"), ("primitives", "p")):
        (tmp_path / f"{name}.txt").write_text(text)
    spark.createDataFrame([("1", "p"), ("2", "q")], "index string, perturbation string").write.parquet(f"{tmp_path}/records.parquet")
    call = ["generate", "--records", f"{tmp_path}/records.parquet", "--output", f"{tmp_path}/made", "--report-template", f"{tmp_path}/report.txt", "--explain-template", f"{tmp_path}/explain.txt", "--primitives", f"{tmp_path}/primitives.txt", "--model"]
    commit = sinks.commit

    def killed(df, path, number):
        if path.endswith("explanations"):
            raise KeyboardInterrupt
        commit(df, path, number)

    sinks.commit = killed
    try:
        with pytest.raises(KeyboardInterrupt):
            main([*call, "quarry.operators.providers:echo"])
    finally:
        sinks.commit = commit
    for _ in range(2):
        main([*call, "quarry.operators.providers:echo"])
    for name in ("reports", "explanations"):
        assert sorted(r["index"] for r in spark.read.parquet(f"{tmp_path}/made/{name}").collect()) == ["1", "2"]
