"""Request-log operators in batch and as streams."""

import random

import pytest
from pyspark.sql import functions as F

from inkloom.operators import events as ev
from inkloom.streaming import requests as st

SCHEMA = "key string, event_id long, ts timestamp"


def log(spark, rows):
    """rows of (key, event_id, seconds)"""
    df = spark.createDataFrame(rows, "key string, event_id long, s double")
    return df.select("key", "event_id", F.timestamp_micros((F.col("s") * 1_000_000).cast("long")).alias("ts"))


def keep(rows, gap):
    out, last = set(), {}
    for key, event, s in sorted(rows, key=lambda r: (r[0], round(r[2] * 1e6), r[1])):
        t = round(s * 1e6)
        if key not in last or t - last[key] >= gap * 1e6:
            out.add((key, event))
            last[key] = t
    return out


def sample(n, keys, span, seed):
    rng = random.Random(seed)
    return [(rng.choice(keys), i, round(1000 + rng.random() * span, 6)) for i in range(n)]


@pytest.mark.parametrize("gap,chunk,span", [(0.3, 2.0, 60), (0.3, 3600.0, 60), (5.0, 20.0, 600), (0.3, 1.2, 6)])
def test_debounce_equals_loop(spark, gap, chunk, span):
    rows = sample(1500, ["hot"] * 8 + ["a", "b"], span, 3) + [("tie", 9000, 5.0), ("tie", 9001, 5.0), ("tie", 9002, 5.3)]
    got = {(r.key, r.event_id) for r in ev.debounce(log(spark, rows), "key", gap, chunk).collect()}
    assert got == keep(rows, gap)


def test_debounce_survives_small_batches(spark):
    rows = sample(400, ["hot", "b"], 30, 5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {(r.key, r.event_id) for r in ev.debounce(log(spark, rows), "key", 0.3, 2.0).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == keep(rows, 0.3)


def test_three_of_six_are_admitted(spark):
    rows = [("ip1:/sign-in", i, 10.0 + i) for i in range(6)] + [("ip2:/sign-in", 9, 12.0)]
    out = {r.event_id: r.admitted for r in ev.rate_limit(log(spark, rows), 60, 3).collect()}
    assert [out[i] for i in range(6)] == [True] * 3 + [False] * 3 and out[9]
    later = ev.rate_limit(log(spark, rows + [("ip1:/sign-in", 50, 10.0 + 660)]), 60, 3)
    assert later.where("event_id = 50").first().admitted
    w = {r.key: r for r in ev.rate_windows(log(spark, rows), 60, 3).collect()}
    assert (w["ip1:/sign-in"].admitted, w["ip1:/sign-in"].denied) == (3, 3)


def test_ranking_is_limited_before_the_exchange(spark, capsys):
    ev.rate_limit(log(spark, sample(10, ["a"], 10, 1)), 60, 3).explain()
    assert "WindowGroupLimit" in capsys.readouterr().out


def test_cleanup_takes_one_batch(spark):
    rows = [(f"expired-{i:03d}", i, 1000.0 + i) for i in range(105)] + [("fresh", 999, 99_990.0)]
    gone = ev.expire_keys(ev.limiter_rows(log(spark, rows)), "1970-01-02 03:46:40")
    assert gone.count() == 100 and gone.where("key = 'fresh'").count() == 0


def test_newest_valid_session(spark):
    t = lambda c: F.timestamp_seconds(F.col(c))
    s = spark.createDataFrame([(1, 10, 0, 1000), (1, 11, 500, 900), (1, 12, 2000, 2000)],
                              "user_id long, session_id long, c long, e long").select(
        "user_id", "session_id", t("c").alias("created"), t("e").alias("expires"))
    e = spark.createDataFrame([(1, 1, 0), (2, 1, 500), (3, 1, 899), (4, 1, 900), (5, 1, 1000), (6, 2, 10)],
                              "event_id long, user_id long, t long").select("event_id", "user_id", t("t").alias("ts"))
    for bucket in (86400, 100):
        got = {r.event_id: r.session_id for r in ev.active_session_at(e, s, bucket).collect()}
        assert got == {1: 10, 2: 11, 3: 11, 4: 10}


@pytest.mark.parametrize("url,origin", [
    ("https://studio.example.test", "https://studio.example.test"), ("https://Studio.test:443/", "https://studio.test"),
    ("http://localhost:8787", "http://localhost:8787"), ("http://[::1]/", "http://[::1]"), ("http://studio.test", None),
    ("https://studio.test/app", None), ("https://studio.test/?q=1", None), ("https://u:p@studio.test/", None),
    ("https://studio.test/#x", None), ("not a url", None)])
def test_origins(spark, url, origin):
    assert spark.range(1).select(ev.accepted_origin(F.lit(url)).alias("o")).first().o == origin


# -- streams: files are written one by one, so each becomes its own micro-batch -------------------------

def feed(spark, folder, batches):
    for i, rows in enumerate(batches):
        log(spark, rows).coalesce(1).write.parquet(f"{folder}/in/part={i:03d}")
    return spark.readStream.schema(SCHEMA + ", part int").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def drain(out, folder, mode="append"):
    query = (out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/cp")
             .outputMode(mode).trigger(availableNow=True).start())
    query.awaitTermination()
    assert query.exception() is None


def flush(t):
    return [("flush", 10_000_000 + int(t), float(t))]


def test_stream_debounce_equals_batch(spark, tmp_path):
    rows = sorted(sample(300, ["hot", "b"], 60, 11), key=lambda r: r[2])
    batches = [rows[:100], rows[100:200], rows[200:]]
    drain(st.debounce(feed(spark, tmp_path, batches), 0.3), tmp_path)
    got = {(r.key, r.event_id) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == keep(rows, 0.3)


@pytest.fixture()
def small_chunks(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_streams_do_not_depend_on_chunks(spark, tmp_path, small_chunks):
    import random

    rows = sample(300, ["hot", "b"], 60, 11)
    random.Random(1).shuffle(rows)
    drain(st.debounce(feed(spark, tmp_path / "d", [rows]), 0.3), tmp_path / "d")
    assert {(r.key, r.event_id) for r in spark.read.parquet(f"{tmp_path}/d/out").collect()} == keep(rows, 0.3)
    drain(st.admit(feed(spark, tmp_path / "a", [rows]), 60, 40), tmp_path / "a")
    got = {(r.key, r.event_id) for r in spark.read.parquet(f"{tmp_path}/a/out").where("admitted").collect()}
    slots = {}
    for key, event, t in sorted(rows, key=lambda r: (r[2], r[1])):
        slots.setdefault((key, t // 60), []).append((key, event))
    assert got == {x for own in slots.values() for x in own[:40]}


def test_late_requests_are_judged_by_their_own_window(spark, tmp_path):
    drain(st.admit(feed(spark, tmp_path, [[("k", 1, 70.0)], [("k", 2, 30.0), ("k", 3, 31.0)], [("k", 4, 32.0), ("k", 5, 71.0)]]), 60, 2), tmp_path)
    got = {r.event_id: r.admitted for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {1: True, 2: True, 3: True, 4: False, 5: True}


def test_stream_admission_and_restart(spark, tmp_path):
    first = [("k", i, 10.0 + i) for i in range(4)]
    stream = feed(spark, tmp_path, [first])
    drain(st.admit(stream, 60, 3), tmp_path)
    # A new query over the same checkpoint continues with the counts of the first one.
    log(spark, [("k", 10, 20.0), ("k", 11, 61.0)]).coalesce(1).write.parquet(f"{tmp_path}/in/part=001")
    drain(st.admit(stream, 60, 3), tmp_path)
    got = {r.event_id: r.admitted for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {0: True, 1: True, 2: True, 3: False, 10: False, 11: True}


def test_stream_windows_drop_late_rows(spark, tmp_path):
    batches = [[("k", i, 10.0 + i) for i in range(5)], flush(1000), flush(1100), [("k", 77, 30.0)], flush(2000), flush(3000)]
    drain(st.windowed_counts(feed(spark, tmp_path, batches), 60, 3), tmp_path)
    rows = [r for r in spark.read.parquet(f"{tmp_path}/out").collect() if r.key == "k"]
    assert [(r.requests, r.admitted, r.denied) for r in rows] == [(5, 3, 2)]


def test_stream_idle_keys_expire(spark, tmp_path):
    batches = [[("k", 1, 100.0), ("k", 2, 130.0)], flush(500), flush(1000), flush(1100), flush(1200)]
    drain(st.expired_keys(feed(spark, tmp_path, batches)), tmp_path)
    rows = [tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").where("key = 'k'").select("key", "count", "last_us").collect()]
    assert rows == [("k", 2, 130_000_000)]


def test_stream_sessions_join(spark, tmp_path):
    t = lambda c: F.timestamp_seconds(F.col(c))
    s = spark.createDataFrame([(1, 10, 100, 4000)], "user_id long, session_id long, c long, e long").select(
        "user_id", "session_id", t("c").alias("created"), t("e").alias("expires"))
    e = spark.createDataFrame([(1, 1, 50), (2, 1, 200), (3, 1, 4000), (4, 2, 200)],
                              "event_id long, user_id long, t long").select("event_id", "user_id", t("t").alias("ts"))
    s.write.parquet(f"{tmp_path}/s")
    e.write.parquet(f"{tmp_path}/e")
    read = lambda p, d: spark.readStream.schema(d.schema).parquet(f"{tmp_path}/{p}")
    drain(st.active_sessions(read("e", e), read("s", s)), tmp_path)
    assert [(r.event_id, r.session_id) for r in spark.read.parquet(f"{tmp_path}/out").collect()] == [(2, 10)]


def test_stream_latest_in_update_mode(spark, tmp_path):
    stream = feed(spark, tmp_path, [[("k", 1, 10.0)], [("k", 2, 30.0)], [("k", 3, 20.0)]])
    seen = {}

    def take(batch, _):
        seen.update({r.key: r.event_id for r in batch.collect()})

    query = st.latest_wins(stream).writeStream.outputMode("update").foreachBatch(take).option(
        "checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    query.awaitTermination()
    assert seen == {"k": 2}
