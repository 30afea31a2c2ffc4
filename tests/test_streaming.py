import pytest

from tapline.operators import radius
from tapline.streaming import streams

PACKETS = "src_ip string, dst_ip string, src_port int, dst_port int, l4 string, tcp_flags int, ts_ns bigint"
S = 10**9


@pytest.fixture
def feed(spark, tmp_path):
    """Writes rows as files one after another and runs a stream over them to its end."""

    def run(rows, schema, make, mode="append"):
        place = tmp_path / "in"
        for k, part in enumerate(rows):
            spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(place / f"{k:03}"))
        source = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(place))
        name = f"out{abs(hash(str(tmp_path)))}"
        query = make(source).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "state")).start()
        query.processAllAvailable()
        query.stop()
        return [tuple(r) for r in spark.table(name).collect()]

    return run


def test_handshakes(feed):
    def talk(t, sport, answer_after, a="10.0.0.1", b="1.2.3.4"):
        return [(a, b, sport, 443, "tcp", 2, t * S), (b, a, 443, sport, "tcp", 18, (t + answer_after) * S)]

    late = [("x", "y", 1, 1, "tcp", 16, 10_000 * S)]
    got = feed([talk(100, 1, 1) + talk(100, 2, 40), talk(105, 3, 30), late, late], PACKETS, streams.handshake_edges)
    assert sorted(r[:4] for r in got) == [("10.0.0.1", "1.2.3.4", 443, 100 * S), ("10.0.0.1", "1.2.3.4", 443, 105 * S)]


def test_first_deliveries(feed):
    rows = [[(1, "a", 100), (2, "a", 101), (3, "b", 102)], [(4, "b", 103), (6, "c", 4000)], [(7, "c", 4001)], [(5, "a", 5000)]]
    got = feed(rows, "n int, k string, t bigint", lambda s: streams.first_deliveries(s.selectExpr("n", "k", "timestamp_seconds(t) as t"), ["k"], "t", 60_000))
    assert sorted(r[1] for r in got) == ["a", "a", "b", "c"]


def test_periods(feed):
    rows = [[("a", 0), ("a", 60), ("a", 1000)], [("z", 100_000)], [("z", 200_000)]]
    got = feed(rows, "k string, t bigint", lambda s: streams.periods(s.selectExpr("k", "timestamp_seconds(t) as t"), "k", "t"))
    assert sorted((r[0], r[3]) for r in got if r[0] == "a") == [("a", 1), ("a", 2)]


def test_sessions_like_batch(feed, spark):
    schema = "imsi string, ip string, sid string, ts_ms bigint, sess_time_sec bigint, status int"
    first = [("1", "i", "s", 1_000, None, 1), ("1", "i", "s", 50_000, 50, 2), ("1", "i", "s", 90_000, 90, 3), ("2", "i", "", 5_000, 5, 2)]
    then = [("1", "i", "t", 200_000, None, 1), ("1", "i", "u", 260_000, None, 1), ("1", "i", "u", 300_000, 40, 3)]
    end = [("9", "i", "x", 10**9, 0, 3)]
    got = feed([first, then, end, end], schema, streams.sessions)
    batch = radius.sessions(spark.createDataFrame(first + then, schema))
    want = {tuple(r) for r in batch.collect()}
    assert {r for r in got if r[0] == "1"} == {r for r in want if r[0] == "1"}
    assert ("2", "i", "-", 0, 5_000, True) in got
