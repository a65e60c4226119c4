from lectern.operators.monitor import latest_state
from lectern.streaming import events as E

SCHEMA = "run string, seq int, event_type string, value double"


def test_stream_equals_batch_whatever_the_order(spark, tmp_path):
    rows = [("r", 2, "b", 2.0), ("r", 1, "a", 1.0), ("s", 1, "a", 5.0), ("r", 3, "c", 0.5)]
    batch = spark.createDataFrame(rows, SCHEMA)
    batch.repartition(3).write.json(str(tmp_path / "in"))
    stream = E.read_events(spark, str(tmp_path / "in"), SCHEMA)
    E.to_memory(E.state_stream(stream, ["run"], "seq", ["event_type", "value"]), "state_out")
    want = latest_state(batch, ["run"], "seq", ["event_type", "value"])
    assert sorted(map(tuple, spark.table("state_out").collect())) == sorted(map(tuple, want.collect()))
    E.to_memory(E.rollup_stream(stream, "run", "event_type", "value"), "rollup_out")
    assert {r.run: r.n_events for r in spark.table("rollup_out").collect()} == {"r": 3, "s": 1}
