"""Chains are drawn from tables stored once, however often a line reads its rows."""

from tracemill.operators import logons


def test_lines_of_chains_are_stored(spark):
    rows = [(k, k * 1000000, "H", "U", ("4624", "4688", "4634")[k % 3], "0x1" if k < 6 else None, f"k{k}") for k in range(12) if k < 6 or k % 3 == 1]
    events = spark.createDataFrame(rows, "ord long, ts_us long, host string, user string, event_id string, session string, key string")
    life, act = logons.lifecycles(events), logons.activities(events, events.select("ord"))
    assert sorted(r.ord for r in life.collect()) == [0, 1, 2, 3, 4, 5] and sorted(r.ord for r in act.collect()) == [7, 10]
    assert life.inputFiles() and all("/logons-" in f for f in life.inputFiles())
    assert act.inputFiles() and all("/activity-" in f for f in act.inputFiles())
