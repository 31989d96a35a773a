"""Scopes and identity from one walk through the records, as from two."""

import json

from tracemill.operators import nested


def test_one_walk_gives_what_two_give(spark):
    records = [
        {"host": {"name": "H1"}, "raw": {"Computer": "WS", "event_data": {"TargetLogonId": "0x01"}, "Event": {"System": {"Channel": "Security", "record_id": 7}}}}, {"list": [{"System": {"Channel": "A", "EventRecordID": "1"}}]},
        {"channel": "B", "EventRecordID": 2, "members": [{"user": {"username": " U "}, "session_id": 3}]}, [], 5,
    ]
    frame = spark.createDataFrame([*enumerate(map(json.dumps, records)), (8, "{"), (9, None)], "k int, value string").cache()
    once = nested.scopes_and_identity(frame)
    assert sorted(map(str, once.collect())) == sorted(map(str, nested.record_identity(nested.scopes(frame)).collect()))
    assert once._jdf.queryExecution().analyzed().toString().count("parse_json") == 1
