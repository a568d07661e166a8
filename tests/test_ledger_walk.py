"""The walk of a long case."""

import time

from weftline.operators import ledger

SCHEMA = "scenario_id string, a_id string, seq long, event_id string, action string, b_id string, supersedes_event_id string, reverses_event_id string"


def test_a_long_case_is_walked_in_linear_time(spark):
    n = 12_000
    rows = [("s", "1", i, f"e{i}", "accept_candidate", "b", f"e{i - 1}" if i > 1 else None, None) for i in range(1, n)]
    # e2 is undone, a reject clears the last accept, an undo of that reject brings it back
    rows += [("s", "1", n, f"e{n}", "reject_candidate", "b", None, None), ("s", "1", n + 1, f"e{n + 1}", "undo", None, None, f"e{n}"), ("s", "1", n + 2, f"e{n + 2}", "accept_candidate", "c", None, None)]
    events = spark.createDataFrame(rows, SCHEMA)
    began = time.monotonic()
    assert [r["event_id"] for r in ledger.walk(events).collect()] == [f"e{n + 2}"]
    assert time.monotonic() - began < 25
