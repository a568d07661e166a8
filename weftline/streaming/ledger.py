"""The review ledger as a stream: case states kept up to date while events arrive in order."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OUTPUT = "scenario_id string, a_id string, status string, accepted_b_id string, deferred boolean, rejected_candidates string, last_seq long"
STATE = "events string"


def fold(events: list[list]) -> tuple[str | None, bool, set[str]]:
    """(accepted B, deferred, rejected Bs) of [seq, event_id, action, b_id, reverses] rows in order."""
    undone = {e[4] for e in events if e[2] == "undo"}
    accepted, deferred, rejected = None, False, set()
    for _, event, action, b, _ in events:
        if action == "undo" or event in undone:
            continue
        if action == "accept_candidate":
            accepted, deferred = b, False
        elif action == "reject_candidate":
            rejected.add(b)
            accepted = None if accepted == b else accepted
        elif action == "defer":
            deferred = True
    return accepted, deferred, rejected


def live_state(events: DataFrame) -> DataFrame:
    """A streaming frame of events to updates of case states; the last row of a case holds.

    The state of a case is its own events, as an undo may take out any earlier one; people make them, so they are few.
    """
    import json

    def update(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else []
        for pdf in batches:
            held += [[int(r.seq), r.event_id, r.action, None if pd.isna(r.b_id) else r.b_id, None if pd.isna(r.reverses_event_id) else r.reverses_event_id] for r in pdf.itertuples()]
        held.sort()
        state.update((json.dumps(held),))
        accepted, deferred, rejected = fold(held)
        status = "accepted" if accepted is not None else "deferred" if deferred else "rejected_candidates" if rejected else "none"
        yield pd.DataFrame([[*key, status, accepted, deferred, "|".join(sorted(rejected)), held[-1][0]]], columns=["scenario_id", "a_id", "status", "accepted_b_id", "deferred", "rejected_candidates", "last_seq"])

    chosen = events.select("scenario_id", "a_id", F.col("seq").cast("long"), "event_id", "action", "b_id", "reverses_event_id")
    return chosen.groupBy("scenario_id", "a_id").applyInPandasWithState(update, OUTPUT, STATE, "update", "NoTimeout")
