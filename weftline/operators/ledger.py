"""The append-only review ledger: checks of a log, its effective state, and summaries.

Events are numbered from 1. An undo takes one earlier event of the same case out of the log. The state of a case
(scenario_id, a_id) is what its live events leave, in order: the last accept stands unless a later reject names its B;
a defer stands unless a later accept; every rejected B stays rejected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CASE = ("scenario_id", "a_id")


class LedgerError(ValueError):
    """A log that breaks its own rules."""


class IncompatibleSnapshot(LedgerError):
    """Events of another snapshot."""


def live_events(events: DataFrame) -> DataFrame:
    """The events that are neither undos nor undone."""
    undone = events.filter("action = 'undo'").select(F.col("reverses_event_id").alias("event_id")).distinct()
    return events.filter("action <> 'undo'").join(undone, "event_id", "left_anti")


def effective_state(events: DataFrame) -> DataFrame:
    """(scenario_id, a_id, status, accepted_b_id, accepted_event_id, deferred, rejected_candidates), one row for each case
    with live events. Aggregations only: a case with very many events is pre-aggregated on every task."""
    live = live_events(events)
    accept, reject, defer = (F.col("action") == x for x in ("accept_candidate", "reject_candidate", "defer"))
    last = live.groupBy(*CASE).agg(F.max_by(F.struct("b_id", "event_id", "seq"), F.when(accept, F.col("seq"))).alias("acc"), F.max(F.when(accept, F.col("seq"))).alias("acc_seq"), F.max(F.when(defer, F.col("seq"))).alias("defer_seq"))
    rejected = live.filter(reject).groupBy(*CASE, "b_id").agg(F.max("seq").alias("rej_seq"))
    sets = rejected.groupBy(*CASE).agg(F.array_sort(F.collect_set("b_id")).alias("rejected_candidates"))
    hit = rejected.select(*CASE, F.col("b_id").alias("_b"), "rej_seq")
    accepted = last.filter("acc_seq is not null").select(*CASE, F.col("acc.b_id").alias("_b"), F.col("acc.event_id").alias("_e"), "acc_seq").join(hit, [*CASE, "_b"], "left").filter("rej_seq is null or rej_seq < acc_seq").select(*CASE, F.col("_b").alias("accepted_b_id"), F.col("_e").alias("accepted_event_id"))
    out = last.join(accepted, list(CASE), "left").join(sets, list(CASE), "left").withColumn("deferred", F.col("defer_seq").isNotNull() & (F.col("acc_seq").isNull() | (F.col("defer_seq") > F.col("acc_seq"))))
    status = F.when(F.col("accepted_b_id").isNotNull(), "accepted").when(F.col("deferred"), "deferred").when(F.size("rejected_candidates") > 0, "rejected_candidates").otherwise("none")
    return out.select(*CASE, status.alias("status"), "accepted_b_id", "accepted_event_id", "deferred", F.coalesce("rejected_candidates", F.array().cast("array<string>")).alias("rejected_candidates"))


def problems(events: DataFrame, snapshot_id: str, superseding: bool = True) -> DataFrame:
    """(event_id, problem) of a log. superseding: False leaves the walk out, for who does not ask for what it finds.

    The accept that an accept has to supersede depends on what had been undone by then, so it is found by an ordered walk of
    each case's own events (walk() below), after the checks that single rows and joins can make.
    """
    found = []
    add = lambda df, text: found.append(df.select("event_id", F.lit(text).alias("problem")))
    add(events.filter(F.col("snapshot_id") != snapshot_id), "another snapshot")
    numbers = events.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("seq").alias("d"), F.min("seq").alias("lo"), F.max("seq").alias("hi"))
    add(numbers.filter("n > 0 and (n <> d or lo <> 1 or hi <> n)").select(F.lit(None).cast("string").alias("event_id")), "seq is not unique and contiguous from 1")
    add(events.groupBy("event_id").count().filter("count > 1"), "event_id is not unique")
    unknown = ~F.col("action").isin("accept_candidate", "reject_candidate", "defer", "undo")
    add(events.filter(unknown), "unknown action")
    has_b, has_s, has_r = (F.col(c).isNotNull() for c in ("b_id", "supersedes_event_id", "reverses_event_id"))
    add(events.filter(F.col("action").isin("accept_candidate", "reject_candidate") & ~has_b), "no b_id")
    add(events.filter((F.col("action") == "reject_candidate") & has_s), "a reject must not supersede")
    add(events.filter((F.col("action") == "defer") & (has_b | has_s)), "a defer carries a b_id or supersedes")
    add(events.filter((F.col("action") != "undo") & has_r), "only an undo reverses")
    add(events.filter((F.col("action") == "undo") & (has_b | has_s)), "an undo carries a b_id or supersedes")
    targets = events.select(F.col("event_id").alias("reverses_event_id"), F.col("seq").alias("t_seq"), F.col("action").alias("t_action"), *[F.col(c).alias(f"t_{c}") for c in CASE])
    undo = events.filter("action = 'undo'").join(targets, "reverses_event_id", "left")
    add(undo.filter("t_seq is null or t_seq >= seq"), "an undo does not name an earlier event")
    add(undo.filter("t_scenario_id <> scenario_id or t_a_id <> a_id"), "an undo targets another case")
    add(undo.filter("t_action = 'undo'"), "an undo targets an undo")
    again = Window.partitionBy("reverses_event_id").orderBy("seq")
    add(undo.withColumn("_n", F.row_number().over(again)).filter("_n > 1"), "an undo targets an undone event")
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out.unionByName(walk(events)) if superseding else out


def walk(events: DataFrame) -> DataFrame:
    """(event_id, problem): accepts that do not supersede the accept effective at their time.

    An ordered fold of each case's events, in time linear in them.
    """
    from collections import defaultdict
    from collections.abc import Iterator

    import pandas as pd

    def live(held: list, undone: set):
        """The last of held that is not undone."""
        while held and held[-1][1]["event_id"] in undone:
            held.pop()
        return held[-1] if held else None

    def check(batches: Iterator[pd.DataFrame]) -> pd.DataFrame:
        own = pd.concat(list(batches)).sort_values("seq").to_dict("records")
        # what is undone stays undone, so undone events leave the ends of the lists for good: each event is looked at once or twice
        accepts, rejects, undone, wrong = [], defaultdict(list), set(), []
        for n, e in enumerate(own):
            if e["action"] == "undo":
                undone.add(e["reverses_event_id"])
            elif e["action"] == "reject_candidate":
                rejects[e["b_id"]].append((n, e))
            elif e["action"] == "accept_candidate":
                last = live(accepts, undone)
                later = live(rejects[last[1]["b_id"]], undone) if last else None
                current = last[1] if last and not (later and later[0] > last[0]) else None
                if (e["supersedes_event_id"] or None) != (current["event_id"] if current else None):
                    wrong.append(e["event_id"])
                accepts.append((n, e))
        return pd.DataFrame({"event_id": pd.Series(wrong, dtype="object"), "problem": "an accept does not supersede the effective accept"})

    return events.select(*CASE, "seq", "event_id", "action", "b_id", "supersedes_event_id", "reverses_event_id").groupBy(*CASE).applyInPandas(lambda pdf: check(iter([pdf.astype(object).where(pdf.notna(), None)])), "event_id string, problem string")


def check(events: DataFrame, snapshot_id: str) -> None:
    """Raise on the first problems of a log."""
    bad = problems(events, snapshot_id).limit(5).collect()
    if any(r["problem"] == "another snapshot" for r in bad):
        raise IncompatibleSnapshot(f"events of another snapshot than {snapshot_id!r}")
    if bad:
        raise LedgerError("; ".join(f"{r['event_id']}: {r['problem']}" for r in bad))


def summary(state: DataFrame, cases: DataFrame, baseline: DataFrame | None = None) -> DataFrame:
    """One row of counts over cases (a_id); baseline: (a_id, b_id), the B chosen before."""
    by_a = state.groupBy("a_id").agg(F.max((F.col("status") == "accepted").cast("int")).alias("acc"), F.max(F.col("deferred").cast("int")).alias("defd"), F.max((F.size("rejected_candidates") > 0).cast("int")).alias("rej"), F.array_sort(F.collect_set("accepted_b_id")).alias("chosen"))
    held = cases.select("a_id").distinct().join(by_a, "a_id", "left")
    if baseline is not None:
        held = held.join(baseline.select("a_id", F.col("b_id").alias("_base")), "a_id", "left")
    one = lambda c: F.coalesce(c == 1, F.lit(False))
    acc = one(F.col("acc"))
    defd = ~acc & one(F.col("defd"))
    rej = ~acc & ~defd & one(F.col("rej"))
    same = F.coalesce((F.size("chosen") == 1) & (F.element_at("chosen", 1) == F.col("_base")), F.lit(False)) if baseline is not None else None
    changed = F.count_if(acc & ~same) if baseline is not None else F.lit(None).cast("long")
    return held.agg(F.count(F.lit(1)).alias("cases"), F.count_if(acc).alias("accepted"), F.count_if(defd).alias("deferred"), F.count_if(rej).alias("rejected_candidate_only"), F.count_if(~acc & ~defd & ~rej).alias("untouched"), changed.alias("changed_mappings"), F.count_if(rej).alias("unresolved_evidence"))


def numbered(new: DataFrame, last: int) -> DataFrame:
    """new with seq counted on from last in the order it has now: rows are counted by ranges of that order first, so no task
    holds more than one range."""
    parts = new.repartitionByRange("seq").withColumn("_p", F.spark_partition_id())
    sizes = parts.groupBy("_p").count()
    before = sizes.select("_p", F.coalesce(F.sum("count").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # a row for each range
    own = Window.partitionBy("_p").orderBy("seq")
    return parts.withColumn("_n", F.row_number().over(own)).join(F.broadcast(before), "_p").withColumn("seq", (F.col("_n") + F.col("_before") + last).cast("long")).drop("_p", "_n", "_before")


def append(events: DataFrame, new: DataFrame, snapshot_id: str) -> DataFrame:
    """The log with new events, numbered on from its end, if the whole still holds."""
    last = events.agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]
    out = events.unionByName(numbered(new, last).select(*events.columns))
    check(out, snapshot_id)
    return out


def undo(events: DataFrame, event_id: str, new_id: str, at: str) -> DataFrame:
    """The log with an undo of one of its events at its end, if that may be undone."""
    target = events.filter(F.col("event_id") == event_id)
    made = target.select(*[{"event_id": F.lit(new_id), "action": F.lit("undo"), "reverses_event_id": F.lit(event_id), "occurred_at_utc": F.lit(at)}.get(c, F.col(c) if c in (*CASE, "seq", "snapshot_id", "method_version") else F.lit(None).cast(events.schema[c].dataType)).alias(c) for c in events.columns])
    snapshot = events.select("snapshot_id").first()
    if snapshot is None or made.isEmpty():
        raise LedgerError(f"no event {event_id!r} to undo")
    return append(events, made, snapshot[0])


def import_events(events: DataFrame, given: DataFrame, snapshot: tuple[str, str], given_snapshot: tuple[str, str]) -> tuple[DataFrame, dict]:
    """(the log, what became of the import). A snapshot is its id and its analytical digest.

    Nothing of a log from other evidence, of one that breaks its own rules, or of one that would break the whole is taken: it
    is put in quarantine, described but not applied. Events whose id the log has are passed over; the others are numbered on.
    """
    quarantine = {"snapshot_id": given_snapshot[0], "analytical_digest": given_snapshot[1], "event_count": given.count()}
    missing = [c for c in events.columns if c not in given.columns]
    if missing:
        return events, {"status": "rejected", "reason": "corrupt", "message": f"columns missing: {', '.join(missing)}", "quarantine": quarantine}
    other = given_snapshot != snapshot or not given.filter(~F.col("snapshot_id").eqNullSafe(F.lit(snapshot[0]))).isEmpty()
    if other:
        return events, {"status": "rejected", "reason": "incompatible_snapshot", "message": "made from other evidence", "quarantine": quarantine}
    new = given.select(*events.columns).join(events.select("event_id"), "event_id", "left_anti").select(*events.columns)
    try:
        check(given, snapshot[0])
        merged = append(events, new, snapshot[0])
    except LedgerError as e:
        return events, {"status": "rejected", "reason": "invalid_ledger", "message": str(e), "quarantine": quarantine}
    return merged, {"status": "ok", "imported": new.count(), "quarantine": None}


def consequences(state: DataFrame, baseline: DataFrame) -> DataFrame:
    """(a_id, consequence): what decisions change against the baseline choice."""
    held = state.join(baseline.select("a_id", F.col("b_id").alias("base_b_id")), "a_id", "left")
    kind = F.when(F.col("accepted_b_id").isNotNull() & F.col("base_b_id").isNull(), "new_mapping").when(F.col("accepted_b_id") == F.col("base_b_id"), "confirmed").when(F.col("accepted_b_id").isNotNull(), "changed").when(F.array_contains("rejected_candidates", F.col("base_b_id")), "withdrawn").when(F.col("deferred"), "deferred").otherwise("unchanged")
    return held.select("scenario_id", "a_id", F.coalesce(kind, F.lit("unchanged")).alias("consequence"))
