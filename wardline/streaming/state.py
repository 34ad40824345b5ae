"""State that follows a stream: chains, counters and anchors, keyed by log or session."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from wardline.functions.shipping import ship
from wardline.operators.audit import GENESIS, AnchorState, chained
from wardline.plans.catalog import COUNTER_TTL_S

CHAIN = "log_id string, line_no bigint, seq bigint, prev_hash string, entry_hash string, raw string"
COUNTER = "session string, count bigint, first_seen_ts bigint, last_seen_ts bigint, banner boolean"


def chain_stream(entries: DataFrame) -> DataFrame:
    """Chained rows of a stream of ``log_id``, ``line_no``, ``fields``; a log's state is its head (seq, hash)."""
    ship(entries.sparkSession)

    def step(key: tuple, parts: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seq, head = state.get if state.exists else (0, GENESIS)
        rows = pd.concat(list(parts)).sort_values("line_no")
        new = chained(rows["fields"].tolist(), seq, head)
        state.update((new[-1][0], new[-1][2]))
        yield pd.DataFrame({"log_id": key[0], "line_no": rows["line_no"].tolist(), **{c: [r[i] for r in new] for i, c in enumerate(("seq", "prev_hash", "entry_hash", "raw"))}})

    return entries.select(F.col("log_id").cast("string").alias("log_id"), "line_no", "fields").groupBy("log_id").applyInPandasWithState(step, CHAIN, "seq bigint, entry_hash string", "append", GroupStateTimeout.NoTimeout)


def count_sessions(seen: list[int], state: tuple[int, int, int] | None, ttl: int = COUNTER_TTL_S) -> tuple[int, int, int, bool]:
    """(count, first, last, whether this was the first row) after rows at these seconds; a silent session starts anew."""
    count, first, last = state or (0, 0, 0)
    began = False
    for at in sorted(seen):
        if count and at - last >= ttl:
            count = 0
        if not count:
            first, began = at, True
        count, last = count + 1, at
    return count, first, last, began


def count_stream(rows: DataFrame) -> DataFrame:
    """Updates of each session's counter for a stream of ``session``, ``at_s`` (seconds); idle state is dropped."""
    ship(rows.sparkSession)

    def step(key: tuple, parts: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        count, first, last, began = count_sessions([int(x) for p in parts for x in p["at_s"]], tuple(state.get) if state.exists else None)
        state.update((count, first, last))
        state.setTimeoutDuration(COUNTER_TTL_S * 1000)
        yield pd.DataFrame({"session": [key[0]], "count": [count], "first_seen_ts": [first], "last_seen_ts": [last], "banner": [began]})

    return rows.select("session", "at_s").groupBy("session").applyInPandasWithState(step, COUNTER, "count bigint, first bigint, last bigint", "update", GroupStateTimeout.ProcessingTimeTimeout)


def session_counters(rows: DataFrame) -> DataFrame:
    """The counters of a finished table of ``session``, ``at_s``: those of each session's last stretch without a gap of the TTL.

    Built-in windows alone: a gap begins a stretch, and the last stretch is what is left of a session.
    """
    from pyspark.sql import Window

    by = Window.partitionBy("session").orderBy("at_s")
    gap = F.coalesce(F.col("at_s") - F.lag("at_s").over(by) >= COUNTER_TTL_S, F.lit(False)).cast("int")
    parts = rows.select("session", "at_s", gap.alias("gap")).withColumn("part", F.sum("gap").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    sums = parts.groupBy("session", "part").agg(F.count("*").alias("count"), F.min("at_s").alias("first_seen_ts"), F.max("at_s").alias("last_seen_ts"))
    last = sums.groupBy("session").agg(F.max_by(F.struct("count", "first_seen_ts", "last_seen_ts"), "part").alias("x"))
    return last.select("session", "x.count", "x.first_seen_ts", "x.last_seen_ts")


def counter_snapshot(counters: DataFrame, now_s: int, ttl: int = COUNTER_TTL_S) -> DataFrame:
    """Rows ``session`` and ``entry`` (JSON) of the counters that have been touched within the TTL, for a file that outlives the stream."""
    return counters.where(F.col("last_seen_ts") > F.lit(now_s) - ttl).select("session", F.to_json(F.struct("count", "first_seen_ts", "last_seen_ts")).alias("entry"))


def anchor_stream(chain_rows: DataFrame, every_n: int, every_minutes: float, shipper: Callable[[int, str, str], None], clock: Callable[[], float] = time.time) -> DataFrame:
    """Ships the heads of a stream of chained rows when they are due; a row a due head and attempt.

    ``log_id``, ``seq``, ``entry_hash``, ``status`` (``anchored``, ``failed`` for the first failure of a streak, ``failed
    again``) and ``entry``, the fields of the error row that the first failure owes the log. The cadence is the log's
    state, so a restarted stream goes on where it was; the shipper, sent to the executors, sees each head at least once.
    """
    AnchorState(every_n, every_minutes)
    ship(chain_rows.sparkSession)

    def step(key: tuple, parts: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        own = AnchorState(every_n, every_minutes)
        if state.exists:
            own.seq, at, own.gap = state.get
            own.at = None if at is None or at != at else at
        out = []
        for r in pd.concat(list(parts)).sort_values("seq").itertuples(index=False):
            now, error = clock(), []
            if own.due(r.seq, now):

                def tried(*head: object) -> None:
                    try:
                        shipper(*head)
                    except Exception as e:
                        error.append(type(e).__name__)
                        raise

                status = own.ship((r.seq, r.entry_hash, r.ts or ""), now, tried)
                fields = json.dumps({"action": "audit.anchor", "target": "<shipper>", "outcome": "error", "details": {"anchor_seq": r.seq, "error": error[0]}}) if status == "failed" else None
                out.append((key[0], r.seq, r.entry_hash, status, fields))
        state.update((own.seq, own.at, own.gap))
        yield pd.DataFrame(out, columns=["log_id", "seq", "entry_hash", "status", "entry"])

    rows = chain_rows.select(F.col("log_id").cast("string").alias("log_id"), "seq", "entry_hash", F.get_json_object("raw", "$.ts").alias("ts"))
    return rows.groupBy("log_id").applyInPandasWithState(step, "log_id string, seq bigint, entry_hash string, status string, entry string", "seq bigint, at double, gap boolean", "append", GroupStateTimeout.NoTimeout)
