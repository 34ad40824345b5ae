"""Hash-chained audit logs: building chains, verifying them, anchoring their heads.

A log is the rows with one ``log_id`` in the order of ``line_no``. Chaining is sequential within a log, so a
log stays in one task, which reads it in batches; logs run in parallel. Verification is not: each line is hashed on its own, compared with
the line before it by a window, and the first line at fault is the result.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.functions.shipping import ship

# fixed values
BASE_FIELDS = ("ts", "actor", "role", "session", "machine", "action", "target", "outcome", "details")
GENESIS = "0" * 64
PRESETS = {
    "general": {"content_fields_always": False, "retention_days": 90, "fail_mode": "open", "sanitize_strict": False},
    "healthcare": {"content_fields_always": True, "retention_days": 365, "fail_mode": "closed", "sanitize_strict": True},
    "biotech": {"content_fields_always": True, "retention_days": 365, "fail_mode": "closed", "sanitize_strict": True},
}
ANCHOR_ROWS, ANCHOR_MINUTES = 100, 15.0


def is_blank(line: Column) -> Column:
    """True for lines that hold nothing but what Python's strip() takes away."""
    return F.coalesce(line, F.lit("")).rlike(r"^[\s\x0b\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]*\z")


def canonical(value: object) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def hash_of(entry: dict) -> str:
    return hashlib.sha256(canonical({k: v for k, v in entry.items() if k != "entry_hash"}).encode()).hexdigest()


def content_sha256(content: Column) -> Column:
    """Null for null."""
    return F.sha2(content, 256)


def entries_from(rows: DataFrame, preset: str = "general", content: tuple[Column, Column] | None = None, has_content: Column | None = None) -> DataFrame:
    """``log_id``, ``line_no`` and ``fields`` (JSON) of new rows; missing base fields get their defaults.

    ``content``: texts before and after a write, of which the log keeps the hashes (in rows with ``has_content``).
    Without it the slots are there, as nulls, for presets that always have them.
    """
    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx")
    defaults = {"ts": now, "action": F.lit(""), "target": F.lit(""), "outcome": F.lit(""), "actor": F.lit("agent"), "role": F.lit("unknown"), "session": F.lit(""), "machine": F.lit(""), "details": F.lit("{}")}
    pick = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), defaults[c]) if c in rows.columns else defaults[c]
    fields = {c: pick(c) for c in BASE_FIELDS}
    parts = [F.struct(F.lit(c).alias("k"), F.when(F.lit(c == "details"), v).otherwise(F.to_json(F.array(v)).substr(F.lit(2), F.length(F.to_json(F.array(v))) - 2)).alias("v")) for c, v in fields.items()]
    if content or PRESETS[preset]["content_fields_always"]:
        hashes = [content_sha256(c) for c in content] if content else [F.lit(None).cast("string")] * 2
        slots = [F.struct(F.lit(f"content_sha256_{n}").alias("k"), F.coalesce(F.concat(F.lit('"'), h, F.lit('"')), F.lit("null")).alias("v")) for n, h in zip(("before", "after"), hashes)]
        asked = has_content if has_content is not None and not PRESETS[preset]["content_fields_always"] else F.lit(True)
        parts += [F.when(asked, x) for x in slots]
    json_text = F.concat(F.lit("{"), F.array_join(F.transform(F.array_compact(F.array(*parts)), lambda p: F.concat(F.lit('"'), p["k"], F.lit('":'), F.coalesce(p["v"], F.lit("null")))), ","), F.lit("}"))
    return rows.select("log_id", "line_no", json_text.alias("fields"))


def chained(fields: list[str], seq: int = 0, prev: str = GENESIS) -> list[tuple[int, str, str, str]]:
    """(seq, prev_hash, entry_hash, line) of entries that continue a chain."""
    out = []
    for text in fields:
        seq += 1
        entry = json.loads(text) | {"seq": seq, "prev_hash": prev}
        entry["entry_hash"] = hash_of(entry)
        out.append((seq, prev, entry["entry_hash"], canonical(entry)))
        prev = entry["entry_hash"]
    return out


def chain(entries: DataFrame, heads: DataFrame | None = None) -> DataFrame:
    """``log_id``, ``line_no``, ``seq``, ``prev_hash``, ``entry_hash``, ``raw`` of new ``entries(log_id, line_no, fields)``.

    ``heads``: ``log_id``, ``seq``, ``entry_hash`` of the logs as they are (see heads()).
    """
    kind = dict(entries.dtypes)["log_id"]
    if heads is not None:
        entries = entries.join(heads.select("log_id", F.col("seq").alias("head_seq"), "entry_hash"), "log_id", "left")
    else:
        entries = entries.withColumns({"head_seq": F.lit(0).cast("bigint"), "entry_hash": F.lit(None).cast("string")})

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        log, seq, prev = None, 0, GENESIS  # of the log that the last batch ended in
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                if log is None or r.log_id != log[0]:
                    log, seq, prev = (r.log_id,), 0 if pd.isna(r.head_seq) else int(r.head_seq), GENESIS if pd.isna(r.entry_hash) else r.entry_hash
                ((seq, before, prev, line),) = chained([r.fields], seq, prev)
                out.append((r.log_id, r.line_no, seq, before, prev, line))
            yield pd.DataFrame(out, columns=["log_id", "line_no", "seq", "prev_hash", "entry_hash", "raw"])

    ship(entries.sparkSession)
    # a log follows itself in one task, which holds a batch of it at a time
    ordered = entries.select("log_id", "line_no", "fields", "head_seq", "entry_hash").repartition("log_id").sortWithinPartitions("log_id", "line_no")
    return ordered.mapInPandas(run, f"log_id {kind}, line_no bigint, seq bigint, prev_hash string, entry_hash string, raw string")


_CHECKED = "parsed boolean, seq bigint, prev_hash string, entry_hash string, own_hash string, ts string"


def _check_line(text: str | None) -> tuple:
    try:
        entry = json.loads(text or "")
        own = hash_of(entry) if isinstance(entry, dict) else None
    except (ValueError, RecursionError):
        own = None
    if own is None:
        return False, None, None, None, None, None
    seq = entry.get("seq")
    text_of = lambda k: v if isinstance(v := entry.get(k), str) else None
    return True, seq if type(seq) is int and abs(seq) < 2**63 else None, text_of("prev_hash"), text_of("entry_hash"), own, text_of("ts")


def _checked(raw: str) -> Column:
    """What each line says and the hash that it should have; lines that are no JSON object are not parsed."""

    ship()

    @F.pandas_udf(_CHECKED)
    def run(lines: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_check_line(t) for t in lines], columns=["parsed", "seq", "prev_hash", "entry_hash", "own_hash", "ts"]).astype({"seq": "Int64"})

    return run(F.col(raw))


def checked_lines(lines: DataFrame) -> DataFrame:
    """Each line of ``lines(log_id, line_no, raw)`` that is not blank, its place ``n`` and its fault, if any."""
    by = Window.partitionBy("log_id").orderBy("line_no")
    rows = lines.where(~is_blank(F.col("raw"))).withColumn("e", _checked("raw")).withColumn("n", F.row_number().over(by)).withColumn("before", F.coalesce(F.lag("e.entry_hash").over(by), F.when(F.col("n") == 1, GENESIS)))
    fault = (
        F.when(~F.col("e.parsed"), "unparseable line")
        .when(~F.col("e.seq").eqNullSafe(F.col("n").cast("bigint")), "seq out of order")
        .when(~F.col("e.prev_hash").eqNullSafe(F.col("before")), "broken chain link")
        .when(~F.col("e.entry_hash").eqNullSafe(F.col("e.own_hash")), "entry hash mismatch")
    )
    return rows.select("log_id", "line_no", "n", "e", fault.alias("fault"))


def verify(lines: DataFrame, logs: DataFrame | None = None) -> DataFrame:
    """``log_id``, ``ok``, ``count`` (lines read up to the fault), ``broken_at``, ``reason`` of each log.

    ``logs``: the logs to report on, if some may be empty; a missing log is in order.
    """
    rows = checked_lines(lines)
    out = rows.groupBy("log_id").agg(F.min(F.when(F.col("fault").isNotNull(), F.struct("n", "fault"))).alias("first"), F.count("*").alias("lines"))
    if logs is not None:
        out = logs.select("log_id").distinct().join(out, "log_id", "left")
    broken = F.col("first.n")
    return out.select("log_id", broken.isNull().alias("ok"), F.coalesce(broken, "lines", F.lit(0)).cast("bigint").alias("count"), broken.cast("bigint").alias("broken_at"), F.coalesce("first.fault", F.lit("")).alias("reason"))


def heads(lines: DataFrame) -> DataFrame:
    """The last line of each log that can be parsed, which a new entry continues."""
    rows = lines.where(~is_blank(F.col("raw"))).withColumn("e", _checked("raw")).where("e.parsed")
    last = rows.groupBy("log_id").agg(F.max_by("e", "line_no").alias("e"))
    return last.select("log_id", F.coalesce("e.seq", F.lit(0)).alias("seq"), F.coalesce("e.entry_hash", F.lit(GENESIS)).alias("entry_hash"), "e.ts")


# --- anchors -------------------------------------------------------------------------------------


class AnchorState:
    """When the head of a growing log is due to be anchored, by rows or by elapsed time."""

    def __init__(self, every_n: int = ANCHOR_ROWS, every_minutes: float = ANCHOR_MINUTES):
        if every_n < 0 or every_minutes < 0:
            raise ValueError("cadences must not be negative")
        if not every_n and not every_minutes:
            raise ValueError("both cadences are off, so nothing would be anchored")
        self.every_n, self.every_s = every_n, every_minutes * 60
        self.seq, self.at, self.gap = 0, None, False

    def due(self, seq: int, now: float) -> bool:
        """Whether a head is due; the first one only starts the clock."""
        started, self.at = self.at is not None, now if self.at is None else self.at
        return (self.every_n > 0 and seq >= self.seq + self.every_n) or (started and self.every_s > 0 and now >= self.at + self.every_s)

    def anchored(self, seq: int, now: float) -> None:
        self.seq, self.at, self.gap = seq, now, False

    def ship(self, head: tuple[int, str, str], now: float, shipper: Callable[[int, str, str], None]) -> str:
        """``anchored``, ``failed`` (first of a streak: an error row belongs in the log) or ``failed again``."""
        try:
            shipper(*head)
        except Exception:  # noqa: BLE001  a shipper is the user's code and must not stop the log
            status = "failed again" if self.gap else "failed"
            self.gap = True
            return status
        self.anchored(head[0], now)
        return "anchored"


def anchors_due(chain_rows: DataFrame, every_n: int = ANCHOR_ROWS, every_minutes: float = 0.0, clock: str | None = None) -> DataFrame:
    """``log_id``, ``seq``, ``entry_hash`` of the heads that a log's cadence anchors.

    By rows alone a head is due at each multiple of ``every_n``; with ``clock`` (seconds, a column) also by time.
    """
    if every_minutes <= 0 or clock is None:
        AnchorState(every_n, 0)
        return chain_rows.where(F.col("seq") % every_n == 0).select("log_id", "seq", "entry_hash")

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        log, state = None, None
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                if log is None or r.log_id != log[0]:
                    log, state = (r.log_id,), AnchorState(every_n, every_minutes)
                if state.due(r.seq, r.clock):
                    state.anchored(r.seq, r.clock)
                    out.append((r.log_id, r.seq, r.entry_hash))
            yield pd.DataFrame(out, columns=["log_id", "seq", "entry_hash"])

    ship(chain_rows.sparkSession)
    kind = dict(chain_rows.dtypes)["log_id"]
    rows = chain_rows.select("log_id", "seq", "entry_hash", F.col(clock).cast("double").alias("clock"))
    return rows.repartition("log_id").sortWithinPartitions("log_id", "seq").mapInPandas(run, f"log_id {kind}, seq bigint, entry_hash string")


def cross_check(receipts: DataFrame, lines: DataFrame) -> DataFrame:
    """Each receipt ``log_id``, ``seq``, ``entry_hash`` with ``status``: matches, differs or missing in the log."""
    held = lines.where(~is_blank(F.col("raw"))).withColumn("e", _checked("raw")).where("e.parsed and e.seq is not null").groupBy("log_id", F.col("e.seq").alias("seq")).agg(F.min_by("e.entry_hash", "line_no").alias("held"))
    status = F.when(F.col("held").isNull(), "missing").when(F.col("held") == F.col("entry_hash"), "matches").otherwise("differs")
    return receipts.join(held, ["log_id", "seq"], "left").select("log_id", "seq", "entry_hash", status.alias("status"))


def within_retention(rows: DataFrame, preset: str, now: Column | None = None) -> DataFrame:
    """Rows whose ``ts`` lies within the preset's retention. The logs' own format never drops rows; this is a filter for reports."""
    days = PRESETS[preset]["retention_days"]
    return rows.where(F.to_timestamp("ts") >= (now if now is not None else F.current_timestamp()) - F.expr(f"INTERVAL {days} DAYS"))
