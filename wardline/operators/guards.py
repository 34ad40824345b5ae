"""Guards: commands and paths to allow, ask or deny, with the rule that decided.

Null and empty inputs are allowed; inputs over MAX_CHARS are asked about without being matched.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions.rules import first_elsewhere, first_native, let, native
from wardline.functions.shipping import ship
from wardline.plans.catalog import ALLOW, ASK, COMMAND_OVER_CAP, DENY, MAX_CHARS, PATH_OVER_CAP, Names, Rule, command_rules, path_rules


#: Columns of a step between, in names of their own.
_HERE, _PLACE, _NORMAL = "__wardline_here", "__wardline_place", "__wardline_normal"


def _of(rules: list[Rule], place: Column, what: str, none: str | None) -> Column:
    values = F.array(F.lit(none).cast("string"), *[F.lit(getattr(r, what)) for r in rules])
    return F.element_at(values, F.coalesce(place + 2, F.lit(1)))


def _either(elsewhere: Column) -> Column:
    """The place that the JVM found, else Python's.

    The optimizer copies what holds a Python function into each use of it. Two mentions of the JVM's place keep its patterns apart.
    """
    return F.when(F.col(_HERE).isNotNull(), F.col(_HERE)).otherwise(elsewhere)


def _within(text: Column) -> Column:
    return F.when((F.length(text) > 0) & (F.length(text) <= MAX_CHARS), text)


def _verdict(rules: list[Rule], place: Column, whole: Column, over_cap: str) -> Column:
    """struct<decision, reason, rule_id> from the place of the first rule that matches."""
    over = F.length(whole) > MAX_CHARS
    return F.struct(
        F.when(over, ASK).otherwise(_of(rules, place, "decision", ALLOW)).alias("decision"),
        F.when(over, over_cap).otherwise(_of(rules, place, "reason", "")).alias("reason"),
        F.when(~F.coalesce(over, F.lit(False)), _of(rules, place, "id", None)).alias("rule_id"),
    )


def _red(rules: list[Rule], place: Column, whole: Column, over_is_red: bool) -> Column:
    """struct<red, pattern_id>; rules that deny come first, so the first match tells."""
    red = [r for r in rules if r.decision == DENY]
    place = F.when(place < len(red), place)
    over = F.coalesce(F.length(whole) > MAX_CHARS, F.lit(False)) & F.lit(over_is_red)
    return F.struct((over | place.isNotNull()).alias("red"), F.when(over, "over_cap").otherwise(_of(red, place, "id", "")).alias("pattern_id"))


def red_only(red: Column) -> Column:
    """A struct<red, pattern_id> as the JSON that a host asks for when it only wants to know of catastrophes."""
    return F.concat(F.lit('{"red": '), red["red"].cast("string"), F.lit(', "pattern_id": "'), red["pattern_id"], F.lit('"}'))


def judge_commands(rows: DataFrame, command: str, out: str = "verdict", red: str | None = None, over_is_red: bool = False, names: Names = Names()) -> DataFrame:
    """``rows`` with ``out``: struct<decision, reason, rule_id> of a column of commands.

    ``red``: also that column, struct<red, pattern_id>; ``over_is_red``: for the error path, where an input
    over the cap counts as catastrophic.
    """
    rules = command_rules(names)
    given = _within(F.col(command))
    staged = rows.withColumn(_HERE, F.when(native(given), first_native(rules, given)))
    staged = staged.withColumn(_PLACE, _either(first_elsewhere(rules, given)))
    return _judged(staged, rules, command, COMMAND_OVER_CAP, out, red, over_is_red)


def judge_paths(rows: DataFrame, path: str, out: str = "verdict", red: str | None = None, over_is_red: bool = False, normal: str | None = None, names: Names = Names()) -> DataFrame:
    """As judge_commands() for a column of paths; ``normal``: also a column of normalized paths."""
    rules = path_rules(names)
    given = _within(F.col(path))
    staged = rows.withColumn(_NORMAL, F.when(native(given), _normalize_native(given)))
    staged = staged.withColumn(_HERE, first_native(rules, F.col(_NORMAL)))
    staged = staged.withColumn(_PLACE, _either(first_elsewhere(rules, given, normalize_in_python)))
    if normal:
        staged = staged.withColumn(normal, normalize_path(given))
    return _judged(staged, rules, path, PATH_OVER_CAP, out, red, over_is_red).drop(_NORMAL)


def _judged(staged: DataFrame, rules: list[Rule], whole: str, over_cap: str, out: str, red: str | None, over_is_red: bool) -> DataFrame:
    new = {out: _verdict(rules, F.col(_PLACE), F.col(whole), over_cap)}
    if red:
        new[red] = _red(rules, F.col(_PLACE), F.col(whole), over_is_red)
    return staged.withColumns(new).drop(_HERE, _PLACE)


# --- paths ---------------------------------------------------------------------------------------

_TAIL = r"[\s.]+$"


def normalize_in_python(path: str) -> str:
    """The normal form of one path: slashes, lower case, no dot segments, streams or trailing blanks and dots."""
    text = path.replace("\\", "/").lower()
    drive = text[:2] if text[1:2] == ":" and text[0].isalpha() else ""
    text = text.removeprefix(drive)
    rooted, kept = text[:1] == "/", []
    for part in text.split("/"):
        if part == "..":
            if kept and kept[-1] != "..":
                kept.pop()
            elif not rooted:
                kept.append(part)
        elif part not in ("", ".") and (short := re.sub(_TAIL, "", part, flags=re.ASCII)):
            kept.append(short)
    if kept:
        kept[-1] = kept[-1].partition(":")[0]
    return re.sub(_TAIL, "", drive + "/" * rooted + "/".join(kept), flags=re.ASCII)


def _segments(rest: Column) -> Column:
    """A path's segments with dots resolved."""
    rooted = F.startswith(rest, F.lit("/"))

    def push(kept: Column, part: Column) -> Column:
        short = F.regexp_replace(part, r"(?d)[\s.]+\z", "")
        up = F.when((F.size(kept) > 0) & (F.try_element_at(kept, F.lit(-1)) != ".."), F.slice(kept, 1, F.size(kept) - 1)).when(~rooted, F.concat(kept, F.array(part))).otherwise(kept)
        return F.when(part.isin("", "."), kept).when(part == "..", up).when(short == "", kept).otherwise(F.concat(kept, F.array(short)))

    return F.aggregate(F.split(rest, "/", -1), F.array().cast("array<string>"), push)


def _joined(drive: Column, rest: Column) -> Column:
    def form(kept: Column) -> Column:
        base = F.substring_index(F.coalesce(F.try_element_at(kept, F.lit(-1)), F.lit("")), ":", 1)
        head = F.when(F.size(kept) > 1, F.concat(F.array_join(F.slice(kept, 1, F.size(kept) - 1), "/"), F.lit("/"))).otherwise("")
        return F.regexp_replace(F.concat(drive, F.when(F.startswith(rest, F.lit("/")), "/").otherwise(""), head, base), r"(?d)[\s.]+\z", "")

    return let(_segments(rest), form)


def _normalize_native(path: Column) -> Column:
    def form(text: Column) -> Column:
        drive = F.regexp_extract(text, "^([a-z]:)?", 0)
        return let(F.substr(text, F.length(drive) + 1), lambda rest: _joined(drive, rest))

    return let(F.lower(F.replace(path, F.lit("\\"), F.lit("/"))), form)


def normalize_path(path: Column) -> Column:
    ship()

    @F.pandas_udf("string")
    def elsewhere(paths: pd.Series) -> pd.Series:
        return paths.map(lambda p: None if p is None else normalize_in_python(p))

    return F.when(native(path), _normalize_native(path)).otherwise(elsewhere(F.when(~native(path), path)))
