"""Rules as columns: which rule of a catalog matches first.

Short ASCII text is matched in the JVM by one CASE over ``rlike``. Text that is longer, where Java's engine
recurses in repeated groups, or that holds other characters, whose classes differ between engines, goes to an
Arrow function with Python's engine; rows that need none send it a null.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from wardline.functions.shipping import ship
from wardline.plans.catalog import Rule

#: Characters up to which the JVM's engine is safe for all patterns of the catalogs.
NATIVE_CHARS = 1000


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body uses it; no Python function inside."""
    return F.transform(F.array(value), body)[0]


def is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.length(text)


def native(text: Column) -> Column:
    """True if the JVM may match the text."""
    return is_ascii(text) & (F.length(text) <= NATIVE_CHARS)


def folded(text: Column) -> Column:
    """The text in lower case, with the four other characters that match an ASCII letter where case is ignored as that letter."""
    odd = F.contains(text, F.lit("\u017f")) | F.contains(text, F.lit("\u0131")) | F.contains(text, F.lit("\u0130")) | F.contains(text, F.lit("\u212a"))
    return F.lower(F.when(odd, F.translate(text, "\u017f\u0131\u0130\u212a", "siik")).otherwise(text))


def has_any(text: Column, words: Sequence[str]) -> Column:
    """Whether the text holds one of the words as it is: a search many times faster than a pattern's, to tell what a pattern can't match."""
    out = F.lit(False)
    for word in words:
        out = out | F.contains(text, F.lit(word))
    return out


def _java(rule: Rule, pattern: str) -> str:
    return f"(?{'' if rule.exact else 'i'}d{'m' if rule.multiline else ''}){pattern}"


def matches(rule: Rule, text: Column) -> Column:
    """Whether a rule matches short ASCII text."""
    *before, last = [_java(rule, s) for s in rule.stages]
    if not before:
        return text.rlike(last)

    def on_line(line: Column) -> Column:
        for stage in before:  # what follows the leftmost match of each stage
            line = F.try_element_at(F.split(line, stage, 2), F.lit(2))
        return F.coalesce(line.rlike(last), F.lit(False))

    return F.exists(F.split(text, "\n", -1), on_line)


def first_in_python(rules: Sequence[Rule], text: str) -> int | None:
    """The place of the first rule that matches."""
    for k, rule in enumerate(rules):
        if _found(_compiled(rule), text):
            return k
    return None


def _compiled(rule: Rule) -> list[re.Pattern[str]]:
    how = re.ASCII | (0 if rule.exact else re.IGNORECASE) | (re.MULTILINE if rule.multiline else 0)
    return [re.compile(s, how) for s in rule.stages]


def _found(stages: list[re.Pattern[str]], text: str) -> bool:
    if len(stages) == 1:
        return stages[0].search(text) is not None
    for line in text.split("\n"):
        at = 0
        for stage in stages:
            hit = stage.search(line, at)
            if hit is None:
                break
            at = hit.end()
        else:
            return True
    return False


def first_native(rules: Sequence[Rule], text: Column) -> Column:
    """The place (from 0) of the first rule that matches a short ASCII text, else null."""
    case = None
    for k, rule in enumerate(rules):
        hit = matches(rule, text)
        case = F.when(hit, F.lit(k)) if case is None else case.when(hit, F.lit(k))
    return case


def first_elsewhere(rules: Sequence[Rule], text: Column, form: Callable[[str], str] = str) -> Column:
    """The place of the first rule that matches other texts, brought into their form by Python; null for short ASCII."""
    rules = list(rules)
    ship()

    @F.pandas_udf("int")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else first_in_python(rules, form(t))).astype("Int32")

    return run(F.when(~native(text), text))


def first_rule(rules: Sequence[Rule], text: Column) -> Column:
    """The place (int, from 0) of the first rule that matches a text that is not null, else null."""
    return F.when(native(text), first_native(rules, text)).otherwise(first_elsewhere(rules, text))
