"""What happens where a guard could not evaluate its input, and what its target may look like in a log."""

from __future__ import annotations

import os
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from wardline.functions.rules import NATIVE_CHARS, folded, has_any, let
from wardline.functions.shipping import ship
from wardline.operators.guards import normalize_path
from wardline.plans.catalog import DECISION_OF_REASON, DENY, FLAT_SECRET, MAX_CHARS, SAME_CHARS, TARGET_CHARS, Names, linear_secret_pattern


def decision_of(outcome_reason: Column) -> Column:
    """The decision that a reason stands for; unknown reasons deny."""
    pairs = [F.lit(x) for kv in DECISION_OF_REASON.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), outcome_reason), F.lit(DENY))


def resolve_error_policy(policy: Column, attended: Column, self_repair: Column, red: Column) -> Column:
    """struct<decision, outcome_reason>. Nulls in self_repair and red count as false, a null policy as unknown."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    reason = (
        F.when(yes(self_repair), "allowed-selfrepair")
        .when(yes(red), "denied-catastrophic-unevaluated")
        .when(policy == "open", "allowed-unevaluated")
        .when(policy == "closed", "denied-unevaluated")
        .when((policy == "ask") & yes(attended), "asked-unevaluated")
        .when(policy == "ask", "would-have-asked")
        .when(policy == "observe", "would-have-blocked")
        .otherwise("denied-unevaluated")
    )
    return F.struct(decision_of(reason).alias("decision"), reason.alias("outcome_reason"))


# --- self-repair ---------------------------------------------------------------------------------

#: Line ends of Python's splitlines(). Fixed values.
_LINE_ENDS = r"[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
_BLANK = r"[\s\x0b\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def self_repair_commands(names: Names = Names(), distribution: str = "wardline", checkout: str = "wardline") -> list[str]:
    """Whole commands that repair the guard's own installation. Fixed values."""
    plugin, package, dist, folder = (re.escape(x) for x in (names.plugin, names.package, distribution, checkout))
    tool, flags = r"(pip|pip3|pipx|uv(?:\s+pip)?)", r"(?:--?\S+\s+)*"
    named = dist + r"(?:\[[^\]]+\])?(?:==[^\s]+)?(?:\[[^\]]+\])?"
    return [
        rf"{tool}\s+install\s+{flags}-e\s+(?:.*[/\\])?{folder}/?",
        rf"{tool}\s+install\s+{flags}{named}",
        rf"{tool}\s+(?:uninstall|upgrade)\s+{flags}{named}",
        rf"{plugin}\s+(enable|disable)",
        rf"python(3|\.exe)?\s+-m\s+{package}\.plugin_cli\s+(enable|disable)",
        rf"(which|command\s+-v|where)\s+{plugin}",
    ]


def is_self_repair(raw: Column, home: str | None = None, names: Names = Names(), distribution: str = "wardline") -> Column:
    """True for commands and paths that repair the guard itself; null and blank inputs are none."""
    home = (home if home is not None else os.path.expanduser("~")).rstrip("/")
    # what repairs names the guard or begins at home; nothing else is brought into a form and matched
    given = {n.lower() for n in (names.plugin, names.package, names.policy, distribution, "wardline")}
    words = ["~", *sorted(n for n in given if not any(m in n for m in given - {n}))]
    likely = let(folded(raw), lambda low: has_any(low, words)) if all(map(str.isascii, given)) else F.lit(True)
    raw = F.when(likely, raw)
    text = F.regexp_replace(F.coalesce(raw, F.lit("")), f"(?d)^{_BLANK}+|{_BLANK}+\\z", "")
    # a long text is no repair command, and could recurse too deep in the JVM's engine
    commands = "|".join(f"(?:{c})" for c in self_repair_commands(names, distribution))
    command = F.coalesce(F.when(F.length(text) <= NATIVE_CHARS, text).rlike(f"(?iud)^(?:{commands})\\z"), F.lit(False))
    line = let(F.split(text, _LINE_ENDS, 2)[0], lambda x: F.when(x.rlike(r"^~(/|\z)"), F.concat(F.lit(home), F.substr(x, F.lit(2)))).otherwise(x))
    folders = "|".join(re.escape(f) for f in (f"{home.lower()}/.{names.policy}", f"/opt/{names.policy}", f"/usr/local/{names.policy}"))
    return F.when(raw.isNull(), False).otherwise(command | F.coalesce(normalize_path(F.when(raw.isNotNull(), line)).rlike(f"(?s)^(?:{folders})(?:/|\\z)"), F.lit(False)))


# --- redaction -----------------------------------------------------------------------------------

#: One of these, in lower case, is in whatever is redacted.
SECRET_WORDS = ("token", "key", "secret", "password", "cred", "authorization")
_SECRET = re.compile(linear_secret_pattern(), re.IGNORECASE)


def redact(raw: Column) -> Column:
    """Credential-shaped values as ``<redacted>``, then cut to TARGET_CHARS with an ellipsis. Null: ``None``."""

    ship()

    @F.pandas_udf("string")
    def elsewhere(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else _SECRET.sub("<redacted>", t))

    text = F.coalesce(raw, F.lit("None"))
    named = has_any(folded(text), SECRET_WORDS)
    own = (F.length(text) <= MAX_CHARS) & ~text.rlike(f"[^{SAME_CHARS}]")  # the flat pattern does not recurse
    plain = F.regexp_replace(text, "(?id)" + FLAT_SECRET, "<redacted>")
    # the function answers what it is asked, which is null where it is not
    out = F.coalesce(elsewhere(F.when(named & ~own, text)), F.when(named, plain).otherwise(text))
    return F.when(F.length(out) > TARGET_CHARS, F.concat(F.substring(out, 1, TARGET_CHARS - 3), F.lit("..."))).otherwise(out)
