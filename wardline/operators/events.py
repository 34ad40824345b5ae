"""Host events (JSON) to decisions and to the responses that the hosts understand.

Host A sends tool_name and tool_input, host B toolName-less params with a command or a path. Anything that is
not of the expected form is allowed. ``trigger`` marks rows whose guard could not run; the error policy
decides on those. An unknown decision of host B denies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions.rules import let
from wardline.operators import guards, policy
from wardline.operators.audit import entries_from
from wardline.plans.catalog import ALLOW, ASK, DENY, INPUT_OVER_CAP, MAX_CHARS, Names

# fixed values
MAX_BYTES = 4 * MAX_CHARS
WRITE_TOOLS = ("Write", "Edit", "MultiEdit")
PATH_KEYS = ("file_path", "path", "filePath")
UNAVAILABLE = "Guard unavailable — "
TITLE = "wardline"


def text_of_input(raw: Column) -> Column:
    """Bytes of a hook's input as text, by their byte order mark; UTF-8 without one."""
    utf16 = F.substring(raw, 1, 2).isin(F.unhex(F.lit("FFFE")), F.unhex(F.lit("FEFF")))
    bom = F.substring(raw, 1, 3) == F.unhex(F.lit("EFBBBF"))
    return F.when(utf16, F.decode(F.when(utf16, raw), "UTF-16")).when(bom, F.make_valid_utf8(F.substr(raw, F.lit(4)).cast("string"))).otherwise(F.make_valid_utf8(raw.cast("string")))


def _string(variant: Column, path: str) -> Column:
    """A value that is a JSON string, else null."""
    value = F.try_variant_get(variant, path, "variant")
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(variant, path, "string"))


def command_and_path(event: Column, host: str) -> tuple[Column, Column]:
    """What a host's event (JSON text) asks to run and to write; null where it does not."""
    if host not in ("A", "B"):
        raise ValueError("host must be A or B")

    def of_host(v: Column) -> Column:
        if host == "A":
            tool = _string(v, "$.tool_name")
            command, path = F.when(tool == "Bash", _string(v, "$.tool_input.command")), F.when(tool.isin(*WRITE_TOOLS), _string(v, "$.tool_input.file_path"))
        else:
            command = _string(v, "$.params.command")
            path = F.when(command.isNull(), F.coalesce(*[_string(v, f"$.params.{k}") for k in PATH_KEYS], _string(v, "$.derivedPaths[0]")))
        return F.struct(command.alias("command"), path.alias("path"))

    both = let(F.try_parse_json(event), of_host)  # parsed once
    return both["command"], both["path"]


def decide(rows: DataFrame, event: str, host: str, out: str = "result", trigger: str | None = None, error_policy: str | None = None, attended: str | None = None, names: Names = Names()) -> DataFrame:
    """``rows`` with ``out``: struct<decision, reason, rule_id, outcome_reason> for a column of events as JSON text."""
    no = F.lit(False)
    given = rows.withColumn("__wardline_over", F.coalesce(F.octet_length(event) > MAX_BYTES, no))
    command, path = command_and_path(F.when(~F.col("__wardline_over"), F.col(event)), host)
    given = given.withColumns({"__wardline_command": command, "__wardline_path": path})
    given = guards.judge_commands(given, "__wardline_command", "__wardline_c", "__wardline_cr", True, names)
    given = guards.judge_paths(given, "__wardline_path", "__wardline_p", "__wardline_pr", True, None, names)
    is_command = F.col("__wardline_command").isNotNull()
    of = lambda k: F.when(is_command, F.col(f"__wardline_c.{k}")).otherwise(F.col(f"__wardline_p.{k}"))
    decision, reason, rule, outcome = of("decision"), of("reason"), of("rule_id"), F.lit(None).cast("string")
    if trigger is not None:
        given = given.withColumn("__wardline_raw", F.coalesce("__wardline_command", "__wardline_path", F.lit("")))
        given = given.withColumns({"__wardline_repair": policy.is_self_repair(F.col("__wardline_raw"), names=names), "__wardline_red": F.when(is_command, F.col("__wardline_cr.red")).otherwise(F.col("__wardline_pr.red"))})
        given = given.withColumn("__wardline_resolved", policy.resolve_error_policy(F.col(error_policy) if error_policy else F.lit("closed"), F.col(attended) if attended else no, F.col("__wardline_repair"), F.col("__wardline_red")))
        failed = F.col(trigger).isNotNull() & (is_command | F.col("__wardline_path").isNotNull())
        outcome = F.when(failed, F.col("__wardline_resolved.outcome_reason"))
        decision = F.when(failed, F.col("__wardline_resolved.decision")).otherwise(decision)
        unavailable = F.when(F.col("__wardline_resolved.decision") == ALLOW, "").otherwise(F.concat(F.lit(UNAVAILABLE), outcome))
        reason, rule = F.when(failed, unavailable).otherwise(reason), F.when(~failed, rule)
    over = F.col("__wardline_over")
    result = F.struct(
        F.when(over, ASK).otherwise(decision).alias("decision"),
        F.when(over, INPUT_OVER_CAP).otherwise(reason).alias("reason"),
        F.when(~over, rule).alias("rule_id"),
        F.when(~over, outcome).alias("outcome_reason"),
    )
    return given.withColumn(out, result).select(*[c for c in rows.columns if c != out], out)


def _ascii_json(text: Column) -> Column:
    """A JSON string of ASCII; the catalogs' reasons hold one other character, the dash."""
    array = F.to_json(F.array(text))
    return F.replace(array.substr(F.lit(2), F.length(array) - 2), F.lit("—"), F.lit("\\u2014"))


def response(result: Column, host: str) -> Column:
    """The host's response JSON; null for what host A allows, ``{}`` for what host B allows."""
    reason = _ascii_json(result["reason"])
    if host == "A":
        decision = F.when(result["decision"] == "cannot_evaluate", DENY).otherwise(result["decision"])
        body = F.concat(F.lit('{"hookSpecificOutput": {"hookEventName": "PreToolUse", "permissionDecision": "'), decision, F.lit('", "permissionDecisionReason": '), reason, F.lit("}}"))
        return F.when(decision != ALLOW, body)
    ask = F.concat(F.lit('{"requireApproval": {"title": "' + TITLE + '", "description": '), reason, F.lit(', "severity": "warning", "allowedDecisions": ["allow-once", "deny"]}}'))
    block = F.concat(F.lit('{"block": true, "blockReason": '), reason, F.lit("}"))
    return F.when(result["decision"] == ALLOW, "{}").when(result["decision"] == ASK, ask).when(result["decision"] == DENY, block).otherwise('{"block": true, "blockReason": "Guard internal error"}')


def audit_details(result: Column) -> Column:
    return F.to_json(F.struct(result["reason"].alias("reason")))


def decision_entries(decided: DataFrame, event: str, host: str, result: str = "result", preset: str = "general") -> DataFrame:
    """``log_id``, ``line_no``, ``fields`` of the audit row for each event that a guard decided (see decide()), for audit.chain().

    ``decided`` has ``log_id`` and ``line_no``. A write whose event holds content keeps the hashes of what was there
    before and of what is written. Events that ask for nothing, and those whose guard could not run, give no row.
    """
    command, path = command_and_path(F.col(event), host)
    at = "$.tool_input" if host == "A" else "$.params"
    held = F.try_parse_json(event)
    inner = lambda key: F.try_variant_get(held, f"{at}.{key}", "variant")
    after = F.coalesce(_string(held, f"{at}.content_after"), _string(held, f"{at}.content"))
    has_content = path.isNotNull() & (inner("content").isNotNull() | inner("content_after").isNotNull() | inner("content_before").isNotNull())
    of = F.col(result)
    fields = {"target": F.coalesce(command, path), "action": F.when(command.isNotNull(), "bash").otherwise("write"), "outcome": of["decision"], "details": audit_details(of)}
    told = {"__before": _string(held, f"{at}.content_before"), "__after": after, "__has": has_content}
    rows = decided.where(of["outcome_reason"].isNull()).withColumns({**fields, **told}).where("target is not null")
    return entries_from(rows, preset, (F.col("__before"), F.col("__after")), F.col("__has"))


def unavailable_details(trigger: Column, action_tier: Column, attended: Column, outcome_reason: Column, error_policy: Column, host: Column) -> Column:
    """The details of the audit row that says that a guard could not evaluate, as JSON."""
    fields = [trigger.alias("trigger"), F.coalesce(action_tier, F.lit("unknown")).alias("action_tier"), attended.alias("attended"), outcome_reason.alias("outcome_reason"), F.lit(False).alias("guard_authoritative"), error_policy.alias("error_policy"), host.alias("harness")]
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
