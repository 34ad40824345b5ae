"""Settings of an installation, resolved on the driver: arguments, then environment, then file, then defaults.

A source whose value can't be used is passed over with a warning, so loading never fails.
"""

from __future__ import annotations

import os
import sys
import tomllib
import warnings
from collections.abc import Callable, Mapping
from dataclasses import asdict, dataclass, field
from pathlib import Path
from typing import Any

from wardline.operators.audit import PRESETS
from wardline.operators.shapes import MODES
from wardline.plans.catalog import Names

# fixed values
POLICIES = ("open", "closed", "ask", "observe")
HOSTS = {"openclaw": "closed", "claude_code": "observe"}
FORCED_CLOSED = ("healthcare", "biotech")
ASK_MS, SPAWN_MS = (1_000, 600_000), (1_000, 60_000)
MOST_BYTES = 1 << 20
TRUE, FALSE = ("1", "true", "yes", "on"), ("0", "false", "no", "off")


@dataclass(frozen=True)
class Settings:
    compliance: str = "general"
    audit_path: str = "~/.wardline/audit.jsonl"
    retention_days: int = 90
    fail_mode: str = "open"
    content_fields_always: bool = False
    sanitize_strict: bool = False
    structured_output_mode: str = "strict"
    error_policy: str = "closed"
    unattended: bool = False
    ask_timeout_ms: int = 60_000
    spawn_timeout_ms: int = 5_000
    health_probe: bool = True
    #: Which source each setting came from.
    sources: dict[str, str] = field(default_factory=dict, compare=False)

    def to_dict(self) -> dict[str, Any]:
        return {k: v for k, v in asdict(self).items() if k != "sources"}


Reader = Callable[[Any], Any]


def one_of(*allowed: str) -> Reader:
    return lambda raw: raw if isinstance(raw, str) and raw in allowed else None


def a_path(raw: Any) -> str | None:
    return os.path.expanduser(raw.strip()) if isinstance(raw, str) and raw.strip() else None


def a_bool(raw: Any) -> bool | None:
    return raw if isinstance(raw, bool) else None


def bool_text(raw: Any) -> bool | None:
    text = raw.strip().lower() if isinstance(raw, str) else ""
    return True if text in TRUE else False if text in FALSE else None


def int_text(low: int, high: int) -> Reader:
    def read(raw: Any) -> int | None:
        try:
            number = int(raw.strip()) if isinstance(raw, str) else None
        except ValueError:
            return None
        return number if number is not None and low <= number <= high else None

    return read


def _either(raw: Any) -> bool | None:
    return a_bool(raw) if isinstance(raw, bool) else bool_text(raw)


def detect_host(names: Names = Names(), env: Mapping[str, str] | None = None, argv0: str | None = None) -> str | None:
    """The host that runs the guard, by the environment or the program's exact name."""
    env = os.environ if env is None else env
    told = env.get(_key(names, "HARNESS"), "").strip()
    if told in HOSTS:
        return told
    if told:
        warnings.warn(f"unknown host {told!r}; looking at the program's name", stacklevel=2)
    base = (sys.argv[0] if argv0 is None else argv0).replace("\\", "/").rpartition("/")[2].lower().removesuffix(".exe")
    by_name = {f"{names.policy}-openclaw-guard": "openclaw", f"{names.policy}-bash-guard": "claude_code", f"{names.policy}-write-guard": "claude_code"}
    return by_name.get(base)


def _key(names: Names, what: str) -> str:
    return f"{names.policy.upper().replace('-', '_')}_{what}"


def read_file(path: str | os.PathLike | None, names: Names, env: Mapping[str, str]) -> dict:
    """The first settings file that exists, all or nothing."""
    told = [os.fspath(p) for p in (path, env.get(_key(names, "CONFIG"), "").strip()) if p]
    usual = [f"{names.policy}.toml", os.path.expanduser(f"~/.{names.policy}/config.toml")]
    for place in (*told, *usual):
        at = Path(place)
        try:
            if not at.exists():
                if place in told:
                    warnings.warn(f"settings file not found: {place!r}", stacklevel=3)
                continue
            if not at.is_file() or at.stat().st_size > MOST_BYTES:
                raise ValueError("not a regular file, or too large")
            return tomllib.loads(at.read_text(encoding="utf-8"))
        except (OSError, ValueError) as e:
            warnings.warn(f"settings file {place!r} is not used: {e}", stacklevel=3)
            return {}
    return {}


def load(path: str | os.PathLike | None = None, *, names: Names = Names(), host: str | None = None, env: Mapping[str, str] | None = None, **arguments: Any) -> Settings:
    """Settings from ``arguments`` (compliance, audit_path, sanitize_strict, structured_output_mode), environment, file and defaults."""
    env = os.environ if env is None else env
    file = read_file(path, names, env)

    def table(name: str) -> dict:
        part = file.get(name, {})
        if not isinstance(part, dict):
            warnings.warn(f"[{name}] is not a table", stacklevel=3)
            return {}
        return part

    sources: dict[str, str] = {}

    def resolved(name: str, default: Any, argument: Reader | None, from_env: tuple[str, Reader], from_file: tuple[Any, Reader] | None = None) -> Any:
        text = env.get(_key(names, from_env[0]), "").strip() or None
        tiers = [("env", text, from_env[1])]
        if argument:
            tiers.insert(0, ("arguments", arguments.get(name), argument))
        if from_file:
            tiers.append(("file", *from_file))
        for tier, raw, read in tiers:
            if raw is None:
                continue
            value = read(raw)
            if value is not None:
                sources[name] = tier
                return value
            warnings.warn(f"{name} from {tier} is not valid: {raw!r}", stacklevel=3)
        sources[name] = "default"
        return default

    presets, modes = one_of(*PRESETS), one_of(*MODES)
    compliance = resolved("compliance", "general", presets, ("COMPLIANCE", presets), (file.get("compliance"), presets))
    preset = PRESETS[compliance]
    strict = resolved("sanitize_strict", preset["sanitize_strict"], _either, ("SANITIZE_STRICT", bool_text), (table("sanitize").get("strict"), a_bool))
    if preset["sanitize_strict"] and not strict:
        warnings.warn(f"strict is off, which the {compliance} preset has on", stacklevel=2)
    policies = one_of(*POLICIES)
    policy = resolved("error_policy", HOSTS.get(host or "", "closed"), None, ("ERROR_POLICY", policies), (table("guard").get("error_policy"), policies))
    if compliance in FORCED_CLOSED and policy != "closed":
        warnings.warn(f"the {compliance} preset closes on errors; {policy!r} is not used", stacklevel=2)
        policy, sources["error_policy"] = "closed", "preset"
    return Settings(
        compliance=compliance,
        audit_path=resolved("audit_path", os.path.expanduser(f"~/.{names.policy}/audit.jsonl"), a_path, ("AUDIT_PATH", a_path), (table("audit").get("path"), a_path)),
        retention_days=preset["retention_days"],
        fail_mode=preset["fail_mode"],
        content_fields_always=preset["content_fields_always"],
        sanitize_strict=strict,
        structured_output_mode=resolved("structured_output_mode", "strict", modes, ("STRUCTURED_OUTPUT_MODE", modes), (table("structured_output").get("mode"), modes)),
        error_policy=policy,
        unattended=resolved("unattended", False, None, ("UNATTENDED", bool_text)),
        ask_timeout_ms=resolved("ask_timeout_ms", 60_000, None, ("ASK_TIMEOUT_MS", int_text(*ASK_MS))),
        spawn_timeout_ms=resolved("spawn_timeout_ms", 5_000, None, ("SPAWN_TIMEOUT_MS", int_text(*SPAWN_MS))),
        health_probe=resolved("health_probe", True, None, ("HEALTH_PROBE", bool_text)),
        sources=sources,
    )
