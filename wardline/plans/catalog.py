"""The rule catalogs. Patterns, reasons, ids and word lists are fixed values; nothing here is configurable
but the names under which the guard itself is installed (``Names``), which some rules protect."""

from __future__ import annotations

from dataclasses import dataclass

ALLOW, ASK, DENY = "allow", "ask", "deny"
MAX_CHARS = 1_000_000
COMMAND_OVER_CAP = "Command exceeds the size cap and was not fully evaluated — confirm manually"
PATH_OVER_CAP = "Path exceeds the size cap and was not fully evaluated — confirm manually"
INPUT_OVER_CAP = "Hook input exceeds the size cap — confirm manually"


@dataclass(frozen=True)
class Names:
    """Under what names the guard that the rules protect is installed."""

    package: str = "wardline"
    plugin: str = "wardline-plugin"
    policy: str = "wardline"


@dataclass(frozen=True)
class Rule:
    """One pattern, or several that match in order on one line. Letters match in either case unless ``exact``."""

    id: str
    decision: str
    reason: str
    stages: tuple[str, ...]
    multiline: bool = False
    exact: bool = False


def _red(id_: str, reason: str, *stages: str, **how: bool) -> Rule:
    return Rule(id_, DENY, reason, stages, **how)


def _yellow(id_: str, reason: str, *stages: str, **how: bool) -> Rule:
    return Rule(id_, ASK, reason, stages, **how)


def command_rules(names: Names = Names()) -> list[Rule]:
    """Command rules, the first match decides. Fixed values."""
    cluster = r"-([a-z]{0,12}r[a-z]{0,12}f[a-z]{0,12}|[a-z]{0,12}f[a-z]{0,12}r[a-z]{0,12})"
    split = r"(-[a-z]{0,12}r[a-z]{0,12}\s+(?:-{1,2}\S+\s+)*-[a-z]{0,12}f[a-z]{0,12}|-[a-z]{0,12}f[a-z]{0,12}\s+(?:-{1,2}\S+\s+)*-[a-z]{0,12}r[a-z]{0,12})"
    flags = r"\s+(?:-{1,2}\S+\s+)*"
    shell = r"(?:(?:bash|sh|zsh|dash|ash)\s+(?:-{1,2}\S+\s+)*-[a-zA-Z]*c\s+['\"]?|eval\s+['\"]?|xargs\s+(?:-\S+\s+(?:[^-\s]\S*\s+)?)*)"
    start = r"(?:^|[;&|]|" + shell + r")\s*(?:\w+=\S*\s+)*"
    root, quoted = r"/([\s;&|<>)'\"]|$|\*)", r"""["']/["']"""
    home, here, windows = r"(~|\$HOME)/?([\s;&|<>)]|$)", r"\.\.?([\s;&|<>)]|$)", r"/c/(Windows|Program|Users\s*$)"
    rm = lambda form, target: r"rm\s+" + form + flags + target
    delete = "Recursive force-delete — please confirm target is correct"
    plugin = names.plugin.replace("-", r"\-")
    return [
        _red("rm_recursive_root", "Destructive rm -rf targeting root directory", rm(cluster, root)),
        _red("rm_recursive_root_quoted", "Destructive rm -rf targeting root directory (quoted)", rm(cluster, quoted)),
        _red("rm_recursive_root_split", "Destructive rm -rf targeting root directory (split flags)", rm(split, root)),
        _red("rm_recursive_home", "Destructive rm -rf targeting home directory", rm(cluster, home)),
        _red("rm_recursive_cwd_parent", "Destructive rm -rf targeting current/parent directory", rm(cluster, here)),
        _red("rm_recursive_windows_system", "Destructive rm -rf targeting system-critical Windows path", rm(cluster, windows)),
        _red("rm_recursive_root_quoted_split", "Destructive rm -rf targeting root directory (quoted)", rm(split, quoted)),
        _red("rm_recursive_home_split", "Destructive rm -rf targeting home directory", rm(split, home)),
        _red("rm_recursive_cwd_parent_split", "Destructive rm -rf targeting current/parent directory", rm(split, here)),
        _red("rm_recursive_windows_system_split", "Destructive rm -rf targeting system-critical Windows path", rm(split, windows)),
        _red("rm_no_preserve_root", "rm with --no-preserve-root flag", r"rm\s+--no-preserve-root"),
        _red("pipe_to_shell", "Pipe-to-shell: downloading and executing remote code", r"(curl|wget|fetch)\s.*\|\s*(bash|sh|zsh|powershell|pwsh|cmd)"),
        _red("pipe_to_source", "Pipe-to-source: downloading and sourcing remote code", r"(curl|wget).*\|\s*source"),
        _red("decode_and_execute", "Decode-and-execute pipeline (obfuscated remote/embedded code)", r"(base64\s+(-d|--decode)|openssl\s+enc\s+[^|]*-d)[^|]*\|\s*(bash|sh|zsh|powershell|pwsh)"),
        _red("exec_process_substitution", "Executing remote code via process substitution", r"(bash|sh|zsh)\s+<\(\s*(curl|wget|fetch)"),
        _red("powershell_encoded", "Encoded PowerShell command (potential obfuscation)", r"powershell.*-[eE]nc(odedCommand)?"),
        _red("fork_bomb", "Fork bomb detected", r":\s*\(\s*\)\s*\{\s*:\s*\|\s*:\s*&\s*\}\s*;\s*:", exact=True),
        _red("cred_exfil_network", "Potential credential exfiltration via network", r"(curl|wget|nc|ncat)\s", r"(-d|--data)", r"\$\{?[A-Z_]*(TOKEN|KEY|SECRET|PASSWORD|CRED)"),
        _red("cred_file_upload", "Uploading a credential/secret file to the network", r"(curl|wget|nc|ncat)\s", r"(-d\s*@|--data(-binary)?\s*@|-T\s|--upload-file\s|--post-file=)", r"(\.pem|\.key|id_rsa|id_ed25519|id_ecdsa|id_dsa|\.ssh/|\.aws/|\.env\b|credentials|secrets|token)"),
        _red("cred_file_pipe_network", "Piping a local secret file to a network tool", r"(\.ssh/|\.pem\b|\.key\b|id_rsa|id_ed25519|\.aws/|\.env\b|credentials|secrets)", r"\|\s*(nc|ncat|curl|wget)\s"),
        _red("disk_format_mkfs", "Disk format operation detected", start + r"(sudo\s+)?mkfs(\.|\s)", multiline=True),
        _red("disk_format_wipe", "Disk format/wipe operation detected (Windows-native or wipefs form)", start + r"(sudo\s+)?(format\s+[a-z]:|wipefs\s)", multiline=True),
        _red("raw_disk_write", "Raw disk write operation detected", start + r"(sudo\s+)?dd\s+if=[^\n|]*of=/dev/(sd|hd|nvme|mmcblk|vd|xvd|disk|loop)", multiline=True),
        _red("write_redirect_windows_system", "Write redirect to Windows system directory", r">\s*/c/Windows/"),
        _yellow("rm_recursive", delete, r"rm\s+" + cluster + r"\s"),
        _yellow("rm_recursive_split", delete, r"rm\s+" + split + r"\s"),
        _yellow("net_upload", "Network upload detected — sending local data to a remote server", r"(curl|wget)\s+.*(-X\s*POST|-X\s*PUT|--upload-file|--data-binary\s+@)"),
        _yellow("git_destructive", "Destructive git operation — may lose commit history or untracked files", r"git\s+(push\s+--force|reset\s+--hard|clean\s+-fd)"),
        _yellow("pkg_install", "Package installation — confirm this is an approved dependency", r"(pip|npm|yarn|pnpm)\s+install\s"),
        _yellow("win_del", "Recursive/forced delete (Windows del) — please confirm target is correct", start + r"del\s+/[sq]", multiline=True),
        _yellow("win_remove_item", "Recursive forced Remove-Item — please confirm target is correct", r"remove-item\b(?=[^\n]*-recurse)(?=[^\n]*-force)"),
        _yellow("shred", "Secure-delete tool — destroys file contents irrecoverably", start + r"(sudo\s+)?shred\s", multiline=True),
        _yellow("chmod_777", "Setting world-writable permissions (777)", start + r"(sudo\s+)?chmod\s+(-[a-zA-Z]+\s+)*[0-7]?777\b", multiline=True),
        _yellow("registry", "Windows registry modification", r"(reg\s+(add|delete)|regedit)"),
        _yellow("service_control", "System service/process manipulation", r"(net\s+stop|taskkill|sc\s+delete)"),
        _yellow("guard_disable", f"Disabling {names.policy} runtime guard — confirm intentional", start + rf"({plugin}|(python(?:3(\.\d+)?|\.exe)?|py)\s+-m\s+{names.package}\.plugin_cli)\s+(?:\S+\s+)*['\"]?disable['\"]?\b", multiline=True),
    ]


def path_rules(names: Names = Names()) -> list[Rule]:
    """Rules for normalized paths, the first match decides. Fixed values."""
    policy = names.policy.replace("-", r"\-")
    config = f"Modifying {names.policy} policy config — confirm intentional (config is not a trust boundary)"
    return [
        _red("self_modify_guard_module", f"Cannot modify active {names.policy} guard module (self-modification attack vector)", rf"(?s)^(?=.*\.py$)(?:.*/)?{names.package}/", exact=True),
        _red("self_modify_hook_script", "Cannot modify active security hook scripts", r"hooks/scripts/(bash-guard|write-guard)\.sh$", exact=True),
        _red("claude_settings_json", "Cannot modify Claude settings.json (contains hook/permission configs)", r"\.claude/settings\.json$", exact=True),
        _red("claude_settings_local_json", "Cannot modify Claude settings.local.json (contains hook/permission configs)", r"\.claude/settings\.local\.json$", exact=True),
        _red("ssh_private_key", "Cannot overwrite SSH private key", r"(^|/)\.ssh/id_[a-z0-9_]+$", exact=True),
        _red("openclaw_env", "Cannot modify .openclaw/.env (agent API credentials)", r"\.openclaw/\.env$", exact=True),
        _yellow("policy_toml", config, rf"(^|/){policy}\.toml$"),
        _yellow("policy_home_toml", config, rf"(^|/)\.{policy}/config\.toml$"),
        _yellow("agent_template", "Modifying agent template — confirm this change is intentional", r"agents/.*\.md$"),
        _yellow("rules_md", "Modifying orchestration rules — confirm this change is intentional", r"\.claude/rules/.*\.md$"),
        _yellow("hook_script", "Modifying hook script — confirm this change is intentional", r"hooks/scripts/.*\.(sh|js|py)$"),
        _yellow("memory_md", "Modifying memory file — should this go through Vault instead?", r"/memory/.*\.md$"),
        _yellow("env_file", "Modifying environment file — may contain secrets", r"\.(env|env\.local|env\.production)$"),
        _yellow("shell_startup", "Modifying shell startup file — common persistence vector; confirm intentional", r"(^|/)\.(bashrc|bash_profile|bash_login|bash_logout|zshrc|zprofile|profile)$"),
        _yellow("credential_file", "Modifying file that may contain credentials", r"(credentials|secrets|tokens|passwords)\.(json|yaml|yml|toml|ini|txt)$"),
        _yellow("key_cert", "Modifying a .pem/.key file — confirm this isn't a private key you meant to keep", r"\.(pem|key)$"),
        _yellow("claude_md", "Modifying CLAUDE.md instruction file — affects Claude behavior", r"claude\.md$"),
        _yellow("sync_md", "Modifying sync protocol file — affects cross-instance communication", r"(^|/)(claude_)?sync/.*\.md$"),
    ]


# --- error path: fixed values -------------------------------------------------------------------

DECISION_OF_REASON = {
    "allowed-selfrepair": ALLOW,
    "allowed-unevaluated": ALLOW,
    "would-have-blocked": ALLOW,
    "asked-unevaluated": ASK,
    "denied-catastrophic-unevaluated": DENY,
    "denied-unevaluated": DENY,
    "would-have-asked": DENY,
}
TARGET_CHARS = 4096
COUNTER_TTL_S = 24 * 60 * 60
_VALUE = r"""(?:"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|[^;"']+)"""
#: The same set of matches with loops that a recursive engine runs without recursion.
_FLAT = r"""(?:"[^"\\]*+(?:\\.[^"\\]*+)*+"|'[^'\\]*+(?:\\.[^'\\]*+)*+'|[^;"']+)"""


def secret_pattern(value: str = _VALUE) -> str:
    return r"(?:\b[A-Z_]*(?:TOKEN|KEY|SECRET|PASSWORD|CRED)[A-Z_]*\s*[:=]\s*" + value + r"|[A-Za-z_-]*(?:Authorization|Api-Key|Token|Secret|Key)\s*[:=]\s*(?:Bearer\s+)?" + value + ")"


def linear_secret_pattern(value: str = _VALUE, word: str = r"\w") -> str:
    """A pattern with the same matches as secret_pattern() that takes a run of letters once.

    What stands before a keyword can take all letters of its run, so a match that begins inside a run begins at its first
    letter too; and what follows a run, the sign, is looked at before keywords are sought in it.
    """
    first = rf"(?<![{word}])(?=[A-Z_]*+\s*+[:=])[A-Z_]*(?:TOKEN|KEY|SECRET|PASSWORD|CRED)[A-Z_]*+\s*+[:=]\s*{value}"
    second = rf"(?<![A-Za-z_-])(?=[A-Za-z_-]*+\s*+[:=])[A-Za-z_-]*(?:Authorization|Api-Key|Token|Secret|Key)\s*+[:=]\s*(?:Bearer\s+)?{value}"
    return f"(?:{first}|{second})"


#: For the JVM's engine, in texts of characters on which it agrees with Python's.
FLAT_SECRET = linear_secret_pattern(_FLAT, r"\p{L}\p{N}_")
SAME_CHARS = r"\t\n\x0b\x0c\r\x20-\x7e\u00a1-\u00ac\u00ae-\u017e\u0180-\u024f\u2013\u2014\u2018\u2019\u201c\u201d"
