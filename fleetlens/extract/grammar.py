"""Line grammar: a list of rules that is compiled to one column expression."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetlens.extract.base import render
from fleetlens.functions.text import blank_to_null

FIELDS = ("user", "ip", "uid", "target_user", "group", "command", "method", "failures", "home", "shell",
          "action", "target", "job")
IDENTIFIERS = ("user", "target_user", "group")


@dataclass(frozen=True)
class GrammarRule:
    """A pattern with positional groups; ``groups`` maps group numbers to field names.

    ``guard`` is a literal every match contains: a plain substring test that spares most lines the regex.
    ``families`` limits a rule to distributions of these families.  A later rule of the same name and
    family replaces an earlier one.
    """

    name: str
    guard: str
    pattern: str
    groups: tuple[str, ...]
    category: str
    subcategory: str
    severity: str
    process: str
    family: str | None = None


# Distributions by family.
FAMILIES = {
    "debian": ("debian", "ubuntu", "linuxmint", "kali"),
    "rhel": ("rhel", "centos", "fedora", "rocky", "almalinux", "rhel-family"),
}

# What the log lines look like.  '-' marks a group that is matched but not kept.
_PID = r"(?:\[\d+\])?"
_SUDO = r"TTY=\S+ ; PWD=\S+ ; USER=(\S+) ; COMMAND=(.*)$"
RULES = (
    GrammarRule("sshd_failed_password", "Failed password for ",
                rf"sshd{_PID}: Failed password for (?:invalid user )?(\S+) from (\S+) port \d+",
                ("user", "ip"), "login_activity", "failed_login", "low", "sshd"),
    GrammarRule("sshd_invalid_user", "Invalid user ",
                rf"sshd{_PID}: Invalid user (\S+) from (\S+)(?: port \d+)?",
                ("user", "ip"), "login_activity", "invalid_user", "low", "sshd"),
    GrammarRule("sshd_accepted", "Accepted ",
                rf"sshd{_PID}: Accepted (password|publickey|keyboard-interactive/pam) for (\S+) from (\S+) port \d+",
                ("method", "user", "ip"), "login_activity", "successful_login", "info", "sshd"),
    GrammarRule("sshd_session_opened", "pam_unix(sshd:session): session opened",
                rf"sshd{_PID}: pam_unix\(sshd:session\): session opened for user ([^\s(]+)",
                ("user",), "login_activity", "session_opened", "info", "sshd"),
    GrammarRule("sshd_session_closed", "pam_unix(sshd:session): session closed",
                rf"sshd{_PID}: pam_unix\(sshd:session\): session closed for user (\S+)",
                ("user",), "login_activity", "session_closed", "info", "sshd"),
    GrammarRule("sshd_disconnect", "Disconnected from",
                rf"sshd{_PID}: Disconnected from(?: authenticating| invalid)? user (\S+) (\S+) port \d+",
                ("user", "ip"), "login_activity", "disconnect", "info", "sshd"),
    GrammarRule("sshd_received_disconnect", "Received disconnect from ",
                rf"sshd{_PID}: Received disconnect from (\S+): \d+: .*",
                ("ip",), "login_activity", "disconnect", "info", "sshd"),
    GrammarRule("sudo_command", "COMMAND=", rf"sudo{_PID}:\s+(\S+) : {_SUDO}",
                ("user", "target_user", "command"), "privilege_escalation", "sudo_command", "info", "sudo"),
    GrammarRule("sudo_auth_failure", "incorrect password attempt",
                rf"sudo{_PID}:\s+(\S+) : (\d+) incorrect password attempts? ; {_SUDO}",
                ("user", "failures", "target_user", "command"), "privilege_escalation", "sudo_failure", "medium",
                "sudo"),
    GrammarRule("sudo_not_in_sudoers", "NOT in sudoers",
                rf"sudo{_PID}:\s+(\S+) : user NOT in sudoers ; {_SUDO}",
                ("user", "target_user", "command"), "privilege_escalation", "sudo_denied", "high", "sudo"),
    GrammarRule("su_session", "su", rf"su{_PID}: (?:\(to (\S+)\) )?(\S+)(?: on| to)",
                ("target_user", "user"), "privilege_escalation", "su_attempt", "low", "su"),
    GrammarRule("pam_auth_failure", "authentication failure;",
                r"pam_unix\((?:sshd|login|su|sudo):auth\): authentication failure;.*(?:ruser=|logname=)\S*.*"
                r"rhost=(\S*)\s*(?:user=(\S+))?",
                ("ip", "user"), "login_activity", "auth_failure", "low", "pam"),
    GrammarRule("useradd_new_user", "new user: name=",
                r"useradd\[\d+\]: new user: name=([^,]+), UID=(\d+), GID=\d+, home=([^,]+), shell=(\S+)",
                ("user", "uid", "home", "shell"), "user_accounts", "account_created", "medium", "useradd"),
    GrammarRule("useradd_new_group", ": name=",
                r"(?:groupadd|useradd)\[\d+\]: (?:new group|group added to \S+): name=([^,\s]+)",
                ("group",), "user_accounts", "group_created", "info", "groupadd"),
    GrammarRule("usermod_group_add", "usermod[", r"usermod\[\d+\]: add .([^']+). to group .([^']+).",
                ("user", "group"), "privilege_escalation", "group_membership_added", "medium", "usermod"),
    GrammarRule("userdel_delete", "userdel[", r"userdel\[\d+\]: delete user .([^']+).",
                ("user",), "user_accounts", "account_deleted", "medium", "userdel"),
    GrammarRule("passwd_changed", "passwd:chauthtok",
                r"passwd\[\d+\]: pam_unix\(passwd:chauthtok\): password changed for (\S+)",
                ("user",), "user_accounts", "password_changed", "low", "passwd"),
    GrammarRule("chage_changed", "chage[", r"chage\[\d+\]: changed password expiry for (\S+)",
                ("user",), "user_accounts", "password_policy_changed", "low", "chage"),
    GrammarRule("cron_session", "pam_unix(cron:session): session opened",
                r"CRON\[\d+\]: pam_unix\(cron:session\): session opened for user ([^\s(]+)",
                ("user",), "persistence", "cron_run", "info", "cron"),
    GrammarRule("cron_session_closed", "pam_unix(cron:session): session closed",
                r"CRON\[\d+\]: pam_unix\(cron:session\): session closed for user ([^\s(]+)",
                ("user",), "persistence", "cron_session_closed", "info", "cron"),
    GrammarRule("cron_command", "CMD (", r"CRON\[\d+\]: \(([^\s)]+)\) CMD \((.*)\)",
                ("user", "command"), "persistence", "cron_command", "info", "cron"),
    GrammarRule("crontab_modified", "crontab[",
                r"crontab\[\d+\]: \(([^\s)]+)\) (REPLACE|DELETE) \(([^\s)]+)\)",
                ("user", "action", "target_user"), "persistence", "crontab_modified", "medium", "crontab"),
    GrammarRule("crontab_edit", "crontab[",
                r"crontab\[\d+\]: \(([^\s)]+)\) (BEGIN EDIT|END EDIT) \(([^\s)]+)\)",
                ("user", "action", "target_user"), "persistence", "crontab_edit", "low", "crontab"),
    GrammarRule("cron_reload", "RELOAD (", r"cron\[\d+\]: \(([^\s)]+)\) RELOAD \(([^\s)]+)\)",
                ("user", "target"), "persistence", "cron_reload", "info", "cron"),
    GrammarRule("anacron_job", "anacron[", r"anacron\[\d+\]: Job .([^']+). (started|terminated)",
                ("job", "action"), "persistence", "anacron_job", "info", "anacron"),
    GrammarRule("login_failure_tty", "FAILED LOGIN",
                r"login\[\d+\]: FAILED LOGIN.*FOR .?(\S+?).?[,;] .*$",
                ("user",), "login_activity", "failed_login", "low", "login"),
    GrammarRule("systemd_logind_new_session", "New session ",
                r"systemd-logind\[\d+\]: New session \S+ of user (\S+)",
                ("user",), "login_activity", "session_opened", "info", "systemd-logind"),
    GrammarRule("ufw_block", "[UFW BLOCK]", r"kernel:.*\[UFW BLOCK\].*SRC=(\S+) DST=\S+",
                ("ip",), "network_config", "firewall_block", "info", "kernel", "debian"),
    GrammarRule("sshd_auth_rhel_unix_fail", "unix_chkpwd[",
                r"unix_chkpwd\[\d+\]: password check failed for user \(([^)]+)\)",
                ("user",), "login_activity", "failed_login", "low", "unix_chkpwd", "rhel"),
)

# The sentence of every subcategory.
SENTENCES = {
    "failed_login": "Wrong password for {user}[, coming from {ip}]",
    "invalid_user": "Login tried as unknown account {user}[, coming from {ip}]",
    "successful_login": "{user} logged in by {method}[, coming from {ip}]",
    "session_opened": "A session of {user} began",
    "session_closed": "A session of {user} ended",
    "disconnect": "Connection of {user}[ at {ip}] ended",
    "sudo_command": "{user}, acting as {target_user}, ran: {command}",
    "sudo_failure": "sudo refused {user} after {failures} wrong passwords",
    "sudo_denied": "sudo refused {user}, who has no entry",
    "su_attempt": "{user} switched to {target_user} by su",
    "auth_failure": "PAM refused {user}[, coming from {ip}]",
    "account_created": "Account {user} made (uid={uid}, home={home}, shell={shell})",
    "group_created": "Group {group} made",
    "group_membership_added": "{user} joined group {group}",
    "account_deleted": "Account {user} removed",
    "password_changed": "New password for {user}",
    "password_policy_changed": "New password ageing for {user}",
    "cron_run": "A cron session of {user} began",
    "firewall_block": "The firewall stopped traffic of {ip}",
}
CRON_SENTENCES = {
    "cron_command": "cron, as {user}, ran: {command}",
    "cron_session_closed": "A cron session of {user} ended",
    "crontab_modified": "{user} {verb} the crontab of {target_user} ({action})",
    "crontab_edit": "{user} edits the crontab of {target_user} ({action})",
    "cron_reload": "cron read {target} again",
    "anacron_job": "anacron job {job} {action}",
}


def _overlay(rules: Sequence[GrammarRule]) -> list[GrammarRule]:
    """Later rules of a name and family replace earlier ones; their place stays."""
    table: dict[tuple[str, str | None], GrammarRule] = {}
    for rule in rules:
        table[(rule.name, rule.family)] = rule
    return list(table.values())


def _literal(text: str) -> str:
    """SQL literal without escapes: raw, in the kind of quote the text does not use."""
    quote = '"' if "'" in text else "'"
    if quote in text:
        raise ValueError(f"both kinds of quote in {text!r}")
    return f"r{quote}{text}{quote}"


def _applies(rule: GrammarRule, rules: Sequence[GrammarRule], distro: str) -> str:
    """Family rules count on their distributions, and there they hide a common rule of the same name."""
    member = lambda family: f"lower(coalesce({distro}, '')) IN ({', '.join(map(repr, FAMILIES[family]))})"
    if rule.family:
        return f" AND {member(rule.family)}"
    return "".join(f" AND NOT {member(r.family)}" for r in rules if r.family and r.name == rule.name)


_UNQUOTE = "regexp_replace({}, '(?s)^([\\'\"])(.*)\\\\1$', '$2')"


def _entry_sql(rule: GrammarRule, rules: Sequence[GrammarRule], text: str, distro: str) -> str:
    pattern, captured = _literal(rule.pattern), {}
    for i, name in enumerate(rule.groups, 1):
        value = f"regexp_extract({text}, {pattern}, {i})"
        # An empty remote host of a PAM line is a value, not a missing one.
        keep_empty = (rule.name, name) == ("pam_auth_failure", "ip")
        captured[name] = value if keep_empty else f"nullif({value}, '')"
        if name in IDENTIFIERS:
            captured[name] = _UNQUOTE.format(captured[name])
    facts = {"rule": rule.name, "category": rule.category, "subcategory": rule.subcategory,
             "severity": rule.severity, "process": rule.process}
    fields = [f"'{n}', {_literal(v)}" for n, v in facts.items()]
    fields += [f"'{n}', {captured.get(n, 'CAST(NULL AS STRING)')}" for n in FIELDS]
    return (f"CASE WHEN contains({text}, {_literal(rule.guard)}){_applies(rule, rules, distro)} "
            f"AND rlike({text}, {pattern}) THEN named_struct({', '.join(fields)}) END")


def line_matches(text: str, distro: str, rules: Sequence[GrammarRule] = RULES) -> Column:
    """Array with one struct per rule found: rule facts and captured fields.

    ``text`` and ``distro`` are column names.  The expression is written as SQL, as one text is much
    quicker to hand to Spark than a thousand column calls.
    """
    rules = _overlay(rules)
    return F.expr("array_compact(array(" + ", ".join(_entry_sql(r, rules, text, distro) for r in rules) + "))")


def sentence(match: Column, cron: bool = False) -> Column:
    """Description of a match.  Kinds without a sentence show their captured fields as JSON."""
    captured = {name: match[name] for name in FIELDS}
    fields = dict(captured)
    fields["user"] = F.coalesce(captured["user"], F.lit("unknown user"))
    fields["ip"] = blank_to_null(captured["ip"])
    sub = match["subcategory"]
    fields["method"] = F.coalesce(captured["method"], F.lit("unknown method"))
    fields["failures"] = F.coalesce(captured["failures"], F.lit("?"))
    fields["target_user"] = F.coalesce(
        captured["target_user"],
        F.when(sub == "sudo_command", "root").when(sub == "su_attempt", "another user")
        .otherwise(fields["user"]))
    if cron:
        fields["command"] = F.trim(captured["command"])
        fields["verb"] = F.when(captured["action"] == "REPLACE", "replaced").otherwise("deleted")
        fields["target"] = F.coalesce(captured["target"], F.lit("a crontab"))
    table = {**SENTENCES, **CRON_SENTENCES} if cron else SENTENCES
    fallback = F.concat(match["rule"], F.lit(": "), F.to_json(F.struct(
        *[captured[n].alias(n) for n in FIELDS])))
    return F.coalesce(*[F.when(sub == name, render(t, fields)) for name, t in table.items()], fallback)
