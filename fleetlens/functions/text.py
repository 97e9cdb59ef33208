"""String helpers shared by extraction, rules and reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetlens.schema import RAW_LINE_MAX_BYTES


def bind(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), lambda v: body(v)), 1)


def blank_to_null(value: Column) -> Column:
    return F.when(value != "", value)


def first_filled(*values: Column | str) -> Column:
    """The first value that is neither null nor empty; plain strings are literals."""
    columns = [F.lit(v) if isinstance(v, str) else blank_to_null(v) for v in values]
    return F.coalesce(*columns)


def capture(text: Column, pattern: str, group: int = 1) -> Column:
    """Regex group, null (not '') where the pattern does not match or the group took no part."""
    return blank_to_null(F.regexp_extract(text, pattern, group))


def truncate_bytes(text: Column, limit: int = RAW_LINE_MAX_BYTES) -> Column:
    """At most ``limit`` UTF-8 bytes; a character cut in half at the end is dropped."""
    head = F.substring(F.encode(text, "UTF-8"), 1, limit)
    # A half character can only be in the last three bytes, and what is left of them decides.
    candidates = [F.substring(head, 1, limit - cut) for cut in range(4)]
    valid = [F.try_validate_utf8(c.cast("string")) for c in candidates]
    return F.when(F.octet_length(text) <= limit, text).otherwise(F.coalesce(*valid, head.cast("string")))


def clean_utf8(text: Column) -> Column:
    """Replace undecodable bytes by the replacement character."""
    return F.make_valid_utf8(text)


def unquote_identifier(value: Column) -> Column:
    """Take off one matching outer pair of quotes; apostrophes inside a name stay."""
    return F.regexp_replace(value, r"(?s)^(['\"])(.*)\1$", "$2")


def strip_quotes(value: Column) -> Column:
    """Take off every quote character at both ends."""
    return F.btrim(value, F.lit("'\""))


def owner_from_path(path: Column) -> Column:
    """Account whose home directory holds the file; null outside /home and /root."""
    clean = F.btrim(F.translate(path, "\\", "/"), F.lit("/"))
    return (F.when(clean.rlike("^home/"), F.split(clean, "/").getItem(1))
            .when(clean.rlike("^root(/|$)"), F.lit("root")))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


# Names that decide how a package change is graded.
ATTACK_TOOL_TOKENS = ("netcat", "nc", "ncat", "nmap", "socat", "tcpdump", "john", "hydra", "masscan")
SECURITY_TOOL_TOKENS = ("auditd", "audit", "ufw", "fail2ban", "apparmor", "selinux", "clamav", "clamd",
                        "rkhunter")
REMOVAL_ACTIONS = ("remove", "purge", "erase", "package_remove")
RPM_ARCHES = ("x86_64", "noarch", "i686", "aarch64", "armv7hl", "ppc64le", "s390x", "src")


def package_tokens(package: Column) -> Column:
    """Words of a package name before any ``:arch``, lower case."""
    return F.split(F.lower(F.substring_index(package, ":", 1)), r"[-_.+]")


def package_class(package: Column) -> Column:
    tokens = package_tokens(package)
    return (F.when(F.arrays_overlap(tokens, F.array(*map(F.lit, SECURITY_TOOL_TOKENS))), "security")
            .when(F.arrays_overlap(tokens, F.array(*map(F.lit, ATTACK_TOOL_TOKENS))), "attack")
            .otherwise("plain"))


def package_severity(package: Column, action: Column) -> Column:
    """high: a security control goes away; medium: an attacker's tool is touched; else info."""
    tokens = package_tokens(package)
    security = F.arrays_overlap(tokens, F.array(*map(F.lit, SECURITY_TOOL_TOKENS)))
    attack = F.arrays_overlap(tokens, F.array(*map(F.lit, ATTACK_TOOL_TOKENS)))
    return (F.when(action.isin(*REMOVAL_ACTIONS) & security, "high")
            .when(attack, "medium").otherwise("info"))


def package_note(severity: Column) -> Column:
    return (F.when(severity == "high", "a security control was taken off this host")
            .when(severity == "medium", "package often used for scanning, tunnelling or password attacks"))


def rpm_name(nevra: Column) -> Column:
    """Package name of an rpm label: the arch goes, then everything from the version on."""
    no_arch = F.regexp_replace(nevra, r"\.(" + "|".join(RPM_ARCHES) + r")$", "")
    return F.regexp_replace(no_arch, r"-(?=\d|:).*$", "")


def severity_rank(severity: Column) -> Column:
    """0 for high up to 3 for info, so that ascending order is most severe first."""
    return (F.when(severity == "high", 0).when(severity == "medium", 1)
            .when(severity == "low", 2).otherwise(3))


def severity_of_rank(rank: Column) -> Column:
    return (F.when(rank == 0, "high").when(rank == 1, "medium")
            .when(rank == 2, "low").otherwise("info"))


def sorted_text(values: Column, separator: str = ", ") -> Column:
    """Distinct values of an array column in order, as one text.  For closed vocabularies."""
    return F.array_join(F.array_sort(F.array_distinct(values)), separator)


def terminal(raw_line: Column, description: Column) -> Column:
    """Terminal named by a login or logout record, 'unknown' where there is none."""
    raw = F.coalesce(raw_line, F.lit(""))
    return F.coalesce(
        capture(raw, r"\bline=(\S+)"),
        capture(raw, r"\b(?:on|TTY=)(\S+)"),
        capture(F.coalesce(description, F.lit("")), r"\b(pts/\d+|tty\d+)"),
        F.lit("unknown"),
    )


def privileged_group(description: Column) -> Column:
    """Group named after the words 'privileged group'."""
    return F.rtrim(capture(description, r"privileged group\s+(\S+)"), F.lit(".,)"))


# The prefixes that extraction writes in front of a command, and the suffix behind it.
COMMAND_PREFIX = (
    r"^(?:Process executed"
    r"|Privileged command executed via sudo"
    r"|Process running at collection time \(user [^)]*\)"
    r"|User \S+ executed):\s*"
)
COMMAND_SUFFIX = r"\s{2,}\(exe=[^)]*\)\s*$"

# The bare command behind an execution event, the raw line where the description has none.  Kept as SQL
# text because findings quote it in their evidence predicate.
COMMAND_SQL = (
    "coalesce(nullif(trim(regexp_replace(regexp_replace(trim(coalesce(description, '')), "
    f"r'{COMMAND_PREFIX}', ''), r'{COMMAND_SUFFIX}', '')), ''), trim(coalesce(raw_line, '')))"
)


def command_of() -> Column:
    return F.expr(COMMAND_SQL)


IPV4 = r"(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
# At most eight groups, one '::' at most; embedded IPv4 tails are allowed.
IPV6 = (r"(?=[0-9a-fA-F:.]*:[0-9a-fA-F:.]*:)(?!.*::.*::)(?!.*:::)(?!:[^:])(?:[0-9a-fA-F]{0,4}:){1,7}"
        r"(?:[0-9a-fA-F]{1,4}|" + IPV4 + r")?(?<!(?<!:):)(?:%\S+)?")


def is_ip(value: Column) -> Column:
    full_v6 = value.rlike("^" + IPV6 + "$") & (
        value.contains("::") | value.rlike(r"^(?:[^:]+:){7}[^:]+$") | value.rlike(r"^(?:[^:]+:){6}[\d.]+$"))
    return F.coalesce(value.rlike("^" + IPV4 + "$") | full_v6, F.lit(False))


def source_ip_of(value: Column) -> Column:
    return F.when(is_ip(value), value)


def source_host_of(value: Column) -> Column:
    return F.when(~is_ip(value), blank_to_null(value))


def key_fingerprint(blob_base64: Column) -> Column:
    """``SHA256:`` form of an SSH public key, null where the blob is not base64; no text is that of no bytes."""
    strict = blob_base64.rlike("^(?:[A-Za-z0-9+/]+={0,2})?$") & (F.length(blob_base64) % 4 == 0)
    blob = F.try_to_binary(F.when(strict, blob_base64), F.lit("base64"))
    digest = F.base64(F.unhex(F.sha2(blob, 256)))
    return F.concat(F.lit("SHA256:"), F.rtrim(digest, F.lit("=")))


GROUP_MARK = "\x01"


def capture_groups(text: Column, pattern: str, count: int) -> Column:
    """All groups of a pattern that starts at ``^``, as an array with group i at place i; null for no match.

    One evaluation of the pattern per row, where a ``regexp_extract`` per group costs one each.  Groups that
    took no part are ''.
    """
    marked = GROUP_MARK + GROUP_MARK.join(f"${i}" for i in range(1, count + 1))
    # Whatever follows the match is swallowed; a mark inside the text itself is made harmless first.
    whole = pattern.removesuffix("$") + r"(?s:.*)$"
    replaced = F.regexp_replace(F.translate(text, GROUP_MARK, "\ufffd"), whole, marked)
    return bind(replaced, lambda r: F.when(r.startswith(GROUP_MARK), F.split(r, GROUP_MARK)))


def any_match(text: Column, patterns: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [text.rlike(p) for p in patterns])


def reasons(text: Column, table: tuple[tuple[str, str], ...]) -> Column:
    """Reasons of every pattern that is found in the text, in table order."""
    return F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(why)) for p, why in table]))


def sql_quote(value: Column) -> Column:
    """A Spark SQL string literal of the value, for predicates kept as text."""
    escaped = F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'"))
    return F.concat(F.lit("'"), escaped, F.lit("'"))
