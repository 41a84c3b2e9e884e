"""Normalised identities and labels that don't give secrets away."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def git_identity(value: str | Column) -> Column:
    """host/owner/repo of a remote: scp or URL form, without credentials, query, fragment and .git; null if empty."""
    v = F.trim(F.col(value) if isinstance(value, str) else value)
    v = F.regexp_replace(F.regexp_replace(v, "#.*$", ""), r"\?.*$", "")
    scp = F.regexp_replace(v, r"^git@([^:]*):", "$1/")
    url = F.regexp_replace(F.regexp_replace(v, r"^.*?://", ""), r"^.*@", "")
    out = F.when(v.startswith("git@"), F.when(v.contains(":"), scp)).when(v.contains("://"), url).otherwise(v)
    out = F.regexp_replace(F.regexp_replace(out, "^/+|/+$", ""), r"(\.git)+$", "")
    out = F.translate(F.replace(out, F.lit("\\"), F.lit("/")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(out != "", out)


def normal_path(value: str | Column) -> Column:
    """A path without empty and `.` parts, `..` taken with the part before it; `..` at the front of a relative path stays."""
    v = F.col(value) if isinstance(value, str) else value
    absolute = v.startswith("/")
    parts = F.filter(F.split(v, "/"), lambda p: (p != "") & (p != "."))
    kept = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda done, p: F.when(p != "..", F.concat(done, F.array(p)))
        .when(F.size(done) == 0, F.when(absolute, done).otherwise(F.concat(done, F.array(p))))
        .when(F.element_at(done, -1) == "..", F.concat(done, F.array(p)))
        .otherwise(F.slice(done, 1, F.size(done) - 1)),
    )
    return F.concat(F.when(absolute, F.lit("/")).otherwise(F.lit("")), F.array_join(kept, "/"))


def account_label(value: str | Column) -> Column:
    v = F.col(value) if isinstance(value, str) else value
    return F.when(F.length(v) > 8, F.concat(F.substring(v, 1, 8), F.lit("…"))).otherwise(v)


def short_hash(value: str | Column) -> Column:
    return F.substring(F.sha2(value, 256), 1, 8)


def content_hash(*columns: str) -> Column:
    """Of a fact without its reading time, so that reading it again gives the same."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def field_after(value: str | Column, marker: str) -> Column:
    """What follows the last marker, up to white space or a brace, without quotes; null if nothing does."""
    v = F.col(value) if isinstance(value, str) else value
    found = F.regexp_extract(v, f"(?s)^.*\\Q{marker}\\E[\"']?([^\\s}}\"']+)", 1)
    return F.when(found != "", found)


#: What marks a title as private.
PRIVATE_WORDS = (
    "/private/", "/volumes/", "/users/", "/home/", "api key", "apikey", "password", "passwd", "secret=", "token=",
    "bearer ", "\\users\\", "密钥", "密码",
)
PRIVATE_PATTERNS = (
    r"(sk-|ghp_|github_pat_|xoxb-|xoxp-)[a-z0-9_.-]{20,}",
    r"(^|[^0-9.])(10\.\d{1,3}|127\.\d{1,3}|192\.168|172\.(1[6-9]|2\d|3[01]))(\.\d{1,3}){2}($|[^0-9.])",
    r"(^|[^0-9a-f:])(fe80:|f[cd][0-9a-f]{2}:)",
    r"[a-z0-9_.-]+@[a-z0-9_-]+(\.[a-z0-9_-]+)+",
    r"(?=[a-z0-9_.-]*[0-9])(?=[a-z0-9_.-]*[a-z])[a-z0-9_.-]{32,}",
)


def private(value: str | Column) -> Column:
    """Whether a title may hold a secret, a private path or address, or a long identifier."""
    v = F.lower(F.col(value) if isinstance(value, str) else value)
    found = F.lit(False)
    for word in PRIVATE_WORDS:
        found = found | v.contains(word)
    for pattern in PRIVATE_PATTERNS:
        found = found | v.rlike(pattern)
    return found | (v.contains(" --") & (F.length(v) > 72))


def thread_label(depth: Column, path: Column, nickname: Column, title: Column, thread_id: Column) -> Column:
    """A thread's label: of a subagent its path's last part, its nickname or its id; else its title if that is harmless."""
    short = F.substring(thread_id, 1, 13)
    last = F.replace(F.regexp_extract(path, r"([^/]+)/*$", 1), F.lit("_"), F.lit(" "))
    title = F.trim(title)
    harmless = (title != "") & ~title.contains("\n") & ~title.contains("<") & (F.length(title) <= 96) & ~private(title)
    return F.when(depth > 0, F.coalesce(F.when(last != "", last), nickname, F.concat(F.lit("Subagent "), short))).otherwise(F.when(harmless, title).otherwise(F.concat(F.lit("Session "), short)))
