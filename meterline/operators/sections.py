"""Sections of a dashboard by grouping sets: totals, series and breakdowns of a period from one pass over its cube."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tokens import MEASURES

#: Sections and what their rows are grouped by, besides the window; an empty one is the total over all qualities.
SECTIONS = {
    "total": ("quality",),
    "points": ("local_day", "quality"),
    "project_series": ("project", "local_day", "quality"),
    "by_project": ("project", "quality"),
    "by_model": ("model", "quality"),
    "by_account": ("account", "quality"),
}
KEYS = ("quality", "local_day", "project", "model", "account")


def sections(cube: DataFrame, windows: dict[str, tuple[str, str]], wanted: dict[str, tuple[str, ...]] = SECTIONS) -> DataFrame:
    """(section, part, quality, local_day, project, model, account, event_count, measures): what a section isn't grouped by is null.

    windows has the first and last day of each part of the result, such as the period and the one it is compared with; they
    may overlap. A day cube with a column project is read once: it is added up without threads, then by all sections at once.
    """
    day = F.col("local_day")
    inside = F.array_compact(F.array(*[F.when(day.between(first, last), F.lit(name)) for name, (first, last) in windows.items()]))
    sums = [F.sum(c).cast("bigint").alias(c) for c in ("event_count", *MEASURES)]
    spread = cube.select("*", F.explode(inside).alias("part")).groupBy("part", *KEYS).agg(*sums)
    sets = [[F.col(c) for c in ("part", *by)] for by in wanted.values()]
    grouped = spread.groupingSets(sets, "part", *[F.col(c) for c in KEYS]).agg(*sums, F.grouping_id().alias("_id"))
    # The grouping id has a bit for each key that a set lacks, the first key's highest.
    bits = {name: sum(1 << (len(KEYS) - 1 - i) for i, k in enumerate(KEYS) if k not in by) for name, by in wanted.items()}
    name = F.element_at(F.create_map(*[F.lit(x) for n, b in bits.items() for x in (b, n)]), F.col("_id").cast("int"))
    return grouped.select(name.alias("section"), "part", *KEYS, "event_count", *MEASURES)


#: What may be wrong with a ledger, as (id, state, severity, the count that must be above 0, its events, its tokens); fixed values.
RULES = (
    ("quarantined-events", "quarantined", "critical", "quarantined", "quarantined", "quarantined_tokens"),
    ("unknown-events", "unknown", "warning", "unknown", "unknown", None),
    ("official-account-calibration", "unknown", "warning", "missing_accounts", None, None),
    ("provisional-account-identities", "unknown", "warning", "provisional", None, "provisional_tokens"),
    ("rollout-reconstruction-pending", "unknown", "info", "pending", None, None),
    ("rollout-reconstruction-unrecoverable", "unknown", "warning", "unrecoverable", None, None),
)


def issues(state: DataFrame, first_seen: Column, last_seen: Column) -> DataFrame:
    """(id, state, severity, n, event_count, token_count, first_seen, last_seen) of each rule that hits; state is one row of counts."""
    own = lambda c, none: F.lit(none).cast("bigint") if c is None else F.col(c).cast("bigint")
    rows = [
        F.struct(F.lit(i).alias("id"), F.lit(s).alias("state"), F.lit(v).alias("severity"), own(n, 0).alias("n"), own(e, 0).alias("event_count"), own(t, None).alias("token_count"))
        for i, s, v, n, e, t in RULES
    ]
    return state.select(F.explode(F.array(*rows)).alias("i"), first_seen.alias("first_seen"), last_seen.alias("last_seen")).select("i.*", "first_seen", "last_seen").where("n > 0")


def figures(parts: dict[str, tuple[DataFrame, tuple[str, ...], tuple[str, ...]]]) -> DataFrame:
    """(part, item, figure, value) of named tables, each with its key columns and its figures; nulls have no row.

    An item is the keys with bars between them, null ones as empty texts.
    """
    out = []
    for name, (rows, keys, columns) in parts.items():
        item = F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]) if keys else F.lit("")
        each = F.explode(F.array(*[F.struct(F.lit(c).alias("figure"), F.col(c).cast("double").alias("value")) for c in columns]))
        out.append(rows.select(F.lit(name).alias("part"), item.alias("item"), each.alias("f")).select("part", "item", "f.*").where("value is not null"))
    return reduce(DataFrame.unionByName, out)
