"""Views that put several queries together: sessions, timeline, bundle, exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import aggregates as agg
from ..operators import quota, trees
from ..sources import ledger as source
from .ledger import Ledger

MOST_NODES = 800


def session_nodes(x: Ledger, root: str) -> DataFrame:
    """The tree of a session: each node's own usage and that of its subtree, by depth, then the latest; MOST_NODES at most."""
    tree = x.members.where(F.col("root_id") == root).select("thread_id", "relative_depth")
    own = agg.cube_totals(x.effective_days.where("quality = 'confirmed'").join(tree.select("thread_id"), "thread_id", "left_semi"), "thread_id").select("thread_id", F.col("total").alias("own_total"))
    pairs = trees.ancestors(x.catalog.join(tree.select("thread_id"), "thread_id", "left_semi")).select("thread_id", "ancestor_id")
    below = pairs.join(own, "thread_id", "left").groupBy(F.col("ancestor_id").alias("thread_id")).agg(F.coalesce(F.sum("own_total"), F.lit(0)).cast("bigint").alias("subtree_total"))
    rows = tree.join(x.catalog.select("thread_id", "parent_thread_id", "updated_at"), "thread_id").join(own, "thread_id", "left").join(below, "thread_id").na.fill(0, ["own_total"])
    return rows.orderBy("relative_depth", F.desc("updated_at"), "thread_id").limit(MOST_NODES)


def search(x: Ledger, part: str) -> DataFrame:
    """(thread_id, hit): threads whose id contains a text, whatever its case, and all threads above them."""
    return search_fields(x.catalog, part, "thread_id")


def search_fields(catalog: DataFrame, part: str, *fields: str) -> DataFrame:
    """(thread_id, hit): threads of which some fields, such as title, nickname and model, contain a text, and all above."""
    hits = catalog.where(F.lower(F.concat_ws(" ", *fields)).contains(part.strip().lower())).select("thread_id")
    found = trees.ancestors(catalog).join(hits, "thread_id", "left_semi")
    return found.groupBy(F.col("ancestor_id").alias("thread_id")).agg((F.min("distance") == 0).alias("hit"))


def focus(catalog: DataFrame, thread_id: str) -> DataFrame:
    """The rows of a thread and of all below it."""
    below = trees.descendants(catalog, thread_id).select("thread_id")
    return catalog.join(below.union(catalog.where(F.col("thread_id") == thread_id).select("thread_id")), "thread_id", "left_semi")


def timeline(x: Ledger) -> DataFrame:
    """(at, kind, account, detail): switches of account, observed resets and resets to come, in order."""
    seen = source.auth_markers(x.facts).where("kind = 'account_seen'").withColumn("source_id", F.lit("log"))
    switches = quota.switches(seen).select(F.col("observed_at").alias("at"), F.lit("account_switch").alias("kind"), "account", F.concat_ws(" > ", "before", "account").alias("detail"))
    resets = quota.reset_events(x.quota).select("at", F.lit("quota_reset").alias("kind"), "account", F.col("reset_class").alias("detail"))
    due = quota.latest(x.quota).where(F.col("resets_at") > source.now()).select(F.col("resets_at").alias("at"), F.lit("quota_reset_scheduled").alias("kind"), "account", F.lit("scheduled").alias("detail"))
    return switches.unionByName(resets).unionByName(due).orderBy("at", "kind", "account")


def bundle(x: Ledger) -> DataFrame:
    """(section, row): the rows of a dashboard's sections as JSON, in one DataFrame."""
    from . import catalogue as c

    sections = {"summary": c.summary_kpis, "by_project": c.effective_by_project, "by_model": c.breakdown_pivot_share, "ranking": c.project_ranking, "counts": c.catalog_counts}
    out = None
    for name, plan in sections.items():
        rows = plan(x)
        part = rows.select(F.lit(name).alias("section"), F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"}).alias("row"))
        out = part if out is None else out.unionByName(part)
    return out


def export(points: DataFrame, path: str, kind: str = "csv") -> None:
    """Writes points as CSV with a header, or as JSON lines."""
    writer = points.write.mode("overwrite")
    (writer.option("header", "true").csv if kind == "csv" else writer.json)(path)
