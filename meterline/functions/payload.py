"""Quota payloads and fingerprints."""

from __future__ import annotations

import hashlib
import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Names of keys that are never kept, alone or after an underscore.
SENSITIVE = re.compile(r"(?i)(.*_)?(secret|api_key|credential|email|account_id|user_id|workspace_id|organization_id|org_id|token)|authorization|cookie|set-cookie|password")
WINDOW = "struct<used_percent: double, window_minutes: bigint, limit_window_seconds: bigint, resets_at: bigint, reset_at: bigint>"
LIMIT = "limit_id string, limit_name string"


def without_secrets(value):
    if isinstance(value, dict):
        return {k: without_secrets(v) for k, v in value.items() if not SENSITIVE.fullmatch(k)}
    return [without_secrets(v) for v in value] if isinstance(value, list) else value


@F.pandas_udf(StringType())
def sanitized(payload: pd.Series) -> pd.Series:
    """JSON without sensitive keys at any depth; null for what isn't JSON."""

    def one(text: str | None) -> str | None:
        try:
            return json.dumps(without_secrets(json.loads(text)), ensure_ascii=False) if text is not None else None
        except ValueError:
            return None

    return payload.map(one)


def quota_windows(rows: DataFrame, payload: str = "payload") -> DataFrame:
    """rows with pool_key, kind, limit_id, limit_name, window_name, used_percent, window_seconds, resets_at, warning.

    Two shapes: an account's response (rate_limit, additional_rate_limits, code_review_rate_limit) and an event, which is
    one pool by itself. Windows have any name; what has no used_percent is none. A percentage outside 0 to 100 is null
    with a warning.
    """
    part = "map<string, string>"
    shape = f"rate_limit {part}, additional_rate_limits array<struct<limit_id: string, limit_name: string, rate_limit: {part}>>, code_review_rate_limit {part}, {LIMIT}"
    both = rows.withColumn("_r", F.from_json(payload, shape)).withColumn("_e", F.from_json(payload, part))
    pool = lambda key, kind, own_id, name, windows: F.struct(key.alias("pool_key"), F.lit(kind).alias("kind"), own_id.alias("limit_id"), name.alias("limit_name"), windows.alias("windows"))
    response = F.col("_r.rate_limit").isNotNull() | F.col("_r.additional_rate_limits").isNotNull() | F.col("_r.code_review_rate_limit").isNotNull()
    main = pool(F.lit("main"), "main", F.col("_r.limit_id"), F.col("_r.limit_name"), F.col("_r.rate_limit"))
    review = pool(F.lit("code_review"), "code_review", F.col("_r.code_review_rate_limit")["limit_id"], F.col("_r.code_review_rate_limit")["limit_name"], F.col("_r.code_review_rate_limit"))
    event = pool(F.coalesce("_r.limit_id", "_r.limit_name", F.lit("main")), "event", F.col("_r.limit_id"), F.col("_r.limit_name"), F.col("_e"))
    more = F.transform(F.coalesce("_r.additional_rate_limits", F.array()), lambda x, i: pool(F.coalesce(x["limit_id"], x["limit_name"], F.concat(F.lit("additional-"), i.cast("string"))), "additional", x["limit_id"], x["limit_name"], x["rate_limit"]))
    pools = F.when(response, F.concat(F.array(main), more, F.array(review))).otherwise(F.array(event))
    flat = both.withColumn("_p", F.explode(pools)).where("_p.windows is not null").withColumn("_w", F.explode(F.map_entries("_p.windows"))).withColumn("_x", F.from_json("_w.value", WINDOW))
    flat = flat.where(F.col("_w.value").startswith("{") & F.get_json_object("_w.value", "$.used_percent").isNotNull())
    used = F.col("_x.used_percent")
    return flat.select(
        *rows.columns, "_p.pool_key", "_p.kind", "_p.limit_id", "_p.limit_name", F.col("_w.key").alias("window_name"),
        F.when(used.between(0, 100), used).alias("used_percent"), F.coalesce("_x.limit_window_seconds", F.col("_x.window_minutes") * 60).alias("window_seconds"),
        F.coalesce("_x.resets_at", "_x.reset_at").alias("resets_at"), F.when(~used.between(0, 100), "used_percent_out_of_range").alias("warning"),
    )


def listed(items: Column) -> Column:
    """A list; null counts as the empty one."""
    return F.coalesce(items, F.array())


def quota_label(name: Column, limit_id: Column, pool_key: Column, main: str = "main") -> Column:
    """How a pool is called: its name, `main` for the main pool, what follows its key's prefix, or just a pool."""
    filled = lambda c: F.when(F.trim(c) != "", F.trim(c))
    return F.coalesce(filled(name), F.when(limit_id == main, main), F.when(pool_key.startswith("additional:id:"), F.substring(pool_key, 15, 1 << 30)), F.lit("additional"))


def fingerprint(value: Column, key: bytes, domain: str) -> Column:
    """HMAC-SHA256 in hex of a value within a domain, both with their lengths in front. The key's pads are constants."""
    key = hashlib.sha256(key).digest() if len(key) > 64 else key
    inner, outer = (bytes(b ^ pad for b in key.ljust(64, b"\0")) for pad in (0x36, 0x5C))
    framed = lambda c: F.concat(F.unhex(F.lpad(F.hex(F.octet_length(c).cast("bigint")), 16, "0")), c)
    message = F.concat(framed(F.lit(domain.encode())), framed(F.encode(value, "UTF-8")))
    return F.sha2(F.concat(F.lit(outer), F.unhex(F.sha2(F.concat(F.lit(inner), message), 256))), 256)
