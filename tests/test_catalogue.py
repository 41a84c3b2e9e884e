"""Every registered query of the ledger against its SQL, and laws that hold between queries."""

from __future__ import annotations

import math

import duckdb
import pandas as pd
import pytest

from meterline.plans import catalogue, more, sections  # noqa: F401
from meterline.plans.ledger import Ledger


def rows(frame: pd.DataFrame) -> list[tuple]:
    def plain(v):
        if v is None or v is pd.NaT or (not isinstance(v, (list, str)) and pd.isna(v)):
            return None
        v = v.item() if hasattr(v, "item") else v
        return float(f"{v:.10g}") if isinstance(v, float) and not math.isinf(v) else v if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    columns = sorted(frame.columns)
    return sorted((tuple(plain(v) for v in r) for r in frame[columns].itertuples(index=False)), key=str)


@pytest.fixture(scope="module")
def duck(data):
    connection = duckdb.connect()
    connection.execute(f"create view events as select * from '{data}/events.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_its_sql(spark, data, duck, name):
    ours, theirs = catalogue.QUERIES[name](spark, data).toPandas(), duck.execute(catalogue.ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


@pytest.fixture(scope="module")
def ledger(spark, data):
    return Ledger(spark, data)


def total(df):
    from pyspark.sql import functions as F

    return df.agg(F.coalesce(F.sum("total"), F.lit(0))).first()[0]


def test_sums_are_conserved_from_facts_to_cubes(ledger):
    assert total(ledger.facts) == total(ledger.days) == total(ledger.hours)
    assert total(ledger.recon) == total(ledger.recon_days) == total(ledger.recon_hours)


def test_effective_sums_agree_and_take_the_larger_source(ledger):
    from pyspark.sql import functions as F

    days = ledger.effective_days.where("quality = 'confirmed'")
    best = ledger.selection.agg(F.sum(F.greatest("sampling_tokens", "reconstruction_tokens"))).first()[0]
    assert total(days) == best == total(ledger.effective_hours.where("quality = 'confirmed'")) == total(ledger.effective_facts.where("quality = 'confirmed'"))


def test_control_totals_of_the_mapping(spark, data):
    r = catalogue.QUERIES["raw_total"](spark, data).first()
    assert (r.event_count, r.input, r.cached_input, r.cache_write_input, r.cache_write_observed, r.output, r.reasoning_output, r.total) == (1000, 4004419, 2002014, 203592, 2038153, 1000600, 333187, 5005019)


def test_parts_of_a_window_equal_the_whole(spark, data):
    assert catalogue.QUERIES["rolling7_split"](spark, data).first() == catalogue.QUERIES["rolling7_exact"](spark, data).first()


def test_apportioned_residual_adds_up(ledger):
    from meterline.operators import official

    raw = official.alignment(ledger.residual_rows, ledger.official, ledger.official).first().raw_residual
    assert total(ledger.allocated) == raw > 0


def test_scan_reads_only_needed_columns(spark, data):
    plan = catalogue.QUERIES["raw_by_account"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema" in plan and "event_id" not in plan.split("ReadSchema")[1].split("\n")[0]


def test_the_greedy_matcher_equals_its_sql_with_nulls(spark, data, duck):
    """By tuples: frames of one engine hold longs beside nulls as doubles, those of the other don't."""
    columns = ["thread_id", "observation_id", "candidate_id", "gap_micros"]
    ours = sorted((tuple(r) for r in catalogue.QUERIES["interval_match_greedy"](spark, data).select(*columns).collect()), key=str)
    theirs = duck.execute(catalogue.oracle.sql(f"select {', '.join(columns)} from ({catalogue.GREEDY})")).fetchall()
    assert ours == sorted(theirs, key=str) and any(r[2] is None for r in ours) and any(r[2] is not None for r in ours)


@pytest.fixture(scope="module")
def close(data, tmp_path_factory):
    """Events of which three quarters are copies 300 to 900 ms later, so that logouts come within a second of each other, with
    readings between them."""
    folder, events = tmp_path_factory.mktemp("close"), data.replace("sf0.001", "sf0.01") + "/events.parquet"
    copies = f"select event_id + n * 1000000 event_id, ts + n * interval 300 millisecond ts, user_id + n * 1000 user_id, event_type, value, props from '{events}', range(4) r(n)"
    readings = f"select event_id + 9000000, ts + interval 450 millisecond, user_id, 'signup', value, props from '{events}' where event_type = 'error'"
    duckdb.sql(f"copy ({copies} union all {readings}) to '{folder}/events.parquet'")
    connection = duckdb.connect()
    connection.execute(f"create view events as select * from '{folder}/events.parquet'")
    return str(folder), connection


@pytest.mark.parametrize("name", ["epoch_stats", "account_epoch_lookup", "account_epochs_inferred", "quota_held_back"])
def test_epochs_between_close_logouts_equal_their_sql(spark, close, name):
    folder, connection = close
    ours, theirs = catalogue.QUERIES[name](spark, folder), connection.execute(catalogue.ORACLES[name]).fetchall()
    columns = [c[0] for c in connection.description]
    assert sorted((tuple(r) for r in ours.select(*columns).collect()), key=str) == sorted(theirs, key=str)


def test_thinned_epochs_between_close_logouts_equal_their_sql(spark, close):
    folder, connection = close
    ours, theirs = catalogue.QUERIES["account_epochs_thinned"](spark, folder), connection.execute(catalogue.ORACLES["account_epochs_thinned"]).fetchall()
    columns = [c[0] for c in connection.description]
    assert sorted((tuple(r) for r in ours.select(*columns).collect()), key=str) == sorted(theirs, key=str)
    assert sorted(theirs, key=str) != sorted(connection.execute(catalogue.ORACLES["account_epochs_inferred"]).fetchall(), key=str)
