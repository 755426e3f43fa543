"""Every registered query of the reference's operators against its SQL twin."""

import duckdb
import pytest

import __spark_entry__
from galena.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(columns, rows):
    own = lambda v: None if v is None else round(v, 6) if isinstance(v, float) else str(v)[:10] if hasattr(v, "isoformat") else v
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(([own(r[i]) for i in order] for r in rows), key=str)


@pytest.mark.parametrize("name", list(catalogue.ORACLE_SQL))
def test_query(spark, oracle, name):
    got = catalogue.QUERIES[name](spark, SF)
    want = oracle.sql(catalogue.ORACLE_SQL[name])
    assert plain(got.columns, got.collect()) == plain(want.columns, want.fetchall())


def test_entry_and_registry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_rows_only(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0


@pytest.mark.parametrize("name", ["measure_all_lineitem", "gold_orders_summary", "gold_lineitem_summary"])
def test_summaries_ask_a_profile_for_counts_alone(spark, monkeypatch, name):
    monkeypatch.setattr(catalogue.profile, "_numeric", lambda *_: pytest.fail("no statistics are used"))
    assert catalogue.QUERIES[name](spark, SF).count() > 0


def test_keys_are_not_profiled_for_measures(spark, monkeypatch):
    seen, own = [], catalogue.profile.profile
    monkeypatch.setattr(catalogue.profile, "profile", lambda df, **how: seen.append(df.columns) or own(df, **how))
    assert catalogue.QUERIES["measure_all_lineitem"](spark, SF).count() == 3
    assert [sorted(x) for x in seen] == [["l_discount", "l_extendedprice", "l_quantity", "l_returnflag", "l_tax"]]
