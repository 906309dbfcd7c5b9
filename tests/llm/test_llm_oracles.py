"""Operators with SQL give the rows that DuckDB gives; the rules also where cutoffs are found."""

import duckdb
import pytest
from wavelake.llm import queries, rules

TABLES = "documents pages benchmark labels conversations".split()


def plain(x):
    if x is None or x != x:
        return None
    return int(x) if isinstance(x, float) and x == int(x) else round(x, 6) if isinstance(x, float) else x


def rows(cursor_columns, data):
    order = sorted(range(len(cursor_columns)), key=lambda i: cursor_columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def compare(spark, query, sql, sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = query(spark, sf)
    want = c.execute(sql)
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert rows(got.columns, got.collect()) == rows(names, want.fetchall())


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_oracle(spark, sf, name):
    compare(spark, queries.QUERIES[name], queries.ORACLE_SQL[name], sf)


def test_rules_with_cutoffs(spark, monkeypatch):
    sf = "/root/testdata/sf0.01"
    monkeypatch.setattr(rules, "RISK", 0.6)
    monkeypatch.setattr(rules, "LEVEL", 0.4)
    monkeypatch.setattr(rules.choose_cutoffs, "__defaults__", (0.6, 0.4))
    assert rules.op6_quality_rules(spark, sf).where("n_broken > 0").count() > 20
    compare(spark, rules.op6_quality_rules, rules._oracle(), sf)
