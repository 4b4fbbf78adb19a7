"""Registered queries read whole tables, not a part of them."""

from compare import DATA

from augury.operators import profile as P
from augury.plans import fixtures, series_queries, text_queries


def test_time_columns_of_all_orders(spark, monkeypatch):
    # Two URGENT orders have a text date that parses; those of other priorities have none.
    rows = [(k, "1-URGENT" if k < 3 else "5-LOW", f"2024-01-0{k}", 1.0 * k) for k in range(1, 9)]
    made = spark.createDataFrame(rows, "o_orderkey long, o_orderpriority string, d string, o_totalprice double").selectExpr("o_orderkey * IF(o_orderkey < 3, 1, 40) AS o_orderkey", "o_orderpriority", "CAST(d AS TIMESTAMP) AS o_orderdate", "o_totalprice")
    monkeypatch.setattr(fixtures, "table", lambda *_: made)
    assert "as_text" not in {r["name"] for r in series_queries.detect_axis(spark, "").collect()}


def test_coercion_impact_has_every_column_of_parts(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(text_queries.jobs, "coercion_impact", lambda df, key, target: seen.append(df))
    text_queries.impact(spark, DATA)
    parts = fixtures.table(spark, DATA, "part")
    assert seen[0].count() == parts.count() and {*parts.columns, *fixtures.text_numbers(spark, DATA).columns} == set(seen[0].columns)
    # The strict pattern leaves a column as text, so that the patterns do not share a run.
    assert set(P.numeric_like(seen[0])) - set(P.numeric_like(seen[0], pattern=P.UNITS_ONLY)) == {"style"}
