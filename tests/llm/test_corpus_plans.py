"""The native operators' plans hold no Python, and no operator makes a product of tables."""

import pytest

from tracklane.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op2_mix_sources", "op7_license_scans", "op9_quality_rules", "op11_chat_formatting"])
def test_native(spark, name):
    text = queries.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    for node in ("Python", "Pandas", "MapInArrow", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert node not in text


def test_native_operators_compare_with_sql(spark):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name, sql in queries.oracle_sql().items():
        got = queries.queries()[name](spark, SF).toPandas()
        expected = con.execute(sql).fetchdf()
        columns = sorted(got.columns)
        rows = lambda df: sorted(map(str, df[columns].astype(object).where(df[columns].notna(), None).itertuples(index=False, name=None)))  # noqa: E731, B023
        assert columns == sorted(expected.columns) and rows(got) == rows(expected), name
