"""Queries over inputs that aren't regular, held against their SQL."""

import duckdb
import pytest

from brindle.plans import registry


def against_sql(spark, folder, tables, name):
    """(rows of the query, rows of its SQL) over `tables` (name: (columns, rows)), both sorted."""
    con = duckdb.connect()
    for t, (schema, rows) in tables.items():
        path = f"{folder}/{t}.parquet"
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(path)
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}/*.parquet')")
    df = registry.queries()[name](spark, str(folder))
    cols = ", ".join(f'"{c}"' for c in df.columns)
    key = lambda r: tuple(str(x) for x in r)
    return sorted((tuple(r) for r in df.collect()), key=key), sorted(con.execute(f"SELECT {cols} FROM ({registry.oracle_sql()[name]})").fetchall(), key=key)


def documents(ids, text):
    rows = [(k, text(k), ("en", "de", "fr")[k % 3], f"s{k % 4}") for k in ids]
    return {"documents": ("doc_id long, text string, lang string, source string", rows), "labels": ("doc_id long, toxic int", [(k, k // 2 % 2) for k in ids])}


@pytest.mark.parametrize("name", ["caption_gate"])
def test_texts_without_tokens(spark, tmp_path, name):
    odd = ["", " ", "---", "жук", None, "one two three", "a"]
    got, want = against_sql(spark, tmp_path, documents(range(84), lambda k: odd[k % 7]), name)
    assert got == want and len(got) == 84


@pytest.mark.parametrize("name", ["components", "reject_cases", "hard_edges", "manifest_joins"])
def test_targets_that_arent_there(spark, tmp_path, name):
    """Gaps between ids, and a video that no pair meets (3003)."""
    tables = documents([*range(60), *range(1000, 1060), 3003], lambda k: f"text {k % 50}")
    lines = [(k, 10.0 * k) for k in range(0, 1100, 7)]
    got, want = against_sql(spark, tmp_path, tables | {"lineitem": ("l_orderkey long, l_extendedprice double", lines)}, name)
    assert got == want and got
