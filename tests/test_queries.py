"""Every query runs, and equals its DuckDB twin where it has one."""

import os

import duckdb
import pandas as pd
import pytest

from tessera import catalogue


def plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 9) + 0.0
    return None if v is pd.NaT else str(v) if not isinstance(v, (int, bool, str, type(None))) else v


def rows_of(d, columns):
    return sorted((tuple(plain(v) for v in r) for r in d[columns].astype(object).itertuples(index=False)), key=str)


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in os.listdir(sf_dir):
        c.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{sf_dir}/{t}')")
    return c


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query(spark, duck, sf_dir, name):
    d = catalogue.QUERIES[name](spark, sf_dir)
    got = d.toPandas()
    assert len(got.columns) == len(set(got.columns))
    if name in catalogue.ORACLES:
        want = duck.execute(catalogue.ORACLES[name]).df()
        columns = sorted(got.columns)
        assert columns == sorted(want.columns)
        assert rows_of(got, columns) == rows_of(want, columns)
    else:
        assert len(got) > 0


def test_list_text_of_odd_rows(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    lists = [[-3.4e-6, 0.0], [-0.0, -1.0], [-4.9e-6, -5.1e-6], [], None, [None, 1.5], [None, None], [nan, inf], [-inf, 2.5], [7.25], [3.4e38, 1e-30], [0.015625, -0.015625], [123456792.0, 1e13]]
    spark.createDataFrame(list(enumerate(lists)), "vec_id long, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    want = sorted(c.execute(catalogue.ORACLES["list_text"]).fetchall())
    assert len(want) == len(lists)
    assert sorted(map(tuple, catalogue.QUERIES["list_text"](spark, str(tmp_path)).select("vec_id", "text").collect())) == want


def test_list_text_is_of_whole_lists(spark, tmp_path):
    lists = [[(-1) ** k * (k + 0.5) / 64 for k in range(n)] for n in (1, 2, 3, 64, 1000)]
    spark.createDataFrame(list(enumerate(lists)), "vec_id long, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    want = sorted(c.execute(catalogue.ORACLES["list_text"]).fetchall())
    got = sorted(map(tuple, catalogue.QUERIES["list_text"](spark, str(tmp_path)).select("vec_id", "text").collect()))
    assert got == want
    assert [t.count(",") + 1 for _, t in got] == [len(x) for x in lists]
    assert all(abs(float(v) - x) <= 5.1e-6 for (_, t), a in zip(got, lists, strict=True) for v, x in zip(t.strip("[]").split(", "), a, strict=True))


def test_names_agree():
    assert set(catalogue.ORACLES) <= set(catalogue.QUERIES)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
