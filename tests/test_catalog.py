"""Each catalogue query against its SQL in DuckDB, over the smallest tables."""

import os

import duckdb
import pytest

from segmentry.plans import catalog

SF = "/root/testdata/sf0.001"


def rows(columns, found):
    return sorted(repr(tuple(round(r[c], 6) if isinstance(r[c], float) else r[c] for c in sorted(columns))) for r in found)


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.sql(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{t}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_same_rows(spark, sql, name):
    got = catalog.QUERIES[name](spark, SF)
    want = sql.sql(catalog.SQL[name])
    columns = want.columns
    assert sorted(got.columns) == sorted(columns)
    assert rows(columns, [r.asDict() for r in got.collect()]) == rows(columns, [dict(zip(columns, r)) for r in want.fetchall()])


def test_entry_point_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_only_results_are_left(spark, tmp_path):
    from segmentry.sources.tables import shared_dir

    folder = shared_dir(spark)
    before = set(os.listdir(folder))
    made = [catalog.QUERIES[n](spark, SF) for n in ("segmented_scenes", "scene_index", "parse_scene_lines", "frame_index")]
    left = set(os.listdir(folder)) - before
    assert sorted(n.split("-")[1] for n in left) == ["parse_scene_lines", "scene_index", "segmented_scenes"]
    assert all(d.count() for d in made)
