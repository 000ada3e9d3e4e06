"""Every registered query of the decoding engine against its DuckDB SQL."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from tidewater.plans import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, name):
    con = duckdb.connect()
    for t in os.listdir(SF):
        path = f"{SF}/{t}"
        con.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    want = con.execute(catalog.oracle_sql()[name])
    columns = sorted(c[0] for c in want.description)
    rows = [dict(zip([c[0] for c in want.description], r)) for r in want.fetchall()]
    got = catalog.queries()[name](spark, SF)
    assert sorted(got.columns) == columns
    key = lambda r: tuple((r[c] is None, r[c]) if r[c] is not None else (True, "") for c in columns)
    assert sorted((tuple(map(str, key(r.asDict()))) for r in got.collect())) == sorted(tuple(map(str, key(r))) for r in rows)


def test_finish_states_reach_the_whole_of_nested_payloads(spark, tmp_path):
    nested = '{"k": [1, {"a": "x\\"["}]}'
    spark.createDataFrame([(1, nested), (2, '{"k": 1}'), (3, None)], "event_id long, props string").write.parquet(f"{tmp_path}/events.parquet")
    got = {(r.event_id, r.n_read): r.reason for r in catalog.queries()["json_finish_states"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    assert got == {(a, b): c for a, b, c in con.execute(catalog.oracle_sql()["json_finish_states"]).fetchall()}
    assert len(got) == len(nested) + 1 + 9 and got[1, len(nested)] is None and got[1, len(nested) - 2] == "missingClosingBracket"


@pytest.mark.parametrize("name", ["json_nested", "json_syntax", "yaml_nested", "json_types", "json_partials"])
def test_heavy_queries_use_every_core_for_a_small_file(spark, name):
    got = catalog.queries()[name](spark, SF)
    assert got.select(F.spark_partition_id().alias("p")).distinct().count() >= spark.sparkContext.defaultParallelism
