"""The driver contract, and queries against their SQL at the smallest scale."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from spandrel.plans.queries import ORACLES, QUERIES
from spandrel.plans.views import TABLES

SF = "/root/testdata/sf0.001"
SOME = ["i1_overlap_join", "i4_complement", "g2_audio_activity", "d8_promote", "d3_memo_proposals", "p2_candidate_pairs", "w2_resume_plan", "t7_map_subtitles", "e4_day_order", "s2_rule_candidates", "f4_build_cuts", "v4_validate_annotations", "st4_stream_outcomes"]


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(ORACLES) <= set(QUERIES) and len(QUERIES) > 100


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", SOME)
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    ours = sorted(map(str, (tuple(r) for r in df.select(*[f"`{c}`" for c in cols]).collect())))
    theirs = sorted(map(str, con.sql(ORACLES[name]).select(*[duckdb.ColumnExpression(c) for c in cols]).fetchall()))
    assert ours == theirs


def test_scratch_tables_can_be_released(spark):
    import os

    from spandrel.functions import shared

    kept = shared.stored(spark.range(3), "kept")
    folder = kept.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    held, shared._written[:] = shared._written[:-1], shared._written[-1:]
    assert os.path.isdir(folder) and shared.release(spark) == 1 and not os.path.isdir(folder)
    shared._written[:] = held
