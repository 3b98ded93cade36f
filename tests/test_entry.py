"""The driver's contract, and a sample of queries against their SQL twins."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, digest

FOLDER = "/root/testdata/sf0.001"
SAMPLE = ["a1_read_bio", "a2_read_icsl_tsv", "a3_read_nested_nlu", "b6_expand_contractions", "c3_check_bio", "d3_diff_inventory", "d8_max_rouge_l", "d9_max_bleu4", "contamination_report", "e12_span_f1", "e33_time_features", "f4_pick_until", "j9_ratio_sweep", "k3_kept_commands", "k8_family_ablation", "k9_augment", "l3_project_slots", "n2_partition_baseline"]
NAMES = list(entry.oracle_sql()) if os.environ.get("ALL_QUERIES") else SAMPLE


def test_contract(spark):
    df = entry.entry(spark)
    assert df.columns == ["metric", "value"] and df.count() == 16
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    df = entry.queries()[name](spark, FOLDER)
    cur = con.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    assert digest(df.columns, [tuple(r) for r in df.collect()])[1] == digest(cols, cur.fetchall())[1]
