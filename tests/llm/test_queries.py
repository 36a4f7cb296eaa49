"""Every registered query on the smallest tables: against SQL where there is some, else its rows and columns."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from evalspark.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "documents embeddings benchmark labels conversations".split()
COLUMNS = {
    "op1": "doc_id n_tokens ids_sha256 decoded_sha256", "op3": "doc_id size source_size target taken", "op9": "doc_id score kept",
    "op4": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept", "op7": "doc_id start n_tokens ids_crc32",
    "op5": "doc_id size text_crc32 law shard slot grown_shard", "op8": "doc_id held_out score predicted", "pipeline": "doc_id n_tokens", "op11": "doc_id held_out lang_pred score",
}

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="the test tables are not here")


def test_all_operators_are_registered():
    names = [n.split("_")[0] for n in QUERIES]
    assert sorted(names) == sorted(["pipeline", *(f"op{n}" for n in range(1, 14))])
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({ORACLES[name]})").fetchall()
    assert sorted(tuple(r) for r in df.select(columns).collect()) == sorted(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs_over_the_whole_table(spark, name):
    df = QUERIES[name](spark, SF)
    assert set(COLUMNS[name.split("_")[0]].split()) <= set(df.columns)
    if name != "pipeline":
        assert df.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
