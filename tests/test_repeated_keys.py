"""Queries on the bytes of a key take all its values together and give keys without a byte no row, as their SQL does."""

import duckdb
import pytest

import __spark_entry__ as entry


@pytest.mark.parametrize("name", ["ascii_ratio", "entropy_h8", "incompressible_rule"])
def test_rows_that_repeat_a_key_and_rows_without_bytes(spark, tmp_path, name):
    rows = [(1, "abcabc é", "en"), (1, "ünï\tx" * 300, "en"), (2, "", "fr"), (3, None, "fr"), (4, "aaaa", "de"), (4, "", "de"), (4, None, "de"), (5, "one", None), (6, "two", None)]
    rows += [(7, "".join(map(chr, range(i, i + 300))), "en") for i in range(400)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    wanted = con.execute(entry.oracle_sql()[name]).fetchall()
    got = [tuple(r) for r in entry.queries()[name](spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(((k, *(x + 0.0 if isinstance(x, float) else x for x in v)) for k, *v in wanted), key=str)
