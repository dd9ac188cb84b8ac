import duckdb
import pytest

from kinweave.llm import queries
from tests.compare import connect, differences


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, sf_dir, name):
    only_here, only_there, n = differences(spark, connect(sf_dir), queries.QUERIES[name], queries.ORACLES[name], sf_dir)
    assert not only_here and not only_there and n


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


def test_lines_of_repeated_rows(spark, tmp_path):
    """Rows with one doc_id are documents each, to the operator and to its SQL."""
    line = "a line that has far more than forty characters in it"
    rows = [(1, line)] * 4 + [(2, line), (3, f"{line}\nown"), (3, f"own\n {line.upper()} "), (4, ""), (4, "")]
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    only_here, only_there, n = differences(spark, con, queries.QUERIES["op2_linededup"], queries.ORACLES["op2_linededup"], str(tmp_path))
    assert not only_here and not only_there and n == len(rows)
    got = queries.QUERIES["op2_linededup"](spark, str(tmp_path)).groupBy("doc_id").agg({"n_dropped": "sum"}).collect()
    assert {r[0]: r[1] for r in got} == {1: 4, 2: 1, 3: 0, 4: 0}
