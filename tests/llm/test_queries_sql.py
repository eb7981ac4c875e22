"""The registered queries: against their SQL where there is some, else that they run whole."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from driftwood.llm.queries import ORACLE_SQL, QUERIES

SF = Path("/root/testdata/sf0.001")
#: What a join leaves out shows on more rows than the smallest tables have.
LARGER = Path("/root/testdata/sf0.01")
pytestmark = pytest.mark.skipif(not SF.exists(), reason="no tables here")
ROWS = {8: "pages", 10: "embeddings", 12: "embeddings"}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in SF.glob("*.parquet"):
        c.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    ours, theirs = QUERIES[name](spark, str(SF)).toPandas(), duck.sql(ORACLE_SQL[name]).df()
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    sort = lambda df: sorted(df[columns].astype(str).itertuples(index=False, name=None))
    assert sort(ours) == sort(theirs)


@pytest.mark.skipif(not LARGER.exists(), reason="no tables here")
@pytest.mark.parametrize("name", ["op1_line_dedup", "op3_jaccard_join", "op4_decontaminate"])
def test_query_equals_sql_on_more_rows(spark, name):
    duck = duckdb.connect()
    for f in LARGER.glob("*.parquet"):
        duck.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    ours, theirs = QUERIES[name](spark, str(LARGER)).toPandas(), duck.sql(ORACLE_SQL[name]).df()
    columns = sorted(ours.columns)
    sort = lambda df: sorted(df[columns].astype(str).itertuples(index=False, name=None))
    assert sort(ours) == sort(theirs)


@pytest.mark.parametrize("n", [5, 6, 7, 8, 9, 10, 11, 12])
def test_query_has_a_row_for_each_row(spark, duck, n):
    name = next(q for q in QUERIES if q.startswith(f"op{n}_"))
    table = ROWS.get(n, "documents")
    assert QUERIES[name](spark, str(SF)).count() == duck.execute(f"SELECT count(*) FROM {table}").fetchall()[0][0]


def test_held_out_accuracy(spark, duck):
    out = QUERIES["op5_language_id"](spark, str(SF)).toPandas().set_index("doc_id")
    lang = duck.sql("SELECT doc_id, lang FROM documents").df().set_index("doc_id")["lang"]
    held = out[out["held_out"]]
    assert (held["lang_pred"] == lang.loc[held.index]).mean() > 0.95
