import math
import os

import duckdb
import pytest

from colloq.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")

COLUMNS = {
    "p1_found": [("record_kind", "string"), ("term_a", "string"), ("term_b", "string")],
    "p3_found": [("turn_id", "bigint"), ("file_id", "int"), ("word_ord", "bigint")],
    "p4_found": [("src", "string"), ("rec_id", "bigint"), ("pii_type", "string"), ("start_char", "int"), ("end_char", "int")],
    "p5_found": [("src", "string"), ("rec_id", "bigint"), ("start_char", "int"), ("end_char", "int")],
    "p6_found": [("file_id", "int"), ("speaker", "string"), ("first_segment_id", "bigint"), ("last_segment_id", "bigint")],
    "p9_found": [("doc_id", "bigint")],
}
MAY_BE_EMPTY = {"p1_found", "p1_scores", "p1_sessions"}


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    return tuple(map(plain, value)) if isinstance(value, (list, tuple)) else value


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for file in os.listdir(SF):
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{SF}/{file}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, db, name):
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = [tuple(r) for r in df.select(*columns).collect()]
    if name in COLUMNS:
        assert df.dtypes == COLUMNS[name]
        assert len(rows) == len(set(rows))
    elif name not in MAY_BE_EMPTY:
        assert rows
    if sql := queries.SQL.get(name):
        result = db.execute(sql)
        names = [d[0] for d in result.description]
        assert sorted(names) == columns
        want = [tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall()]
        assert sorted((tuple(map(plain, r)) for r in rows), key=repr) == sorted(want, key=repr)
