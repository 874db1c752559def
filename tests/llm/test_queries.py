"""Every registered query of the subpackage, against its oracle SQL where there is one, on the smallest tables."""

import pytest

from ledgerloom.llm import queries
from tests.test_entry import DATA, duck, needs_data, plain  # noqa: F401

COLUMNS = {
    "p1_found": {"field_id"}, "p1_forms": {"field_id", "raw_form", "suggested_form"}, "p2_found": {"record_id", "counterparty_id"}, "p2_links": {"record_id", "counterparty_id"},
    "p6_ids": {"doc_id", "ids"}, "p7_containers": {"doc_id", "piece", "n_tokens", "container"}, "p7_fill": {"containers", "tokens", "filled", "fullest"}, "p8_found": {"doc_id"},
    "p8_levels": {"doc_id", "level", "demanding", "shares"},
}


def test_every_query_has_an_oracle_or_known_columns():
    assert set(queries.QUERIES) == set(COLUMNS) | set(queries.ORACLE)


@needs_data
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(name, spark, duck):  # noqa: F811
    df = queries.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    rows = df.collect()
    if name not in queries.ORACLE:
        assert set(columns) == COLUMNS[name] and rows
        return
    r = duck.sql(queries.ORACLE[name])
    assert sorted(r.columns) == columns
    at = [r.columns.index(c) for c in columns]
    assert sorted(tuple(plain(r[c]) for c in columns) for r in rows) == sorted(tuple(plain(row[i]) for i in at) for row in r.fetchall())


@needs_data
def test_found_rows_are_whole(spark, duck):  # noqa: F811
    """Tokens packed are tokens encoded, a link a record, and records collapsed are records."""
    q = queries.QUERIES
    encoded = q["p6_ids"](spark, DATA).selectExpr("sum(size(ids))", "count(*)").first()
    packed = q["p7_containers"](spark, DATA).selectExpr("sum(n_tokens)", "count(distinct doc_id)").first()
    assert tuple(encoded) == tuple(packed)
    links = q["p2_links"](spark, DATA)
    assert links.count() == links.select("record_id").distinct().count() and q["p2_found"](spark, DATA).join(links, ["record_id", "counterparty_id"], "left_anti").count() == 0
    assert q["p5_records"](spark, DATA).selectExpr("sum(copies)").first()[0] == duck.sql("select count(*) from candidates").fetchall()[0][0]
