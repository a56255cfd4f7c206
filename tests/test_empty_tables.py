"""Queries over written files and streams on tables without rows, and on one row of nulls."""

import pytest

from lectern.plans import catalog

SCHEMAS = {
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_orderdate timestamp_ntz",
    "lineitem": "l_orderkey bigint, l_linenumber int, l_quantity double",
}
NAMES = ["desk_answers", "rewritten_streams", "tagged_files", "tagged_file_pages"]


@pytest.fixture(scope="module", params=[0, 1], ids=["empty", "nulls"])
def tables(request, spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("tables")
    for name, schema in SCHEMAS.items():
        n = len(schema.split(","))
        spark.createDataFrame([(None,) * n] * request.param, schema).write.parquet(f"{at}/{name}.parquet")
    return request.param, str(at)


@pytest.mark.parametrize("name", NAMES)
def test_tables_without_rows(spark, tables, name):
    n, at = tables
    found = [tuple(r) for r in catalog.queries()[name](spark, at).collect()]
    if n == 0 or name.startswith("tagged"):
        assert found == []
    elif name == "desk_answers":
        assert {(r[0], r[1], r[2]) for r in found} == {(None, "command", 400), (None, "status", 404), (None, "download", 404)}
    else:
        assert [r[2] for r in found] == ["open", "body", "close"]
