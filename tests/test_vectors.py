"""Hand-worked vectors of the rules."""

import pandas as pd
from pyspark.sql import functions as F

from lectern.functions import scalars as s
from lectern.functions import text as t
from lectern.operators import elements, structure
from lectern.sources.adapters import page_source


def test_charge(spark):
    want = {0: (0, 0.0, None), 3: (0, 0.0, None), 4: (1, 0.05, 5), 7: (4, 0.2, 20), 10: (7, 0.35, 35), 26: (23, 1.15, 114), 44: (41, 2.05, 204), 500: (497, 24.85, 2485)}
    df = spark.createDataFrame([(p,) for p in want], "p int")
    got = {r.p: (r.b, r.a, r.c) for r in df.select("p", s.billable(F.col("p")).alias("b"), s.amount(F.col("p")).alias("a"), s.cents_truncated(F.col("p")).alias("c")).collect()}
    assert got == want


def test_progress(spark):
    got = spark.createDataFrame([(p,) for p in (1, 2, 4, 7)], "p int").select(s.progress(F.col("p"), F.lit(7))).collect()
    assert [r[0] for r in got] == [0, 12, 37, 75]


def heads(spark, levels):
    return spark.createDataFrame([("d", i, v, "x") for i, v in enumerate(levels)], "doc string, ord long, level int, text string")


def test_heading_levels(spark):
    issues = lambda levels: sorted(r.severity for r in structure.heading_hierarchy_issues(heads(spark, levels)).collect())
    assert issues([1, 2, 3]) == []
    assert issues([2, 3]) == ["warning"]
    assert issues([1, 3]) == ["error"]
    assert issues([1, 4, 1, 3]) == ["error", "error"]


def test_outline(spark):
    got = structure.outline_parents(heads(spark, [1, 2, 3, 2, 1, 3])).orderBy("ord").collect()
    assert [r.parent for r in got] == [None, 0, 1, 0, None, 4]


def test_coverage_grades(spark):
    got = spark.createDataFrame([(90.0,), (89.9,), (75.0,), (74.9,)], "p double").select(s.coverage_grade(F.col("p"))).collect()
    assert [r[0] for r in got] == ["ok", "warning", "warning", "error"]


def test_matcher(spark):
    df = spark.createDataFrame([(1, "a b\na b"), (2, "q\nq z w v u t"), (3, None), (4, "")], "doc_id long, text string")
    got = sorted(map(tuple, structure.block_element_match(df).collect()))
    assert got == [(1, 0, 0, 0), (1, 1, 1, 1), (2, 0, 0, 0), (2, 1, 1, 1)]


def test_lines_and_fences(spark):
    df = spark.createDataFrame([("a\r\nb  c \x0b\x85d", "```json\n{}\n```"), (None, "{}")], "x string, f string")
    got = df.select(t.lines(F.col("x")), t.strip_fences(F.col("f"))).collect()
    assert [tuple(r) for r in got] == [(["a", "b", "c", "d"], "{}"), ([], "{}")]


def test_headings_and_repeats(spark):
    df = spark.createDataFrame([(1, "Title\nABC\n123\nTitle\nlong line\nxy")], "doc_id long, text string")
    got = [(r.type, r.level, r.text) for r in elements.page_elements(df).orderBy("ord").collect()]
    assert got == [("heading", 1, "Title"), ("heading", 2, "ABC"), ("paragraph", None, "123"), ("paragraph", None, "long line")]


def test_analyzers_fall_back(spark):
    calls = lambda ok: lambda x: x.where(x.str.contains(ok), None).map(lambda v: None if v is None else f"{ok}:{v}")
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "doc_id long, text string")
    got = {r.doc_id: (r.answer, r.analyzer) for r in page_source(df, [calls("a"), calls("b")]).collect()}
    assert got == {1: ("a:a", 0), 2: ("b:b", 1), 3: (None, -1)}


def test_decode(spark):
    raw = [b"caf\xe9", b"\xfe\xff\x00a\x00b", b"\xff\xfea\x00", None]
    got = spark.createDataFrame([(r,) for r in raw], "b binary").select(s.decode_bytes("b")).toPandas().iloc[:, 0]
    assert [None if pd.isna(x) else x for x in got] == ["café", "ab", "a", None]
