"""File sets at size: names in lists, files dealt out to tasks by number and bytes; files of documents made from their rows."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern.operators import elements, pages, structure
from lectern.sources import content, docx, files, pdf, tagging

ODD = ["", None, " \n\t", "TITLE\n\x0b a \r\nB B\x85c   d\x1c", "x" * 80 + "\n" + "É" * 3 + "\nß\nAB", "one\nONE\none\n　two  three ", "\x1f\na(\\)b\tc\n語 ü"]


def test_small_files_share_a_task(spark, tmp_path):
    files.write_files(spark.range(400).select(F.col("id").cast("string").alias("name"), F.encode(F.col("id").cast("string"), "UTF-8").alias("content")), str(tmp_path))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16m")
    try:
        found = files.read_files(spark, str(tmp_path))
        assert found.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
        assert {(r.name, bytes(r.content)) for r in found.collect()} == {(str(k), str(k).encode()) for k in range(400)}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_tagged_files_write_files_alone(spark, tmp_path, monkeypatch):
    """Neither instructions nor pages are written on the way, and nothing is joined but texts and sizes."""
    kinds = []
    monkeypatch.setattr(pdf, "folder", lambda spark, kind: kinds.append(kind) or f"{tmp_path}/{kind}")
    monkeypatch.setattr(content, "folder", lambda spark, kind: kinds.append(kind) or f"{tmp_path}/{kind}")
    monkeypatch.setattr("lectern.sources.shared.folder", lambda spark, kind: kinds.append(kind) or f"{tmp_path}/{kind}-{len(kinds)}")
    assert pdf.tagged_files(spark, "/root/testdata/sf0.001").where("tag = 'H1'").count() > 0
    assert kinds == ["files"]


def test_parts_of_a_text_are_those_of_the_table(spark):
    docs = spark.createDataFrame(list(enumerate(ODD)), "doc_id int, text string")
    want = {r.doc_id: ([(h.level, h.text) for h in r.heads], [p.text for p in r.paragraphs]) for r in elements.parts(docs).collect()}
    lines = {r.doc_id: r.x for r in elements.text_lines(docs).groupBy("doc_id").agg(F.expr("transform(array_sort(collect_list(struct(line_no, line))), y -> y.line) as x")).collect()}
    for k, x in enumerate(ODD):
        own, *rest = elements.parts_of(x)
        assert tuple(rest) == want[k] and own == lines.get(k, []) and all(pdf._quoted(y) == spark.range(1).select(content._quoted(F.lit(y))).first()[0] for y in own)


def test_a_page_is_tagged_as_the_table_of_pages(spark):
    made = [("H1", ["a", "b"]), ("P", ["c"]), ("P", ["a", "c", "d"])]
    streams = [
        b"q BT (A b) Tj [(c) -1 ( d)] TJ ET Q /Im Do BT (zz) ' ET", b"BT BT (c) Tj ET ET (x) Tj Do", b"/P <</MCID 3>> BDC BT 1 2 (a C D) \" /Im Do ET EMC", b"", b"BT (c) Tj",
        b"Do Do w BT ET BT (a) Tj (B) Tj ET (", b"/A BMC EMC", b"BT [(a) 1 [(b)] <63>] TJ /x TJ Tj ET w w",
    ]
    table = spark.createDataFrame([(k, bytearray(x)) for k, x in enumerate(streams)], "page bigint, content binary")
    own = spark.createDataFrame([(k, made) for k in range(len(streams))], "page bigint, elements array<struct<tag: string, tokens: array<string>>>")
    spans = tagging.spans(tagging.plain(content.written(table)), own)
    want = {r.page: (bytes(r.content), r.error) for r in tagging.rewritten(table, spans).collect()}
    marks = {r.page: sorted(tuple(x) for x in r.m) for r in spans.where("mcid is not null").groupBy("page").agg(F.collect_list(F.struct("mcid", "tag")).alias("m")).collect()}
    for k, x in enumerate(streams):
        if want[k][1]:
            with pytest.raises(content.StreamError, match=want[k][1]):
                tagging.tagged_page(x, made)
        else:
            data, found = tagging.tagged_page(x, made)
            assert data == want[k][0] and sorted(found) == marks.get(k, [])


@settings(max_examples=20, deadline=None)
@given(st.lists(st.integers(1, 6), max_size=12))
def test_links_of_headings(spark, levels):
    entries, count = pdf.linked([(3 * k, level, "t", 1) for k, level in enumerate(levels)])
    heads = spark.createDataFrame([(1, 3 * k, level) for k, level in enumerate(levels)], "doc int, ord int, level int")
    keys = ("ord", "parent", "prev", "next", "first", "last")
    assert sorted(str([e[k] for k in keys]) for e in entries) == sorted(str([r[k] for k in keys]) for r in structure.outline_links(heads).collect())
    assert count == next((r.count_written for r in structure.outline_counts(heads).collect()), 0)


def test_sizes_of_a_document(spark):
    lines = spark.createDataFrame([(1, 2, 1.0), (1, 2, 30.0), (1, 3, None), (2, 1, 5.0), (None, 1, 5.0)], "l_orderkey bigint, l_linenumber int, l_quantity double")
    got = {r.doc_id: sorted(map(tuple, r.sizes)) for r in pages.sizes_by_document(lines).collect()}
    assert got == {1: [(2, 11.0, 11.0), (3, 11.0, 11.0)], 2: [(1, 8.5, 11.0)]}


def test_text_of_marks():
    data = b"BT (no) Tj /P <</MCID 2>> BDC (a) Tj /Span <</X 1>> BDC [(b) 1 (c)] TJ EMC (no) Tj /P <</MCID 0>> BDC (d) Tj /Q BMC (no) Tj EMC /P <</MCID 5>> BDC (e) Tj (f"
    assert pdf.shown_by_mark(data) == {2: "abc", 0: "d", 5: "e"}


def test_packages_are_not_sent_to_the_driver(spark):
    """The report's join knows the lists of names alone, yet deals packages and texts out by document."""
    plan = docx.package_report(spark, "/root/testdata/sf0.001")._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_the_manifest_holds_no_names(spark, tmp_path):
    files.write_files(spark.range(0, 3000, 1, 3).select(F.concat(F.lit("name-"), F.col("id").cast("string")).alias("name"), F.lit(b"x").alias("content")), str(tmp_path))
    (made,) = tmp_path.glob("manifest-*.json")
    assert len(made.read_text()) < 1000 and sum(a["n"] for a in json.loads(made.read_text())["attempts"]) == 3000
    assert files.manifest(spark, str(tmp_path)).where("name like 'name-%' and path like concat('%/', name)").select("name").distinct().count() == 3000
    with pytest.raises(ValueError, match="2 names come more than once, such as 'a'"):
        files.write_files(spark.createDataFrame([(n, b"") for n in "abcab"], "name string, content binary").repartition(5), str(tmp_path))
    assert len(list(tmp_path.iterdir())) == 2 and files.manifest(spark, str(tmp_path)).count() == 3000
