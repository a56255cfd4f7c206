"""Tagged files: a round trip, a file as others write it, broken files, and what an independent reader of objects sees."""

import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.sources import pdf
from lectern.sources.content import StreamError


def entry(ord_, text, page, **links):
    return {"ord": ord_, "text": text, "page": page} | {k: links.get(k) for k in ("parent", "prev", "next", "first", "last")}


LEAVES = [
    {"w": 612.0, "h": 792.0, "content": b"BT ET", "marks": [{"mcid": 0, "tag": "H1"}, {"mcid": 2, "tag": "P"}]},
    {"w": 792.0, "h": 612.0, "content": None, "marks": []},
]
OUTLINE = [entry(5, "A (b)\\", 1, next=9, first=7, last=7), entry(7, "Ünï 語", 2, parent=5), entry(9, "", 2, prev=5)]


def test_round_trip():
    one, two = pdf.scan(pdf.pack("Tïtle (x) 語", "en-US", LEAVES, OUTLINE, 3))
    facts = {"title": "Tïtle (x) 語", "lang": "en-US", "marked": True, "n_pages": 2, "n_elements": 2, "n_outline": 3, "outline_count": 3, "error": None}
    assert one == {"page": 1, "w": 8.5, "h": 11.0, "content": b"BT ET", "slots": ["H1", None, "P"], **facts}
    assert two == {"page": 2, "w": 11.0, "h": 8.5, "content": b"", "slots": [], **facts}


def test_objects_by_plain_search():
    """Places in the table, links and the metadata, without the reader."""
    data = pdf.pack("T & t", None, LEAVES, OUTLINE, 3)
    start = int(re.search(rb"startxref\n(\d+)", data)[1])
    assert data[start : start + 4] == b"xref"
    places = [int(x) for x in re.findall(rb"(\d{10}) 00000 n ", data[start:])]
    assert [data[p:].split(b" ", 1)[0] for p in places] == [b"%d" % k for k in range(1, len(places) + 1)]
    body = {k: data[p : data.index(b"endobj", p)] for k, p in enumerate(places, 1)}
    assert b"/Lang" not in body[1] and b"/DisplayDocTitle true" in body[1] and b"/Marked true" in body[1]
    about = body[int(re.search(rb"/Metadata (\d+)", body[1])[1])]
    xmp = zlib.decompress(about[about.index(b"stream\n") + 7 : about.rindex(b"\nendstream")])
    assert b">T &amp; t<" in xmp and b"<pdfuaid:part>1<" in xmp
    items = [b for b in body.values() if b"/Dest" in b]
    assert [len(re.findall(rb"/(?:Prev|Next|First|Last) ", b)) for b in items] == [3, 0, 1]
    assert body[int(re.search(rb"/Parent (\d+)", items[1])[1])] == items[0]


@settings(max_examples=100, deadline=None)
@given(st.text(), st.lists(st.tuples(st.binary(max_size=50), st.sets(st.integers(0, 6))), min_size=1, max_size=5))
def test_any_pages(title, made):
    title = title.encode("utf-16", "replace").decode("utf-16")
    rows = list(pdf.scan(pdf.pack(title, "de", [{"w": 100.0, "h": 50.5, "content": c, "marks": [{"mcid": i, "tag": "P"} for i in sorted(m)]} for c, m in made], [], 0)))
    assert [r["content"] for r in rows] == [c for c, _ in made] and {r["title"] for r in rows} == {title}
    assert [[i for i, x in enumerate(r["slots"]) if x] for r in rows] == [sorted(m) for _, m in made]


def by_hand(objects, trailer=b"", start=b"%PDF-1.4\n", prev=None):
    out, at = bytearray(start), {}
    for n, body in objects.items():
        at[n] = len(out)
        out += b"%d 0 obj %b endobj\n" % (n, body)
    table = b"".join(b"%d 1\n%010d 00000 n \n" % (n, p) for n, p in at.items())
    place = len(out)
    return bytes(out + b"xref\n" + table + b"trailer <<%b%b>>\nstartxref\n%d\n%%%%EOF" % (trailer, b" /Prev %d" % prev if prev else b"", place)), place


TREE = {
    1: b"<</Pages 2 0 R /Lang (en\\055GB) /StructTreeRoot <</ParentTree <</Kids [9 0 R]>>>>>>", 2: b"<</Kids [3 0 R 4 0 R] /MediaBox [0 0 720 360]>>",
    3: b"<</Kids [5 0 R]>>", 4: b"<</MediaBox [10 10 82 82] /Contents [6 0 R 7 0 R] /StructParents 4>>", 5: b"<</Contents 6 0 R>>",
    6: b"<</Length 8 0 R>> stream\r\n(a) Tj\nendstream", 7: b"<</Length 2>>\nstream\nET\nendstream", 8: b"6", 9: b"<</Nums [4 [10 0 R 77 0 R]]>>", 10: b"<</S /H2>>", 11: b"<</Title <FEFF0041>>>",
}


def test_a_file_as_others_write_it():
    data, place = by_hand(TREE, b"/Root 1 0 R /Info 11 0 R")
    one, two = pdf.scan(data)
    assert (one["w"], one["h"], one["content"], one["slots"], one["lang"], one["title"], one["marked"]) == (10, 5, b"(a) Tj", [], "en-GB", "A", False)
    assert (two["w"], two["h"], two["content"], two["slots"]) == (1, 1, b"(a) Tj\nET", ["H2", None])
    # changed later: the newer object counts, and the rest is found by the older table
    newer, _ = by_hand({7: b"<</Length 1>>\nstream\nQ\nendstream"}, b"/Root 1 0 R", data + b"\n", place)
    assert [r["content"] for r in pdf.scan(newer)] == [b"(a) Tj", b"(a) Tj\nQ"]


@pytest.mark.parametrize(
    "data, message",
    [
        (b"", "no table of objects"), (b"GIF89a", "no table of objects"), (b"%PDF-1.5\n9 0 obj<</Type /XRef>>stream\nx\nendstream\nstartxref\n9\n%%EOF", "no table of objects"),
        (by_hand(TREE | {3: b"<</Kids [2 0 R]>>"}, b"/Root 1 0 R")[0], "pages that aren't a tree"), (by_hand(TREE | {6: b"<</Length 3 /Filter /LZWDecode>> stream\nabc\nendstream"}, b"/Root 1 0 R")[0], "filter /LZWDecode"),
        (by_hand({1: b"1 0 R"}, b"/Root 1 0 R")[0], "references without an end"), (pdf.pack("t", "en", LEAVES, [], 0)[:-200], "no table of objects"),
    ],
)
def test_broken_files(data, message):
    with pytest.raises(StreamError, match=message):
        list(pdf.scan(data))


def test_rows_of_files(spark):
    good = pdf.pack("t", "en", LEAVES, OUTLINE, 3)
    half = by_hand(TREE | {7: b"<</Length 2 /Filter /Odd>>\nstream\nET\nendstream"}, b"/Root 1 0 R")[0]
    files = [("a", good), ("b", half), ("c", None), ("d", b"%PDF"), ("e", good.replace(b"/Kids", b"/Kidz"))]
    rows = pdf.read_pages(spark.createDataFrame([(n, None if x is None else bytearray(x)) for n, x in files], "name string, content binary")).collect()
    assert sorted((r.name, r.page or 0, r.error or "") for r in rows) == [("a", 1, ""), ("a", 2, ""), ("b", 0, "filter /Odd"), ("b", 1, ""), ("c", 0, "no table of objects"), ("d", 0, "no table of objects"), ("e", 1, "")]
    assert pdf.read_pages(spark.createDataFrame([], "name string, content binary")).count() == 0


def test_documents_with_odd_rows(spark):
    docs = spark.createDataFrame([(1, "TITLE\n" + "\n".join(f"line {k} of it" for k in range(45)), None, "s", 9), (2, None, "en", "s", 0), (3, "", "en", "s", 0), (4, "x\n(\\) ü 語\x0b", "", None, 3), (5, "same\nsame\nsame", "de", "s", 3)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    lines = spark.createDataFrame([(1, 2, 1.0)], "l_orderkey bigint, l_linenumber int, l_quantity double")
    files = pdf.tagged(docs, lines.withColumn("l_quantity", lines.l_quantity + 40))
    rows = {(r.doc_id, x["page"]): x for r in files.collect() for x in pdf.scan(bytes(r.content))}
    assert sorted(rows) == [(1, 1), (1, 2), (1, 3), (4, 1), (5, 1)]
    assert (rows[1, 1]["title"], rows[1, 1]["lang"], rows[1, 1]["w"], rows[1, 2]["w"]) == ("TITLE", "en-US", 8.5, 11.0)
    assert rows[1, 1]["slots"][0] == "H1" and all(x["error"] is None for x in rows.values())
    assert b"/H1 <</MCID 0>> BDC" in rows[1, 1]["content"] and rows[1, 1]["content"].startswith(b"/Artifact BMC\n0.5 w\nEMC")
