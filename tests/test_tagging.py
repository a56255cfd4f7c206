"""Marks in content streams: bytes by hand, any stream's instructions kept, faults, pages without elements."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern.sources import content, tagging

ELEMENTS = "page bigint, elements array<struct<tag: string, tokens: array<string>>>"
PARTS = [b"BT", b"ET", b"(a\\)(b)) Tj", b"[(x) -1.50 <FEFF0041>] TJ", b"q", b"/Im#31 Do", b"BI /W 1 ID \x00(EIx] EI", b"% note\n1 0 0 1 .5 +2 cm", b"/Span <</MCID 3 /L [1 (EMC)]>> BDC", b"EMC", b"/P BMC", b"/X MP", b"1 2 (w) \""]


def mark(first, last, tag, mcid=None):
    return {"first": first, "last": last, "tag": tag, "mcid": mcid}


def bare(data):
    return [x for x in content.instructions(data) if x[0] not in tagging.MARKS]


def test_bytes_by_hand():
    data = b"q /A <</MCID 1>> BDC BT (EMC \\( x) Tj % no\n ET EMC BI /W 1 ID \xff(EIx EI  Q"
    assert tagging.rewrite(data, [mark(0, 0, "Artifact"), mark(2, 4, "H1", 0), mark(6, 7, "Artifact")]) == b"\n".join(
        [b"/Artifact BMC", b"q", b"EMC", b"/H1 <</MCID 0>> BDC", b"BT", b"(EMC \\( x) Tj", b"ET", b"EMC", b"/Artifact BMC", b"BI /W 1 ID \xff(EIx EI", b"Q", b"EMC"]
    )
    assert tagging.rewrite(b"", []) == tagging.rewrite(b" /A BMC EMC % x", []) == b""


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(PARTS)), st.sampled_from([b" ", b"\n", b"\r\n%c\n"]))
def test_all_else_is_kept(parts, between):
    data = between.join(parts)
    found = list(content.instructions(data))
    marks = [mark(i, i, "P", i) for i, x in enumerate(found) if x[0] not in tagging.MARKS]
    out = list(content.instructions(tagging.rewrite(data, marks)))
    assert [x for x in out if x[0] not in tagging.MARKS] == bare(data)
    assert [x[0] for x in out] == [y for x in bare(data) for y in ("BDC", x[0], "EMC")]


def test_pages(spark):
    title, line = b"BT (The Title) Tj ET", b"BT [(one ) -20 (line) [true null] (more)] TJ ET"
    streams = {1: title + b" /Im0 Do\n" + line, 2: title + b" (never closed", 3: title, 4: None, 5: b"/A BMC EMC", 6: b"/Im0 Do " + title}
    df = spark.createDataFrame([(k, None if x is None else bytearray(x)) for k, x in streams.items()], "page bigint, content binary")
    own = [("H1", ["the", "title"]), ("P", ["one", "linemore"])]
    elements = spark.createDataFrame([(1, own), (2, own), (6, None)], ELEMENTS)
    instr = tagging.plain(content.written(df))
    assert {r.text for r in instr.where("op = 'TJ'").collect()} == {"one linemore"}
    out = {r.page: (bytes(r.content), r.error) for r in tagging.rewritten(df, tagging.spans(instr, elements)).collect()}
    assert out[1] == (b"/H1 <</MCID 0>> BDC\nBT\n(The Title) Tj\nET\nEMC\n/Figure <</MCID 1>> BDC\n/Im0 Do\nEMC\n/P <</MCID 2>> BDC\nBT\n[(one ) -20 (line) [true null] (more)] TJ\nET\nEMC", None)
    assert out[2] == (streams[2], "string without its end")
    assert out[3] == (b"/Artifact BMC\nBT\n(The Title) Tj\nET\nEMC", None)
    assert out[4] == out[5] == (b"", None)
    assert out[6][0].count(b"/Artifact BMC") == 2 and b"MCID" not in out[6][0]


def test_no_pages(spark):
    df = spark.createDataFrame([], "page bigint, content binary")
    instr = tagging.plain(content.written(df))
    assert tagging.rewritten(df, tagging.spans(instr, spark.createDataFrame([], ELEMENTS))).count() == 0


def test_large_stream(spark):
    data = b"\n".join(b"BT (line %d of a page) Tj ET" % k for k in range(100_000))
    df = spark.createDataFrame([(1, bytearray(data))], "page bigint, content binary")
    out = tagging.rewritten(df, tagging.spans(tagging.plain(content.written(df)), spark.createDataFrame([], ELEMENTS)))
    assert out.select(F.length("content").alias("n"), "error").collect() == [(len(data) + 100_000 * 18, None)]
