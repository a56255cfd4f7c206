"""Blocks and runs of artifacts of instruction streams: against a plain loop, streams without a page, and what is shuffled."""

import random

from pyspark.sql import functions as F

from lectern.operators import pages, structure
from lectern.sources import tagging

INSTR = "page bigint, i bigint, op string, text string"
SHOW = ("Tj", "TJ", "'", '"')


def by_hand(rows):
    """(blocks, islands) of one page's (i, op, text), in order."""
    blocks, inside, begun = [], False, None
    for i, op, text in rows:
        if op == "BT":
            inside, begun, shown = True, i, []
        elif op == "ET" and inside:
            blocks.append(("text", begun, i, "".join(shown).strip()))
            inside = False
        elif op == "Do" and not inside:
            blocks.append(("image", i, i, ""))
        elif inside and op in SHOW:
            shown.append(text or "")
    islands, run = [], None
    for i, _, _ in rows:
        if any(first <= i <= last for _, first, last, _ in blocks):
            run = None
        elif run is None:
            islands.append(run := [i, i, 1])
        else:
            run[1:] = i, run[2] + 1
    return [(k, *b) for k, b in enumerate(sorted(blocks, key=lambda b: b[1]))], [tuple(x) for x in islands]


def streams(seed=3):
    rand = random.Random(seed)
    made = {p: [(i, rand.choice(["BT", "BT", "ET", "ET", "Do", "q", "Tj", "TJ", None]), rand.choice([" a", "b ", None, ""])) for i in sorted(rand.sample(range(90), rand.randint(0, 40)))] for p in range(60)}
    return made | {60: [(0, "ET", None), (1, "BT", None), (2, "Do", None), (3, "BT", "x"), (4, "Tj", "y")], 61: [(0, "BT", None)]}


def test_blocks_and_islands(spark):
    made = streams()
    rows = [(p, *x) for p, found in made.items() for x in found]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, INSTR).repartition(5)
    blocks, islands = {}, {}
    for r in structure.content_blocks(df).orderBy("page", "block").collect():
        blocks.setdefault(r.page, []).append((r.block, r.type, r.first, r.last, r.text))
    for r in structure.artifact_islands(df).orderBy("page", "first").collect():
        islands.setdefault(r.page, []).append((r.first, r.last, r.n))
    want = {p: by_hand(x) for p, x in made.items()}
    assert blocks == {p: b for p, (b, _) in want.items() if b} and islands == {p: x for p, (_, x) in want.items() if x}


def test_instructions_of_no_page(spark):
    """Their blocks have no text, and all of them are one run of artifacts, as a join by page has it."""
    df = spark.createDataFrame([(None, 0, "BT", None), (None, 1, "Tj", "a"), (None, 2, "ET", None), (None, 3, "Do", None)], INSTR)
    assert [tuple(r) for r in structure.content_blocks(df).orderBy("block").collect()] == [(None, 0, "text", 0, 2, ""), (None, 1, "image", 3, 3, "")]
    assert [tuple(r) for r in structure.artifact_islands(df).collect()] == [(None, 0, 3, 4)]


def test_images_at_one_place_stay_two(spark):
    df = spark.createDataFrame([(1, 0, "Do", None), (1, 0, "Do", None), (1, 1, "q", None)], INSTR)
    assert [(r.type, r.first, r.last) for r in structure.content_blocks(df).collect()] == [("image", 0, 0)] * 2


def test_pages_of_a_long_stream(spark):
    """Time grows with a page, not with its square."""
    df = spark.range(300_000).select(F.lit(1).cast("bigint").alias("page"), F.col("id").alias("i"), F.when(F.col("id") == 0, "BT").otherwise("q").alias("op"), F.lit(None).cast("string").alias("text"))
    assert [tuple(r) for r in structure.artifact_islands(df).collect()] == [(1, 0, 299_999, 300_000)]


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_instructions_are_shuffled_once(spark, tmp_path):
    spark.createDataFrame([(p, *x) for p, found in streams().items() for x in found], INSTR).write.parquet(f"{tmp_path}/instr")
    spark.createDataFrame([(1, [("P", ["a"])])], "page bigint, elements array<struct<tag: string, tokens: array<string>>>").write.parquet(f"{tmp_path}/elements")
    instr, elements = spark.read.parquet(f"{tmp_path}/instr"), spark.read.parquet(f"{tmp_path}/elements")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        assert shuffles(structure.content_blocks(instr)) == shuffles(structure.artifact_islands(instr)) == 1
        assert shuffles(tagging.spans(instr, elements)) == 3  # instructions for either, and elements
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_all_blocks_of_pages(spark):
    """Blocks that take nothing have nulls; pages without elements have all such."""
    block = [(0, "image", 0, 0, []), (1, "text", 2, 4, ["a"]), (2, "text", 6, 8, ["z"])]
    schema = "page bigint, blocks array<struct<block: int, type: string, first: bigint, last: bigint, tokens: array<string>>>, elements array<struct<tag: string, tokens: array<string>>>"
    df = spark.createDataFrame([(1, block, [("H1", ["a"])]), (2, block, None), (None, block, None)], schema)
    got = sorted((tuple(r) for r in pages.assign(df, every=True).collect()), key=str)
    places = [(0, 0), (2, 4), (6, 8)]
    assert got == sorted([(1, 0, 0, "Figure", 0), (1, 2, 4, "H1", 1), (1, 6, 8, None, None), *((p, *x, None, None) for p in (2, None) for x in places)], key=str)
    assert sorted(tuple(r) for r in pages.assign(df.where("page = 1")).collect()) == [(1, 0, "Figure", 0), (1, 1, "H1", 1)]
