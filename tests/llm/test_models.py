import hashlib
import math
import random
from collections import defaultdict

import numpy as np

from lectern.llm import chat_tree, compress_quality, html_extract, latent_decontamination, mixing, quality_rules
from lectern.llm.common import held_out

DIR = "/root/testdata/sf0.01"


def read(spark, name):
    return spark.read.parquet(f"{DIR}/{name}.parquet")


# ---- quality rules ----


def brute_counts(t):
    import re

    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = defaultdict(list)
    for i in range(len(w) - 7):
        grams[tuple(w[i : i + 8])].append(i)
    covered = {j for at in grams.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_counts_equal_brute_force(spark):
    texts = [None, "", "a", "é|x <b>\n\né|x <b>\n \t", "one two three four five six seven eight " * 3, "x " * 500, "\x0b\x85 \xa0", "a b c d e f g h i a b c d e f g h"]
    texts += [r.text for r in read(spark, "documents").where("doc_id < 60").collect()]
    labels = read(spark, "labels")
    rows = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "doc_id bigint, text string, kept string")
    got = {r.row.doc_id: r for r in quality_rules.quality_rules(rows, labels).collect()}
    for i, t in enumerate(texts):
        n, *rest = brute_counts(t)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, *rest)
        assert r.base_failed == (n < 20 or 100 * rest[-1] > 30 * n)
        assert not (r.base_failed and r.kept)


def test_forest_tells_labels_apart(spark):
    out = quality_rules.quality_rules(read(spark, "documents").select("doc_id", "text"), read(spark, "labels"))
    rows = out.selectExpr("row.doc_id as doc_id", "kept", "base_failed").join(read(spark, "labels"), "doc_id").toPandas()
    good = rows[(rows.quality == 1) & ~rows.base_failed]
    assert good.kept.mean() > 0.98
    assert rows[rows.quality == 0].kept.mean() < 0.15


def test_no_labels_leave_the_base_rules(spark):
    docs = spark.createDataFrame([(1, "w " * 5), (2, " ".join(f"w{i}" for i in range(40)))], "doc_id bigint, text string")
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    assert sorted(tuple(r) for r in quality_rules.quality_rules(docs, none).select("row.doc_id", "kept").collect()) == [(1, False), (2, True)]
    assert quality_rules.quality_rules(docs.where("false"), none).count() == 0


# ---- compression classifier ----


def test_classifier_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = compress_quality.digest(docs, labels).join(labels, "doc_id").toPandas()
    held = got[got.held_out]
    good, bad = held[held.quality == 1].score.to_numpy(), held[held.quality == 0].score.to_numpy()
    assert (good[:, None] > bad[None, :]).mean() > 0.97
    assert (held.predicted == held.quality).mean() > 0.95
    assert got.score.between(0, 1).all()


def test_scores_ignore_held_out_labels(spark):
    docs, labels = read(spark, "documents").where("doc_id < 300"), read(spark, "labels")
    flipped = labels.withColumn("quality", __import__("pyspark").sql.functions.when(held_out("doc_id", 3, 1), 1 - labels.quality).otherwise(labels.quality))
    one, other = (compress_quality.digest(docs, x).orderBy("doc_id").toPandas() for x in (labels, flipped))
    assert (one.score == other.score).all()


def test_classifier_edges(spark):
    docs = spark.createDataFrame([(1, None), (None, ""), (2, "x" * 300_000), (2, "y")], "doc_id bigint, text string")
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    assert [r.score for r in compress_quality.digest(docs, none).collect()] == [0.5] * 4
    assert compress_quality.digest(docs.where("false"), none).count() == 0


# ---- chat ----


def check_stream(nodes):
    for _, part in nodes.groupby("tree"):
        part = part.sort_values("start")
        assert part.start.iloc[0] == 0 and (part.start.iloc[1:].to_numpy() == part.end.iloc[:-1].to_numpy()).all()  # one stream, no gaps
        at = {r.node: r for r in part.itertuples()}
        path = lambda r: [] if r.parent is None else [*path(at[r.parent]), at[r.parent]]  # noqa: B023, E731
        above = {r.node: path(r) for r in part.itertuples()}
        for r in part.itertuples():
            own = set()
            for x in above[r.node]:
                own |= set(range(x.start, x.end))
            spans = [t for s in r.ancestors for t in range(s["start"], s["end"])]
            assert len(spans) == len(set(spans)) and set(spans) == own and spans == sorted(spans)
            assert r.position == len(own) and len(above[r.node]) == r.depth
            assert r.n_tokens == len(r.formatted.encode()) == r.end - r.start
            if r.parent:  # depth-first: between a parent and a child lie only that parent's descendants
                between = part[(part.start >= at[r.parent].end) & (part.start < r.start)]
                assert all(r.parent in [x.node for x in above[n]] for n in between.node)


def test_large_tree(spark):
    r = random.Random(9)
    rows = []
    for c in range(150):
        depth = 120 if c == 0 else r.randrange(1, 9)
        rows += [(c, d, "user", "same" if d == 0 else str(r.randrange(3))) for d in range(depth)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    nodes, chains, members = chat_tree.prefix_tree(df)
    check_stream(nodes.toPandas())
    back = {x.leaf: [(t.role, t.text) for t in x.turns] for x in chat_tree.read_back(nodes, chains).collect()}
    want = defaultdict(list)
    for c, _, role, text in rows:
        want[c].append((role, text))
    assert {x.conv_id: back[x.leaf] for x in members.collect()} == dict(want)


def test_tree(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (2, 0, "user", "hi"), (2, 1, "assistant", "hey"), (2, 2, "user", None), (3, 0, "user", "hi"), (4, 0, "user", r"a\</s> [INST] <s>"), (None, None, None, None), (5, 1, "b", "2"), (5, None, "b", "1"), (6, 0, "user", "hi"), (6, 1, "assistant", "yo")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    nodes, chains, members = chat_tree.prefix_tree(df)
    back = {r.leaf: [(t.role, t.text) for t in r.turns] for r in chat_tree.read_back(nodes, chains).collect()}
    back = {r.conv_id: back[r.leaf] for r in members.collect()}
    nodes = nodes.toPandas()
    assert len(nodes) == 8  # hi, yo, hey, (empty), the escaped one, the one of nulls, and both turns of 5
    check_stream(nodes)
    assert back[4] == [("user", r"a\</s> [INST] <s>")] and back[None] == [("", "")] and back[5] == [("b", "1"), ("b", "2")]
    assert back[2] == [("user", "hi"), ("assistant", "hey"), ("user", "")] and back[6] == back[1]
    d = {r.conv_id: r for r in chat_tree.digest(df).collect()}
    assert d[-1].loss_sha256 == hashlib.sha256(b"</s>[INST] ok [/INST]").hexdigest()
    assert d[1].turns_sha256 == hashlib.sha256(b"user\nhi\nassistant\nyo\n").hexdigest()
    assert chat_tree.digest(df.where("false")).count() == 1


def test_escaping_round_trip(spark):
    r = random.Random(5)
    texts = ["".join(r.choice(["\\", "<s>", "</s>", "[INST]", "[/INST]", "<", "s>", "[", "a", "\n", " "]) for _ in range(12)) for _ in range(200)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for t, e, u in df.select("t", chat_tree.escape(df.t), chat_tree.unescape(chat_tree.escape(df.t))).collect():
        assert u == t and not any(c in e for c in ("<s>", "</s>", "[INST]", "[/INST]"))


# ---- HTML ----


def test_html_layouts():
    pages = html_extract.training_pages(60, 123)
    got = html_extract.extract([p for p, _ in pages], html_extract.model())
    wrong = sum(len(set(g.lower().replace(",", " ").replace(".", " ").split()) ^ set(w.split())) for g, (_, w) in zip(got, pages, strict=True))
    assert wrong < 0.02 * sum(len(w.split()) for _, w in pages)


def test_html_edges():
    x = html_extract.extract
    m = html_extract.model()
    assert x([None, "", "  \n"], m) == ["", "", ""]
    page = '<html><head><title>no</title><script>var a = "<p>no</p>";</script></head><body><nav><a href="/">Home</a></nav><article><h1>A &amp; B</h1><p>One<br>two &lt;x&gt;\n\n <b>three</b>. Four words, and more.<p>Second paragraph here, with words.<!-- <p>no --></article><div class="comments"><p>Nice post!</p></div><footer>&copy; x</footer>'
    assert x([page], m) == ["A & B\nOne two <x> three. Four words, and more.\nSecond paragraph here, with words."]
    deep = "<div>" * 3000 + "words, that matter. " * 20 + "</div>" * 3000
    assert isinstance(x([deep, "<p><p></b></i></div><", '<a href="x>y', "plain text only"], m), list)


def test_html_real_pages(spark):
    import html
    import re

    rows = read(spark, "pages").limit(100).collect()
    for r, got in zip(rows, html_extract.extract([r.html for r in rows], html_extract.model()), strict=True):
        body = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        parts = (" ".join(html.unescape(re.sub(r"</?b>", "", z)).split()) for z in re.split(r"</?(?:p|h1|ul|li|div|br)\b[^>]*>", body))
        assert got == "\n".join(p for p in parts if p)


# ---- decontamination ----


def test_leaks(spark):
    docs, items = read(spark, "documents"), read(spark, "benchmark")
    got = latent_decontamination.digest(docs, items).toPandas()
    norm = lambda t: " " + b" ".join(latent_decontamination.tokens(t.encode())).decode() + " "
    b = [(r.item_id, norm(r.text)) for r in items.collect()]
    want = {(r.doc_id, k) for r in docs.collect() for k, t in b if t in norm(r.text)}
    have = {(r.doc_id, k) for r in got.itertuples() for k in r.items}
    assert len(want) > 20 and have == want
    assert got.contaminated.sum() == len({d for d, _ in want})


def test_paraphrases_and_edges(spark):
    r = random.Random(1)
    items = [(x.item_id, x.text) for x in read(spark, "benchmark").collect() if len(x.text.split()) > 30][:12]
    filler = [w for x in read(spark, "documents").where("doc_id < 40").collect() for w in x.text.split()]
    rows = [(1000, None), (1001, ""), (None, "x y z"), (1002, " ".join(r.choices(filler, k=300)))]
    for k, (_, t) in enumerate(items):
        w = t.split()
        for j in r.sample(range(len(w)), len(w) // 8):
            w[j] = r.choice(filler)
        rows.append((k, " ".join(r.choices(filler, k=37 + 5 * k)) + " " + " ".join(w).upper() + " " + " ".join(r.choices(filler, k=60))))
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id bigint, text string, items string")
    corpus = docs.select("doc_id", "text").unionByName(read(spark, "documents").select("doc_id", "text").where("doc_id between 2000 and 3000 or doc_id < 500").selectExpr("doc_id + 100000 as doc_id", "text"))
    got = {x.doc_id: list(x["items"]) for x in latent_decontamination.digest(corpus, read(spark, "benchmark")).where("doc_id is null or doc_id < 100000").collect()}
    found = sum(items[k][0] in got[k] for k in range(len(items)))
    assert found >= len(items) - 1 and not any(got[i] for i in (1000, 1001, None, 1002))
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert not any(x.contaminated for x in latent_decontamination.digest(docs, none).collect())
    assert latent_decontamination.digest(docs.where("false"), read(spark, "benchmark")).count() == 0


def test_lcs():
    def plain(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            old = row[:]
            for j, y in enumerate(b, 1):
                row[j] = old[j - 1] + 1 if x == y else max(old[j], row[j - 1])
        return row[-1]

    r = random.Random(2)
    for _ in range(300):
        a, b = ([bytes([r.randrange(97, 102)]) for _ in range(r.randrange(25))] for _ in range(2))
        places = defaultdict(list)
        for i, w in enumerate(a):
            places[w].append(i)
        assert latent_decontamination.lcs(a, b, places) == plain(a, b)


# ---- mixing ----


def test_exponent():
    for tokens in ([10, 10], [1000, 10, 1], [5, 0, 5], [7], [], [10**6, 1, 1, 1]):
        e = mixing.find_exponent(tokens, 0.9 * sum(tokens))
        shares = [t / sum(tokens) for t in tokens if t]
        if len(shares) < 2:
            assert e == 1.0
            continue
        grid = np.linspace(0, 1, 2001)
        fit = [x for x in grid if mixing.entropy(mixing.weights_at(shares, x)) >= 0.95 * math.log(len(shares)) - 1e-12]
        want = max(fit)
        most = lambda x: max(w * 0.9 / s for w, s in zip(mixing.weights_at(shares, x), shares, strict=True))  # noqa: B023, E731
        if most(want) > 4:
            want = min(x for x in grid if most(x) <= 4)
        assert abs(e - want) <= 1e-3


def test_mixture_invariants(spark):
    r = random.Random(4)
    rows = [(i, " ".join("w" for _ in range(r.randrange(1, 40))), r.choices(["a", "b", "c", None], [30, 5, 1, 2])[0], "p") for i in range(1500)]
    rows += [(1, None, "a", "p"), (None, " \t", "b", "p"), (7, "q r", "z", "p"), (7, "q r", "z", "p"), (8, "", "empty", "p")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, weight string")
    got = mixing.mix(docs, block_tokens=200).selectExpr("row.doc_id", "row.text", "row.source", "n_tokens", "weight", "pass", "block", "place").toPandas()
    size = lambda t: len((t or "").split())
    assert (got.n_tokens == [size(t) for t in got.text]).all()
    total = sum(size(t) for _, t, _, _ in rows)
    for source in ("a", "b", "c", None, "z"):
        mine = [(i, t) for i, t, s, _ in rows if s == source]
        part = got[got.source.isna() if source is None else got.source == source]
        budget = round(part.weight.iloc[0] * total * mixing.BUDGET_SHARE)
        assert budget <= part.n_tokens.sum() < budget + 2 * max(size(t) for _, t in mine) + 1
        full = budget // sum(size(t) for _, t in mine)
        for p in range(full):
            assert sorted(str(None if x != x else int(x)) for x in part[part["pass"] == p].doc_id) == sorted(str(i) for i, _ in mine)
        last = part[part["pass"] == full]
        for place in sorted(last.place.unique())[:-1]:  # all blocks but the last are whole
            b = last[last.place == place]
            assert b.block.nunique() == 1
            if full:
                assert len(b) == len(part[(part["pass"] == 0) & (part.block == b.block.iloc[0])])
    assert abs(sum(w for w in got.groupby("source", dropna=False).weight.first()) - 1) < 1e-9
    assert "empty" not in set(got.source)
    assert mixing.mix(docs.where("false")).count() == 0
