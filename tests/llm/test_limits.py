"""Long texts, hubs, tables without ids, and plain versions of what SQL can't say."""

import hashlib
import itertools
import math
import random
import resource
import zlib

import numpy as np
import pytest
import zstandard

from lectern.llm import chat_tree, common, compress_quality, ctw_scoring, html_extract, latent_decontamination, line_dedup, quality_rules, simhash_dedup

from .test_dedup import brute_lines, fingerprint
from .test_models import brute_counts


def peak_mb():
    return resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024


def long_text(mb, seed=1):
    r = random.Random(seed)
    line = [" ".join(r.choice("abcdefgh") * r.randrange(1, 9) + str(r.randrange(10_000)) for _ in range(12)) for _ in range(5000)]
    return "\n".join(r.choice(line) for _ in range(mb << 14))[: mb << 20]


# ---- pieces ----


def test_pieces():
    r = random.Random(1)
    for _ in range(300):
        t = "".join(r.choice("ab \n") for _ in range(r.randrange(60))).encode()
        size = r.randrange(1, 9)
        assert b"".join(common.word_pieces(t, size)) == t
        assert [w for p in common.word_pieces(t, size) for w in p.split()] == t.split()
        assert b"\n".join(common.line_pieces(t, size)) == t


def test_fingerprints_in_pieces(monkeypatch):
    r = random.Random(2)
    docs = [" ".join(r.choice("ABcd") + str(r.randrange(50)) for _ in range(n)) for n in (0, 1, 3, 4, 5, 70, 400, 1000)] + ["x" * 3000, " \t\n"]
    want = [fingerprint(t) for t in docs]
    for size, counted in ((1 << 20, 1 << 15), (50, 7), (7, 1)):
        monkeypatch.setattr(simhash_dedup, "word_pieces", lambda t, size=size: common.word_pieces(t, size))
        monkeypatch.setattr(simhash_dedup, "COUNTED", counted)
        assert simhash_dedup.fingerprints([t.encode() for t in docs]).tolist() == want


def test_a_long_text_takes_little_memory():
    text = long_text(40).encode()
    before = peak_mb()
    simhash_dedup.fingerprints([text])
    assert peak_mb() - before < 400
    before = peak_mb()
    quality_rules.counts([text])
    assert peak_mb() - before < 1500


def test_counts_of_long_texts():
    text = long_text(2) + "\n" + long_text(1)
    c = quality_rules.counts([b"a b", text.encode(), b""])[:, :5].tolist()
    assert c[0] == list(brute_counts("a b")) and c[2] == [0] * 5
    assert c[1] == list(brute_counts(text))


# ---- lines ----


def test_a_universal_line_and_a_long_text(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "line_pieces", lambda t: common.line_pieces(t, 1000))
    rows = [(i % 40 if i % 3 else None, f"all of them\nown {i}\n" + "\n".join(f"w{j}" for j in range(i % 50))) for i in range(400)]
    rows += [(1000, "\n".join(["all of them", "x"] * 5000)), (1001, "\n" * 3000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted((tuple(r) for r in line_dedup.digest(df).collect()), key=str) == brute_lines(rows)


# ---- components ----


def test_a_hub(spark):
    edges = [(0, i) for i in range(1, 3000)] + [(5000 + i, 5001 + i) for i in range(40)] + [(7, 7)]
    got = {r.node: r.root for r in common.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert all(got[i] == 0 for i in range(3000)) and all(got[5000 + i] == 5000 for i in range(41))


# ---- context-tree weighting ----


def thue_morse(k):
    a, b = b"a", b"b"
    for _ in range(k):
        a, b = a + b, b + a
    return a.decode(), b.decode()


def test_long_words_and_texts_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(ctw_scoring, "pieces", lambda table, depth: PIECES(table, depth, 700))
    one, other = thue_morse(10)
    held = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 7 == 2)
    rows = [(100 + i, one) for i in range(9)] + [(held, f"{other} {one}"), (300, "ab cd " * 900)]
    got = {r.doc_id: r for r in ctw_scoring.ctw_scoring(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got[held].n_tokens == 3 and got[held].n_known == 2  # the complement was never seen
    whole = {r.doc_id: r for r in _unpatched(spark, rows, monkeypatch)}
    for i in got:
        assert math.isclose(got[i].score, whole[i].score, rel_tol=1e-6) and math.isclose(got[i].base_score, whole[i].base_score, rel_tol=1e-12)
        assert (got[i].n_tokens, got[i].n_known, got[i].n_bytes) == (whole[i].n_tokens, whole[i].n_known, whole[i].n_bytes)


PIECES = ctw_scoring.pieces


def _unpatched(spark, rows, monkeypatch):
    monkeypatch.setattr(ctw_scoring, "pieces", PIECES)
    return ctw_scoring.ctw_scoring(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()


def test_without_training_text(spark):
    held = [i for i in range(99) if zlib.crc32(str(i).encode()) % 7 == 2][:3]
    got = ctw_scoring.ctw_scoring(spark.createDataFrame([(i, "abc de") for i in held], "doc_id bigint, text string")).collect()
    for r in got:
        assert math.isclose(r.score, 7 * 8 * math.log10(0.5), rel_tol=1e-6)
        assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (3, 0, 0, 0.0)


# ---- compression ----


def test_features_are_those_of_plain_compression():
    r = random.Random(3)
    good, bad = (b" ".join(r.choice(w) for _ in range(3000)) for w in ([b"the", b"cat", b"sat"], [b"buy", b"now", b"$$$"]))
    text = b"the cat sat buy " * 200
    model = compress_quality.Classifier(good, bad, None, 0.5)
    n = round(len(text) / 1024)
    size = [sum(len(zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_checksum=False, write_dict_id=False).compress(text[len(text) * i // n : len(text) * (i + 1) // n])) for i in range(n)) for d in (good, bad)]
    d = (size[1] - size[0]) / sum(size) * 10
    x = model.features(text)
    assert math.isclose(x[1], d) and math.isclose(x[2], 2 * sum(size) / len(text) - 1)
    long = bytes(range(256)) * 400
    assert b"".join(compress_quality.pieces(long)) == long and len(compress_quality.pieces(long)) == 100


def test_few_labels_and_repeated_ids(spark):
    docs = spark.createDataFrame([(1, "good words here " * 9, 0, 0.1)] * 40 + [(2, "b@d $$$ " * 9, 0, 0.1), (3, None, 0, 0.1)], "doc_id bigint, text string, row int, score double")
    for labels in ([(1, 1), (2, 0)], [(1, 1), (2, 0), (3, 0)], [(1, 1)]):
        got = compress_quality.compress_quality(docs, spark.createDataFrame(labels, "doc_id bigint, quality int")).selectExpr("row.doc_id as i", "row.score as s", "score").collect()
        assert len(got) == 42 and all(0 <= r.score <= 1 and r.s == 0.1 for r in got)
        if len(labels) > 1:
            assert next(r.score for r in got if r.i == 1) > next(r.score for r in got if r.i == 2)


# ---- isolation forest ----


def test_paths_by_plain_recursion():
    rng = np.random.default_rng(4)
    x = np.vstack([rng.normal(size=(300, 8)), rng.normal(size=(5, 8)) * 9])
    forest = quality_rules.IsolationForest(x, np.arange(305) >= 300)

    def path(tree, v, at=0):
        f, cut, left, right, length = tree[at]
        return length if f < 0 else path(tree, v, int(left if v[int(f)] < cut else right))

    want = [2 ** (-sum(path(t, v) for t in forest.trees) / len(forest.trees) / forest.norm) for v in x]
    assert np.allclose(forest.score(x), want)
    assert forest.score(x)[300:].min() > np.median(forest.score(x)[:300])


def test_verdicts_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    held = common.held_out("doc_id", 3, 1)
    out = quality_rules.quality_rules(docs.select("doc_id", "text"), labels.where(~held)).selectExpr("row.doc_id as doc_id", "kept", "base_failed")
    rows = out.join(labels.where(held), "doc_id").toPandas()
    good = rows[(rows.quality == 1) & ~rows.base_failed]
    assert good.kept.mean() > 0.98 and rows[rows.quality == 0].kept.mean() < 0.15


# ---- chat ----


def test_the_loss_comes_through_the_mask(spark, monkeypatch):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", r"a </s> \[INST] é"), (1, 2, "assistant", ""), (2, 0, "user", "q"), (None, 0, "assistant", "x"), (None, 0, "assistant", "x"), (None, 1, None, None)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = chat_tree.digest(df).collect()
    assert len(got) == 6  # each row without an id is a conversation
    one = next(r for r in got if r.conv_id == 1)
    assert one.loss_sha256 == hashlib.sha256(rows[1][3].encode()).hexdigest() and one.loss_chars == len(rows[1][3])
    assert sorted(r.loss_chars for r in got if r.conv_id is None) == [0, 1, 1]
    right = chat_tree.loss_mask
    monkeypatch.setattr(chat_tree, "loss_mask", lambda role, text: __import__("pyspark").sql.functions.transform(right(role, text), lambda m: m.withField("from", m["from"] - 1)))
    wrong = next(r for r in chat_tree.digest(df).collect() if r.conv_id == 1)
    assert wrong.loss_sha256 != one.loss_sha256 and wrong.turns_sha256 == one.turns_sha256


def test_a_long_conversation(spark):
    rows = [(1, i, "user" if i % 2 else "assistant", f"t{i % 7}") for i in range(6000)]
    got = next(r for r in chat_tree.digest(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).collect() if r.conv_id == 1)
    assert got.n_turns == 6000 and got.turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for _, _, r, t in rows).encode()).hexdigest()


# ---- HTML ----


def best_labelling(root, nodes, odds):
    """The text of the best of all labellings, tried one by one."""
    best, most = None, -math.inf
    for choice in itertools.product([True, False], repeat=len(nodes)):
        taken = dict(zip(map(id, nodes), choice, strict=True))
        if any(taken[id(n)] and n.parent is not root and not taken[id(n.parent)] for n in nodes):
            continue
        score = sum((-math.log1p(math.exp(-o)) if taken[id(n)] else -math.log1p(math.exp(o))) for n, o in zip(nodes, odds, strict=True))
        score -= html_extract.SWITCH * sum(not taken[id(n)] and n.parent is not root and taken[id(n.parent)] for n in nodes)
        if score > most:
            best, most = taken, score

    def text(n):
        return [x for i in n.items for x in ([i] if isinstance(i, str) else text(i) if best[id(i)] else [])]

    return "\n".join(text(root))


def test_decoding_is_the_best_labelling():
    r = random.Random(8)
    for k in range(60):
        def tree(depth):
            return "".join(f"<div>w{r.randrange(99)}{tree(depth - 1)}</div>" for _ in range(r.randrange(0, 3) if depth < 3 else r.randrange(1, 3))) if depth else ""

        root = html_extract.parse("<body>" + tree(3) + "</body>")
        nodes = html_extract.nodes_of(root)
        if not 0 < len(nodes) <= 11:
            continue
        odds = np.array([r.gauss(0, 2) for _ in nodes])
        want = best_labelling(root, nodes, odds.tolist())
        if want:
            assert html_extract.decode(root, nodes, odds) == want, k


STORY = "Some words of the story, which goes on for a while and says what happened to all of those who took part in it. " * 4


def test_tables_figures_and_more_of_an_article():
    inside = f"<h1>T</h1><p>{STORY}</p><table><tr><th>Name</th><th>Value</th></tr><tr><td>a</td><td>1</td></tr></table><figure><img src=x><figcaption>A caption</figcaption></figure><details><summary>More</summary><p>Further words here</p></details><dl><dt>x</dt><dd>y</dd></dl><pre>code here</pre><p><a href='#'>one link</a></p><p>{STORY}</p>"
    page = f"<html><body><nav><ul><li><a href='/'>Home</a></li></ul></nav><article>{inside}</article><footer>&copy; me</footer></body></html>"
    story = STORY.strip()
    want = ["T", story, "Name", "Value", "a", "1", "A caption", "More", "Further words here", "x", "y", "code here", "one link", story]
    loose = f'<body>First paragraph of the article, {STORY}<div class="content"><p>Second {STORY}</p></div></body>'
    got = html_extract.extract([page, loose], html_extract.model())
    assert got[0].split("\n") == want
    assert got[1].split("\n") == [f"First paragraph of the article, {story}", f"Second {story}"]


def test_pages_as_a_table(spark):
    page = f"<html><body><nav><a href='/'>Home</a></nav><article><h1>A &amp; B</h1><p>{STORY}</p></article></body></html>"
    long = "<html><body><article>" + f"<p>{STORY}</p>" * 4000 + "</article></body></html>"
    rows = [(1, "u", page, 7), (1, "v", page, 8), (None, None, None, None), (2, "w", " \n", 1), (3, "x", long, 2)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, text int").selectExpr("*", "text as row", "text as h")
    got = sorted((tuple(r) for r in html_extract.digest(df).collect()), key=str)
    text, many = f"A & B\n{STORY.strip()}", "\n".join([STORY.strip()] * 4000)
    assert got == sorted([(1, "u", text, len(text)), (1, "v", text, len(text)), (None, None, "", 0), (2, "w", "", 0), (3, "x", many, len(many))], key=str)
    assert {r.row.text for r in html_extract.html_extract(df).select("row").collect()} == {7, 8, None, 1, 2}
    assert html_extract.digest(df.where("false")).count() == 0


# ---- decontamination ----


def test_singular_vectors_are_those_of_the_matrix(spark):
    r = random.Random(5)
    topics = [[f"t{k}w{i}" for i in range(7)] for k in range(6)]  # fewer words than RANK: the sketch loses nothing
    docs = [" ".join(r.choice(topics[i % 6]) for _ in range(r.randrange(30, 120))) for i in range(200)]
    df = spark.createDataFrame([(t,) for t in docs], "text string").repartition(5)
    frequency, n, tasks = latent_decontamination.document_frequency(df)
    idf = latent_decontamination.inverse_frequency(frequency, n)
    u, s = latent_decontamination.latent_space(df, idf, tasks)
    rows = []
    for t in docs:
        ids, _ = latent_decontamination._hashed([t.encode()])
        for i in range(0, len(ids), latent_decontamination.PASSAGE):
            v = np.zeros(latent_decontamination.VOCABULARY)
            np.add.at(v, ids[i : i + latent_decontamination.PASSAGE], 1)
            own = ids[i : i + latent_decontamination.PASSAGE]
            rows.append(v * idf / math.sqrt((idf[own] ** 2).sum()))
    a = np.array(rows)
    used = np.nonzero(a.any(axis=0))[0]
    _, want, vt = np.linalg.svd(a[:, used], full_matrices=False)
    assert len(rows) == n and tasks == 5 and np.allclose(s[:6], want[:6], rtol=1e-3)
    assert np.linalg.norm(vt[:6] @ u[used], axis=1).min() > 0.999


@pytest.mark.parametrize("items", [3, 10_000])
def test_blocks_of_items_change_nothing(spark, monkeypatch, items):
    monkeypatch.setattr(latent_decontamination, "ITEMS", items)
    r = random.Random(6)
    text = lambda n: " ".join(f"w{r.randrange(400)}" for _ in range(n))
    bench = [(k, text(30)) for k in range(8)]
    bench += [(2, text(30)), (2, bench[2][1]), (None, text(9)), (9, None)]
    docs = [(k, f"{text(40)} {t} {text(20)}", "a") for k, t in enumerate(t for i, t in bench if i is not None and t)] + [(50, text(100), "b")]
    got = {x.doc_id: list(x["items"]) for x in latent_decontamination.digest(spark.createDataFrame(docs, "doc_id bigint, text string, items string"), spark.createDataFrame(bench, "item_id bigint, text string")).collect()}
    assert got == {**{k: [k] for k in range(8)}, 8: [2], 9: [2], 50: []}
