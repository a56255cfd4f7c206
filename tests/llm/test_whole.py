"""What operators must not leave out: words that are common, paraphrases at the limit, rows without ids, loose markup."""

import random

import corpus_pipeline
from lectern.llm import html_extract, latent_decontamination

WORDS = [f"{a}{b}{c}" for a in "bdfgklmn" for b in "aeiou" for c in "rstvz"]


def sentence(r, n):
    return " ".join(r.choice(WORDS) + str(r.randrange(30)) for _ in range(n))


def leaks(spark, docs, items):
    docs = spark.createDataFrame(docs, "doc_id bigint, text string")
    items = spark.createDataFrame(items, "item_id bigint, text string")
    return {x.doc_id: list(x["items"]) for x in latent_decontamination.digest(docs, items).collect()}


def test_leaks_of_common_words(spark):
    """A third of the rows are copies of an item; another item has only the commonest words."""
    r = random.Random(1)
    copied, common = sentence(r, 30), "of the and to in a is it that was for on are as with his they at be this".split()
    r.shuffle(common)
    docs = [(i, sentence(r, 60) if i % 3 else copied) for i in range(120)]
    docs = [(i, " ".join(w + " " + r.choice(common) for w in t.split()) if i % 3 else t) for i, t in docs]
    docs += [(200, sentence(r, 50) + " " + copied + " " + sentence(r, 20)), (201, sentence(r, 33) + " " + " ".join(common) + " " + sentence(r, 40)), (202, sentence(r, 90))]
    got = leaks(spark, docs, [(7, copied), (8, " ".join(common)), (9, sentence(r, 25))])
    assert {i: x for i, x in got.items() if x} == {**{i: [7] for i in range(0, 120, 3)}, 200: [7], 201: [8]}


def is_leak(item, text):
    """By the longest common subsequence with every stretch of the text."""
    t = latent_decontamination.tokens
    words, doc, answer = t(item), t(text), latent_decontamination._answer(item)
    places = lambda ws: {w: [i for i, x in enumerate(ws) if x == w] for w in ws}
    reach = len(words) + 2 * (len(words) // 4 + 2)
    for i in range(max(1, len(doc) - reach // 2)):
        near = doc[i : i + reach]
        share = latent_decontamination.lcs(words, near, places(words)) / len(words)
        if share >= 0.7 or share >= 0.5 and len(answer) >= 3 and latent_decontamination.lcs(answer, near, places(answer)) >= 0.8 * len(answer):
            return True
    return False


def paraphrases(r, items, filler):
    """Of each item, one with 30% of its words replaced and one with half of them, the answer kept where that is possible."""
    rows = []
    for text in items:
        n, m = len(text.split()), len(latent_decontamination._answer(text.encode()))
        for share in (0.3, 0.5):
            w = text.split()
            for j in r.sample(range(n), int(share * n)) if share < 0.5 else r.sample(range(n - m), min(n // 2, n - m)):
                w[j] = r.choice(filler)
            rows.append(" ".join(r.choices(filler, k=r.randrange(20, 60))) + " " + " ".join(w) + " " + " ".join(r.choices(filler, k=40)))
    return rows


def test_paraphrases_at_the_limit(spark):
    r = random.Random(4)
    read = lambda t: spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet")
    items = [(x.item_id, x.text) for x in read("benchmark").collect()]
    filler = [w for x in read("documents").where("doc_id < 40").collect() for w in x.text.split()]
    texts = paraphrases(r, [t for _, t in items], filler)
    want = {(i, k) for i, t in enumerate(texts) for k, item in items if is_leak(item.encode(), t.encode())}
    assert len(want) > 60
    corpus = [*enumerate(texts), *((x.doc_id + 1000, x.text) for x in read("documents").where("doc_id < 500").collect())]
    have = {(i, k) for i, ks in leaks(spark, corpus, items).items() for k in ks if i < 1000}
    assert have == want, f"{len(have & want)} of {len(want)} found, {len(have - want)} others"


# ---- near-dedup ----


def test_rows_without_ids_stay(spark):
    """Null and repeated ids: each text that is no copy stays, one row of each group of copies does."""
    r = random.Random(6)
    own = [sentence(r, 30) for _ in range(9)]
    rows = [(None, t) for t in own[:4]] + [(5, t) for t in own[4:7]] + [(1, own[7]), (None, own[7]), (5, own[7]), (None, own[8]), (None, own[8]), (None, None), (None, "")]
    docs = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id bigint, text string, t string")
    got = corpus_pipeline.near_duplicates(spark, docs, None)
    assert got.columns == docs.columns
    kept = sorted(((x.doc_id, x.text or "") for x in got.collect()), key=str)
    assert kept == sorted([(None, t) for t in own[:4]] + [(5, t) for t in own[4:7]] + [(1, own[7]), (None, own[8]), (None, "")], key=str)


# ---- HTML ----


def test_text_of_the_body_and_unclosed_buttons():
    a, b = "First part of the story, with a good many words in it that tell what came to pass.", "The second part goes on, and says how it ended for all of them, in some more words."
    pages = [f"<body><h1>Title of it</h1>{a}<br>{b}<ul><li>one thing</li><li>another thing</li></ul>{a}</body>"]
    pages += [f"<body><header>{x}</header><article><h1>Title of it</h1><p>{a}</p><p>{b}</p></article></body>" for x in ("<button>Menu", "<svg><path d=''>", "<button>Menu</button><select><option>x</option>")]
    got = html_extract.extract(pages, html_extract.model())
    assert got[0].split("\n") == ["Title of it", f"{a} {b}", "one thing", "another thing", a]
    assert all(x == f"Title of it\n{a}\n{b}" for x in got[1:])


def test_loose_layouts():
    pages = html_extract.loose_pages(60, 77)
    got = html_extract.extract([p for p, _ in pages], html_extract.model())
    wrong = sum(len(set(g.lower().replace(",", " ").replace(".", " ").split()) ^ set(w.split())) for g, (_, w) in zip(got, pages, strict=True))
    assert wrong < 0.05 * sum(len(w.split()) for _, w in pages)
