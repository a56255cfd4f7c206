"""Candidates come from the latent space: recall against exhaustive search, and what happens without its vectors."""

import random

import numpy as np
import pytest

from lectern.llm import latent_decontamination as m
from tests.llm.test_whole import is_leak, paraphrases, sentence

READ = "/root/testdata/sf0.01/{}.parquet"


@pytest.fixture(scope="module")
def space(spark):
    docs = spark.read.parquet(READ.format("documents"))
    frequency, n, tasks = m.document_frequency(docs)
    idf = m.inverse_frequency(frequency, n)
    items = [(x.item_id, x.text.encode()) for x in spark.read.parquet(READ.format("benchmark")).collect()]
    texts = [x.text or "" for x in docs.select("text").collect()]
    return items, frequency, idf, *m.latent_space(docs, idf, tasks), texts


def test_recall_of_paraphrases(space):
    """Of stretches that exhaustive LCS calls leaks, 30% or half of the words replaced."""
    items, *rest, texts = space
    searcher, r = m.Searcher(items, *rest), random.Random(11)
    assert searcher.directed.all()
    filler = [w for x in texts[:100] for w in x.split()]
    made = [paraphrases(r, [t.decode() for _, t in items], filler) for _ in range(3)]
    rows = [t.encode() for part in made for t in part]
    want = {(i, k) for i, t in enumerate(rows) for k, item in items if is_leak(item, t)}
    have = {(i, k) for i, found in enumerate(searcher.leaks(rows)) for k in found}
    assert len(want) > 180 and not have - want and len(have) >= 0.97 * len(want), f"{len(have)} of {len(want)}"


def test_without_vectors_nothing_is_found(space):
    items, frequency, idf, vectors, values, texts = space
    rows = [t.encode() for t in texts]
    found = lambda v: sum(map(bool, m.Searcher(items, frequency, idf, v, values).leaks(rows)))
    assert found(vectors) > 20 and found(np.zeros_like(vectors)) == 0


def test_items_without_direction(space):
    """An item of the commonest words alone is found by counts, also without vectors; the others keep their direction."""
    items, frequency, idf, vectors, values, _ = space
    common = b" ".join(f"c{i}".encode() for i in range(20))
    frequency, idf = frequency.copy(), idf.copy()
    own = np.unique(m._hashed([common])[0])
    frequency[own], idf[own] = frequency.max() * 2, 0.1
    searcher = m.Searcher([*items, (-5, common)], frequency, idf, np.zeros_like(vectors), values)
    assert list(searcher.directed) == [True] * len(items) + [False]
    assert searcher.leaks([b"before it " + common + b" after it"]) == [{-5: 1.0}]


def test_long_texts_and_repeated_items(space):
    items, *rest, _ = space
    r, searcher = random.Random(3), m.Searcher([*items, items[0]], *rest)
    long = (sentence(r, 200) + " ").encode() * 2000
    assert searcher.leaks([long + items[0][1] + b" " + long, b"", long])[0] == {items[0][0]: 1.0}
