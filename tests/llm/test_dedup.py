import hashlib
import random
import re
from itertools import combinations

import pytest
import xxhash

from lectern.llm import line_dedup, simhash_dedup, substring_dedup
from lectern.llm.common import components

SCHEMA = "doc_id bigint, text string, block int, row string, keys string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, 1, "r", "k") for i, t in rows], SCHEMA)


def words(n, seed):
    r = random.Random(seed)
    return [r.choice("ab cd ef gh é ij kl mn op qr st uv".split()) + str(r.randrange(400)) for _ in range(n)]


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def brute_lines(rows, min_docs=10):
    low = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
    where = {}
    for i, t in rows:
        for x in (t or "").split("\n"):
            where.setdefault(low(x), set()).add(i)
    out = []
    for i, t in rows:
        ls = (t or "").split("\n")
        kept = [x for x in ls if not (low(x) and len(where[low(x)]) >= min_docs)]
        out.append((i, len(ls), len(ls) - len(kept), sha("\n".join(kept))))
    return sorted(out, key=str)


def test_line_dedup(spark):
    rows = [(i, f" Shared LINE\t\nown {i}\n\n{'É' if i % 2 else 'é'} line\nSHARED line") for i in range(12)]
    rows += [(50, None), (51, ""), (52, "shared line"), (None, "shared line\nx"), (None, None), (3, "again own"), (60, "nine\n" * 30), *[(70 + i, "nine") for i in range(8)], (90, "x" * 200_000)]
    got = sorted((tuple(r) for r in line_dedup.digest(table(spark, rows)).collect()), key=str)
    assert got == brute_lines(rows)
    out = line_dedup.line_dedup(table(spark, rows))
    assert out.columns == ["doc_id", "text", "block", "row", "keys", "n_lines", "n_dropped"]


def brute_windows(rows, n=35):
    docs = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    seen = {}
    for d, w in enumerate(docs):
        for i in range(len(w) - n + 1):
            seen.setdefault(tuple(w[i : i + n]), []).append((d, i))
    gone = [set() for _ in docs]
    for places in seen.values():
        if len(places) > 1:
            for d, i in places:
                gone[d] |= set(range(i, i + n))
    return sorted(((i, len(w), len(g), sha(" ".join(x for j, x in enumerate(w) if j not in g))) for (i, _), w, g in zip(rows, docs, gone, strict=True)), key=str)


def test_substring_dedup(spark):
    a, b = words(60, 1), words(90, 2)
    rows = [(1, " ".join(words(20, 3) + a + words(20, 4))), (2, "\n".join(words(50, 5) + a[5:] + words(9, 6))), (3, " ".join(b)), (4, " ".join(b)), (5, " ".join(b[:40] + ["edit"] + b[41:])), (6, " ".join(a[:34])), (7, None), (8, ""), (9, "same " * 80), (10, "x \xa0 y"), (None, " ".join(b[10:50])), (3, " ".join(words(70, 7))), (11, " ".join(words(3000, 8) + words(3000, 8)))]
    rows += [(100 + i, " ".join(words(i % 7, i) + a[:45])) for i in range(60)]
    got = sorted((tuple(r) for r in substring_dedup.digest(table(spark, rows)).collect()), key=str)
    assert got == brute_windows(rows)


def fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    grams = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def labels_of(fps, threshold=4):
    """Component label (least index) of each fingerprint by comparing all pairs."""
    label = list(range(len(fps)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, j in combinations(range(len(fps)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= threshold:
            a, b = find(i), find(j)
            label[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def brute_groups(rows):
    fps = [fingerprint(t) for _, t in rows]
    label = labels_of(fps)
    least = {}
    for (i, _), g in zip(rows, label, strict=True):
        if i is not None:
            least[g] = min(i, least.get(g, i))
    return sorted(((i, f"{f:016x}", least.get(g)) for (i, _), f, g in zip(rows, fps, label, strict=True)), key=str)


@pytest.mark.parametrize("chunk", [20_000, 7])
def test_simhash(spark, chunk, monkeypatch):
    monkeypatch.setattr(simhash_dedup, "CHUNK", chunk)
    base = words(300, 1)
    rows = [(i, " ".join(words(40, 100 + i))) for i in range(30)]
    for k in range(40):
        w = base[:]
        w[k * 7] = f"edit{k}"
        rows.append((200 + k, " ".join(w)))
    rows += [(7, None), (900, ""), (901, " \n"), (902, "one"), (903, "ONE"), (904, "one two three four"), (None, " ".join(base)), (None, "alone here " * 9), (5, " ".join(base)), (905, "one two")]
    got = sorted((tuple(r) for r in simhash_dedup.digest(table(spark, rows)).collect()), key=str)
    assert got == brute_groups(rows)


def test_simhash_links_of_random_pairs(spark):
    """Fingerprints at exactly 4 and 5 bits, and chains of them."""
    r = random.Random(3)
    fps = []
    for _ in range(150):
        f = r.getrandbits(64)
        fps.append(f)
        for bits in (1, 2, 3, 4, 4, 5, 6):
            g = f
            for b in r.sample(range(64), bits):
                g ^= 1 << b
            fps.append(g)
    fps = sorted(set(fps))
    sign = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(sign(f),) for f in fps], "fp bigint")
    roots = {row.node: row.root for row in components(simhash_dedup.near_links(df)).collect()}
    label = labels_of(fps)
    mine = [roots.get(sign(f), sign(f)) for f in fps]
    assert len(set(zip(mine, label, strict=True))) == len(set(label)) == len(set(mine))


def test_simhash_keeps_one_of_each(spark):
    rows = [(3, "a b c d e f"), (1, "a b c d e f"), (2, "q w r t y u i o"), (None, "a b c d e f"), (5, "zz"), (5, "yy"), (2, "q w r t y u i o")]
    kept = sorted((x.doc_id, x.text) for x in simhash_dedup.simhash_dedup(table(spark, rows)).collect())
    assert kept == [(1, "a b c d e f"), (2, "q w r t y u i o"), (5, "yy")]


def test_empty(spark):
    none = table(spark, [])
    assert line_dedup.digest(none).count() == substring_dedup.digest(none).count() == simhash_dedup.digest(none).count() == simhash_dedup.simhash_dedup(none).count() == 0
