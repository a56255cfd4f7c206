import math
from collections import Counter, defaultdict

import numpy as np

from lectern.llm import ctw_scoring as c


def brute(train: list[bytes], texts: list[bytes], depth: int) -> list[float]:
    """Context-tree weighting by its recursive definition."""
    n = defaultdict(lambda: [0, 0])
    contexts = defaultdict(set)

    def decisions(t):
        s = c.EDGE * depth + t + c.EDGE
        for i in range(depth, len(s)):
            for k in range(8):
                yield s[i - depth : i], (1 << k) | (s[i] >> (8 - k)), (s[i] >> (7 - k)) & 1

    for t in train:
        for ctx, node, bit in decisions(t):
            for d in range(depth + 1):
                n[(ctx[depth - d :], node)][bit] += 1
                if d:
                    contexts[(ctx[depth - d + 1 :], node)].add(ctx[depth - d :])

    def kt(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)

    def log_w(ctx, node):
        e = kt(*n.get((ctx, node), (0, 0)))
        if len(ctx) == depth:
            return e
        return float(np.logaddexp(e, sum(log_w(x, node) for x in contexts.get((ctx, node), ())))) + math.log(0.5)

    out = []
    for t in texts:
        total = 0.0
        for ctx, node, bit in decisions(t):
            p = None
            for d in range(depth, -1, -1):
                x = ctx[depth - d :]
                a, b = n.get((x, node), (0, 0))
                own = ((a, b)[bit] + 0.5) / (a + b + 1)
                if p is None:
                    p = own
                else:
                    w = math.exp(math.log(0.5) + kt(a, b) - log_w(x, node))
                    p = w * own + (1 - w) * p
            total += math.log10(p)
        out.append(total)
    return out


def base(train, texts):
    n = Counter(w for t in train for w in [*t.lower().split(), b""])
    all_, v = sum(n.values()), len(n)
    return [sum(math.log10((n[w] + 1) / (all_ + v + 1)) for w in [*t.lower().split(), b""]) for t in texts]


def test_scores_equal_the_definition(spark):
    import zlib

    rows = [(i, t) for i, t in enumerate(["abab abc", "", None, "abba ABBA", "é ü\tñ", "abab abc", "zz", "ab" * 40, "x y z", "\x0b\x85 q", "abc abd", "bab"])]
    rows += [(None, "null id"), (3, "again"), (3, "again")]
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in rows]
    got = c.ctw_scoring(spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id bigint, text string, block string")).collect()
    data = [(t or "").encode() for _, t in rows]
    train = [t.lower() for t, h in zip(data, held, strict=True) if not h]
    key = lambda i, b: (str(i), round(b, 6))
    want = sorted((key(i, b), h, s) for (i, _), b, h, s in zip(rows, base(train, data), held, brute(train, [t.lower() for t in data], c.DEPTH), strict=True))
    have = sorted((key(r.doc_id, r.base_score), r.held_out, r.score) for r in got)
    assert [(a, b) for a, b, _ in want] == [(a, b) for a, b, _ in have]
    assert np.allclose([x for *_, x in want], [x for *_, x in have], atol=1e-4)
    assert {r.train_tokens for r in got} == {sum(len(t.split()) + 1 for t in train)}


def test_empty_table(spark):
    assert c.ctw_scoring(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
