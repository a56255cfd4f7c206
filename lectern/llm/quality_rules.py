"""Quality rules: an isolation forest over rule statistics, its threshold calibrated from labelled rows.

Every document gets exact counts (words, symbols, repeated lines and 8-word windows). Rates of these counts, with
pseudo-counts so that short clean texts don't look odd, go down random trees; a short mean path marks an anomaly. Forest
and threshold come from all labelled rows (one row of a repeated id). Trees differ by the rows that they get: each labelled
row is dealt to so many trees that every tree has SUBSAMPLE rows, and to one at least, so with more rows than
TREES * SUBSAMPLE the trees' shares grow, a TREES-th of the rows each. A share weighs what SUBSAMPLE rows do, bad rows
BAD_SHARE of it, however many it holds. Trees are grown where their shares lie; only their nodes, bounded by the depth,
reach the driver. The threshold is exact over a histogram of all labelled scores (GRID steps).

Texts are counted once and written to the shared folder with their counts; no text is shuffled.

Defined cases: null text counts as empty (n_words 0, so base_failed); ids may repeat or be null, each row is judged;
without labels of both classes only the base rules decide; empty tables give empty results; other columns are kept.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PIECE_BYTES, drop_materialized, labelled, line_pieces, materialize, slices, text_of, texts, tidy, word_pieces

TREES, SUBSAMPLE, BAD_SHARE, SEED = 200, 256, 0.02, 7
#: Trees whose shares of rows lie in one task, and steps of a score at which the threshold may lie.
TOGETHER, GRID = 4, 1 << 16
#: Of labelled good rows, at most this share may fall below the threshold.
GOOD_LOSS = 0.003
SYMBOLS, UPPER, DIGITS, SHOUT = b"#*$%&|<>", bytes(range(65, 91)), b"0123456789", b"!?"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_digits", "n_shout", "n_lines", "n_twice")
WINDOW = 8
#: A split picks its statistic at random, weighted by this power of the kurtosis: heavy tails are cut first.
TAIL_POWER = 2.0
#: Rates enter as log(1 + RATE_SCALE * rate), so that uniform splits also tell small rates apart.
RATE_SCALE = 30.0


def repeated_words(words: np.ndarray, starts: np.ndarray, n: int = WINDOW) -> np.ndarray:
    """Flag of each word (64-bit hashes of several texts in a row, each beginning at starts) that lies in an n-word
    window found twice or more in its own text."""
    size, flags = len(words), np.zeros(len(words) + 1, np.int64)
    if size < n:
        return flags[:size] > 0
    text = np.zeros(size, np.int64)
    text[starts[(starts > 0) & (starts < size)]] = 1
    text = np.cumsum(text)
    w = words.astype(np.uint64)
    at = np.nonzero(text[n - 1 :] == text[: size - n + 1])[0]
    key = text[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for j in range(n):
        key = (key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + w[at + j]
    key ^= key >> np.uint64(32)
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    np.add.at(flags, at[twice], 1)
    ends = np.minimum(at[twice] + n, size)
    np.add.at(flags, ends, -1)
    return np.cumsum(flags[:size]) > 0


def _word_hashes(text: bytes) -> tuple[np.ndarray, int]:
    """64-bit hashes of a text's words in order, and its characters in words; a piece of the text at a time."""
    found, chars = [np.zeros(0, np.int64)], 0
    for piece in word_pieces(text):
        words = piece.split()
        found.append(np.fromiter(map(hash, words), np.int64, len(words)))
        chars += len(b"".join(words).decode("utf-8", "replace"))
    return np.concatenate(found), chars


def _lines(text: bytes) -> tuple[int, int]:
    """Lines with a word, and how many of them equal an earlier one (by 128-bit digests)."""
    own: set[bytes] = set()
    n = 0
    for piece in line_pieces(text):
        lines = [x for x in piece.split(b"\n") if x and not x.isspace()]
        n += len(lines)
        own.update(lines if len(text) <= PIECE_BYTES else map(xxhash.xxh3_128_digest, lines))
    return n, n - len(own)


def counts(docs: list[bytes]) -> np.ndarray:
    """One row of COUNTS for each text."""
    out, hashes, lens = np.zeros((len(docs), len(COUNTS)), np.int64), [], []
    for i, b in enumerate(docs):
        words, chars = _word_hashes(b)
        lens.append(len(words))
        hashes.append(words)
        n_lines, n_dup = _lines(b)
        less = lambda chars: len(b) - len(b.translate(None, chars))  # noqa: B023, E731
        out[i] = (len(words), chars, less(SYMBOLS), n_dup, 0, less(UPPER), less(DIGITS), less(SHOUT), n_lines, np.count_nonzero(words[1:] == words[:-1]))
    if sum(lens):
        starts = np.concatenate([[0], np.cumsum(lens)])
        total = np.concatenate([[0], np.cumsum(repeated_words(np.concatenate(hashes), starts[:-1]))])
        out[:, 4] = total[starts[1:]] - total[starts[:-1]]
    return out


def features(c: np.ndarray) -> np.ndarray:
    n, chars = c[:, 0] + 20.0, c[:, 1] + 100.0
    rates = [c[:, 2] / n, c[:, 3] / (c[:, 8] + 4.0), c[:, 4] / n, c[:, 5] / chars, c[:, 6] / chars, c[:, 7] / n, c[:, 9] / n]
    return np.column_stack([(c[:, 1] + 100.0) / n, *(np.log1p(RATE_SCALE * r) for r in rates)])


def _average_path(n: np.ndarray | float):
    n = np.maximum(np.asarray(n, float), 1)
    whole = np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / n, np.where(n == 2, 1.0, 0.0))
    return np.where((n < 3) & (n != 2), np.interp(n, (1, 2, 3), (0.0, 1.0, 2 * (math.log(2) + 0.5772156649) - 4 / 3)), whole)


def dealt(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, tree) pairs: each row goes to `times` different trees, which its key picks."""
    steps = np.array([i for i in range(1, TREES + 1) if math.gcd(i, TREES) == 1], np.uint64)
    keys = keys.astype(np.uint64)
    first, step = keys % np.uint64(TREES), steps[keys // np.uint64(TREES) % np.uint64(len(steps))]
    row = np.repeat(np.arange(len(keys)), times)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
    return row, ((first[row] + nth.astype(np.uint64) * step[row]) % np.uint64(TREES)).astype(np.int64)


class Shares:
    """How n_good and n_bad rows are shared out: to how many trees a row goes, and what a tree's rows weigh together."""

    def __init__(self, n_good: int, n_bad: int):
        self.size = min(SUBSAMPLE, n_good + n_bad)
        bad = min(n_bad, math.ceil(self.size * BAD_SHARE))
        self.weight = (self.size - bad, bad)
        self.times = tuple(min(TREES, math.ceil(w * TREES / n)) if n else 0 for w, n in zip(self.weight, (n_good, n_bad), strict=True))
        self.times = tuple(max(1, t) for t in self.times)

    def weights(self, odd: np.ndarray) -> np.ndarray:
        """Weights of a tree's rows; none counts for more than one row."""
        n = (np.count_nonzero(~odd), np.count_nonzero(odd))
        good, bad = (min(1.0, w / max(1, k)) for w, k in zip(self.weight, n, strict=True))
        return np.where(odd, bad, good)


def grown(x: np.ndarray, odd: np.ndarray, shares: Shares, rng) -> np.ndarray:
    """A tree (feature, cut, left child, right child, leaf path) of its share of rows, to depth log2(size). A node that
    weighs no more than one row is a leaf. The rows' order is of no effect."""
    order = np.lexsort((odd, *x.T))
    x, w, nodes = x[order], shares.weights(odd[order]), []
    _grow(x, w, 0, math.ceil(math.log2(max(shares.size, 2))), nodes, rng)
    return np.array(nodes)


def _grow(x: np.ndarray, w: np.ndarray, depth: int, limit: int, nodes: list, rng) -> int:
    at, total = len(nodes), w.sum()
    nodes.append([-1, 0.0, 0, 0, depth + float(_average_path(total))])
    spread = np.ptp(x, axis=0) if total > 1 + 1e-9 else np.zeros(x.shape[1])
    if depth < limit and spread.any():
        off = x - w @ x / total
        z = off / np.maximum(np.sqrt(w @ off**2 / total), 1e-12)
        tails = np.where(spread > 0, w @ z**4 / total, 0.0) ** TAIL_POWER * (spread > 0)
        f = int(rng.choice(len(tails), p=tails / tails.sum()))
        cut = rng.uniform(x[:, f].min(), x[:, f].max())
        left = x[:, f] < cut
        nodes[at][:2] = [f, cut]
        nodes[at][2] = _grow(x[left], w[left], depth + 1, limit, nodes, rng)
        nodes[at][3] = _grow(x[~left], w[~left], depth + 1, limit, nodes, rng)
    return at


class IsolationForest:
    """Random trees as arrays, see grown()."""

    def __init__(self, x: np.ndarray, odd: np.ndarray, seed: int = SEED):
        """Of rows at hand. odd: rows known as bad."""
        shares = Shares(np.count_nonzero(~odd), np.count_nonzero(odd))
        keys = np.random.default_rng(seed).integers(0, 1 << 62, len(x))
        row, tree = dealt(keys, np.where(odd, shares.times[1], shares.times[0]))
        self._keep([grown(x[row[tree == t]], odd[row[tree == t]], shares, np.random.default_rng([seed, t])) for t in range(TREES) if (tree == t).any()], shares)

    @classmethod
    def of(cls, trees: list[np.ndarray], shares: Shares) -> IsolationForest:
        forest = cls.__new__(cls)
        forest._keep(trees, shares)
        return forest

    def _keep(self, trees: list[np.ndarray], shares: Shares) -> None:
        self.trees, self.norm = trees, float(_average_path(shares.size)) or 1.0

    def score(self, x: np.ndarray) -> np.ndarray:
        """2 ** (-mean path / norm): near 1 for anomalies."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for t in self.trees:
            at = np.zeros(len(x), np.int64)
            while True:
                f = t[at, 0].astype(np.int64)
                inner = f >= 0
                if not inner.any():
                    break
                left = x[rows, np.maximum(f, 0)] < t[at, 1]
                at = np.where(inner, np.where(left, t[at, 2], t[at, 3]).astype(np.int64), at)
            total += t[at, 4]
        return 2.0 ** (-total / len(self.trees) / self.norm)


def threshold(steps: np.ndarray, good: np.ndarray, bad: np.ndarray) -> float:
    """The cut of fewest labelled errors among those that reject at most GOOD_LOSS of the good rows, from the numbers of
    good and bad rows in each step of scores that has any, in order. Scores below it are kept."""
    lost, caught = good.sum() - np.cumsum(good), np.cumsum(bad)
    first = int(np.argmax(lost <= math.floor(good.sum() * GOOD_LOSS)))
    best = first + int(np.argmin((lost + caught)[first:]))
    after = steps[best + 1] if best + 1 < len(steps) else steps[best] + 1
    return float((steps[best] + 1 + after) / 2 / GRID)


def _matrix(b: pa.RecordBatch) -> np.ndarray:
    return np.column_stack([b.column(n).to_numpy(zero_copy_only=False) for n in COUNTS])


def _forest(known: DataFrame, shares: Shares) -> IsolationForest:
    """Trees grown where their shares of all known rows (doc_id, y, counts) are brought together."""
    names = [f"x{i}" for i in range(features(np.ones((1, len(COUNTS)), np.int64)).shape[1])]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            odd = b.column("y").to_numpy() == 0
            row, tree = dealt(b.column("key").to_numpy(), np.where(odd, shares.times[1], shares.times[0]))
            x = features(_matrix(b))[row]
            yield pa.RecordBatch.from_arrays([pa.array(tree), pa.array(odd[row]), *[pa.array(c) for c in x.T]], ["tree", "odd", *names])

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [b for b in batches if b.num_rows]
        if not found:
            return
        tree, odd, *x = (np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in found]) for i in range(2 + len(names)))
        x = np.column_stack(x)
        for t in np.unique(tree):
            own = tree == t
            nodes = grown(x[own], odd[own].astype(bool), shares, np.random.default_rng([SEED, int(t)]))
            yield pa.RecordBatch.from_arrays([pa.array([int(t)]), pa.array([nodes.tobytes()], pa.binary())], ["tree", "nodes"])

    rows = known.withColumn("key", F.xxhash64("doc_id")).mapInArrow(tidy(deal), "tree bigint, odd boolean, " + ", ".join(f"{n} double" for n in names))
    together = rows.repartitionById(-(-TREES // TOGETHER), F.floor(F.col("tree") / TOGETHER).cast("int"))
    trees = sorted((r.tree, bytes(r.nodes)) for r in together.mapInArrow(tidy(grow), "tree bigint, nodes binary").collect())  # TREES rows
    return IsolationForest.of([np.frombuffer(n).reshape(-1, 5) for _, n in trees], shares)


def fit(counted: DataFrame, labels: DataFrame) -> tuple[IsolationForest, float] | None:
    """A forest and its threshold from all labelled rows; None unless both classes are there. counted: doc_id, h (a hash of
    the text; of rows with one id that of the least counts), counts."""
    one = counted.join(labelled(labels, "quality").where("y in (0, 1)"), "doc_id").groupBy("doc_id", F.col("y").cast("bigint").alias("y")).agg(F.min(F.struct("h", *COUNTS)).alias("c"))
    known = materialize(one.select("doc_id", "y", *[F.col(f"c.{n}") for n in COUNTS]))
    n = dict(known.groupBy((F.col("y") == 0).alias("odd")).count().collect())
    model = None
    if len(n) == 2:
        forest = _forest(known, Shares(n[False], n[True]))

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                step, odd = (forest.score(features(_matrix(b))) * GRID).astype(np.int64), b.column("y").to_numpy() == 0
                steps, at = np.unique(step, return_inverse=True)
                sums = [np.bincount(at, weights=w, minlength=len(steps)).astype(np.int64) for w in (~odd, odd)]
                yield pa.RecordBatch.from_arrays([pa.array(steps), *map(pa.array, sums)], ["step", "good", "bad"])

        placed = known.mapInArrow(tidy(place), "step bigint, good bigint, bad bigint").groupBy("step").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
        found = placed.toPandas().sort_values("step")  # GRID rows at most
        model = forest, threshold(*(found[c].to_numpy() for c in ("step", "good", "bad")))
    drop_materialized(known)
    return model


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs (doc_id, text, ...) -> `row` (the input columns as a struct), the counts, base_failed, anomaly score, kept."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "row"):
            c = counts(texts(text_of(b)))
            yield pa.RecordBatch.from_arrays([*b.columns, *map(pa.array, c.T)], ["row", "h", *COUNTS])

    rows = docs.select(F.struct(*docs.columns).alias("row"), F.xxhash64("text").alias("h"))
    kind = rows.schema["row"].dataType.simpleString()
    counted = materialize(rows.mapInArrow(tidy(measure), f"row {kind}, h bigint, " + ", ".join(f"{n} bigint" for n in COUNTS)))
    model = fit(counted.select("row.doc_id", "h", *COUNTS), labels)

    @F.pandas_udf("double")
    def anomaly(c: pd.DataFrame) -> pd.Series:
        return pd.Series(model[0].score(features(c.to_numpy())))

    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    score = anomaly(F.struct(*COUNTS)) if model else F.lit(0.0)
    out = counted.select("row", *COUNTS[:5], failed.alias("base_failed"), score.alias("anomaly"))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("anomaly") < model[1] if model else F.lit(True)))
