"""Quality classifier: zstandard dictionaries of good and of bad labelled text.

Texts are cut into pieces; each piece is compressed with either dictionary, and the difference of the two sizes over their
sum says which class it resembles. A logistic curve over that difference and the compressed shares, fitted on labelled
rows that the dictionaries have not seen, turns it into a probability. At most `per_class` labelled rows of each class are
used for fitting (a documented bound; one row of a repeated id). A dictionary is made from all pieces of all their texts;
the curve is fitted on sizes of whole texts, measured where the rows are; scoring reads every byte of every text.

Defined cases: a null or empty text gets the share of good labels as its score; without labels of both classes every score
is 0.5; with a single label of one class, which no dictionary can be made without, the curve has fixed weights; ids may repeat or be null; empty tables give empty results; inputs of a score are the text alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_materialized, held_out, labelled_sample, materialize, one_text_each, slices, text_of, texts, tidy

PER_CLASS, PIECE, DICT_BYTES, LEVEL = 1200, 1024, 110_000, 3
RIDGE = 0.1


def pieces(text: bytes) -> list[bytes]:
    """Pieces of about PIECE bytes that cover the text; none is much shorter, unless the text is."""
    n = max(1, round(len(text) / PIECE))
    cut = [len(text) * i // n for i in range(n + 1)]
    return [text[a:b] for a, b in zip(cut, cut[1:], strict=False)] if text else []


def dictionary(some: list[bytes]) -> bytes:
    """A dictionary of the given pieces."""
    try:
        return zstandard.train_dictionary(DICT_BYTES, some).as_bytes()
    except zstandard.ZstdError:  # too few samples to train on: their bytes are the dictionary
        return b"".join(some)[-DICT_BYTES:] or b"\n"


class Classifier:
    def __init__(self, good: bytes, bad: bytes, weights: np.ndarray | None, prior: float):
        self.dicts, self.weights, self.prior, self._made = (good, bad), weights, prior, None

    def __getstate__(self):
        return {**self.__dict__, "_made": None}

    def _compressors(self):
        if self._made is None:
            made = []
            for d in self.dicts:
                z = zstandard.ZstdCompressionDict(d)
                z.precompute_compress(level=LEVEL)
                made.append(zstandard.ZstdCompressor(dict_data=z, write_content_size=False, write_checksum=False, write_dict_id=False))
            self._made = made
        return self._made

    def features(self, text: bytes) -> np.ndarray:
        """1, the normalised difference of compressed sizes (positive: good), both compressed shares, and products."""
        good, bad = self._compressors()
        g = b = 0
        for p in pieces(text):
            g += len(good.compress(p))
            b += len(bad.compress(p))
        n = max(len(text), 1)
        d, s = (b - g) / max(b + g, 1) * 10, (g + b) / (2 * n) * 4 - 1
        k = 1 / (1 + n / 200)
        return np.array([1.0, d, s, d * s, d * d, s * s, k, d * k, s * k])

    def scores(self, docs: list[bytes]) -> np.ndarray:
        if self.weights is None:
            return np.full(len(docs), self.prior)
        x = np.array([self.features(t) if t.strip() else np.zeros(len(self.weights)) for t in docs]).reshape(len(docs), -1)
        p = 1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30))) if len(docs) else np.zeros(0)
        return np.where([bool(t.strip()) for t in docs], p, self.prior)


def _weighted(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Ridge-penalised logistic weights of weighted rows, by Newton steps."""
    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float((weight * (np.logaddexp(0, z) - y * z)).sum() + RIDGE / 2 * w @ w)

    w = np.zeros(x.shape[1])
    now = loss(w)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + RIDGE * np.eye(len(w)), x.T @ (weight * (y - p)) - RIDGE * w)
        size = 1.0
        while size > 1e-6 and loss(w + size * step) > now:  # a full step may overshoot where classes are far apart
            size /= 2
        if size <= 1e-6:
            break
        w = w + size * step
        before, now = now, loss(w)
        if before - now < 1e-9 * max(1.0, now):
            break
    return w


def train(docs: DataFrame, labels: DataFrame, target: str = "quality", per_class: int = PER_CLASS) -> Classifier:
    """labels: the rows that may be learnt from. Dictionaries from either half of the rows measure the other half for the
    curve; the final pair is from all rows."""
    share = labels.agg(F.avg(F.col(target).cast("double"))).first()[0]
    prior = 0.5 if share is None else min(max(share, 0.01), 0.99)
    rows = materialize(one_text_each(docs, labelled_sample(labels, target, per_class)).select("doc_id", F.col("y").cast("int").alias("y"), "text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), pa.array([pieces(t) if t.strip() else [] for t in texts(b.column("text"))], pa.list_(pa.binary()))], ["doc_id", "y", "pieces"])

    found = [(r["doc_id"], r["y"], [bytes(p) for p in r["pieces"]]) for r in rows.mapInArrow(tidy(cut), f"doc_id {kind}, y int, pieces array<binary>").collect()]
    found = sorted((r for r in found if r[2]), key=lambda r: (hash_order(r[0]), str(r[0])))
    by = [[r for r in found if r[1] == c] for c in (0, 1)]
    if not by[0] or not by[1]:
        drop_materialized(rows)
        return Classifier(b"\n", b"\n", None, 0.5)
    build = lambda part: tuple(dictionary([p for r in part(by[c]) for p in r[2]]) for c in (1, 0))
    weights = np.array([0.0, 5.0] + [0.0] * 7)
    if min(map(len, by)) > 1:
        others = [Classifier(*build(lambda x, k=k: x[k::2]), None, prior) for k in (1, 0)]  # of the rows that half k hasn't
        half = {r[0]: i % 2 for x in by for i, r in enumerate(x)}

        def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in slices(batches, "text"):
                own = [(others[half[k]].features(t), y) for k, y, t in zip(b.column("doc_id").to_pylist(), b.column("y").to_pylist(), texts(b.column("text")), strict=True) if k in half]
                yield pa.RecordBatch.from_arrays([pa.array([x.tolist() for x, _ in own], pa.list_(pa.float64())), pa.array([y for _, y in own], pa.int32())], ["x", "y"])

        seen = sorted((r["x"], r["y"]) for r in rows.mapInArrow(tidy(measure), "x array<double>, y int").collect())
        x, t = np.array([r[0] for r in seen]), np.array([r[1] for r in seen])
        weight = np.where(t == 1, prior / max(t.mean(), 1e-9), (1 - prior) / max(1 - t.mean(), 1e-9))  # back to the classes' real shares
        weights = _weighted(x, t, weight)
    drop_materialized(rows)
    return Classifier(*build(lambda x: x), weights, prior)


def hash_order(k) -> int:
    import zlib

    return zlib.crc32(f"order {k}".encode())


def compress_quality(docs: DataFrame, labels: DataFrame, target: str = "quality", per_class: int = PER_CLASS) -> DataFrame:
    """docs (doc_id, text, ...) -> `row` (the input columns as a struct) and score."""
    model = train(docs, labels, target, per_class)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "row"):
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(model.scores(texts(text_of(b))), pa.float64())], ["row", "score"])

    rows = docs.select(F.struct(*docs.columns).alias("row"))
    return rows.mapInArrow(tidy(judge), f"row {rows.schema['row'].dataType.simpleString()}, score double")


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    out = compress_quality(docs.select("doc_id", "text"), labels.where(~held_out("doc_id", 3, 1)))
    doc_id = F.col("row.doc_id")
    return out.select(doc_id.alias("doc_id"), "score").select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
