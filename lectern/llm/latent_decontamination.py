"""Benchmark decontamination by latent semantic retrieval.

1. Document frequencies of hashed words over all passages of all documents.
2. Randomised SVD of the corpus's TF-IDF passage matrix A in one pass: every task adds up its part of Y = A'A Omega for one
   Gaussian Omega; singular vectors and values of A follow from Y and Omega'Y (Nystroem form for a positive matrix).
3. Half-overlapping windows of every text and of every item are projected to the latent space, components scaled by one over
   the singular value. A text's window and an item of whose windows one has a cosine of NEAR or more make a candidate
   (`near`). What can't be a leak is then dropped by exact counts (`probe`): a leak leaves out few of an item's words, so it
   holds some of any few that are chosen, here the corpus's rarest of each item (`_lists`), and a stretch with fewer of an
   item's words than a leak needs is none. Items whose windows have no direction in that space, as their words together
   weigh less than a few chance neighbours do, are searched by these counts alone (`directed`).
4. The longest common subsequence decides: a leak if it has STRONG of the item's words, or WEAK of them and the item's
   answer (the words of its last clause) in it, in some stretch of the item's length and a half (`_reach`).

The benchmark is broadcast in blocks of at most ITEMS items and ITEM_BYTES, one narrow pass over the documents for each
block. What the driver gathers (VOCABULARY counts, a VOCABULARY x RANK matrix) doesn't grow with the corpus; the parts of
that matrix are added up in two levels, so no task gathers one from every task.

Defined cases: null and empty texts hold no leak; items without words leak nowhere; ids may be null or repeat (each row is
judged), an item's id too (its leaks count once, by the greatest share); empty tables give empty results (an empty
benchmark: no leaks); other columns are kept in `row`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, text_of, texts, tidy

VOCABULARY, RANK, SEED = 1 << 15, 48, 5
#: Least cosine of a candidate, and item windows that are compared with a slice of texts at once.
NEAR, QUERIES = 0.25, 512
#: Words of a passage (for counts and SVD) and of a search window; windows start at every half.
PASSAGE, HALF = 24, 12
ITEMS, ITEM_BYTES = 10_000, 16 << 20
#: Hits of an item's rarest words that a candidate must have; the more, the longer the lists of such words must be.
HITS = 2
STRONG, WEAK, ANSWER = 0.7, 0.5, 0.8
SLICE = 1 << 20
_PUNCTUATION = bytes(range(33, 48)) + bytes(range(58, 65)) + bytes(range(91, 97)) + bytes(range(123, 127))
_TABLE = bytes.maketrans(_PUNCTUATION + b"\t\n\x0b\x0c\r", b" " * (len(_PUNCTUATION) + 5))


def normal(text: bytes) -> bytes:
    """Lower case, ASCII punctuation and white space as spaces."""
    low = text.lower() if text.isascii() else text.decode("utf-8", "replace").lower().encode()
    return low.translate(_TABLE)


def tokens(text: bytes) -> list[bytes]:
    """Lower-cased words, ASCII punctuation removed."""
    return normal(text).split()


_BASE = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = []
_CHUNK = 1 << 22


def _powers(n: int) -> list[np.ndarray]:
    """Powers 0 to n at least of the base and of its inverse modulo 2 ** 64."""
    if not _POWERS or len(_POWERS[0]) <= n:
        made = []
        for b in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(max(n + 1, 1 << 20), b, np.uint64)
            p[0] = 1
            made.append(np.cumprod(p))
        _POWERS[:] = made
    return _POWERS


def _buckets(line: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(first byte, bucket) of each run of bytes other than the space."""
    raw = np.frombuffer(line, np.uint8)
    gap = np.concatenate([[True], raw == 32, [True]])
    edges = np.nonzero(gap[1:] != gap[:-1])[0]
    first, end = edges[::2], edges[1::2]
    power, inverse = _powers(len(raw))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(raw * power[: len(raw)])])
    h = (sums[end] - sums[first]) * inverse[first]
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return first, (h >> np.uint64(64 - VOCABULARY.bit_length() + 1)).astype(np.uint16)


def _hashed(docs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Word buckets of all texts (normalised) in a row, and words of each text."""
    line = b" ".join(docs)
    ends = np.cumsum(np.fromiter(map(len, docs), np.int64, len(docs)) + 1)
    firsts, ids, at = [np.zeros(0, np.int64)], [np.zeros(0, np.uint16)], 0
    while at < len(line):  # a few MB at a time, cut at a space, however long a text is
        cut = len(line) if len(line) - at <= _CHUNK else line.rfind(b" ", at, at + _CHUNK)
        cut = cut if cut > at else (line.find(b" ", at + _CHUNK) if line.find(b" ", at + _CHUNK) > 0 else len(line))
        first, own = _buckets(line[at:cut])
        firsts.append(first + at)
        ids.append(own)
        at = cut
    return np.concatenate(ids), np.diff(np.searchsorted(np.concatenate(firsts), ends), prepend=0)


def _chunks(sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, text) of the chunks of length words (a text's last may be shorter)."""
    n = -(-sizes // length)
    total = int(n.sum())
    text = np.repeat(np.arange(len(sizes)), n)
    rank = np.arange(total) - np.repeat(np.cumsum(n) - n, n)
    return (np.cumsum(sizes) - sizes)[text] + rank * length, text


def _sums(table: np.ndarray, ids: np.ndarray, first: np.ndarray, length: int) -> np.ndarray:
    """Sums of the rows of table at ids over the chunks of at most length words that begin at first and end where the next
    begins. table has a last row of zeros for words that a short chunk lacks."""
    size = np.diff(np.append(first, len(ids)))
    out = np.zeros((len(first), table.shape[1]), table.dtype)
    for j in range(length):
        own = np.where(size > j, ids[np.minimum(first + j, len(ids) - 1)].astype(np.int32), len(table) - 1)
        out += np.take(table, own, axis=0, mode="clip")
    return out


def _padded(table: np.ndarray) -> np.ndarray:
    return np.vstack([table, np.zeros((1, table.shape[1]), table.dtype)])


def inverse_frequency(frequency: np.ndarray, n: int) -> np.ndarray:
    """Every word weighs something, however common it is."""
    return np.log((n + 1) / (np.minimum(frequency, n) + 1)) + 0.1


def document_frequency(docs: DataFrame) -> tuple[np.ndarray, int, int]:
    """Passages of the corpus that hold each word bucket, the number of passages, and that of the tasks that counted."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(VOCABULARY, np.int64), 0
        for b in slices(batches, "text", SLICE):
            ids, sizes = _hashed([normal(t) for t in texts(b.column("text"))])
            if len(ids):
                first, _ = _chunks(sizes, PASSAGE)
                order = np.argsort(ids, kind="stable")  # a radix sort; passages ascend within a bucket
                own, passage = ids[order], np.repeat(np.arange(len(first)), np.diff(np.append(first, len(ids))))[order]
                new = np.concatenate([[True], (own[1:] != own[:-1]) | (passage[1:] != passage[:-1])])
                total += np.bincount(own[new], minlength=VOCABULARY)
                n += len(first)
        some = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, [-1, -2]).astype(np.int32)), pa.array(np.append(total[some], [n, 1]))], ["bucket", "n"])

    rows = docs.select("text").mapInArrow(tidy(count), "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out, sums = np.zeros(VOCABULARY), {-1: 0, -2: 0}
    for bucket, k in zip(rows["bucket"], rows["n"], strict=True):
        if bucket < 0:
            sums[bucket] = int(k)
        else:
            out[bucket] = k
    return out, sums[-1], sums[-2]


def _sketch(y: np.ndarray, ids: np.ndarray, sizes: np.ndarray, weighted: np.ndarray, w: np.ndarray) -> None:
    """Add A'A Omega of some texts' passages (rows of A have unit length) to y. weighted: Omega, each row times its idf."""
    first, _ = _chunks(sizes, PASSAGE)
    norm = _sums(w[:, None] ** 2, ids, first, PASSAGE)
    z = _sums(weighted, ids, first, PASSAGE) / np.maximum(norm, 1e-6)
    kept = np.nonzero(w[ids])[0]
    if not len(kept):
        return
    own, row = ids[kept], np.repeat(np.arange(len(first)), np.diff(np.append(first, len(ids))))[kept]
    for column, values in zip(y, np.ascontiguousarray(z.T), strict=True):
        column += np.bincount(own, values[row], VOCABULARY) * w[:VOCABULARY]


def latent_space(docs: DataFrame, idf: np.ndarray, tasks: int) -> tuple[np.ndarray, np.ndarray]:
    """(right singular vectors: VOCABULARY x RANK, singular values) of the TF-IDF passages, rows of unit length. tasks: how
    many tasks read docs; their parts are added up among those of equal number modulo its square root, then over these."""
    group, sums = 32, max(1, round(tasks**0.5))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        omega = np.random.default_rng(SEED).standard_normal((VOCABULARY, RANK)).astype(np.float32)
        w = np.append(idf, 0).astype(np.float32)
        weighted = _padded(omega) * w[:, None]
        y = np.zeros((RANK, VOCABULARY))
        for b in slices(batches, "text", SLICE):
            ids, sizes = _hashed([normal(t) for t in texts(b.column("text"))])
            if not len(ids):
                continue
            _sketch(y, ids, sizes, weighted, w)
        parts = np.ascontiguousarray(y.T).reshape(VOCABULARY // group, -1)
        by = np.full(len(parts), TaskContext.get().partitionId() % sums, np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(parts), dtype=np.int32)), pa.array(by), pa.array([p.astype(np.float32).tobytes() for p in parts], pa.binary())], ["part", "by", "y"])

    def total_of(table: pa.Table, kind) -> pa.Table:
        total = np.zeros(group * RANK)
        for x in table.column("y").to_pylist():
            total += np.frombuffer(x, kind)
        return pa.table({"part": table.column("part")[:1], "y": pa.array([total.tobytes()], pa.binary())}, schema=pa.schema([("part", pa.int32()), ("y", pa.binary())]))

    def add(table: pa.Table) -> pa.Table:
        return total_of(table, np.float32)

    def add_sums(table: pa.Table) -> pa.Table:
        return total_of(table, np.float64)

    y = np.zeros((VOCABULARY // group, group * RANK))
    some = docs.select("text").mapInArrow(tidy(sketch), "part int, by int, y binary").groupBy("part", "by").applyInArrow(add, "part int, y binary")
    for r in some.groupBy("part").applyInArrow(add_sums, "part int, y binary").collect():
        y[r["part"]] = np.frombuffer(bytes(r["y"]))
    y = y.reshape(VOCABULARY, RANK)
    omega = np.random.default_rng(SEED).standard_normal((VOCABULARY, RANK)).astype(np.float32).astype(float)
    shift = 1e-9 * max(np.linalg.norm(y), 1e-12)
    y += shift * omega
    core = omega.T @ y
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    keep = values > 1e-10 * max(values.max(), 1e-12)
    u, s, _ = np.linalg.svd(y @ (vectors[:, keep] / np.sqrt(values[keep])), full_matrices=False)
    return u, np.sqrt(np.maximum(s**2 - shift, 0))


class Searcher:
    """Finds the leaks of a block of benchmark items in texts."""

    def __init__(self, items: list[tuple[int, bytes]], frequency: np.ndarray, idf: np.ndarray, vectors: np.ndarray, values: np.ndarray):
        scale = 1 / np.maximum(values, 1e-3 * max(values.max(initial=0), 1e-12))
        self.words = _padded((vectors * scale * idf[:, None]).astype(np.float32))
        self.items, self.ids, self.answers = [], [], []
        for k, text in items:
            if t := tokens(text):
                self.ids.append(k)
                self.items.append(t)
                self.answers.append(_answer(text))
        windows, self.start = [], [0]
        for t in self.items:
            for a in [*range(0, max(len(t) - 2 * HALF, 0), HALF), max(len(t) - 2 * HALF, 0)]:
                windows.append(t[a : a + 2 * HALF])
            self.start.append(len(windows))
        self.queries = self._project(windows)
        if self.items:
            self.directed = self._directed(windows, frequency, idf)
            self._prepare(frequency)

    def _directed(self, windows: list[list[bytes]], frequency: np.ndarray, idf: np.ndarray) -> np.ndarray:
        """Of each item, whether all its windows have a direction: they outweigh the words that may stand beside a part of
        them in a text's window (a quarter of one, of the corpus's mean weight)."""
        ids, sizes = _hashed([b" ".join(w) for w in windows])
        first = np.cumsum(sizes) - sizes
        weight = _sums(_padded(idf[:, None] ** 2), ids, first, 2 * HALF)[:, 0]
        stray = HALF / 2 * (frequency * idf**2).sum() / max(frequency.sum(), 1)
        return np.logical_and.reduceat(weight >= stray, self.start[:-1])

    def _project(self, windows: list[list[bytes]]) -> np.ndarray:
        ids, sizes = _hashed([b" ".join(w) for w in windows])
        first = np.cumsum(sizes) - sizes
        return _unit(_sums(self.words, ids, first, 2 * HALF))

    def leaks(self, docs: list[bytes]) -> list[dict[int, float]]:
        """For each text, item id -> share of the item's words in the common subsequence."""
        out: list[dict[int, float]] = [{} for _ in docs]
        if not self.items:
            return out
        lines = [normal(t) for t in docs]
        split: dict[int, list[bytes]] = {}  # words of the few texts that have candidates
        for d, at, k in self.probe(lines):
            if d not in split:
                split[d] = lines[d].split()
            if out[d].get(self.ids[k], 0.0) < 1 and (share := self.stretches(split[d], at, k)):
                out[d][self.ids[k]] = max(share, out[d].get(self.ids[k], 0.0))
        return out

    def near(self, ids: np.ndarray, first: np.ndarray, text: np.ndarray, starts: np.ndarray, ends: np.ndarray, items: np.ndarray) -> np.ndarray:
        """Which of some stretches (halves from starts on before ends, with an item each, by item) are candidates: a window
        that begins in the stretch is near one of the item's. The windows of all stretches are compared with those of a block
        of items at once; windows and blocks that no stretch asks for are passed over."""
        if not len(items):
            return np.zeros(0, bool)
        vectors = _sums(self.words, ids, first, HALF)
        same = np.nonzero(text[1:] == text[:-1])[0]
        vectors[same] += vectors[same + 1]  # a fresh copy on the right, so halves are those of before
        asked = np.zeros(len(first) + 1, np.int64)
        np.add.at(asked, starts, 1)
        np.add.at(asked, ends, -1)
        halves = np.nonzero(np.cumsum(asked[:-1]) > 0)[0]
        column = np.zeros(len(first), np.int64)
        column[halves] = np.arange(len(halves))
        windows, found, k = np.ascontiguousarray(_unit(vectors[halves]).T), np.zeros(len(items), bool), 0
        begin = np.array(self.start)
        while k < len(self.items):
            to = max(k + 1, int(np.searchsorted(begin, begin[k] + QUERIES, side="right")) - 1)
            lo, hi = np.searchsorted(items, [k, to])
            if lo < hi:
                cosines, own = self.queries[begin[k] : begin[to]] @ windows, items[lo:hi]
                for j in range(int((ends[lo:hi] - starts[lo:hi]).max())):
                    at = np.minimum(starts[lo:hi] + j, ends[lo:hi] - 1)
                    for i in range(int((begin[own + 1] - begin[own]).max())):
                        row = np.minimum(begin[own] + i, begin[own + 1] - 1) - begin[k]
                        found[lo:hi] |= cosines[row, column[at]] >= NEAR
            k = to
        return found

    def probe(self, lines: list[bytes]) -> Iterator[tuple[int, int, int]]:
        """(text, first word in the text, item) of the stretches around candidates that have enough of an item's words for a leak. A stretch
        from one half's start on holds all those of `_reach` words that begin in the half. Counted in buckets, so words that
        share one only add candidates: none is lost."""
        ids, sizes = _hashed(lines)
        if not len(ids):
            return
        first, text = _chunks(sizes, HALF)
        begin, past = (np.cumsum(sizes) - sizes)[text], np.cumsum(sizes)[text]
        opening = np.searchsorted(text, text)  # first half of the same text
        half = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(ids))))
        starts, items = self._starts(ids, half, opening)
        ends = np.minimum(starts + self.span[items], np.searchsorted(text, text[starts], side="right"))
        kept = self.near(ids, first, text, starts, ends, items) | ~self.directed[items]
        starts, items = starts[kept], items[kept]
        edges = np.nonzero(np.diff(items, prepend=-1, append=-1))[0]
        row = np.zeros(VOCABULARY, np.int16)
        for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            k = int(items[lo])
            buckets, times, answer = self.own[k]
            row[buckets] = np.arange(1, len(buckets) + 1)
            for i in range(lo, hi, 1 << 12):  # each word counts as often as the item has it, no more
                x = starts[i : min(i + (1 << 12), hi)]
                at = first[x][:, None] + np.arange(self.reach[k])
                slot = np.where(at < past[x][:, None], row[ids[np.minimum(at, len(ids) - 1)]], 0) + np.arange(len(x))[:, None] * (len(buckets) + 1)
                n = np.bincount(slot.ravel(), minlength=len(x) * (len(buckets) + 1)).reshape(len(x), -1)[:, 1:]
                have = np.minimum(n, times).sum(axis=1)
                x = x[(have >= self.need[k]) | (have >= self.weak[k]) & (np.minimum(n, answer).sum(axis=1) >= self.answer[k])]
                yield from zip(text[x].tolist(), (first[x] - begin[x]).tolist(), [k] * len(x), strict=True)
            row[buckets] = 0

    def _starts(self, ids: np.ndarray, half: np.ndarray, opening: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(half, item), by item, of the stretches in which enough words of an item's lists lie."""
        found = [np.zeros(0, np.int64)]
        for ends, items, hits in self.lists:
            lo, n = ends[ids], ends[ids.astype(np.int64) + 1] - ends[ids]
            word = np.repeat(np.arange(len(ids)), n)
            if not len(word):
                continue
            k = items[lo[word] + np.arange(len(word)) - np.repeat(np.cumsum(n) - n, n)].astype(np.int64)
            key, count = np.unique(k * (len(half) + 1) + half[word], return_counts=True)
            k, h = np.divmod(key, len(half) + 1)
            # a hit counts for the stretches that begin in its half or up to span - 1 halves before, in its text
            back = np.minimum(self.span[k], h - opening[h] + 1)
            of = np.repeat(np.arange(len(key)), back)
            start = h[of] - (np.arange(len(of)) - np.repeat(np.cumsum(back) - back, back))
            key, at = np.unique(k[of] * (len(half) + 1) + start, return_inverse=True)
            found.append(key[np.bincount(at, count[of]) >= hits[key // (len(half) + 1)]])
        k, a = np.divmod(np.unique(np.concatenate(found)), len(half) + 1)
        return a, k

    def _prepare(self, frequency: np.ndarray) -> None:
        """What probe() looks up: needs, reaches, the buckets of each item, and lists of items by rare bucket."""
        least = lambda share, of: np.ceil(share * of - 1e-9).astype(np.int64)
        n, m = np.array([len(t) for t in self.items]), np.array([len(t) for t in self.answers])
        self.need = least(STRONG, n)
        self.weak, self.answer = np.where(m >= 3, least(WEAK, n), self.need), np.where(m >= 3, least(ANSWER, m), 1 << 30)
        self.reach = np.array([self._reach(k) + HALF - 1 for k in range(len(n))])
        self.span = -(-self.reach // HALF)
        own = [np.unique(_hashed([b" ".join(t)])[0], return_counts=True) for t in self.items]
        self.own = []  # of each item: its buckets, how often it has them, how often its answer has them
        pairs: list[list[tuple[int, int]]] = [[], []]
        hits = np.ones((2, len(n)), np.int64)
        for k, (buckets, count) in enumerate(own):
            in_answer = np.zeros(len(buckets), np.int64)
            self.own.append((buckets, count, in_answer))
            self._choose(k, buckets, count, int(n[k] - self.need[k]), int(self.need[k]), frequency, pairs[0], hits[0])
            if m[k] >= 3:
                part, count = np.unique(_hashed([b" ".join(self.answers[k])])[0], return_counts=True)
                in_answer[np.searchsorted(buckets, part)] = count
                self._choose(k, part, count, int(m[k] - self.answer[k]), int(self.answer[k]), frequency, pairs[1], hits[1])
        self.lists = []
        for of, h in zip(pairs, hits, strict=True):
            bucket, item = np.array(of or [(VOCABULARY, 0)], np.int64).T
            order = np.argsort(bucket, kind="stable")
            self.lists.append((np.searchsorted(bucket[order], np.arange(VOCABULARY + 1)), item[order].astype(np.int32), h))

    def _choose(self, k: int, buckets: np.ndarray, count: np.ndarray, missing: int, need: int, frequency: np.ndarray, out: list, hits: np.ndarray) -> None:
        """The rarest buckets of which a leak, lacking no more than `missing` words, has hits[k] words at least."""
        hits[k] = min(HITS, need)
        total = 0
        for b in np.argsort(frequency[buckets], kind="stable"):
            if total >= missing + hits[k]:
                break
            out.append((int(buckets[b]), k))
            total += int(count[b])

    def _reach(self, k: int) -> int:
        """Words of text that an item may be spread over."""
        n = len(self.items[k])
        return n + 2 * (n // 4 + 2)

    def stretches(self, doc: list[bytes], at: int, k: int) -> float:
        """The greatest common share of the stretches of `_reach` words that begin in a half, if it makes a leak, else 0."""
        reach = self._reach(k)
        if not self._judge(doc[at : at + reach + HALF - 1], k):
            return 0.0
        best = 0.0
        for i in range(at, at + HALF):
            best = max(best, self._judge(doc[i : i + reach], k))
            if best == 1:
                break
        return best

    def _judge(self, near: list[bytes], k: int) -> float:
        """The common share of an item and some text if it makes a leak, else 0."""
        share = lcs(self.items[k], near, self._places(k)) / len(self.items[k])
        if share >= STRONG:
            return share
        if share >= WEAK and len(self.answers[k]) >= 3:
            places: dict[bytes, list[int]] = {}
            for i, w in enumerate(self.answers[k]):
                places.setdefault(w, []).append(i)
            if lcs(self.answers[k], near, places) >= ANSWER * len(self.answers[k]):
                return share
        return 0.0

    def _places(self, k: int) -> dict[bytes, list[int]]:
        if not hasattr(self, "_cache"):
            self._cache: dict[int, dict[bytes, list[int]]] = {}
        if k not in self._cache:
            places: dict[bytes, list[int]] = {}
            for i, w in enumerate(self.items[k]):
                places.setdefault(w, []).append(i)
            self._cache[k] = places
        return self._cache[k]


def _answer(text: bytes) -> list[bytes]:
    """Words of the last clause that has three or more."""
    clauses = [tokens(c) for c in text.replace(b"?", b".").replace(b"!", b".").replace(b"\n", b".").split(b".")]
    return next((c for c in reversed(clauses) if len(c) >= 3), [])


def lcs(item: list[bytes], other: list[bytes], places: dict[bytes, list[int]]) -> int:
    """Length of the longest common subsequence, bit-parallel over the item. places: positions of each word in the item."""
    row, full = 0, (1 << len(item)) - 1
    for w in other:
        if w in places:
            match = 0
            for i in places[w]:
                match |= 1 << i
            x = match | row
            row = x & ~(x - ((row << 1) | 1)) & full
    return row.bit_count()


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def latent_decontamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs (doc_id, text, ...) -> `row` (the input columns as a struct), items (ids of leaked items, ascending), shares."""
    kind = docs.select(F.struct(*docs.columns).alias("row")).schema["row"].dataType.simpleString()
    out = docs.select(F.struct(*docs.columns).alias("row"), F.expr("cast(array() as array<bigint>) as items"), F.expr("cast(array() as array<double>) as shares"))
    frequency, n, tasks = document_frequency(docs)
    idf = inverse_frequency(frequency, n)
    vectors, values = latent_space(docs, idf, tasks)
    block: list[tuple[int, bytes]] = []

    def search(df: DataFrame, items: list[tuple[int, bytes]]) -> DataFrame:
        searcher = Searcher(items, frequency, idf, vectors, values)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in slices(batches, "row", SLICE):
                found = searcher.leaks(texts(text_of(b)))
                before = zip(b.column("items").to_pylist(), b.column("shares").to_pylist(), strict=True)
                merged = []
                for (i, s), f in zip(before, found, strict=True):
                    for k, share in zip(i, s, strict=True):
                        f[k] = max(share, f.get(k, 0.0))
                    merged.append(sorted(f.items()))
                yield pa.RecordBatch.from_arrays([b.column("row"), pa.array([[i for i, _ in m] for m in merged], pa.list_(pa.int64())), pa.array([[s for _, s in m] for m in merged], pa.list_(pa.float64()))], ["row", "items", "shares"])

        return df.mapInArrow(tidy(run), f"row {kind}, items array<bigint>, shares array<double>")

    rows = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("bigint").alias("k"), F.encode("text", "UTF-8").alias("t")).orderBy("k", "t")
    size = 0
    for r in rows.toLocalIterator():
        block.append((r["k"], bytes(r["t"])))
        size += len(r["t"])
        if len(block) == ITEMS or size >= ITEM_BYTES:
            out, block, size = search(out, block), [], 0
    return search(out, block) if block else out


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    out = latent_decontamination(docs.select("doc_id", "text"), benchmark)
    return out.select(F.col("row.doc_id").alias("doc_id"), (F.size("items") > 0).alias("contaminated"), "items", F.array_max("shares").alias("common_share"))
