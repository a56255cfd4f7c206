"""Substring dedup by seed and extend: words inside repeated 35-word windows go.

1. Seed. Each text is cut to words; of every `window - GRAM + 1` consecutive GRAM-word hashes the least one is an anchor
   (winnowing), so that equal windows own equal anchors at equal offsets. Anchor hashes are counted over all documents,
   pre-aggregated per block of texts; those found once can't lie in a repeat and end here.
2. Extend. The words left and right of each repeated anchor, as far as the windows that own it reach, are hashed (96 bits).
   Occurrences with equal contexts form a class; a class of two or more is a repeat over its whole reach, whatever the
   number of copies, and needs no more work.
3. Where an anchor has several classes, each window that owns it is hashed and counted: a repeat extends left and right as
   far as some other occurrence shares the window. No pairs of documents arise anywhere.
4. Cut. Repeated classes and windows go back to their blocks, and the words they cover are removed: the union of
   overlapping windows is the maximal repeat over the length threshold.

Words are `[^\\x20\\x09-\\x0D]+`, unchanged. Defined cases: null text has no words; texts shorter than a window keep all
words; a window found twice in one text counts; ids may be null or repeat (each row is a text of its own, so repeated rows
remove each other's long passages); empty tables give empty results.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, compress, count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_materialized, materialize, texts, with_block

WINDOW, GRAM = 35, 16
_M1, _M2 = 0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(half: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n at least of the half's base and of its inverse modulo 2 ** 64."""
    if half not in _POWERS or len(_POWERS[half][0]) <= n:
        base, out = (_M1, _M2)[half], []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(max(n + 1, 1 << 18), b, np.uint64)
            p[0] = 1
            out.append(np.cumprod(p))
        _POWERS[half] = out[0], out[1]
    return _POWERS[half]


class Words:
    """Words of several texts in a row, as hashes, with what is needed to hash any run of them."""

    def __init__(self, docs: list[bytes]):
        known: defaultdict[bytes, int] = defaultdict(count().__next__)
        split = [text.split() for text in docs]
        self.sizes = np.fromiter(map(len, split), np.int64, len(docs))
        self.n, self.ends = int(self.sizes.sum()), np.cumsum(self.sizes)
        self.ids = np.fromiter(map(known.__getitem__, chain.from_iterable(split)), np.int64, self.n)
        self._digests = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, known)), "<u8").reshape(-1, 2)
        self.left = np.repeat(self.ends, self.sizes) - np.arange(self.n)  # words from here to the end of the text
        self._sums: dict[int, np.ndarray] = {}

    def runs(self, first: np.ndarray, size, half: int) -> np.ndarray:
        """Hash of the size words from each first on; equal runs have equal hashes wherever they lie."""
        power, inverse = _powers(half, self.n)
        if half not in self._sums:
            w = _mix(self._digests[:, half] + np.uint64(half))[self.ids] if self.n else np.zeros(0, np.uint64)
            self._sums[half] = np.concatenate([np.zeros(1, np.uint64), np.cumsum(w * power[: self.n])])
        s = self._sums[half]
        return _mix((s[first + size] - s[first]) * inverse[first] + np.asarray(size).astype(np.uint64))


def anchors(words: Words, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(position, hash, first window, windows) of each anchor: windows [first, first + windows) of the row of words have
    it as the least of their gram hashes (the rightmost of equals)."""
    span = window - gram + 1
    starts = np.nonzero(words.left >= window)[0]
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none, none.astype(np.uint64), none, none
    grams = np.full(words.n, np.iinfo(np.uint64).max, np.uint64)
    ok = np.nonzero(words.left >= gram)[0]
    grams[ok] = words.runs(ok, gram, 0)
    # sliding rightmost minimum by doubling: (value, position) of the least in [i, i + length)
    best, at, length = grams.copy(), np.arange(words.n), 1
    while length < span:
        step = min(length, span - length)
        other, place = best[step:], at[step:]
        take = other <= best[:-step]
        best[:-step] = np.where(take, other, best[:-step])
        at[:-step] = np.where(take, np.maximum(place, 0), at[:-step])
        length += step
    own = at[starts]
    edge = np.nonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (starts[1:] != starts[:-1] + 1)]))[0]
    return own[edge], grams[own[edge]], starts[edge], np.diff(np.concatenate([edge, [len(starts)]]))


def _flagged(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """known: sorted."""
    if not len(known):
        return np.zeros(len(values), bool)
    i = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return known[i] == values


def _pieces(table: pa.Table, max_bytes: int = 2 << 20) -> Iterator[pa.Table]:
    """Rows of a block in the order of their ids and texts, a few MB at a time."""
    at, size = 0, 0
    lens = [len(x) for x in texts(table.column("text"))]
    for i, n in enumerate(lens):
        if size and size + n > max_bytes:
            yield table.slice(at, i - at)
            at, size = i, 0
        size += n
    yield table.slice(at)


def _keys(words: Words, first: np.ndarray, size, tag: np.ndarray | int = 0) -> np.ndarray:
    """(lo, hi): 96 bits for each run of words."""
    out = np.empty(len(first), [("lo", "<i8"), ("hi", "<i4")])
    tag = np.asarray(tag).astype(np.uint64)
    out["lo"] = (words.runs(first, size, 0) ^ _mix(tag)).view(np.int64)
    out["hi"] = ((words.runs(first, size, 1) ^ _mix(tag)) >> np.uint64(33)).astype(np.int32)
    return out


def _contexts(words: Words, pos: np.ndarray, first: np.ndarray, windows: np.ndarray, window: int) -> np.ndarray:
    """Keys of all words that an anchor's windows cover, with where the anchor lies among them."""
    return _keys(words, first, windows - 1 + window, pos - first + 1)


def _spread(first: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """The first words of all windows of the given anchors."""
    total = np.cumsum(windows)
    return np.repeat(first - (total - windows), windows) + np.arange(int(total[-1]) if len(total) else 0)


def _known(table: pa.Table) -> np.ndarray:
    out = np.empty(table.num_rows, [("lo", "<i8"), ("hi", "<i4")])
    out["lo"], out["hi"] = table.column("lo").to_numpy(), table.column("hi").to_numpy()
    return out


def _among(keys: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which keys are known: by their low halves first, then by both."""
    out = np.zeros(len(keys), bool)
    if len(keys) and len(known):
        known = np.unique(known)
        at = np.searchsorted(known["lo"], keys["lo"])
        while True:  # equal low halves of different keys are next to each other; hardly ever more than one
            same = (at < len(known)) & (known["lo"][np.minimum(at, len(known) - 1)] == keys["lo"])
            if not same.any():
                break
            out |= same & (known["hi"][np.minimum(at, len(known) - 1)] == keys["hi"])
            at += 1
    return out


def substring_dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, n_words, n_removed, kept (its words joined by one space)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    blocks = with_block(docs.select("doc_id", "text"), "text", "doc_id").select("block", "doc_id", "text")
    by_block = lambda df: df.groupBy("block")

    def seeds(table: pa.Table) -> pa.Table:
        found = [anchors(Words(texts(p.column("text"))), window, gram)[1] for p in _pieces(table)]
        value, n = np.unique(np.concatenate(found), return_counts=True)
        return pa.table({"block": _same(table, len(value)), "anchor": value.view(np.int64), "n": n})

    seen = materialize(by_block(blocks).applyInArrow(seeds, "block int, anchor bigint, n bigint"))
    # what is joined is written first, and merged at every size: adaptive execution splits a common anchor's partition
    often = materialize(seen.groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1").select("anchor"), False)
    repeated = materialize(seen.join(often.hint("merge"), "anchor").select("block", "anchor"))
    for df in (seen, often):
        drop_materialized(df)

    def extend(table: pa.Table, marked: pa.Table) -> pa.Table:
        flags, rows = np.sort(marked.column("anchor").to_numpy().view(np.uint64)), []
        for piece in _pieces(table) if marked.num_rows else ():
            words = Words(texts(piece.column("text")))
            pos, value, first, windows = anchors(words, window, gram)
            some = _flagged(value, flags)
            row = np.empty(int(some.sum()), [("anchor", "<u8"), ("lo", "<i8"), ("hi", "<i4")])
            key = _contexts(words, pos[some], first[some], windows[some], window)
            row["anchor"], row["lo"], row["hi"] = value[some], key["lo"], key["hi"]
            rows.append(row)
        row, n = np.unique(np.concatenate([*rows, np.empty(0, [("anchor", "<u8"), ("lo", "<i8"), ("hi", "<i4")])]), return_counts=True)
        return pa.table({"block": _same(table, len(row)), "anchor": np.ascontiguousarray(row["anchor"]).view(np.int64), "lo": np.ascontiguousarray(row["lo"]), "hi": np.ascontiguousarray(row["hi"]), "n": n})

    parts = materialize(by_block(blocks).cogroup(by_block(repeated)).applyInArrow(extend, "block int, anchor bigint, lo bigint, hi int, n bigint"))
    drop_materialized(repeated)
    classes = materialize(parts.groupBy("anchor", "lo", "hi").agg(F.sum("n").alias("n")))
    mixed = materialize(classes.groupBy("anchor").count().where(F.col("count") > 1).select("anchor"), False)
    # of these anchors, classes of two or more are settled, but their windows count for the other classes
    open_ = materialize(parts.join(mixed.hint("merge"), "anchor").select("block", "anchor"))  # some twice; the blocks don't mind

    def windows_of(table: pa.Table, marked: pa.Table) -> pa.Table:
        flags, keys = np.sort(marked.column("anchor").to_numpy().view(np.uint64)), [np.empty(0, [("lo", "<i8"), ("hi", "<i4")])]
        for piece in _pieces(table) if marked.num_rows else ():
            words = Words(texts(piece.column("text")))
            _, value, first, windows = anchors(words, window, gram)
            some = _flagged(value, flags)
            keys.append(_keys(words, _spread(first[some], windows[some]), window))
        key, n = np.unique(np.concatenate(keys), return_counts=True)
        return pa.table({"block": _same(table, len(key)), "lo": np.ascontiguousarray(key["lo"]), "hi": np.ascontiguousarray(key["hi"]), "n": n})

    each = materialize(by_block(blocks).cogroup(by_block(open_)).applyInArrow(windows_of, "block int, lo bigint, hi int, n bigint"))
    drop_materialized(open_)
    twice = materialize(each.groupBy("lo", "hi").agg(F.sum("n").alias("n")).where("n > 1").select("lo", "hi"), False)
    whole = materialize(classes.where("n > 1").select("lo", "hi").distinct(), False)
    of_windows = each.join(twice.hint("merge"), ["lo", "hi"]).select("block", F.lit(False).alias("whole"), "lo", "hi")
    of_classes = parts.join(whole.hint("merge"), ["lo", "hi"]).select("block", F.lit(True).alias("whole"), "lo", "hi")
    marks = materialize(of_windows.unionByName(of_classes))
    for df in (each, parts, classes, mixed, twice, whole):
        drop_materialized(df)

    def cut(table: pa.Table, marked: pa.Table) -> pa.Table:
        is_whole = marked.column("whole").to_numpy(zero_copy_only=False)
        known = _known(marked)
        classes_here, windows_here = np.unique(known[is_whole]), np.unique(known[~is_whole])
        n_words, n_removed, kept = [], [], []
        for piece in _pieces(table):
            docs = texts(piece.column("text"))
            words = Words(docs)
            pos, _, first, windows = anchors(words, window, gram)
            full = _among(_contexts(words, pos, first, windows, window), classes_here)
            starts = _spread(first[~full], windows[~full])
            starts = starts[_among(_keys(words, starts, window), windows_here)]
            cover = np.zeros(words.n + 1, np.int64)
            np.add.at(cover, np.concatenate([first[full], starts]), 1)
            np.add.at(cover, np.concatenate([first[full] + windows[full] - 1 + window, starts + window]), -1)
            gone = np.cumsum(cover[: words.n]) > 0
            for text, a, b in zip(docs, (words.ends - words.sizes).tolist(), words.ends.tolist(), strict=True):
                g = gone[a:b]
                n_words.append(b - a)
                n_removed.append(int(g.sum()))
                kept.append(b" ".join(compress(text.split(), (~g).tolist()) if n_removed[-1] else text.split()))
        return pa.table({"doc_id": table.column("doc_id"), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept": pa.array(kept, pa.binary()).cast(pa.string())})

    return by_block(blocks).cogroup(by_block(marks)).applyInArrow(cut, f"doc_id {kind}, n_words bigint, n_removed bigint, kept string")


def _same(table: pa.Table, n: int) -> pa.Array:
    return pa.array(np.full(n, table.column("block")[0].as_py() if table.num_rows else -1, np.int32))


def digest(docs: DataFrame) -> DataFrame:
    return substring_dedup(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = r"""
with d as (select row_number() over () as r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
w as (select r, unnest(range(1, len(ws) - 33)) as i, ws from d where len(ws) >= 35),
h as (select r, i, md5(array_to_string(ws[i:i+34], ' ')) as h from w),
t as (select r, i from h where h in (select h from h group by h having count(*) > 1)),
c as (select distinct r, i + j as p from t, range(0, 35) as x(j)),
l as (select r, unnest(ws) as word, generate_subscripts(ws, 1) as p from d),
k as (select r, string_agg(word, ' ' order by p) as kept, count(*) as n from l anti join c using (r, p) group by r)
select doc_id, len(ws) as n_words, len(ws) - coalesce(n, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from d left join k using (r)
"""
