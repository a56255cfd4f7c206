"""SimHash near-dedup by anchor-point covering.

Fingerprints (64 bits) of word shingles link at `threshold` or fewer differing bits. They are cut into three segments of
21, 21 and 22 bits; of four differing bits at most one lies in some segment. In each segment the anchors are the code
words of a Hamming(15, 11) code next to the remaining bits as they are: covering radius 1. A fingerprint is at home at its
nearest anchor and replicated to every anchor within 1 + 1 bits (covering radius plus the segment's share of the
threshold), so linked fingerprints meet at the home of either. Homes and replicas are compared per anchor; only the links
that join something new within a task leave it, never all pairs. Anchors with many homes are dealt out in chunks.

Equal fingerprints are merged before anything is compared, so copies of any number cost one row. Components come from
alternating star contraction over DataFrames.

Defined cases: null and empty texts have fingerprint zero and link like any other; ids may be null (ignored when the least
id of a component is taken) or repeat (each row is returned); empty tables give empty results; other columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, drop_materialized, materialize, slices, texts, tidy, word_pieces

SHINGLE, SEED, THRESHOLD = 4, 42, 4
#: (first bit, bits) of each segment; the first 15 of a segment's bits are coded, the others enter the anchor as they are.
SEGMENTS = ((0, 21), (21, 21), (42, 22))
CODED = 15
#: Homes of one anchor that one comparison task takes; more are dealt out in chunks of this size.
CHUNK = 20_000


#: Shingle hashes whose bits are counted at once.
COUNTED = 1 << 15


def _shingle_hashes(text: bytes, shingle: int, seed: int) -> Iterator[list[int]]:
    """XXH64 of a text's shingles, a piece of the text at a time; the last words of a piece go on to the next."""
    held: list[bytes] = []
    some, xx = False, xxhash.xxh64_intdigest
    for piece in word_pieces(text):
        held += piece.lower().split()
        if len(held) >= shingle:
            line = b" ".join(held)
            ends = np.cumsum(np.fromiter(map(len, held), np.int64, len(held)) + 1)
            starts = np.concatenate([[0], ends[: len(held) - shingle]]).tolist()
            yield [xx(line[a:b], seed) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=True)]
            held, some = held[len(held) - shingle + 1 :], True
    if held and not some:
        yield [xx(b" ".join(held), seed)]


def fingerprints(docs: list[bytes], shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """uint64 fingerprints: a bit is 1 if set in over half of the shingles' XXH64, repeats included. Bits are summed after
    every COUNTED hashes, so memory doesn't grow with the length of a text."""
    ones, sizes = np.zeros((len(docs), 64), np.int64), np.zeros(len(docs), np.int64)
    held: list[int] = []
    of: list[tuple[int, int]] = []  # (text, hashes of it that are held)

    def count() -> None:
        at = np.cumsum([0, *(n for _, n in of)])
        for lo in range(0, len(of), 1 << 12):
            part = of[lo : lo + (1 << 12)]
            first, last = int(at[lo]), int(at[lo + len(part)])
            bits = np.unpackbits(np.array(held[first:last], "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            np.add.at(ones, [i for i, _ in part], np.add.reduceat(bits, at[lo : lo + len(part)] - first, axis=0, dtype=np.int32))
        held.clear()
        of.clear()

    for i, text in enumerate(docs):
        for hashes in _shingle_hashes(text, shingle, seed):
            sizes[i] += len(hashes)
            for lo in range(0, len(hashes), COUNTED):
                part = hashes[lo : lo + COUNTED]
                held += part
                of.append((i, len(part)))
                if len(held) >= COUNTED:
                    count()
    if of:
        count()
    return np.packbits(2 * ones > sizes[:, None], axis=1, bitorder="little").view("<u8").ravel()


def _syndrome(x: np.ndarray) -> np.ndarray:
    """Of Hamming(15, 11): exclusive or of the positions (1 to 15) of the set bits."""
    s = np.zeros(x.shape, np.uint64)
    for i in range(CODED):
        s ^= ((x >> np.uint64(i)) & np.uint64(1)) * np.uint64(i + 1)
    return s


def nearest_word(x: np.ndarray) -> np.ndarray:
    """The code word within one bit of each 15-bit value."""
    s = _syndrome(x)
    return np.where(s > 0, x ^ (np.uint64(1) << (np.maximum(s, np.uint64(1)) - np.uint64(1))), x)


def anchors(segment: np.ndarray, bits: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Home anchor of each segment value, and the other anchors within two bits (arrays; some may repeat the home)."""
    low, high = segment & np.uint64((1 << CODED) - 1), segment >> np.uint64(CODED)
    home_word = nearest_word(low)
    join = lambda h, w: (h << np.uint64(CODED)) | w
    others = [join(high ^ np.uint64(1 << j), home_word) for j in range(bits - CODED)]
    # code words at two bits: with syndrome s, the pairs of positions whose exclusive or is s
    s = _syndrome(low)
    for i in range(1, CODED + 1):
        j = s ^ np.uint64(i)
        ok = (s > 0) & (j > i) & (j <= CODED)
        pair = low ^ np.uint64(1 << (i - 1)) ^ (np.uint64(1) << (np.maximum(j, np.uint64(1)) - np.uint64(1)))
        others.append(np.where(ok, join(high, pair), join(high, home_word)))
    return join(high, home_word), others


def covering(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the fingerprint, anchor key, is home) of every replica."""
    rows, keys, homes = [], [], []
    index = np.arange(len(fps))
    for k, (first, bits) in enumerate(SEGMENTS):
        home, others = anchors((fps >> np.uint64(first)) & np.uint64((1 << bits) - 1), bits)
        tag = np.uint64(k << 32)
        rows.append(index)
        keys.append(home | tag)
        homes.append(np.ones(len(fps), bool))
        for o in others:
            at = np.nonzero(o != home)[0]
            rows.append(at)
            keys.append(o[at] | tag)
            homes.append(np.zeros(len(at), bool))
    return np.concatenate(rows), np.concatenate(keys).astype(np.int64), np.concatenate(homes)


class _Links:
    """Union-find over the values seen in one task; keeps the links that join two of its sets."""

    def __init__(self):
        self.up: dict[int, int] = {}
        self.out: list[tuple[int, int]] = []

    def find(self, x: int) -> int:
        up = self.up
        root = x
        while up.get(root, root) != root:
            root = up[root]
        while up.get(x, x) != root:
            up[x], x = root, up[x]
        return root

    def add(self, a: int, b: int) -> None:
        ra, rb = self.find(a), self.find(b)
        if ra != rb:
            self.up[max(ra, rb)] = min(ra, rb)
            self.out.append((a, b))

    def take(self) -> list[tuple[int, int]]:
        out, self.out = self.out, []
        return out


def compare(homes: np.ndarray, everything: np.ndarray, threshold: int, links: _Links, step: int = 1 << 21) -> None:
    """Links between an anchor's homes and others there (homes may be among them)."""
    rows = max(1, step // max(len(everything), 1))
    for i in range(0, len(homes), rows):
        part = homes[i : i + rows]
        near = np.bitwise_count(part[:, None] ^ everything[None, :]) <= threshold
        a, b = np.nonzero(near)
        if len(a) > 4096:  # one neighbour each is enough for what is already joined; label first, then what is left
            first = near.argmax(axis=0)
            hit = np.nonzero(near.any(axis=0))[0]
            for x, y in zip(part[first[hit]].tolist(), everything[hit].tolist(), strict=True):
                links.add(x, y)
            roots = {v: links.find(v) for v in set(part.tolist()) | set(everything[hit].tolist())}
            ra = np.array([roots[v] for v in part.tolist()], np.uint64)
            rb = np.array([roots.get(v, v) for v in everything.tolist()], np.uint64)
            differ = ra[a] != rb[b]
            pairs = np.unique(np.column_stack([ra[a][differ], rb[b][differ]]), axis=0)
            where = {tuple(p): None for p in pairs.tolist()}
            for x, y, p, q in zip(part[a[differ]].tolist(), everything[b[differ]].tolist(), ra[a][differ].tolist(), rb[b][differ].tolist(), strict=True):
                if where.pop((p, q), 0) is None:
                    links.add(x, y)
        else:
            for x, y in zip(part[a].tolist(), everything[b].tolist(), strict=True):
                if x != y:
                    links.add(x, y)


def _small_groups(fps: np.ndarray, home: np.ndarray, first: np.ndarray, size: np.ndarray, n_home: np.ndarray, threshold: int, links: _Links) -> None:
    """Many anchors at once: all (home, other) pairs of groups of few members, in vectors. Members are sorted homes first."""
    pairs = n_home * size
    for lo in range(0, len(first), 1 << 14):
        part = slice(lo, lo + (1 << 14))
        total = int(pairs[part].sum())
        if not total:
            continue
        group = np.repeat(np.arange(len(first))[part], pairs[part])
        rank = np.arange(total) - np.repeat(np.cumsum(pairs[part]) - pairs[part], pairs[part])
        a, b = fps[first[group] + rank // size[group]], fps[first[group] + rank % size[group]]
        near = (np.bitwise_count(a ^ b) <= threshold) & (a != b)
        for x, y in zip(a[near].tolist(), b[near].tolist(), strict=True):
            links.add(x, y)


def near_links(distinct: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """distinct (fp: long) -> (a, b: long), enough links to join every component within the threshold."""

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            rows, keys, home = covering(fps)
            for i in range(0, len(rows), 1 << 17):
                part = slice(i, i + (1 << 17))
                yield pa.RecordBatch.from_arrays([pa.array(keys[part]), pa.array(~home[part]), pa.array(fps[rows[part]].view(np.int64))], ["anchor", "replica", "fp"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Groups come sorted, homes first. A group that goes on over several batches keeps its homes alone: what comes
        after them is compared and let go."""
        links = _Links()
        group, homes = None, np.zeros(0, np.uint64)  # the last group so far, and its homes
        for batch in batches:
            if not batch.num_rows:
                continue
            at, replica, fps = batch.column("group").to_numpy(), batch.column("replica").to_numpy(zero_copy_only=False), batch.column("fp").to_numpy().view(np.uint64)
            first = np.nonzero(np.concatenate([[True], at[1:] != at[:-1]]))[0]
            size = np.diff(np.concatenate([first, [len(at)]]))
            n_home = np.add.reduceat((~replica).astype(np.int64), first)
            small = (n_home * size <= 4096) & (n_home > 0)
            continued = group is not None and bool(at[0] == group)
            small[-1] = False  # it may go on
            small[0] &= not continued
            _small_groups(fps, replica, first[small], size[small], n_home[small], threshold, links)
            for i in np.nonzero(~small)[0].tolist():
                f, s, h = int(first[i]), int(size[i]), int(n_home[i])
                if i or not continued:
                    group, homes = at[f], np.zeros(0, np.uint64)
                homes = np.concatenate([homes, fps[f : f + h]])
                if len(homes):
                    compare(homes, fps[f : f + s], threshold, links)
            if out := links.take():
                e = np.array(out, np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(e[:, 0]), pa.array(e[:, 1])], ["a", "b"])

    def at_home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            _, keys, home = covering(fps)
            yield pa.RecordBatch.from_arrays([pa.array(keys[home])], ["anchor"])

    spread = distinct.mapInArrow(tidy(replicate), "anchor bigint, replica boolean, fp bigint")
    hot = materialize(distinct.mapInArrow(tidy(at_home), "anchor bigint").groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > CHUNK).select("anchor", F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks")))
    if hot.isEmpty():
        dealt = spread.select(F.xxhash64("anchor").alias("group"), "replica", "fp")
    else:  # each home of such an anchor goes to one chunk, and all that is there is compared with every chunk
        at = spread.join(hot, "anchor", "left")
        own = F.struct(F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int").alias("c"), F.lit(False).alias("replica"))
        every = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda c: F.struct(c.alias("c"), F.lit(True).alias("replica")))
        alone = F.array(F.struct(F.lit(-1).alias("c"), F.col("replica")))
        places = F.when(F.col("chunks").isNull(), alone).when(F.col("replica"), every).otherwise(F.concat(F.array(own), every))
        dealt = at.select("anchor", "fp", F.explode(places).alias("to")).select(F.xxhash64("anchor", "to.c").alias("group"), "to.replica", "fp")
    return dealt.repartition("group").sortWithinPartitions("group", "replica").mapInArrow(tidy(meet), "a bigint, b bigint")


def with_fingerprint(docs: DataFrame, key: Column | None = None) -> DataFrame:
    """doc_id, fp (long), and t (binary) where a key of that type is given."""
    more = [] if key is None else ["t"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fingerprints(texts(b.column("text"))).view(np.int64)), *[b.column(c) for c in more]], ["doc_id", "fp", *more])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", *([] if key is None else [key.alias("t")])).mapInArrow(tidy(run), f"doc_id {kind}, fp bigint" + ", t binary" * len(more))


def simhash_components(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """docs (doc_id, text, ...) -> (doc_id, fp: long, component_id: least doc_id reachable), one row for each row."""
    if threshold != THRESHOLD:
        raise ValueError("the segments and anchors are laid out for a threshold of 4 bits")
    fps = materialize(with_fingerprint(docs))
    least = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(near_links(least.select("fp"), threshold))
    of = materialize(least.join(roots, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root"), "least"))
    # both sides of each join are written tables, so that adaptive execution can split a giant component's partition
    ids = materialize(of.groupBy("root").agg(F.min("least").alias("component_id")))
    by_fp = materialize(of.join(ids, "root").select("fp", "component_id"))
    for df in (least, of, ids):
        drop_materialized(df)
    return fps.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def digest(docs: DataFrame) -> DataFrame:
    return simhash_components(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def simhash_dedup(docs: DataFrame) -> DataFrame:
    """docs with one document of each component: the one of the least doc_id. Of several rows with one id (or none), the
    one of the least text stays."""
    names = docs.columns
    found = simhash_components(docs.select("doc_id", "text"))
    of = materialize(found.groupBy("doc_id").agg(F.max(F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("first"), F.count("*").alias("n")).where("n > 1 or not first").withColumnRenamed("doc_id", "k2"))
    rows = docs.select(F.struct(*names).alias("row"), F.col("doc_id").alias("k"))
    out = rows.join(of.select("k2"), F.col("k").eqNullSafe(F.col("k2")), "left_anti").select("row")
    again = of.where("first")  # ids of several rows: one row stays
    if not again.isEmpty():
        some = rows.join(again.select("k2"), F.col("k").eqNullSafe(F.col("k2")), "left_semi")
        out = out.unionByName(some.groupBy("k").agg(F.min_by("row", F.col("row.text")).alias("row")).select("row"))
    return out.select(*[F.col("row").getField(n).alias(n) for n in names])


def simhash_dedup_rows(docs: DataFrame) -> DataFrame:
    """docs with one row of each component, whatever its id: the one of the least (doc_id, md5 of text), ids before nulls.
    Rows of one id, or none, that have different texts in different components all stay; of rows that have id and text in
    common, one stays."""
    names = docs.columns
    key = lambda text: F.coalesce(F.unhex(F.md5(text)), F.lit(b""))
    fps = materialize(with_fingerprint(docs, key(F.col("text"))))
    distinct = fps.select("fp").distinct()
    roots = components(near_links(distinct))
    of = fps.join(roots, F.col("fp") == F.col("node"), "left").select("doc_id", "t", F.coalesce("root", "fp").alias("root"))
    each = materialize(of.groupBy("doc_id", "t", "root").agg(F.count("*").alias("n")))
    place = F.struct(F.col("doc_id").isNull(), "doc_id", "t")
    best = materialize(each.groupBy("root").agg(F.min(place).alias("best")).withColumnRenamed("root", "r"))
    first = place.getField("doc_id").eqNullSafe(F.col("best").getField("doc_id")) & (F.col("t") == F.col("best").getField("t"))
    found = materialize(each.join(best, F.col("root") == F.col("r")).select(F.col("doc_id").alias("k2"), F.col("t").alias("t2"), first.alias("first"), "n").where("n > 1 or not first"))
    for df in (fps, each, best):
        drop_materialized(df)
    rows = docs.select(F.struct(*names).alias("row"), F.col("doc_id").alias("k"), key(F.col("text")).alias("t"))
    same = F.col("k").eqNullSafe(F.col("k2")) & (F.col("t") == F.col("t2"))
    out = rows.join(found, same, "left_anti").select("row")
    again = found.where("first")  # equal rows: one stays
    if not again.isEmpty():
        out = out.unionByName(rows.join(again, same, "left_semi").groupBy("k", "t").agg(F.first("row").alias("row")).select("row"))
    return out.select(*[F.col("row").getField(n).alias(n) for n in names])
