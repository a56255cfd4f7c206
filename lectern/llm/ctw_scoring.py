"""LM scoring by context-tree weighting over bytes.

Each byte is coded as eight binary decisions. A decision's context is the already coded bits of its byte and the last 0 to
DEPTH bytes; at each context Krichevsky-Trofimov counts from the training texts give an estimate, and the context-tree
weighting recursion (half own estimate, half the product of the children) mixes the estimates of all depths:

    Pw(s) = Pe(s) / 2 + prod Pw(children of s) / 2,     p_d = w_d * KT_d + (1 - w_d) * p_{d+1},   w_d = Pe / (2 * Pw)

The counts are frozen after training, so a text's code length is a sum of table entries, one for each of its bytes.

Corpus counts are taken over all training texts: every block of texts emits its distinct (DEPTH + 1)-byte strings and
words, Spark sums them, subtrees of the context tree are weighted in parallel, and each block gets back the entries that
it needs. A subtree hangs below the last two bytes of a context; below the last three where a pair of bytes holds more than
one part in HEAVY of all strings. Tasks are as many as the strings ask for. Nothing is sampled, capped or collected but
the sums at depths 0 and 1, whose number the alphabet bounds (256 * 255 + 255 rows), and at depth 2 of the at most HEAVY
pairs that are split (255 rows each). Texts are read about a MB at a time, however long they are.

Entries travel as 32-bit floats, sums are 64-bit: as all entries have one sign, a score is off by 2 ** -24 (6e-8) of itself
at most. Words are compared byte by byte.

Defined cases: null text is empty (only its end is coded); a null id counts as the empty text for the fold; ids may repeat,
each row is scored; with no training text every decision has probability 1/2; empty tables give empty results.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PIECE_BYTES, drop_materialized, held_out, materialize, release, texts, with_block, word_pieces

DEPTH = 5
#: Larger blocks than elsewhere: a string that a block holds many times travels once.
BLOCK_BYTES = 16 << 20
#: Pads a text's beginning and codes its end; no UTF-8 text holds this byte.
EDGE = b"\xff"
LOG_HALF = math.log(0.5)


#: Distinct strings that a group of subtrees has on average, and the share of all strings (one part in so many) over which
#: a pair of last bytes is split by the byte before it.
GROUP_ROWS, HEAVY = 200_000, 256

#: (row of the block, bytes before, bytes of the text, its end or nothing)
Part = tuple[int, bytes, bytes, bytes]


def grams(parts: list[Part], depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """(depth + 1)-byte strings as integers, one for each coded byte (those of the parts and the ends), and how many of them
    each part has."""
    buffer = np.frombuffer(b"".join(b"".join(p[1:]) for p in parts), np.uint8)
    n = len(buffer) - depth
    key = np.zeros(n, np.uint64)
    for i in range(depth + 1):
        key <<= np.uint64(8)
        key |= buffer[i : i + n]
    sizes = np.fromiter((len(p[2]) + len(p[3]) for p in parts), np.int64, len(parts))
    starts = np.cumsum(sizes + depth) - sizes - depth
    keep = np.ones(n, bool)
    for j in range(depth):
        keep[starts[1:] - j - 1] = False
    return key[keep], sizes


def pieces(table: pa.Table, depth: int, max_bytes: int = PIECE_BYTES) -> Iterator[list[Part]]:
    """A block's lower-cased texts, about a MB at a time: several texts, or a part of one, cut at white space."""
    column = table.column("text")
    ends = np.cumsum(pc.fill_null(pc.binary_length(column.cast(pa.large_binary())), 0).to_numpy())
    at = 0
    while at < table.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + max_bytes, side="right")))
        docs = texts(column.slice(at, to - at))
        if len(docs) > 1:
            yield [(at + i, EDGE * depth, t.lower(), EDGE) for i, t in enumerate(docs)]
        else:
            before, left = EDGE * depth, len(docs[0])
            for body in word_pieces(docs[0], max_bytes):
                left -= len(body)
                yield [(at, before, low := body.lower(), b"" if left else EDGE)]
                before = (before + low[-depth:])[-depth:] if depth else b""
        at = to


def _merged(keys: list[np.ndarray], ns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and the sums of their counts."""
    key, n = np.concatenate(keys), np.concatenate(ns)
    order = np.argsort(key)
    key, n = key[order], n[order]
    first = np.nonzero(np.concatenate([[True], key[1:] != key[:-1]]))[0]
    return key[first], np.add.reduceat(n, first)


def _log_gamma(n: np.ndarray, half: bool) -> np.ndarray:
    """log Gamma(n + 1/2) or log Gamma(n + 1) of whole numbers n."""
    z = n + (0.5 if half else 1.0)
    big = np.maximum(z, 16.0)
    out = (big - 0.5) * np.log(big) - big + 0.5 * math.log(2 * math.pi) + 1 / (12 * big) - 1 / (360 * big**3) + 1 / (1260 * big**5)
    table = np.array([math.lgamma(i + (0.5 if half else 1.0)) for i in range(17)])
    return np.where(z < 16, table[np.minimum(n, 16).astype(np.int64)], out)


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Log Krichevsky-Trofimov probability of a zeros and b ones."""
    return _log_gamma(a, True) + _log_gamma(b, True) - math.log(math.pi) - _log_gamma(a + b, False)


def _children(parent: np.ndarray, n: int, values: list[np.ndarray]) -> list[np.ndarray]:
    return [np.bincount(parent, v, n) for v in values]


def shortened(key: np.ndarray, depth: int) -> np.ndarray:
    """(context, decision) keys with the context's last depth bytes alone."""
    return (((key >> np.uint64(8)) & np.uint64((1 << (8 * depth)) - 1)) << np.uint64(8)) | (key & np.uint64(0xFF))


class Subtrees:
    """Context-tree nodes at depths top to depth of the given strings, for each binary decision."""

    def __init__(self, gram: np.ndarray, n: np.ndarray, depth: int, top: int):
        self.depth, self.top = depth, top
        symbol = gram & np.uint64(0xFF)
        context = gram >> np.uint64(8)
        bits = [((symbol >> np.uint64(7 - k)) & np.uint64(1)).astype(bool) for k in range(8)]
        node = [(np.uint64(1 << k) | (symbol >> np.uint64(8 - k))) if k else np.ones(len(gram), np.uint64) for k in range(8)]
        key = np.concatenate([(context << np.uint64(8)) | x for x in node])
        self.bit = np.concatenate(bits)
        self.key, self.at = {}, {}
        self.key[depth], self.at[depth] = np.unique(key, return_inverse=True)
        weight = np.tile(n.astype(float), 8)
        size = len(self.key[depth])
        self.a = {depth: np.bincount(self.at[depth], weight * ~self.bit, size)}
        self.b = {depth: np.bincount(self.at[depth], weight * self.bit, size)}
        self.log_e = {depth: log_kt(self.a[depth], self.b[depth])}
        self.log_w = {depth: self.log_e[depth]}
        for d in range(depth - 1, top - 1, -1):
            self.key[d], self.at[d] = np.unique(shortened(self.key[d + 1], d), return_inverse=True)
            self.a[d], self.b[d], below = _children(self.at[d], len(self.key[d]), [self.a[d + 1], self.b[d + 1], self.log_w[d + 1]])
            self.log_e[d] = log_kt(self.a[d], self.b[d])
            self.log_w[d] = np.logaddexp(self.log_e[d], below) + LOG_HALF

    def sums(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(keys one level above the top, and the sums of a, b and log weights of the top's nodes below them)."""
        key, at = np.unique(shortened(self.key[self.top], self.top - 1), return_inverse=True)
        return key.astype(np.int64), *_children(at, len(key), [self.a[self.top], self.b[self.top], self.log_w[self.top]])

    def ones(self, above: dict) -> np.ndarray:
        """Probability of a one at each (decision, string), in the order of the strings, decisions 0 to 7 in a row.
        above: for depths under top, tables (keys, a, b, weight of the own estimate) by (context, decision); keys None: dense."""
        d = self.depth
        p = (self.b[d] + 0.5) / (self.a[d] + self.b[d] + 1)
        up, at = self.at[d], np.arange(len(p))
        for d in range(self.depth - 1, self.top - 1, -1):
            own = (self.b[d] + 0.5) / (self.a[d] + self.b[d] + 1)
            w = np.exp(LOG_HALF + self.log_e[d] - self.log_w[d])
            at = self.at[d][at]
            p = w[at] * own[at] + (1 - w[at]) * p
        k = self.key[self.depth]
        for d in range(self.top - 1, -1, -1):
            keys, a, b, w = above[d]
            at = shortened(k, d).astype(np.int64)
            at = at if keys is None else np.searchsorted(keys, at)
            p = w[at] * (b[at] + 0.5) / (a[at] + b[at] + 1) + (1 - w[at]) * p
        return p[up]

    def log10(self, above) -> np.ndarray:
        """log10 probability of each string's last byte after the bytes before it."""
        one = self.ones(above)
        return np.log10(np.where(self.bit, one, 1 - one)).reshape(8, -1).sum(axis=0)


def upper_tables(rows) -> dict[int, tuple]:
    """Tables of depths 2 (of the pairs that are split), 1 and 0, from a pandas table of sums (level 1 or 2, key at that
    depth, a, b, below: log weights of its children)."""
    def weighed(a, b, below):
        log_e = log_kt(a, b)
        log_w = np.logaddexp(log_e, below) + LOG_HALF
        return log_w, np.exp(LOG_HALF + log_e - log_w)

    out = {}
    two = rows[rows["level"] == 2].sort_values("key")
    keys, a, b = (two[c].to_numpy() for c in ("key", "a", "b"))
    log_w, w = weighed(a, b, two["below"].to_numpy())
    out[2] = keys, a, b, w
    short = shortened(keys.astype(np.uint64), 1).astype(np.int64)
    one = rows[rows["level"] == 1]
    at = np.concatenate([one["key"].to_numpy().astype(np.int64), short])
    a, b, below = (np.bincount(at, np.concatenate([one[c].to_numpy(), x]), 1 << 16) for c, x in (("a", a), ("b", b), ("below", log_w)))
    log_w, w = weighed(a, b, below)
    out[1] = None, a, b, w
    decision = np.arange(1 << 16) & 0xFF
    a, b, below = (np.bincount(decision, v, 256) for v in (a, b, log_w))
    out[0] = None, a, b, weighed(a, b, below)[1]
    return out


def ctw_scoring(docs: DataFrame, depth: int = DEPTH, modulus: int = 7, remainder: int = 2) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes,
    bits_per_byte. Texts whose crc32(doc_id) mod modulus is remainder are held out."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    blocks = with_block(docs.select("doc_id", "text"), "text", "doc_id", block_bytes=BLOCK_BYTES).select("block", "doc_id", "text", held_out("doc_id", modulus, remainder).alias("held"))

    def tally(table: pa.Table) -> pa.Table:
        """Distinct strings and words of a block, with their counts in its training texts (0: only held out here)."""
        words, keys, ns = Counter(), [], []
        end, is_held = 0, table.column("held").to_numpy()
        for parts in pieces(table, depth):
            held = is_held[[p[0] for p in parts]]
            key, sizes = grams(parts, depth)
            key = np.sort((key << np.uint64(1)) | np.repeat(held, sizes).astype(np.uint64))  # low bit: held out
            gram = key >> np.uint64(1)
            first = np.nonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))[0]
            keys.append(gram[first])
            ns.append(np.add.reduceat((~key & np.uint64(1)).astype(np.int64), first))
            for (_, _, body, last), h in zip(parts, held.tolist(), strict=True):
                if h:
                    words.update(dict.fromkeys(body.split(), 0))
                else:
                    words.update(body.split())
                    end += len(last)
            if len(keys) > 3:
                keys, ns = [[x] for x in _merged(keys, ns)]
        key, n = _merged(keys, ns)
        release()
        block = np.full(len(key) + len(words) + 1, table.column("block")[0].as_py(), np.int32)
        return pa.table({
            "block": block,
            "gram": pa.array(np.concatenate([key.view(np.int64), np.zeros(len(words) + 1, np.int64)]), mask=np.concatenate([np.zeros(len(key), bool), np.ones(len(words) + 1, bool)])),
            "word": pa.array([None] * len(key) + list(words) + [b""], pa.binary()),
            "n": np.concatenate([n, np.fromiter(words.values(), np.int64, len(words)), [end]]),
        })  # fmt: skip  # the empty word is the end token

    seen = materialize(blocks.groupBy("block").applyInArrow(tally, "block int, gram bigint, word binary, n bigint"))
    word_rows, gram_rows = seen.where("gram is null").select("block", "word", "n"), seen.where("gram is not null").select("block", "gram", "n")
    counts = materialize(word_rows.groupBy("word").agg(F.sum("n").alias("c")).where("c > 0"))
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()

    # subtrees below each pair of last bytes, or each three where the pair holds many strings; a hash deals them to groups
    tree = materialize(gram_rows.groupBy("gram").agg(F.sum("n").alias("n")))
    n_strings = tree.count()
    last = lambda n: F.shiftright("gram", 8).bitwiseAND(F.lit((1 << 8 * n) - 1))
    heavy = [r["pair"] for r in tree.groupBy(last(2).alias("pair")).count().where(F.col("count") > n_strings / HEAVY).collect()] if depth > 2 else []
    groups = F.lit(max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(n_strings / GROUP_ROWS)))
    split = last(2).isin(heavy) if heavy else F.lit(False)
    dealt = tree.withColumn("split", split).withColumn("deal", F.pmod(F.xxhash64(F.when(F.col("split"), last(3)).otherwise(last(2)), "split"), groups).cast("int"))

    def halves(table: pa.Table) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Depth of the subtrees' roots, which rows of a group hang below such, and their strings and counts."""
        gram, n, is_split = table.column("gram").to_numpy().view(np.uint64), table.column("n").to_numpy(), table.column("split").to_numpy()
        for top, own in ((2, ~is_split), (3, is_split)):
            if own.any():
                yield top, own, gram[own], n[own]

    def top(table: pa.Table) -> pa.Table:
        found = [(s.top - 1, *s.sums()) for s in (Subtrees(gram, n, depth, at) for at, _, gram, n in halves(table))]
        columns = [np.concatenate([f[i] for f in found]) for i in range(1, 5)]
        return pa.table({"level": np.concatenate([np.full(len(f[1]), f[0], np.int32) for f in found]), **dict(zip(("key", "a", "b", "below"), columns, strict=True))})

    sums = dealt.groupBy("deal").applyInArrow(top, "level int, key bigint, a double, b double, below double").groupBy("level", "key").agg(*[F.sum(c).alias(c) for c in ("a", "b", "below")])
    above = upper_tables(sums.toPandas())

    def weigh(table: pa.Table) -> pa.Table:
        v = np.zeros(table.num_rows, np.float32)
        for at, own, gram, n in halves(table):
            v[own] = Subtrees(gram, n, depth, at).log10(above)
        release()
        return pa.table({"gram": table.column("gram"), "v": v})

    model = materialize(dealt.groupBy("deal").applyInArrow(weigh, "gram bigint, v float"))
    needed_grams = gram_rows.join(model, "gram").select("block", "gram", "v", F.lit(None).cast("binary").alias("word"), F.lit(None).cast("bigint").alias("c"))
    needed_words = word_rows.join(counts, "word").select("block", F.lit(None).cast("bigint").alias("gram"), F.lit(None).cast("float").alias("v"), "word", "c")
    needed = materialize(needed_grams.unionByName(needed_words))
    for df in (seen, counts, tree, model):
        drop_materialized(df)
    log_all = math.log10(total + distinct + 1)

    def score(table: pa.Table, lookup: pa.Table) -> pa.Table:
        gram, v = lookup.column("gram").combine_chunks(), lookup.column("v").combine_chunks()
        is_gram = gram.is_valid()
        known = gram.filter(is_gram).to_numpy().view(np.uint64)
        order = np.argsort(known)
        known, value = known[order], v.filter(is_gram).to_numpy()[order]
        is_word = pc.invert(is_gram)
        word = lookup.column("word").combine_chunks().filter(is_word)
        count = lookup.column("c").combine_chunks().filter(is_word).to_numpy()
        ends = pc.binary_length(word).to_numpy() == 0
        end_log = math.log10(int(count[ends].sum()) + 1)
        end_known = int(ends.any())
        del lookup, gram, v, is_gram, is_word, order, ends
        n = table.num_rows
        n_tokens, n_known, n_bytes = np.ones(n, np.int64), np.full(n, end_known), np.zeros(n, np.int64)
        base, model_score = np.full(n, end_log), np.zeros(n)
        for parts in pieces(table, depth):
            row = np.array([p[0] for p in parts])
            key, sizes = grams(parts, depth)
            order = np.argsort(key)  # sorted keys are found much faster than keys in any order
            entry = np.empty(len(key))
            entry[order] = value[np.searchsorted(known, key[order])]
            model_score[row] += np.add.reduceat(entry, np.cumsum(sizes) - sizes)
            n_bytes[row] += [len(p[2]) for p in parts]
            own = [p[2].split() for p in parts]
            n_words = np.fromiter(map(len, own), np.int64, len(own))
            at = pc.index_in(pa.array(list(chain.from_iterable(own)), pa.binary()), value_set=word)
            c = np.append(count, 0)[pc.fill_null(at, len(count)).to_numpy()] if len(at) else np.zeros(0, np.int64)
            upto = np.concatenate([[0], np.cumsum(n_words)])
            logs, seen_ = np.concatenate([[0.0], np.cumsum(np.log10(c + 1.0))]), np.concatenate([[0], np.cumsum(c > 0)])
            n_tokens[row] += n_words
            base[row] += logs[upto[1:]] - logs[upto[:-1]]
            n_known[row] += seen_[upto[1:]] - seen_[upto[:-1]]
        base -= n_tokens * log_all
        del known, value, word, count
        release()
        n = table.num_rows
        bits = [-s / math.log10(2) / max(b, 1) for s, b in zip(model_score, n_bytes, strict=True)]
        return pa.table({"doc_id": table.column("doc_id"), "held_out": table.column("held"), "n_tokens": pa.array(n_tokens, pa.int64()), "n_known": pa.array(n_known, pa.int64()), "train_tokens": pa.array(np.full(n, int(total), np.int64)), "base_score": pa.array(base, pa.float64()), "score": pa.array(model_score, pa.float64()), "n_bytes": pa.array(n_bytes, pa.int64()), "bits_per_byte": pa.array(bits, pa.float64())})

    out = f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, n_bytes bigint, bits_per_byte double"
    return blocks.groupBy("block").cogroup(needed.groupBy("block")).applyInArrow(score, out)

