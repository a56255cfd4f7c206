"""Mixing sources to target weights by temperature.

Source weights are token shares raised to an exponent and normalised. The exponent in [0, 1] is found by bisection: the
largest whose weights have at least the target entropy (as a share of the uniform mix's), then, if a source would be
repeated more than max_repeats times at the token budget, the least larger one that keeps the limit (at 1 no source is
repeated more often than the budget is of the corpus). Weights are realised as block permutations: a source's documents are
dealt by hash to blocks of about BLOCK_TOKENS tokens; pass after pass visits the blocks in another hashed order, and
documents in hashed order within them, until the source's token budget is met; the document that crosses it is the last.

Per-source totals stay a table: a round of the bisection asks it for sums at POINTS exponents at once (exact decimals, so
that any order of adding gives the same), and only those sums come to the driver; weights and budgets are joined as a table
that Spark broadcasts if it is small. So the number of sources has no limit. Prefix sums run over blocks within a source and
over documents within a block (by parts of it, then within one part), so a source with a third of all rows is no task's
group: the blocks of a source are as few as its tokens over BLOCK_TOKENS.

Defined cases: a null source is a source of its own; null and empty texts have no tokens: they cost no budget and come with
every full pass; sources without tokens get weight zero and are left out; ids may be null or repeat (each row is a document
of its own, ordered by a hash of id and text); empty tables give empty results; extra columns are kept.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_materialized, materialize

ENTROPY_SHARE, MAX_REPEATS, BUDGET_SHARE, SEED = 0.95, 4.0, 0.9, 17
BLOCK_TOKENS = 2_000_000
#: Exponents tried in a round of the search, and rounds: to within 33 ** -10 of the interval.
POINTS, ROUNDS = 32, 10


def weights_at(shares: list[float], exponent: float) -> list[float]:
    w = [s**exponent if s > 0 else 0.0 for s in shares]
    total = sum(w) or 1.0
    return [x / total for x in w]


def entropy(weights: list[float]) -> float:
    return -sum(w * math.log(w) for w in weights if w > 0)


#: For each exponent x: the sum of s ** x, and of s ** x * log(s), over the shares s of all sources.
Sums = Callable[[list[float]], list[tuple[float, float]]]


def _search(sums: Sums, n: int, smallest: float, budget_share: float, entropy_share: float, max_repeats: float) -> float:
    """By bisection into POINTS + 1 parts a round; entropy and the largest repetition (that of the smallest share) fall with
    the exponent. n: sources; budget_share: the budget as a share of all tokens."""
    if n < 2:
        return 1.0

    def edge(ok: Callable[[float, float, float], bool], low: float, high: float, rising: bool) -> float:
        """The edge of where ok holds; rising: it holds from the edge up to high."""
        for _ in range(ROUNDS):
            xs = [low + (high - low) * (i + 1) / (POINTS + 1) for i in range(POINTS)]
            far = [x for x, (z, e) in zip(xs, sums(xs), strict=True) if ok(x, z, e) == rising]
            near = [x for x in xs if x not in far]
            low, high = max(near, default=low), min(far, default=high)
        return high if rising else low

    spread = lambda x, z, e: math.log(z) - x * e / z >= entropy_share * math.log(n)
    repeats = lambda x, z, e: smallest ** (x - 1) / z * budget_share <= max_repeats
    holds = lambda ok, x: ok(x, *sums([x])[0])
    exponent = 1.0 if holds(spread, 1.0) else edge(spread, 0.0, 1.0, False)
    return exponent if holds(repeats, exponent) or not holds(repeats, 1.0) else edge(repeats, exponent, 1.0, True)


def find_exponent(tokens: list[int], budget: float, entropy_share: float = ENTROPY_SHARE, max_repeats: float = MAX_REPEATS) -> float:
    """Of sources with these tokens, at this budget of tokens."""
    total = sum(tokens)
    shares = [t / total for t in tokens if t > 0] if total else []
    sums = lambda xs: [(sum(s**x for s in shares), sum(s**x * math.log(s) for s in shares)) for x in xs]
    return _search(sums, len(shares), min(shares, default=1.0), budget / max(total, 1), entropy_share, max_repeats)


def plan(docs: DataFrame, budget_share: float = BUDGET_SHARE, entropy_share: float = ENTROPY_SHARE, max_repeats: float = MAX_REPEATS, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """docs (source, n_tokens) -> s, weight, budget (tokens), total (tokens) and blocks of each source that has tokens."""
    totals = materialize(docs.groupBy(F.col("source").cast("string").alias("s")).agg(F.sum("n_tokens").alias("total")).where("total > 0"))
    whole, n, least = totals.agg(F.coalesce(F.sum("total"), F.lit(1)), F.count("*"), F.coalesce(F.min("total"), F.lit(1))).first()
    share = F.col("total") / F.lit(int(whole))
    exact = lambda c: F.sum(c.cast("decimal(28,22)")).cast("double")

    def sums(xs: list[float]) -> list[tuple[float, float]]:
        at = totals.select(share.alias("share"), F.posexplode(F.array(*map(F.lit, xs))).alias("i", "x"))
        power = F.pow("share", "x")
        found = at.groupBy("i").agg(exact(power).alias("z"), exact(power * F.log("share")).alias("e")).collect()
        return [(r["z"], r["e"]) for r in sorted(found, key=lambda r: r["i"])]

    x = _search(sums, n, least / whole, budget_share, entropy_share, max_repeats)
    weight = F.pow(share, F.lit(x)) / F.lit(sums([x])[0][0] if n else 1.0)
    out = totals.select("s", weight.alias("weight"), F.round(weight * F.lit(int(whole)) * F.lit(budget_share)).cast("bigint").alias("budget"), "total", F.greatest(F.lit(1), F.ceil(F.col("total") / block_tokens)).cast("int").alias("blocks"))
    out = materialize(out)
    drop_materialized(totals)
    return out


def mix(docs: DataFrame, budget_share: float = BUDGET_SHARE, entropy_share: float = ENTROPY_SHARE, max_repeats: float = MAX_REPEATS, block_tokens: int = BLOCK_TOKENS, seed: int = SEED) -> DataFrame:
    """docs (doc_id, text, source, ...) -> `row` (the input columns as a struct), n_tokens, weight, pass (0 on), block and
    place of the block in its pass: one row for each time that a document is drawn."""
    words = F.size(F.split(F.coalesce(F.col("row.text"), F.lit("")), r"[\x20\x09-\x0D]+", -1))
    edges = F.when(F.coalesce(F.col("row.text"), F.lit("")).rlike(r"^[\x20\x09-\x0D]*\z"), F.lit(0)).otherwise(words - F.col("row.text").rlike(r"^[\x20\x09-\x0D]").cast("int") - F.col("row.text").rlike(r"[\x20\x09-\x0D]\z").cast("int"))
    rows = docs.select(F.struct(*docs.columns).alias("row"))
    key = lambda *x: F.xxhash64(F.lit(seed), *x)
    text = F.coalesce(F.col("row.text"), F.lit(""))
    light = rows.select(F.col("row.doc_id").alias("doc_id"), F.col("row.source").alias("source"), key(F.col("row.doc_id"), F.md5(text.cast("binary"))).alias("h"), edges.cast("bigint").alias("n_tokens"))
    light = materialize(light)  # (id, source, hash, tokens): the texts stay where they are
    table = plan(light, budget_share, entropy_share, max_repeats, block_tokens)
    same = F.col("source").cast("string").eqNullSafe(F.col("s"))
    put = light.join(table, same).withColumn("block", F.pmod("h", "blocks").cast("int"))
    # equal rows (same hash) are drawn together: one entry with a count
    entry = put.groupBy("s", "weight", "budget", "total", "block", "h").agg(F.sum("n_tokens").alias("n"))
    block = entry.groupBy("s", "weight", "budget", "total", "block").agg(F.sum("n").alias("size"))
    full = F.floor(F.col("budget") / F.col("total")).cast("int")
    passes = block.select("*", F.explode(F.sequence(F.lit(0), full)).alias("pass"))
    order = Window.partitionBy("s", "pass").orderBy(key("s", "pass", "block"), "block")
    passes = passes.withColumn("place", F.row_number().over(order) - 1).withColumn("before", F.sum("size").over(order) - F.col("size") + F.col("pass") * F.col("total"))
    visited = materialize(passes.where("before < budget").select("s", "block", "pass", "place", "before", "weight", "budget", "size"))
    inside = visited.where("before + size <= budget").select("s", "block", "pass", "place", "weight")
    # the block in which a source's budget ends: documents in hashed order until it is met; those of a first byte of the hash
    # are drawn as a whole but for the byte in which it ends
    edge = visited.where("before + size > budget")
    cut = entry.select("s", "block", "h", "n").join(edge, (entry["s"].eqNullSafe(edge["s"])) & (entry["block"] == edge["block"])).select(edge["s"].alias("s"), edge["block"].alias("block"), "h", "n", "pass", "place", "before", "budget", "weight")
    cut = cut.withColumn("order", key("pass", "h")).withColumn("sub", F.shiftright("order", 56))  # the hash's first byte keeps its order
    group = ["s", "block", "pass"]
    sums = cut.groupBy(*group, "sub").agg(F.sum("n").alias("size"))
    upto = Window.partitionBy(*group).orderBy("sub")
    sums = sums.withColumn("earlier", F.sum("size").over(upto) - F.col("size"))  # over 256 rows at most
    of = sums.select(F.col("s").alias("s2"), F.col("block").alias("b2"), F.col("pass").alias("p2"), F.col("sub").alias("sub2"), "size", "earlier")
    cut = cut.join(of, F.col("s").eqNullSafe(F.col("s2")) & (F.col("block") == F.col("b2")) & (F.col("pass") == F.col("p2")) & (F.col("sub") == F.col("sub2")))
    start = F.col("before") + F.col("earlier")
    drawn = ["s", "block", "pass", "place", "weight", "h"]
    some = cut.where(start + F.col("size") < F.col("budget")).select(*drawn)
    last = cut.where((start < F.col("budget")) & (start + F.col("size") >= F.col("budget")))
    run = Window.partitionBy(*group, "sub").orderBy("order", "h")
    some = some.unionByName(last.withColumn("so_far", F.sum("n").over(run) - F.col("n")).where(start + F.col("so_far") < F.col("budget")).select(*drawn))
    taken = some.groupBy("h", "s", "block", "weight").agg(F.collect_list(F.struct("pass", "place")).alias("extra"))
    whole = inside.groupBy("s", "block", "weight").agg(F.collect_list(F.struct("pass", "place")).alias("draws"))
    named = rows.withColumn("h", key(F.col("row.doc_id"), F.md5(text.cast("binary")))).withColumn("n_tokens", edges.cast("bigint"))
    named = named.join(table, F.col("row.source").cast("string").eqNullSafe(F.col("s"))).select("row", "h", "n_tokens", F.col("s").alias("s1"), F.col("weight").alias("w1"), F.pmod("h", "blocks").cast("int").alias("b1"))
    out = named.join(whole, F.col("s1").eqNullSafe(F.col("s")) & (F.col("b1") == F.col("block")), "left").drop("s", "block", "weight")
    tail = taken.select(F.col("h").alias("h2"), F.col("s").alias("s2"), "extra")
    out = out.join(tail, (F.col("h") == F.col("h2")) & F.col("s1").eqNullSafe(F.col("s2")), "left")
    none = F.expr("cast(array() as array<struct<pass: int, place: int>>)")
    draws = F.concat(F.coalesce("draws", none), F.coalesce("extra", none))
    return out.select("row", "n_tokens", F.col("w1").alias("weight"), F.col("b1").alias("block"), F.explode(draws).alias("d")).select("row", "n_tokens", "weight", "d.pass", "block", "d.place")


def digest(docs: DataFrame) -> DataFrame:
    out = mix(docs.select("doc_id", "text", "source"))
    return out.select(F.col("row.doc_id").alias("doc_id"), F.col("row.source").alias("source"), "n_tokens", F.round("weight", 9).alias("weight"), F.col("pass").cast("bigint").alias("pass"), F.col("block").cast("bigint").alias("block"), F.col("place").cast("bigint").alias("place"))
