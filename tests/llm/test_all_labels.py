"""The quality rules learn from all labelled rows: shares of trees, threshold, and a kind of good rows that no bounded sample has."""

import numpy as np
from pyspark.sql import functions as F

from lectern.llm import quality_rules


def test_every_row_has_a_tree():
    for n_good, n_bad in ((3, 1), (3400, 570), (90_000, 14_000), (60_000, 1)):
        shares = quality_rules.Shares(n_good, n_bad)
        keys = np.random.default_rng(n_good).integers(-(1 << 62), 1 << 62, n_good + n_bad)
        odd = np.arange(n_good + n_bad) >= n_good
        row, tree = quality_rules.dealt(keys, np.where(odd, shares.times[1], shares.times[0]))
        assert set(row) == set(range(len(keys))) and set(tree) == set(range(quality_rules.TREES))
        assert len(set(zip(row, tree))) == len(row)  # never twice to one
        w = shares.weights(odd[row[tree == 7]])
        assert w.max() <= 1 and w.sum() <= quality_rules.SUBSAMPLE
        if n_bad > 100:
            assert w.sum() > 0.9 * quality_rules.SUBSAMPLE and abs(w[odd[row[tree == 7]]].sum() / w.sum() - quality_rules.BAD_SHARE) < 0.01


def test_threshold_by_trying_all():
    rng = np.random.default_rng(3)
    for _ in range(50):
        steps = np.sort(rng.choice(1000, 30, replace=False))
        good, bad = rng.integers(0, 200, 30) * (np.arange(30) < 25), rng.integers(0, 9, 30)
        cut = quality_rules.threshold(steps, good, bad) * quality_rules.GRID
        least = quality_rules.GOOD_LOSS * good.sum()
        errors = {s: good[steps > s].sum() + bad[steps <= s].sum() for s in steps if good[steps > s].sum() <= least}
        assert good[steps >= cut].sum() <= least
        assert good[steps >= cut].sum() + bad[steps < cut].sum() == min(errors.values())


def test_good_rows_beyond_a_sample_count(spark):
    """1,500 good rows, those of the least hashes, have no symbols; 1,000 others have more of them than the bad rows."""
    rank = {r.i: n for n, r in enumerate(spark.range(2500).select(F.col("id").alias("i")).orderBy(F.xxhash64("id")).collect())}
    text = lambda i, n: " ".join([f"word{i % 89}x{j}" for j in range(40 + i % 7)] + ["#"] * n)
    rows = [(i, text(i, 8 if rank[i] >= 1500 else 0), 1) for i in range(2500)] + [(i, text(i, 4), 0) for i in range(2500, 2530)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id bigint, quality int")
    kept = {r.doc_id for r in quality_rules.quality_rules(docs, labels).where("kept").select("row.doc_id").collect()}
    assert len([i for i in range(2500) if i not in kept]) <= quality_rules.GOOD_LOSS * 2500


def test_other_labels_are_no_class(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{i}x{j}" for j in range(30))) for i in range(6)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(0, 0), (1, 2), (2, None), (3, 3)], "doc_id bigint, quality int")
    assert quality_rules.quality_rules(docs, labels).where("kept and anomaly = 0").count() == 6  # one class: the base rules alone
