"""The best element of each block against the join it stood for, and without a shuffle."""

from pyspark.sql import functions as F

from lectern.functions import scalars as s
from lectern.operators import structure

TEXTS = ["a b c\na b. a c\nc d", None, "", "x\n\ny. Y x. X y z\nz", "one two three four five six\none. two. nothing", "w " * 50 + "\n" + "\n".join("w v%d." % (k % 7) for k in range(60))]


def joined(docs):
    both = structure.blocks_and_elements(docs)

    def side(name):
        rows = both.select("doc_id", F.posexplode(name).alias(name[:-1], "tokens"))
        return rows.select("doc_id", name[:-1], F.size("tokens").alias(f"n_{name[:-1]}"), F.explode("tokens").alias("token"))

    common = side("blocks").join(side("elements"), ["doc_id", "token"]).groupBy("doc_id", "block", "element", "n_block", "n_element").count()
    scored = common.withColumn("score", F.col("count") / F.greatest("n_block", "n_element")).where(F.col("score") > s.MATCH_SCORE)
    found = scored.groupBy("doc_id", "block").agg(F.max(F.struct("score", (-F.col("element")).alias("e"))).alias("b"))
    return found.select("doc_id", "block", (-F.col("b.e")).alias("element"), F.round("b.score", 9).alias("score"))


def test_equals_the_join_and_shuffles_nothing(spark):
    docs = spark.createDataFrame([*enumerate(TEXTS), (None, "a\na")], "doc_id bigint, text string").unionByName(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select((F.col("doc_id") + 1000).alias("doc_id"), "text"))
    found = structure.best_match(docs)
    assert "Exchange" not in found._jdf.queryExecution().sparkPlan().toString() and "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    got, want = (sorted(map(tuple, x.collect())) for x in (found, joined(docs)))
    assert got == want and len(got) > 1000
