"""run() against a plain version of each stage. The forest's verdicts, a learnt model, are taken from the operator; the
rest is computed anew."""

import re

import corpus_pipeline
from lectern.llm import latent_decontamination, mixing, quality_rules

from .test_dedup import fingerprint, labels_of

DIR = "/root/testdata/sf0.001"


def plain(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    labels = spark.read.parquet(f"{DIR}/labels.parquet")
    rows = {r.row.doc_id: r.row.asDict() for r in quality_rules.quality_rules(docs, labels).where("kept").collect()}
    low = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
    where = {}
    for i, r in rows.items():
        for x in r["text"].split("\n"):
            where.setdefault(low(x), set()).add(i)
    for r in rows.values():
        r["text"] = "\n".join(x for x in r["text"].split("\n") if not low(x) or len(where[low(x)]) < 10)
        r["n_chars"] = len(r["text"])
    ids = sorted(rows)
    group = labels_of([fingerprint(rows[i]["text"]) for i in ids])
    rows = {ids[g]: rows[ids[g]] for g in set(group)}
    norm = lambda t: " " + b" ".join(latent_decontamination.tokens(t.encode())).decode() + " "
    items = [norm(r.text) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    return {i: r for i, r in rows.items() if not any(t in norm(r["text"]) for t in items)}


def test_run(spark):
    want = plain(spark)
    got = corpus_pipeline.run(spark, DIR).toPandas()
    for r in got.itertuples():
        assert (r.text, r.lang, r.source, r.n_chars) == tuple(want[r.doc_id][k] for k in ("text", "lang", "source", "n_chars"))
        assert r.n_tokens == len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
    tokens = {}
    for r in want.values():
        tokens[r["source"]] = tokens.get(r["source"], 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r["text"]))
    total = sum(tokens.values())
    names = sorted(tokens)
    share = [tokens[n] for n in names]
    weights = mixing.weights_at([x / total for x in share], mixing.find_exponent(share, total * mixing.BUDGET_SHARE))
    longest = max(len(r["text"].split()) for r in want.values())
    for n, w in zip(names, weights, strict=True):
        part = got[got.source == n]
        assert abs(part.weight.iloc[0] - w) < 1e-8
        assert round(w * total * mixing.BUDGET_SHARE) <= part.n_tokens.sum() < round(w * total * mixing.BUDGET_SHARE) + longest
        assert part.doc_id.value_counts().max() <= part["pass"].max() + 1


def test_stages_keep_columns(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").withColumn("keys", __import__("pyspark").sql.functions.lit(1)).withColumn("weight", __import__("pyspark").sql.functions.lit("w"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs2 = stage(spark, docs, DIR)
        assert docs2.columns == docs.columns, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, DIR).columns == ["doc_id", "text", "lang", "source", "n_chars", "keys", "n_tokens", "weight", "pass", "block", "place"]


def test_empty(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DIR)
    assert docs.count() == 0


def test_odd_rows_through_all_stages(spark, tmp_path):
    """Null and repeated ids, null and empty texts, equal rows, a long text, a hot source, columns with the stages' names."""
    import random

    r = random.Random(1)
    words = [f"{a}{b}{c}" for a in "bdfgkl" for b in "aeiou" for c in "rstvz"]
    text = lambda n: " ".join(r.choice(words) + str(r.randrange(40)) for _ in range(n))
    own = [text(60) for _ in range(60)]
    rows = [(i if i % 3 else None, t, "en", "hot" if i % 4 else "cold", len(t), "k", i) for i, t in enumerate(own)]
    rows += [(7, t, "en", "hot", len(t), "k", 0) for t in (text(50), text(70))] + [(5, own[5], "en", "hot", 0, "k", 0)] * 2
    long = "\n".join(text(12) for _ in range(9000))
    rows += [(900, long, None, None, 1, None, None), (901, None, "en", "hot", 0, "k", 0), (None, "", "en", "hot", 0, "k", 0), (902, f"{text(30)} {own[1]} {text(5)}", "en", "new", 0, "k", 0)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, keys string, row int").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(1, 40)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    leak = text(25)
    spark.createDataFrame([(1, leak), (None, None)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, str(tmp_path))
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == before.columns
            assert {x.doc_id for x in docs.collect()} <= {x.doc_id for x in before.collect()}
    kept = {x.text for x in docs.collect()}
    assert len(kept) > 10 and "" not in kept
