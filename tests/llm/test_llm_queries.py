"""The subpackage's queries against their SQL, and the pipeline."""

import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from helpers import DATA, check
from pyspark.sql import functions as F
from test_operators import brute_jaccard

from gridloom.llm import langid, quality, queries
from gridloom.llm.chunks import ChunkEncoder


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_equals_sql(spark, name):
    check(spark, queries.QUERIES[name], queries.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_one_row_a_document(spark, name):
    out = queries.QUERIES[name](spark, DATA)
    n = spark.read.parquet(f"{DATA}/documents.parquet").count()
    assert out.select("doc_id").distinct().count() == n


def one_process(spark, docs, labels):
    """Quality scores of all documents, computed text by text in this process."""
    rows = docs.select("doc_id", "text").collect()
    model = quality.train(docs, labels)
    pooler = quality.Pooler(model.tokens, model.vectors) if model.tokens else None
    scores = [float(quality.scores(model, pooler, [r["text"]])[0]) for r in rows]
    return rows, scores


def languages(docs):
    """The model by a plain fit on the rows to learn from that aren't set aside, and its threshold by a plain quantile over those that are."""
    rows = docs.withColumn("aside", langid.set_aside(docs)).filter(langid.learnable()).select("lang", "text", "aside").collect()
    scorer = langid.Scorer(langid.fit(*zip(*((r["text"], r["lang"]) for r in rows if not r["aside"]), strict=True)))
    told = [(r["lang"], *langid.predict(scorer, [r["text"]])) for r in rows if r["aside"]]
    right = [s[0] for lang, (k,), s in told if k == lang]
    assert 0 < len(right) < len(rows) / 3
    return scorer, float(np.quantile(right, langid.REFUSED))


def test_quality_and_language_equal_one_process(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    rows, scores = one_process(spark, docs, labels)
    got = {r["doc_id"]: r["score"] for r in queries.op7_quality(spark, DATA).collect()}
    assert all(abs(got[r["doc_id"]] - s) < 1e-9 for r, s in zip(rows, scores, strict=True)) and len(got) == len(rows)
    sample = langid.training_rows(docs).collect()
    scorer = langid.Scorer(langid.fit([r["text"] for r in sample], [r["lang"] for r in sample]))
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in queries.op10_language(spark, DATA).collect()}
    for r in rows:
        (lang,), (score,) = langid.predict(scorer, [r["text"]])
        assert got[r["doc_id"]][0] == lang and abs(got[r["doc_id"]][1] - score) < 1e-6


def test_share_of_unseen_rows_that_the_language_stage_refuses(spark):
    """A threshold that refuses 5 % of the rows set aside refuses about as many of those that neither model nor threshold have seen."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("doc_id is not null")
    kept = {r[0] for r in langid.keep_known(docs, 0.05).select("doc_id").collect()}
    unseen = {r[0] for r in docs.filter(langid.held_out() & F.col("lang").isNotNull()).select("doc_id").collect()}
    share = len(unseen - kept) / len(unseen)
    # Rows set aside are about 160: the quantile itself has a spread of some 2 %.
    assert 100 < len(unseen) and 0.005 < share < 0.15


def test_pipeline_equals_brute_force(spark):
    """All stages, text by text in this process, against a run."""
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "language", "exact_dedup", "near_dedup", "packing"]
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    rows, scores = one_process(spark, docs, labels)
    good = {r["doc_id"]: r["text"] for r, s in zip(rows, scores, strict=True) if s >= 0.7}
    scorer, least = languages(docs.filter(F.col("doc_id").isin(list(good))))
    known = {}
    for d, text in good.items():
        (lang,), (score,) = langid.predict(scorer, [text])
        if lang != "und" and score >= least - 1e-9:
            known[d] = text
    first = {}
    for d in sorted(known):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", known[d] or ""), d)
    left = [d for d, _, c in brute_jaccard([(d, known[d]) for d in first.values()]) if d == c]
    library = ChunkEncoder(public_tokenizers.path("byte_bpe_50k.json")).library
    sizes = {d: len(library.encode(known[d] or "", add_special_tokens=False).ids) + 1 for d in left}
    found = Counter()
    for r in corpus_pipeline.run(spark, DATA).collect():
        found[r["doc_id"]] += r["length"]
        assert r["doc_tokens"] == sizes[r["doc_id"]]
    assert found == sizes and 0 < len(left) < len(first) < len(known) <= len(good) < len(rows)


def test_pipeline_stages_take_awkward_tables(spark, docs, rows, none, tmp_path):
    """Nulls, empty and long texts, ties, repeated rows, clashing columns, empty tables: every stage has a defined result."""
    import corpus_pipeline

    spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(40)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    counts = {}
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, str(tmp_path)).count() == 0
        out = stage(spark, docs, str(tmp_path))
        counts[name] = out.count()
        if name != "packing":
            assert out.columns == docs.columns and set(map(repr, map(tuple, out.collect()))) <= set(map(repr, rows))
    texts = {re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "") for r in rows}
    assert counts["exact_dedup"] == len(texts) and counts["packing"] >= len(rows) and counts["language"] <= sum(bool(t.strip()) for t in texts) + len(rows)
    # Without any language to learn from, none is known.
    assert dict(corpus_pipeline.STAGES)["language"](spark, docs.withColumn("lang", F.lit(None).cast("string")), str(tmp_path)).count() == 0
