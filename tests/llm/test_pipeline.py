"""The pipeline's stages replayed by hand on the smallest tables, and on awkward rows."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lamina.llm import langid, toxicity
from lamina.llm.common import staged
from tests.llm.test_files import check_packed
from tests.llm.test_jaccard_join import brute


@pytest.fixture(scope="module")
def replayed(spark, sf_dir, docs):
    out, d = [docs], docs
    for name, stage in corpus_pipeline.STAGES:
        d = staged(stage(spark, d, sf_dir), name)
        out.append(d)
    return out


def test_columns_and_order(docs, replayed):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "toxicity", "near_duplicates", "mixing", "packing"]
    assert all(d.columns == docs.columns for d in replayed[1:5])


def test_filters(spark, sf_dir, docs, replayed):
    net = langid.fit(docs)
    pred = {r["doc_id"]: r["p"] for r in docs.select("doc_id", langid.predicted(net, F.col("text")).alias("p")).collect()}
    kept = {r["doc_id"] for r in replayed[1].collect()}
    assert kept == {d for d, p in pred.items() if p["lang_pred"] != "und" and p["score"] >= corpus_pipeline.LEAST_LANGUAGE}
    scorer = toxicity.fit(replayed[1], spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = replayed[1].select("doc_id", "text").collect()
    s = scorer.scores([r["text"] for r in rows])
    assert {r["doc_id"] for r in replayed[2].collect()} == {r["doc_id"] for r, x in zip(rows, s, strict=True) if x < corpus_pipeline.MOST_TOXIC}
    assert len(kept) > 0.8 * docs.count()


def test_one_of_each_group(replayed):
    before = {r["doc_id"]: r["text"] for r in replayed[2].collect()}
    want = {d for d, (_, c) in brute(before, 5, 80).items() if c == d}
    assert sorted(r["doc_id"] for r in replayed[3].collect()) == sorted(want)


def test_mix_and_packing(spark, sf_dir, replayed):
    assert {r["doc_id"] for r in replayed[4].select("doc_id").distinct().collect()} <= {r["doc_id"] for r in replayed[3].collect()}
    rows = replayed[5].collect()
    assert check_packed(rows) <= 1.03 * sum(r["length"] for r in rows) / 4096 + 1
    assert sum(r["piece"] == 0 for r in rows) == replayed[4].count()
    assert corpus_pipeline.run(spark, sf_dir).count() == len(rows)


def test_awkward_rows_pass_every_stage(spark, sf_dir, awkward):
    d = awkward
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        d = staged(stage(spark, d, sf_dir), name)
        assert k == 4 or d.columns == awkward.columns
        empty = stage(spark, awkward.where(F.lit(False)), sf_dir)
        assert empty.count() == 0


def test_mixing_where_ids_repeat(spark, sf_dir):
    rows = [(None if k % 3 else 7, "a word " * (1 + k % 5) + f"{k}", "en", "ab"[k % 4 == 0], 0) for k in range(400)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    size = {s: sum(len(r[1].split()) for r in rows if r[3] == s) for s in "ab"}
    got = corpus_pipeline.mixed(spark, d, sf_dir)
    assert got.columns == d.columns
    taken = {s: 0 for s in "ab"}
    for r in got.collect():
        taken[r["source"]] += len(r["text"].split())
    total = sum(size.values())
    want = {"a": total / 3, "b": total * 2 / 3}
    if want["b"] > 3 * size["b"]:
        want = {"b": 3 * size["b"], "a": total - 3 * size["b"]}
    assert all(abs(taken[s] - want[s]) <= 8 for s in "ab")
