"""Held-out quality of the trained classifiers, gradients, and awkward rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamina.llm import langid, queries, toxicity

LARGER = "/root/testdata/sf0.01"


def test_language_held_out(spark):
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{LARGER}/documents.parquet").where("lang IS NOT NULL").collect()}
    rows = [r for r in queries.op1_language(spark, LARGER).collect() if r["held_out"] and r["doc_id"] in truth and r["lang_pred"] != "und"]
    assert len(rows) > 50 and all(0 <= r["score"] <= 1 for r in rows)
    assert np.mean([truth[r["doc_id"]] == r["lang_pred"] for r in rows]) > 0.95


def test_gradients_by_differences():
    net = langid.ByteNetwork(["a", "b", "c"], units=3, seed=1)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    rnd = np.random.default_rng(0)
    x, y, weight = rnd.integers(97, 101, (4, 6)).astype(np.uint8), np.array([0, 1, 2, 1]), np.array([1.0, 2.0, 1.0, 0.5])

    def loss():
        p = net.positions(x)
        return -(np.log(p[np.arange(4), :, y]).mean(axis=1) * weight).sum() / weight.sum()

    g = net.gradients(x, y, weight)
    for name in net.w:
        flat, grad = net.w[name].reshape(-1), g[name].reshape(-1)
        for k in np.argsort(-np.abs(grad))[:3]:
            old = flat[k]
            flat[k] = old + 1e-3
            up = loss()
            flat[k] = old - 1e-3
            down = loss()
            flat[k] = old
            assert (up - down) / 2e-3 == pytest.approx(grad[k], rel=0.05, abs=1e-4)


def test_language_of_awkward_rows(awkward, docs):
    net = langid.fit(docs, steps=20)
    rows = awkward.select("doc_id", "text", langid.predicted(net, F.col("text")).alias("p")).collect()
    assert len(rows) == awkward.count()
    for r in rows:
        assert (r["p"]["lang_pred"] == "und") == (r["doc_id"] in (1, 2, 3, 4))
    none = langid.fit(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r[0] for r in docs.select(langid.predicted(none, F.col("text")).lang_pred).distinct().collect()} == {"und"}
    assert awkward.where(F.lit(False)).select(langid.predicted(net, F.col("text"))).count() == 0


def test_a_rare_language_is_learned(spark, docs):
    usable = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", "lang")
    last = usable.orderBy(F.xxhash64("doc_id").desc()).limit(1).withColumn("lang", F.lit("rare"))
    x, y = langid.training_windows(usable.join(last.select("doc_id"), "doc_id", "left_anti").unionByName(last), sample=100)
    assert "rare" in y and len(set(y)) == usable.select("lang").distinct().count() + 1
    assert len(x) == len(y) <= 100 * langid.DOC_WINDOWS
    assert len(set(langid.training_windows(usable.withColumn("lang", F.col("doc_id").cast("string")), sample=30)[1])) == 30


def auc(score, y):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    for v in np.unique(score):
        at = np.flatnonzero(score == v)
        rank[at] = (np.searchsorted(score[order], v, "left") + np.searchsorted(score[order], v, "right") + 1) / 2
    return (rank[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() + 1) / 2) / ((y == 1).sum() * (y == 0).sum())


def test_toxicity_held_out(spark):
    truth = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{LARGER}/labels.parquet").collect()}
    rows = [r for r in queries.op2_toxicity(spark, LARGER).collect()]
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    rows = [r for r in rows if r["held_out"] and truth.get(r["doc_id"]) is not None]
    y = np.array([truth[r["doc_id"]] for r in rows])
    assert auc(np.array([r["score"] for r in rows]), y) > 0.9
    assert np.mean([r["predicted"] for r in rows] == y) > 0.9


def test_subsequence_kernel_by_definition():
    from itertools import combinations

    def slow(a, b):
        span = lambda s: [("".join(s[k] for k in c), c[-1] - c[0] + 1) for c in combinations(range(len(s)), toxicity.LENGTH)]
        return sum(toxicity.DECAY ** (n + m) for u, n in span(a) for v, m in span(b) if u == v)

    pairs = [("idiot", "idiot"), ("i.d.i.o.t", "idiot"), ("idiiot", "idiot"), ("radio", "idiot"), ("abcd", "abcd"), ("aaaaa", "aaaa")]
    got = toxicity.pair_kernels([a for a, _ in pairs], [b for _, b in pairs])
    assert got == pytest.approx([slow(a, b) for a, b in pairs], rel=1e-4)


def test_gapped_insults_are_found():
    clean = [f"we walked to the river number {k} and saw many birds." for k in range(60)]
    bad = [f"go away you stupidhead number {k} and do not return." for k in range(60)]
    s = toxicity.train(clean + bad, np.array([0] * 60 + [1] * 60))
    low = s.scores(["we walked along the street and met friends.", "", None])
    high = s.scores(["you stupidhead go home.", "you s.t.u.p.i.d.h.e.a.d go home.", "you stuupidheead go home.", "you s t u p i d h e a d go home."])
    assert max(low) < 0.5 < min(high)


def test_scores_do_not_depend_on_the_memory(monkeypatch):
    clean = [f"we walked to the river number {k} and saw many birds." for k in range(60)]
    bad = [f"go away you stupidhead number {k} and do not return." for k in range(60)]
    s = toxicity.train(clean + bad, np.array([0] * 60 + [1] * 60))
    texts = [bad[k] if k % 3 == 0 else clean[k] for k in range(60)]
    s._forget()
    want = s.scores(texts)
    monkeypatch.setattr(toxicity, "REMEMBERED", 20)
    s._forget()
    got = np.concatenate([s.scores([t]) for t in texts])
    assert got == pytest.approx(want) and (want > 0.5).sum() == 20


def test_toxicity_of_awkward_rows(spark, awkward):
    labels = spark.createDataFrame([(5, 1), (8, 0), (None, 1), (7, None)], "doc_id long, toxic int")
    scorer = toxicity.fit(awkward, labels)
    rows = awkward.select(toxicity.score(scorer, F.col("text")).alias("s")).collect()
    assert len(rows) == awkward.count() and all(0 <= r["s"] <= 1 for r in rows)
    none = toxicity.fit(awkward, labels.where("toxic = 0"))
    assert all(r["s"] < 0.5 for r in awkward.select(toxicity.score(none, F.col("text")).alias("s")).collect())
