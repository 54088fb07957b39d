"""The join against all pairs."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lamina.llm import jaccard_join
from tests.llm.conftest import lowered, words


def shingles(text, width):
    w = words(lowered(text))
    if not w:
        return frozenset()
    return frozenset(tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1)))


def brute(texts, width, percent):
    sets = {d: shingles(t, width) for d, t in texts.items()}
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    by_set = {}
    for d, s in sets.items():
        by_set.setdefault(s, []).append(d)
    groups = [s for s in by_set if s]
    at = {}
    for k, s in enumerate(groups):
        for x in s:
            at.setdefault(x, []).append(k)
    for k, s in enumerate(groups):
        for d in by_set[s]:
            a, b = find(d), find(by_set[s][0])
            root[max(a, b)] = min(a, b)
        for j, both in Counter(j for x in s for j in at[x] if j < k).items():
            if 100 * both >= percent * (len(s) + len(groups[j]) - both):
                a, b = find(by_set[s][0]), find(by_set[groups[j]][0])
                root[max(a, b)] = min(a, b)
    return {d: (len(sets[d]), find(d)) for d in sets}


def joined(df, **args):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.join(df, **args).collect()}


def edited(seed, n=240, vocabulary=400):
    """Families of texts with a few words changed, so that many pairs lie near the threshold."""
    rnd = random.Random(seed)
    out = {}
    for k in range(n):
        if k % 6 == 0:
            base = [f"w{rnd.randrange(vocabulary)}" for _ in range(rnd.choice([4, 15, 40, 90, 200]))]
        body = list(base)
        for _ in range(rnd.randrange(0, max(2, len(body) // 25))):
            body[rnd.randrange(len(body))] = f"x{rnd.randrange(vocabulary)}"
        if rnd.random() < 0.3:
            body = body[rnd.randrange(3) :]
        out[k] = " ".join(body) + rnd.choice(["", "\n", "  "])
    return out


@pytest.mark.parametrize("width,percent", [(3, 90), (5, 80)])
def test_driver_documents(docs, texts, width, percent):
    assert joined(docs, width=width, percent=percent) == brute(texts, width, percent)


@pytest.mark.parametrize("seed,width,percent,vocabulary", [(1, 3, 90, 400), (2, 5, 80, 400), (3, 3, 90, 12), (4, 2, 70, 8)])
def test_families(spark, seed, width, percent, vocabulary):
    texts = edited(seed, vocabulary=vocabulary)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert joined(df, width=width, percent=percent) == brute(texts, width, percent)


def test_large_regions_are_split(spark, monkeypatch):
    rnd = random.Random(9)
    base = [f"w{k}" for k in range(120)]
    texts = {}
    for k in range(160):
        body = base[:]
        for _ in range(rnd.randrange(1, 5)):
            body[rnd.randrange(len(body))] = f"x{k}"
        texts[k] = " ".join(body)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    monkeypatch.setattr(jaccard_join, "REGION_SETS", 12)
    assert joined(df) == brute(texts, 3, 90)


@pytest.mark.parametrize("edits", [1, 4, 9])
def test_a_dense_ball_is_neither_multiplied_nor_joined_by_one_task(spark, monkeypatch, edits):
    """Near copies far beyond REGION_SETS: all alike, some alike, or none, by the number of changed words."""
    rnd = random.Random(edits)
    texts = {}
    for k in range(600):
        body = [f"w{j}" for j in range(120)]
        for at in rnd.sample(range(0, 120, 3), rnd.randrange(1, edits + 1)):
            body[at] = f"x{k}_{at}"
        texts[k] = " ".join(body)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    regions, inner = [], jaccard_join.region_links

    def counted(members, percent):
        regions.extend(r["count"] for r in members.groupBy("region").count().collect())
        return inner(members, percent)

    monkeypatch.setattr(jaccard_join, "region_links", counted)
    monkeypatch.setattr(jaccard_join, "REGION_SETS", 60)
    assert joined(df) == brute(texts, 3, 90)
    assert max(regions, default=0) <= 90
    assert sum(regions) <= 40 * len(texts), sum(regions)


def test_awkward_rows(awkward):
    got = sorted(map(tuple, jaccard_join.join(awkward).collect()), key=repr)
    assert len(got) == awkward.count()
    by_id = {d: (n, c) for d, n, c in got}
    assert by_id[1] == (0, 1) and by_id[2] == (0, 2) and by_id[3] == (0, 3)
    assert by_id[5] == by_id[6] and by_id[5][1] == 5
    assert by_id[8] == (1, 8) and by_id[None][1] is None
    assert by_id[7][0] == 180_001


def test_empty_table(awkward):
    assert jaccard_join.join(awkward.where(F.lit(False))).count() == 0


def test_sets_around_a_pivot_are_sent_once(spark, monkeypatch):
    """Small regions: no set is sent to two rings, and the links are those of all pairs."""
    texts, sent = edited(3, 120, 60), []
    inner = jaccard_join.window_links

    def counted(members, *args):
        sent.extend(tuple(r) for r in members.select("pivot", "node").collect())
        return inner(members, *args)

    monkeypatch.setattr(jaccard_join, "window_links", counted)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert joined(df, width=2, percent=60) == brute(texts, 2, 60)
    assert sent and len(sent) == len(set(sent))
