"""Conversation trie, lexical search and license rules against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamina.llm import bitsliced, conversation_trie, license_rules, queries

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


# --- conversation trie


def trie(turns):
    """Brute force over (conv_id, turn, role, text) rows."""
    own = {}
    for c, n, role, text in turns:
        if c is not None:
            own.setdefault(c, []).append((n is not None, n or 0, hashlib.md5(f"{role or ''}\x00{text or ''}".encode()).hexdigest(), role or "", text or ""))
    own = {c: [t[3:] for t in sorted(x)] for c, x in own.items()}
    paths = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        paths[c] = tuple(own.get(c - c % 100, [])[:h] + mine[h:])
    members = {}
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members.setdefault(p[:d], []).append(c)
    out = []
    for p, cs in members.items():
        below = [q for q in members if q[: len(p)] == p]
        parents = {q[:-1] for q in members if q}
        ends = ",".join(str(c) for c in sorted(c for c in cs if len(paths[c]) == len(p)))
        saved = sum((len(members[q]) - 1) * len(q[-1][1]) for q in below if q)
        n_children = sum(len(q) == len(p) + 1 for q in below)
        out.append((min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), n_children, sum(q not in parents for q in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def found_trie(spark, turns):
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("node", F.lit("x")).withColumn("rank", F.lit(1))
    got = conversation_trie.nodes(conversation_trie.rebuilt(conversation_trie.turn_lists(df)))
    rows = got.collect()
    ranks = sorted(r["rank"] for r in rows)
    assert ranks == list(range(len(rows))) and all(r["end_rank"] >= r["rank"] for r in rows)
    return sorted((tuple(r)[:8] for r in rows), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    turns = [(c, t, rng.choice(["user", "assistant", None]), rng.choice(["a", "bb", "ccc", None, "é😀"])) for c in rng.sample(range(0, 500), 80) for t in range(rng.randrange(1, 7))]
    turns += [(700, None, "user", "null turn first"), (700, 1, None, None), (700, 1, None, None), (None, 1, "user", "no conversation"), (205, 0, "u", "x" * 50_000)]
    turns += [(900 + k, t, "user", f"t{t}") for k in range(40) for t in range(3)]  # copies in one hundred
    turns += [(1001, t, "user", f"deep {t}") for t in range(300)]
    assert found_trie(spark, turns) == trie(turns)


def test_ids_of_a_node_go_over_partitions_and_parts(spark, monkeypatch):
    monkeypatch.setattr(conversation_trie, "HELD", 20)
    turns = [(100 * k, 0, "user", "same") for k in range(60)] + [(100 * k, 1, "user", f"other {k % 3}") for k in range(30)]
    assert found_trie(spark, turns) == trie(turns)


def test_trie_of_turnless_and_of_nothing(spark):
    lone = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 >= 2)
    assert found_trie(spark, [(lone, 0, "user", "its base is absent")]) == [(lone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(lone).encode()).hexdigest())]
    assert found_trie(spark, []) == []


# --- lexical search


def ranked(docs, items, k=20):
    counts = [(d, Counter(TERM.findall(lowered(t)))) for d, t in docs]
    counts = [(d, c, sum(c.values())) for d, c in counts if c]
    n_docs, total = len(counts), sum(n for *_, n in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    out = []
    for item, text in items:
        asked = Counter(TERM.findall(lowered(text)))
        scores = []
        for d, c, n in counts:
            m = 75 + (25 * n * n_docs) // total
            s = sum(times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 12 * m)) for t, times in asked.items() if t in c)
            if s > 0:
                scores.append((-s, d is None, d or 0))
        out += [(item, r, None if null else d, -s) for r, (s, null, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def test_search_equals_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    vocabulary = [f"w{int(rng.paretovariate(0.6)) % 300}" for _ in range(400)] + ["Äpfel", "İx", "x_y", "THE"]
    docs = [(d, " ".join(rng.choices(vocabulary, k=rng.randrange(0, 60)))) for d in range(700)]
    docs += [(900, None), (901, ""), (902, " ,;\x00"), (None, "w1 w2 w3"), (903, "w1 " * 30_000)] + [(5, docs[5][1])] * 3 + [(1000 + k, "w7 w7 the same tie") for k in range(40)]
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.randrange(1, 40)))) for k in range(12)] + [(50, None), (51, "unseen"), (52, "w7 w7 w7 w7 w7 TIE"), (53, "w1")]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"score": F.lit(1), "rank": F.lit(2), "n": F.lit("x")})
    q = spark.createDataFrame(items, "item_id long, text string").withColumn("query", F.lit("x"))
    want = ranked(docs, items)
    assert sorted(map(tuple, bitsliced.rank(d, q).collect()), key=str) == want
    monkeypatch.setattr(bitsliced, "QUERY_TERMS", 100)  # several blocks of queries
    assert sorted(map(tuple, bitsliced.rank(d.repartition(3), q).collect()), key=str) == want
    assert bitsliced.rank(d.limit(0), q).count() == 0 and bitsliced.rank(d, q.limit(0)).count() == 0


def test_carries_and_top_slices():
    rng = np.random.default_rng(4)
    for _ in range(30):
        n = int(rng.integers(1, 400))
        sums, parts = np.zeros(n, np.int64), []
        for _ in range(int(rng.integers(1, 9))):
            docs = np.flatnonzero(rng.random(n) < rng.random())
            if len(docs):
                impacts, times = rng.integers(1, 1 << int(rng.integers(1, 40)), len(docs)), int(rng.integers(1, 12))
                parts.append((bitsliced.Slices(docs, impacts), times))
                sums[docs] += times * impacts
        if parts:
            at, values = bitsliced.highest(bitsliced.added(parts, (n + 63) // 64), 20)
            want = sorted((-s, d) for d, s in enumerate(sums.tolist()) if s)[:20]
            assert sorted(zip((-values).tolist(), at.tolist(), strict=True)) == want


# --- license rules


def test_license_contract_columns(spark, awkward, docs):
    extra = spark.createDataFrame([(20, "Under the MIT license; under_the MIT-License! CC BY-NC 4.0 / Apache License, Version 2.0"), (21, "underthe mit license"), (22, "licensed under the GPLv3 or later")], "doc_id long, text string")
    both = docs.select("doc_id", "text").unionByName(awkward.select("doc_id", "text")).unionByName(extra)
    for r in license_rules.scan(both).collect():
        words = ALNUM.findall(lowered(r["text"]))
        hits = [(i, label) for phrase, label in license_rules.BASE.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
        starts, base = [i for i, _ in hits], sorted({x for _, x in hits})
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (len(words), len(hits), min(starts, default=None), max(starts, default=None), ",".join(base))
        labels = r["labels"].split(",") if r["labels"] else []
        assert set(base) <= set(labels) and labels == sorted(set(labels)) and 0 <= r["score"] <= 1 and (r["score"] > 0) == bool(labels)
    kept = license_rules.scan(awkward)
    assert kept.count() == awkward.count() and {c.lower() for c in awkward.columns} <= {c.lower() for c in kept.columns}
    assert license_rules.scan(awkward.limit(0)).count() == 0


def test_prefilter_loses_nothing_and_contained_detections_go():
    rng = random.Random(5)
    words = "mit expat license licence under the of terms released licensed apache version 2 0 3 1 bsd clause gnu gpl general public lgpl lesser cc by nc sa nd 4 creative commons attribution is spdx identifier isc zlib libpng style x11 perl vim w3c unicode psf python software any or later v curl ruby boost".split()
    every = list(range(len(license_rules.rules())))
    for _ in range(1500):
        line = " ".join(rng.choices(words, k=25))
        all_ = license_rules.places(line, every)
        inside = lambda p, q: q.first <= p.first and q.last >= p.last
        hidden = lambda p, q: inside(p, q) and (q.priority > p.priority or q.priority == p.priority and (not inside(q, p) or q.order < p.order))
        assert license_rules.detect(line) == sorted(p for p in all_ if not any(q is not p and hidden(p, q) for q in all_)), line


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("SPDX-License-Identifier: BSD-3-Clause", {"bsd-3-clause"}), ("Licensed under the GNU General Public License, version 3.", {"gpl-3"}), ("GPLv2 license or later", {"gpl-2"}),
        ("redistribute it and/or modify it under the terms of the GNU Lesser General Public License", {"lgpl"}), ("Ich gehe mit dir in die Lizenz", set()), ("All rights reserved. License: MIT", {"all-rights-reserved", "mit"}),
        ("https://creativecommons.org/licenses/by-nc-sa/4.0", {"cc-by-nc-sa"}),
    ],
)
def test_labels_of_the_rules(text, labels):
    line = b" ".join(license_rules.folded(text)).decode()
    assert {f.label for f in license_rules.detect(line)} == labels
    assert len(license_rules.rules()) >= 300


def test_queries_are_registered():
    assert {"op11_conversation_trie", "op12_lexical_search"} <= set(queries.ORACLES) and "op13_license_scan" in queries.QUERIES
