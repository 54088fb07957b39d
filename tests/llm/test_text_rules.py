"""Quality rules, mixing, fingerprints and language model against plain computations."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamina.llm import hmm, iblt, mixing, quality_rules, queries
from tests.llm.conftest import lowered, words


def base_counts(text):
    text = text or ""
    w = words(text)
    lines = [x for x in text.split("\n") if words(x)]
    windows = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    n = Counter(windows)
    covered = {k + j for k, x in enumerate(windows) if n[x] > 1 for j in range(3)}
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


@pytest.mark.parametrize("which", ["docs", "awkward"])
def test_quality_counts(request, which):
    df = request.getfixturevalue(which)
    rows = quality_rules.rule_columns(df).select("text", *quality_rules.COUNTS).collect()
    assert len(rows) == df.count()
    for r in rows:
        assert tuple(r)[1:7] == base_counts(r["text"])
        assert not (r["base_failed"] and r["kept"])


def test_line_rules(spark):
    prose = "This is a plain sentence with quite a few words in it, as people write them.\n"
    bad = "home | news | shop | login\n### $$$ %%% ###\nAll rights reserved by the owner of this site.\n"
    rows = [(0, prose * 1 + "".join(f"Another line number {k} tells of other things, such as rain.\n" for k in range(9))), (1, prose + bad), (2, bad * 3)]
    df = quality_rules.with_line_verdict(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r["doc_id"]: r for r in df.collect()}
    assert got[0]["lost_chars"] == 0 and got[0]["kept_by_lines"]
    assert got[1]["clean_text"] == prose.strip("\n")
    assert not got[2]["kept_by_lines"] and got[2]["clean_text"] == ""


def test_quality_is_native(docs):
    plan = quality_rules.rule_columns(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def fair_targets(sizes, weights=(1, 2, 3), cap=3):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % 3] for k, s in enumerate(order)}
    left, free, out = sum(sizes.values()), set(order), {}
    while free:
        total = sum(w[s] for s in free)
        over = [s for s in free if left * w[s] / total > cap * sizes[s]]
        if not over:
            return out | {s: left * w[s] / total for s in free}
        for s in over:
            out[s] = cap * sizes[s]
            free.remove(s)
        left = sum(sizes.values()) - sum(out.values())
    return out


@pytest.mark.parametrize("which", ["docs", "awkward"])
def test_mixing(request, which):
    df = request.getfixturevalue(which).select("doc_id", "text", "source")
    rows = mixing.mix(df).collect()
    assert len(rows) == df.count()
    source = {r["doc_id"]: r["source"] for r in df.collect()}
    size = {}
    for r in df.collect():
        size[r["source"]] = size.get(r["source"], 0) + len(words(r["text"]))
    want = fair_targets(size)
    taken, most = Counter(), Counter()
    for r in rows:
        s = source[r["doc_id"]]
        assert r["source_size"] == size[s] and abs(r["target"] - want[s]) <= 1e-6 * max(1, want[s])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
        most[s] = max(most[s], r["size"])
    if which == "docs":
        for s, t in want.items():
            assert abs(taken[s] - t) <= max(0.01 * t, 60)
    assert sorted(map(repr, rows)) == sorted(map(repr, mixing.mix(df).collect()))


def test_one_size_in_a_hot_source(spark):
    rows = [(k, "one two three four", "hot") for k in range(3000)] + [(k, "a " * (k % 50), "cold") for k in range(3000, 3600)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    taken, target = Counter(), {}
    for r in got:
        taken[r["source_size"]] += r["taken"]
        target[r["source_size"]] = r["target"]
    assert all(abs(taken[k] - t) <= 0.01 * t for k, t in target.items())


def test_fingerprints(spark, sf_dir, texts):
    order = sorted(texts, reverse=True)
    rows = {r["doc_id"]: r for r in queries.op5_fingerprints(spark, sf_dir).collect()}
    assert set(rows) == set(order)

    def likeness(a, b):
        a, b = set(iblt.digests(a).tolist()), set(iblt.digests(b).tolist())
        return len(a & b) / len(a | b) if a | b else 1.0

    for k, d in enumerate(order):
        t, after = texts[d] or "", texts[order[(k + 1) % len(order)]] or ""
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        r = rows[d]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["near_edited"] == pytest.approx(likeness(t, edited)) and r["near_next"] == pytest.approx(likeness(t, after))
    by_text = {}
    for d, t in texts.items():
        assert by_text.setdefault(t or "", rows[d]["fingerprint"]) == rows[d]["fingerprint"]


def test_peeling_recovers_the_difference():
    rnd = np.random.default_rng(2)
    for n in (0, 1, 5, 300):
        shared, a, b = (rnd.integers(0, 1 << 63, m).astype(np.uint64) for m in (200, n, n))
        sets = [np.concatenate([shared, a]), np.concatenate([shared, b])]
        assert iblt.likeness(sets, np.array([0]), np.array([1]))[0] == pytest.approx(200 / (200 + 2 * n))


def test_fingerprints_of_awkward_rows(awkward):
    rows = iblt.fingerprints(awkward).collect()
    assert len(rows) == awkward.count() and all(0 <= r["near_next"] <= 1 for r in rows)
    one = iblt.fingerprints(awkward.where("doc_id = 8")).first()
    assert one["near_next"] == 1.0
    assert iblt.fingerprints(awkward.where(F.lit(False))).count() == 0


def test_language_model(spark, sf_dir, texts):
    rows = {r["doc_id"]: r for r in queries.op4_hmm(spark, sf_dir).collect()}
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in texts}
    c = Counter(w for d, t in texts.items() if not held[d] for w in words(lowered(t)))
    ends = sum(not h for h in held.values())
    n, v = sum(c.values()) + ends, len(c) + 1
    gain = 0.0
    for d, t in texts.items():
        w = words(lowered(t))
        base = sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w) + math.log10((ends + 1) / (n + v + 1))
        r = rows[d]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[d], len(w) + 1, sum(c[x] > 0 for x in w) + 1, n)
        assert r["base_score"] == pytest.approx(base, rel=1e-9)
        assert r["score"] < 0
        gain += (r["score"] - r["base_score"]) * held[d]
    assert gain > 0


def test_forward_is_the_sum_over_all_paths():
    from itertools import product

    m = hmm.Model(np.array([3.0, 5, 2, 1]), states=3)
    for stream in ([0], [1, 2, 0], [3, 1, 1, 2, 0]):
        p = sum(
            m.start[0][s[0]] * np.prod([m.move[a, b] for a, b in zip(s, s[1:], strict=False)]) * np.prod([m.emit[x, k] for x, k in zip(stream, s, strict=True)])
            for s in product(range(3), repeat=len(stream))
        )
        assert m.forward(np.array([len(stream)]), np.array(stream))[0] == pytest.approx(math.log10(p))


def test_rounds_raise_the_likelihood():
    rnd = np.random.default_rng(1)
    stream = np.concatenate([np.append(rnd.integers(1, 4, 30) + 3 * (k % 2), 0) for k in range(60)]).astype(np.uint16)
    lens = np.full(60, 31)
    tokens = np.bincount(stream, minlength=7).astype(float)
    m = hmm.Model(tokens, states=2)
    seen = []
    for _ in range(6):
        c = m.counts(lens, stream)
        seen.append(c[0])
        m.update(c, (tokens + 0.5) / (tokens + 0.5).sum() * 1e-3)
    assert seen[-1] > seen[0] and all(b >= a - 0.5 for a, b in zip(seen, seen[1:], strict=False))


def test_language_model_of_awkward_rows(awkward):
    df = awkward.select("doc_id", (F.col("doc_id") == 8).alias("held"), "text").fillna({"held": False})
    rows = hmm.score(df, rounds=1).collect()
    assert len(rows) == awkward.count()
    assert {r["n_tokens"] for r in rows if r["doc_id"] in (1, 2, 3)} == {1}
    assert hmm.score(df.where(F.lit(False)), rounds=1).count() == 0
    assert hmm.score(df.withColumn("held", F.lit(True)), rounds=1).where("n_known > 0").count() == 0


def test_blocks_of_a_task_leave_no_cycles(monkeypatch):
    """The words of a block are freed with it: a cycle would keep them until the collector happens to run, so a task would grow with its input."""
    import gc
    from types import SimpleNamespace

    import pyarrow as pa
    import pyspark

    monkeypatch.setattr(pyspark, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    monkeypatch.setattr(hmm, "BLOCK_CHARS", 100)
    frame = SimpleNamespace(select=lambda *_: frame, mapInArrow=lambda run, _: run)
    batch = pa.RecordBatch.from_pylist([{"doc_id": k, "held": k % 3 == 0, "text": f"same word{k} word{k} " * 4} for k in range(200)])
    run = hmm.blocks(frame)
    gc.collect()
    gc.disable()
    try:
        made = sum(1 for _ in run(iter([batch])))
        found = gc.collect()
    finally:
        gc.enable()
    assert made > 50 and found < made


def test_staged_blocks_are_read_one_by_one(spark, docs, monkeypatch):
    """Each large row ends its row group, so neither writer nor reader holds many."""
    import pyarrow.parquet as pq

    from lamina.llm.common import staged

    monkeypatch.setitem(hmm.BLOCK_FILES, "parquet.block.size", 1 << 10)
    texts = docs.select("doc_id", F.lit(False).alias("held"), F.repeat("text", 40).alias("text")).coalesce(1)
    monkeypatch.setattr(hmm, "BLOCK_CHARS", 2_000_000)
    found = staged(hmm.blocks(texts), "blocks", **hmm.BLOCK_FILES)
    files = [pq.ParquetFile(f.removeprefix("file://")) for f in found.inputFiles()]
    assert found.count() > 3 and sum(f.num_row_groups for f in files) == found.count()


def test_printed_fingerprints_tell_likeness(spark):
    parts = [f"Paragraph number {k} says something of its own." for k in range(60)]
    texts = [" ".join(parts), " ".join(parts[:55] + ["Another one here."]), " ".join(p.upper() for p in parts), ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    printed = {r["doc_id"]: r["fingerprint"] for r in iblt.fingerprints(df).collect()}
    pairs = [(0, 0), (0, 1), (0, 2), (3, 3)]
    rows = spark.createDataFrame([(k, printed[a], printed[b]) for k, (a, b) in enumerate(pairs)], "k int, a string, b string")
    got = {r["k"]: r["s"] for r in rows.select("k", iblt.compared(F.col("a"), F.col("b")).alias("s")).collect()}
    assert got[0] == got[3] == 1.0 and abs(got[1] - 55 / 61) < 1e-9 and got[2] is None


def test_other_columns_pass_the_rules_untouched(spark):
    from lamina.llm import quality_rules

    df = spark.createDataFrame([("a b c a b c", 7, "x")], "text string, _words int, _facts string")
    row = quality_rules.rule_columns(df).first()
    assert row["_words"] == 7 and row["_facts"] == "x" and row["n_words"] == 6 and row["n_repeat_words"] == 6
