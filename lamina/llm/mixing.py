"""Mixing sources to target weights by entropy balancing.

Each document of a source gets the rate r = min(cap, exp(l z)), with z its size
over the source's mean size: of all rates up to the cap whose tokens add up to
the source's target, those nearest to 1 in relative entropy.  One multiplier l
for each source solves the convex dual; Newton steps, kept inside a bracket,
sum gradient and curvature over the (source, size) histogram on the cluster.
Rates then become whole copies whose tokens follow the running target.

Defined cases: a null text has size 0; null is a source of its own, last in
order; an empty table gives no rows; a source without words gets target 0; very
long texts count in full; equal sizes are told apart by a hash of the id;
repeated rows are separate documents; columns other than id, text and source
are not looked at.  Nothing but a largest residual reaches the driver, and a
task that rounds holds ``RANGE_GROUPS`` groups of a source, about.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina.llm.common import staged, words

#: Documents of one (source, size) group whose order one task settles.
GROUP_ROWS = 512
#: Groups of one source that one task rounds, about; those of a larger source are dealt over several.
RANGE_GROUPS = 20_000


def tilted(lam: Column, z: Column, cap: float) -> Column:
    """The rate of a document of relative size ``z``."""
    return F.least(F.lit(float(cap)), F.exp(F.least(lam * z, F.lit(50.0))))


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (1, 2, 3), cap: float = 3.0) -> DataFrame:
    """(source, source_size, target): weights repeat over the sources in order of code points, null last.

    Targets share all words by weight; one above ``cap`` times its source stops
    there and its excess goes to the others.  With the sources in order of
    cap / weight the stopped ones come first, so running sums give the level.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    per = per.withColumn("most", cap * F.col("source_size"))
    by = Window.orderBy((F.col("most") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("all", F.sum("source_size").over(whole))
    left = F.col("all") - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    per = per.withColumn("level", left / F.sum("w").over(by.rowsBetween(0, Window.unboundedFollowing)))
    per = per.withColumn("first", F.min(F.when(F.col("most") / F.col("w") >= F.col("level"), F.struct((F.col("most") / F.col("w")).alias("r"), "level"))).over(whole))
    level = F.coalesce(F.col("first.level"), F.lit(float("inf")))
    return per.select("source", "source_size", F.least("most", F.col("w") * level).alias("target"))


def balance(hist: DataFrame, targets: DataFrame, cap: float = 3.0, rounds: int = 40, tolerance: float = 1e-7) -> DataFrame:
    """(source, lam, state) from Newton steps on ``hist`` (source, size, n); state 0: no copies, 1: solved, 2: all at the cap."""
    same = F.col("h.source").eqNullSafe(F.col("s.source"))
    mean = hist.groupBy("source").agg((F.sum(F.col("n") * F.col("size") * F.col("size")) / F.greatest(F.sum(F.col("n") * F.col("size")), F.lit(1))).alias("mean"))
    state = (
        targets.alias("h").join(mean.alias("s"), same).select("h.source", "h.target", "s.mean", (cap * F.col("h.source_size")).alias("most"))
        .withColumn("state", F.when(F.col("target") <= 0, 0).when(F.col("target") >= F.col("most") * (1 - 1e-9), 2).otherwise(1))
        .select("source", "target", "mean", "state", F.lit(0.0).alias("lam"), F.lit(-1e4).alias("low"), F.lit(1e4).alias("high"), F.lit(1.0).alias("off"))
        .checkpoint()
    )
    for _ in range(rounds):
        z = F.col("h.size") / F.col("s.mean")
        rate = tilted(F.col("s.lam"), z, cap)
        tokens = F.col("h.n") * F.col("h.size")
        sums = (
            hist.alias("h").join(state.alias("s"), same).where("s.state = 1")
            .groupBy("s.source", "s.target", "s.mean", "s.state", "s.lam", "s.low", "s.high")
            .agg((F.sum(tokens * rate) - F.col("s.target")).alias("f"), F.sum(F.when(rate < cap, tokens * rate * z).otherwise(0)).alias("slope"))
        )
        low = F.when(F.col("f") < 0, F.col("lam")).otherwise(F.col("low"))
        high = F.when(F.col("f") < 0, F.col("high")).otherwise(F.col("lam"))
        step = F.col("lam") - F.least(F.greatest(F.col("f") / F.greatest("slope", F.lit(1e-12)), F.lit(-3.0)), F.lit(3.0))
        new = F.when((step > low) & (step < high), step).otherwise((low + high) / 2)
        moved = sums.select("source", "target", "mean", "state", F.round(new, 10).alias("lam"), low.alias("low"), high.alias("high"), F.abs(F.col("f") / F.col("target")).alias("off"))
        state = moved.unionByName(state.where("state <> 1")).checkpoint()
        worst = state.where("state = 1").agg(F.max("off")).first()[0]
        if worst is None or worst < tolerance:
            break
    return state.select("source", "target", "mean", "state", "lam")


def nearer(sizes: np.ndarray, most: np.ndarray, copies: np.ndarray, off: float) -> np.ndarray:
    """``copies`` with at most four changes, each one copy more, one less or both, that bring the tokens ``off`` the target nearest to it."""
    copies = copies.copy()
    for _ in range(4):
        up, down = np.flatnonzero((copies < most) & (sizes > 0)), np.flatnonzero((copies > 0) & (sizes > 0))
        gain, loss = np.append(0, sizes[up]), np.append(0, sizes[down])
        order = np.argsort(loss, kind="stable")
        at = np.searchsorted(loss[order], gain - off)
        best = (abs(off) - 1e-9, -1, -1)
        for near in (np.clip(at, 0, len(loss) - 1), np.clip(at - 1, 0, len(loss) - 1)):
            left = np.abs(off - gain + loss[order[near]])
            k = int(left.argmin())
            best = min(best, (float(left[k]), k, int(order[near[k]])))
        left, k, j = best
        if k < 0:
            break
        if k:
            copies[up[k - 1]] += 1
        if j:
            copies[down[j - 1]] -= 1
        off = off - int(gain[k]) + int(loss[j])
    return copies


def copies_by_group(groups: DataFrame, solved: DataFrame, cap: float = 3.0) -> DataFrame:
    """Adds ``copies`` to (source, size, part, n): whole numbers that keep each source's running tokens at its running target.

    Groups follow one another by falling size within a range of a source, a part
    of its groups chosen by hash; each range keeps to its own running target and
    is mended at the end, where a copy more or less brings it nearer.
    """
    most = int(cap)

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "part"], ascending=[False, True], kind="stable")
        sizes, ns, rates = pdf["size"].tolist(), pdf["n"].tolist(), pdf["rate"].tolist()
        ideal, taken, out = 0.0, 0, []
        for size, n, rate in zip(sizes, ns, rates, strict=True):
            ideal += n * size * rate
            k = 0 if size == 0 else min(most * n, max(0, int((ideal - taken) / size + 0.5)))
            taken += k * size
            out.append(k)
        return pdf[["source", "size", "part", "n"]].assign(copies=nearer(np.array(sizes), most * np.array(ns), np.array(out), ideal - taken))

    rate = F.when(F.col("s.state") == 2, F.lit(cap)).when(F.col("s.state") == 0, F.lit(0.0))
    rate = rate.otherwise(tilted(F.col("s.lam"), F.col("h.size") / F.col("s.mean"), cap))
    rated = groups.alias("h").join(solved.alias("s"), F.col("h.source").eqNullSafe(F.col("s.source"))).select("h.*", rate.alias("rate"))
    ranges = groups.groupBy("source").agg(F.ceil(F.count("*") / RANGE_GROUPS).cast("int").alias("ranges"))
    rated = rated.alias("a").join(ranges.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source"))).select("a.*", F.pmod(F.xxhash64("a.size", "a.part"), "b.ranges").alias("range"))
    return rated.groupBy("source", "range").applyInPandas(fill, "source string, size long, part int, n long, copies long")


def mix(docs: DataFrame, id_column: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = (1, 2, 3), cap: float = 3.0) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, copies, taken.

    ``copies`` is how often the mix takes the document, at most ``cap``.
    """
    cols = [F.col(id_column).alias("doc_id"), F.col(source).alias("source"), F.size(words(F.col(text))).cast("long").alias("size")]
    sizes = staged(docs.select(*cols), "sizes")
    counted = sizes.groupBy("source", "size").agg(F.count("*").alias("n"))
    hist = staged(counted.withColumn("parts", F.ceil(F.col("n") / GROUP_ROWS).cast("int")), "histogram")
    targets = staged(source_targets(sizes, weights, cap), "targets")
    solved = balance(hist, targets, cap)

    # Documents of one size are dealt over parts of a few hundred, so that no task orders a large group.
    key = ["source", "size"]
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in key]
    placed = sizes.alias("a").join(hist.alias("b"), same).select("a.*", F.pmod(F.xxhash64("a.doc_id"), F.col("b.parts")).cast("int").alias("part"))
    groups = placed.groupBy(*key, "part").agg(F.count("*").alias("n"))
    given = copies_by_group(groups, solved, cap)
    key = [*key, "part"]
    rank = Window.partitionBy(*key).orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id")
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in key]
    ranked = placed.withColumn("rank", F.row_number().over(rank))
    base = F.floor(F.col("b.copies") / F.col("b.n"))
    rows = ranked.alias("a").join(given.alias("b"), same).select(
        "a.doc_id", "a.source", "a.size", (base + F.when(F.col("a.rank") <= F.col("b.copies") - base * F.col("b.n"), 1).otherwise(0)).cast("long").alias("copies")
    )
    return rows.alias("a").join(targets.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source"))).select(
        "a.doc_id", "a.size", "b.source_size", "b.target", (F.col("a.copies") * F.col("a.size")).alias("taken"), "a.copies"
    )
