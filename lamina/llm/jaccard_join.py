"""Exact Jaccard join of documents' word shingles in metric regions around pivots.

Jaccard distance d = 1 - J is a metric; two sets link when d <= r = 1 - s.

1. Texts with equal shingle sets form a class, named by a digest of the set.
2. Which pivots can be near a set?  The range of hash values is cut into K
   blocks; a set's signatures are digests of its hashes in each block.  Sets
   within r differ in at most H hashes, K = H + t, so they agree in t blocks or
   more.  A set with fewer shared signatures has no partner and needs no region,
   and others leave the pivots of their first t - 1, in one order for all.
   H depends on size, so sizes form classes: a set signs for its own class and,
   if a partner can be of the next one, for that too.
3. Pivots.  The first set of each group that shares a signature is a pivot; a
   set knows the pivots of its signatures, and two sets within r know one
   pivot in common.  Each set lies in the Voronoi cell of the pivot that it
   shares most signatures with, and its exact distance to it is taken.  Sets
   within r of a pivot are linked to it, so a ball of near copies is connected
   with one comparison for each set.
4. Windows.  A region (the sets that know a pivot) whose sets all lie in the
   cell of one other pivot is left to that one.  A region still holding more
   than one connected group takes the exact distance of all its sets, those of other
   cells too, and is cut into rings of width r.  By the triangle inequality a
   partner lies in the same or a neighbouring ring, so the sets of the next
   ring are replicated and rings are joined on their own.
5. A ring of over ``REGION_SETS`` sets recurses: pivots are drawn from it and
   every set is compared with them, in salted chunks; sets alike to one are
   linked with it.  What remains meets in blocks of sets that share a hash,
   those in the fewest pivots first; blocks still too large are cut by sizes,
   then into salts that meet two by two.
6. One task joins the rings of a pivot, or one ring where a pivot has over
   ``REGION_SETS`` sets: each set is compared with those that share one of its
   locally rarest hashes and are not connected with it already, so no group
   emits all its pairs.
7. Links join classes into components by large and small stars.

Nothing is capped or dropped.  Only a large block of sets that no pivot is
alike to grows with its square, spread over tasks of ``REGION_SETS`` sets.

Defined cases: null, empty and blank texts have no shingles and stay alone;
texts shorter than a shingle give one of the whole sequence; repeated rows are
one class; rows that share an id but not their text are classes of their own;
a null doc_id stays without a component and links nothing; very long texts give
signatures in proportion; equal signature counts choose the smaller pivot;
columns other than id and text are not looked at; an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina.llm.common import lean, staged
from lamina.operators.connectivity import spanning_stars
from lamina.sources.staging import discard

#: Sets of a region that one task joins; sets of larger regions are first compared with so many pivots.
REGION_SETS = 5000
SPLIT_PIVOTS = 12
#: Rounds of dropping sets that share too few signatures.
DROPS = 2
#: Documents that are broadcast by id to fetch their texts; more are joined by a shuffle.
BROADCAST_ROWS = 500_000
#: Words remembered by one worker with their hashes; sets remembered by one task to sign each once.
REMEMBERED = 200_000
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_SETS = "doc_id long, n_shingles long, node long, need array<int>, signatures array<long>"


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def shingle_set(text: str | None, width: int, known: dict) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text."""
    tokens = (text or "").encode("utf-8", "replace").lower().split()  # of bytes: A-Z and the six ASCII spaces
    h = np.array([known[w] for w in tokens], np.uint64)
    if not len(h):
        return h
    n = max(1, len(h) - width + 1)
    acc = np.full(n, len(h) if len(h) < width else width, np.uint64)
    for k in range(min(width, len(h))):
        acc = _mix(acc * _A + h[k : k + n] * _B)
    return np.unique(acc)


def node_of(h: np.ndarray) -> int:
    """The name of a set: a signed 64-bit digest."""
    return xxhash.xxh3_64_intdigest(h.tobytes()) - (1 << 63)


def node_column(text: Column, width: int) -> Column:
    """The name of each text's set."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = _Words()
        for batch in batches:
            yield pd.Series([node_of(shingle_set(t, width, known)) for t in batch], dtype="int64")

    return F.pandas_udf(run, "long")(text)


class Signer:
    """Block signatures of sets, see point 2; ``percent`` is the least likeness."""

    def __init__(self, percent: int) -> None:
        self.percent = percent
        self.lows = [1]
        self.schemes: dict[int, tuple[int, int, np.ndarray]] = {}

    def class_of(self, n: int) -> int:
        """Sizes of a class span the square of the least likeness, so partners are in the same class or the next."""
        while self.lows[-1] <= n:
            self.lows.append(self.lows[-1] * 10_000 // self.percent**2 + 1)
        return bisect_right(self.lows, n) - 1

    def scheme(self, k: int) -> tuple[int, int, np.ndarray]:
        """Blocks, the number that partners agree in at least, and lower bounds of the blocks, for pairs whose larger set is of class ``k``."""
        if k not in self.schemes:
            self.class_of(self.lows[-1] if len(self.lows) <= k + 1 else 1)
            most = (100 - self.percent) * 2 * (self.lows[k + 1] - 1) // (100 + self.percent)
            agree = 2 + most // 6
            n = most + agree
            bounds = np.array([-(-b * (1 << 64) // n) for b in range(1, n)], np.uint64)
            self.schemes[k] = n, agree, bounds
        return self.schemes[k]

    def sign(self, h: np.ndarray) -> tuple[list[int], np.ndarray]:
        """Least shared signatures with a partner (of even, of odd class) and the signatures; their low bit is the class's.

        A block without hashes gives none unless a set has so many that all
        blocks it agrees in could be empty.
        """
        n, c = len(h), self.class_of(len(h))
        need, found = [0, 0], []
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_mix(h * _B), out=sums[1:])
        for k in (c, c + 1):
            if k > c and n * 100 // self.percent < self.lows[c + 1]:
                break
            blocks, agree, bounds = self.scheme(k)
            at = np.concatenate([[0], np.searchsorted(h, bounds), [n]])
            inside = sums[at[1:]] - sums[at[:-1]]
            name = _mix(_mix(inside + np.uint64((k + 1) * int(_A) & 0xFFFFFFFFFFFFFFFF)) + np.arange(blocks, dtype=np.uint64) * _B)
            filled = at[1:] > at[:-1]
            empty = blocks - int(filled.sum())
            if empty < agree:
                name = name[filled]
            need[k % 2] = max(1, agree - empty)
            found.append(name & ~np.uint64(1) | np.uint64(k % 2))
        return need, np.concatenate(found)


def shingle_sets(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(doc_id, n_shingles, node, need, signatures) of (doc_id, text); a task signs a set that it has seen before only once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        known, signer, seen = _Words(), Signer(percent), set()
        none = [0, 0], np.zeros(0, np.uint64)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                sizes, nodes, needs, names = [], [], [], []
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    h = shingle_set(text, width, known)
                    node = node_of(h)
                    need, name = none if doc is None or not len(h) or node in seen else signer.sign(h)
                    if len(name):
                        if len(seen) >= REMEMBERED:
                            seen.clear()
                        seen.add(node)
                    sizes.append(len(h))
                    nodes.append(node)
                    needs += need
                    names.append(name.astype(np.int64))
                offsets = pa.array(np.cumsum([0, *map(len, names)]).astype(np.int32))
                pair = pa.ListArray.from_arrays(pa.array(np.arange(len(nodes) + 1, dtype=np.int32) * 2), pa.array(needs, pa.int32()))
                arrays = [part.column(0), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), pair, pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(names)))]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_shingles", "node", "need", "signatures"])

    return docs.mapInArrow(run, _SETS)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, pivot, odd, signature) of signatures that two nodes or more share, from rows in order.

    The first and last signature of a partition may go on in another one: their
    rows are kept in any case and carry the signature; other rows carry null.
    """

    def rows(sig: np.ndarray, node: np.ndarray, border: bool) -> Iterator[pa.RecordBatch]:
        fresh = np.append(True, (sig[1:] != sig[:-1]) | (node[1:] != node[:-1]))
        sig, node = sig[fresh], node[fresh]
        starts = np.flatnonzero(np.append(True, sig[1:] != sig[:-1]))
        lens = np.diff(np.append(starts, len(sig)))
        edge = np.zeros(len(starts), bool)
        edge[0] = border
        each = np.repeat((lens > 1) | edge, lens)
        if each.any():
            sig, pivots, edge = sig[each], np.repeat(node[starts], lens)[each], np.repeat(edge, lens)[each]
            columns = [pa.array(node[each]), pa.array(pivots), pa.array((sig & 1).astype(bool)), pa.array(sig, mask=~edge)]
            yield pa.RecordBatch.from_arrays(columns, ["node", "pivot", "odd", "signature"])

    open_sig, chunks, first = None, [], True
    for batch in batches:
        sig, node = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(2))
        if not len(sig):
            continue
        starts = np.flatnonzero(np.append(True, sig[1:] != sig[:-1]))
        if open_sig is not None:
            if sig[0] == open_sig:
                end = starts[1] if len(starts) > 1 else len(sig)
                chunks.append(node[:end])
                if len(starts) == 1:
                    continue
                sig, node, starts = sig[end:], node[end:], starts[1:] - end
            nodes = np.concatenate(chunks)
            yield from rows(np.full(len(nodes), open_sig), nodes, first)
            first = False
        cut = starts[-1]
        if cut:
            yield from rows(sig[:cut], node[:cut], first)
            first = False
        open_sig, chunks = sig[cut], [node[cut:]]
    if open_sig is not None:
        nodes = np.concatenate(chunks)
        yield from rows(np.full(len(nodes), open_sig), nodes, True)


def known_pivots(sets: DataFrame) -> DataFrame:
    """(node, pivot, odd, shared): how many signatures a set shares with groups of which ``pivot`` is the first set.

    Rows are dealt by ranges of (signature, node), so that a signature of very
    many sets is spread over tasks; what ranges know of their border signatures
    is two rows for each.
    """
    n = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = sets.select(F.explode("signatures").alias("signature"), "node").repartitionByRange(n, "signature", "node").sortWithinPartitions("signature", "node")
    found = rows.mapInArrow(_runs, "node long, pivot long, odd boolean, signature long")
    found = staged(found.groupBy("node", "pivot", "odd", "signature").agg(F.count("*").alias("shared")), "pivots")
    border = found.where("signature IS NOT NULL").groupBy("signature").agg(F.min("pivot").alias("first"), F.count_distinct("node").alias("sets"))
    found = found.join(F.broadcast(border), "signature", "left").where("signature IS NULL OR sets > 1")
    return found.groupBy("node", F.coalesce("first", "pivot").alias("pivot"), "odd").agg(F.sum("shared").alias("shared"))


def likely(pivots: DataFrame, needs: DataFrame) -> DataFrame:
    """(node, pivot, shared) of sets that share enough signatures to have a partner, in regions of two or more; ``needs`` has (node, need).

    Partners agree in ``need`` signatures at least.  So each set leaves the
    regions of its first pivots, small regions first, as long as it shares fewer
    signatures with all of them: in one order for all sets, the last pivot that
    two partners have in common is left by neither.
    """
    need = F.when(F.col("odd"), F.col("need")[1]).otherwise(F.col("need")[0])
    pivots = staged(pivots.join(needs, "node").select("node", "pivot", "odd", "shared", need.alias("need")), "known")
    for k in range(DROPS + 1):
        if k < DROPS:
            kept = pivots.join(pivots.groupBy("node", "odd", "need").agg(F.sum("shared").alias("all")).where("all >= need").select("node", "odd"), ["node", "odd"], "left_semi")
        else:
            sizes = pivots.groupBy("pivot", "odd").agg(F.count("*").alias("in"))
            upto = Window.partitionBy("node", "odd").orderBy("in", "pivot").rowsBetween(Window.unboundedPreceding, 0)
            kept = pivots.join(sizes, ["pivot", "odd"]).withColumn("upto", F.sum("shared").over(upto)).where("upto >= need").drop("in", "upto")
        filled = kept.groupBy("pivot").agg(F.max(F.expr("node <> pivot")).alias("other")).where("other").select("pivot")
        was, pivots = pivots, staged(kept.join(filled, "pivot", "left_semi"), "known")
        discard(was)
    return pivots.groupBy("node", "pivot").agg(F.sum("shared").alias("shared"))


def with_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (doc_id, node, ...) with the texts of the rows that have the id; where ids repeat, of all of them."""
    few = wanted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return docs.join(F.broadcast(wanted) if few else wanted, "doc_id")


def distances(docs: DataFrame, pairs: DataFrame, classes: DataFrame, width: int) -> DataFrame:
    """(node, pivot, same, total) of pairs (node, pivot): sizes of the intersection and the union of their sets.

    The sets of a pivot with many are dealt over salts, each with the pivot's text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Words()
        last, around = None, np.zeros(0, np.uint64)
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                out = []
                for node, pivot, text, other in zip(*(c.to_pylist() for c in batch.slice(at, 200).columns), strict=True):
                    if other != last:
                        last, around = other, shingle_set(other, width, known)
                        name = node_of(around)
                    h = shingle_set(text, width, known)
                    if name == pivot and node_of(h) == node:  # rows that share an id may have other texts
                        same = int(overlaps(h, np.array([len(h)]), around)[0])
                        out.append((node, pivot, same, len(h) + len(around) - same))
                columns = zip(*out, strict=True) if out else [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["node", "pivot", "same", "total"])

    pairs = staged(pairs.select("node", "pivot"), "pairs")
    salts = pairs.groupBy("pivot").agg(F.ceil(F.count("*") / 500).cast("int").alias("salts"))
    ids = classes.select("node", F.col("rep").alias("doc_id"))
    near = pairs.join(salts, "pivot").join(ids, "node").select("doc_id", "node", "pivot", F.pmod(F.xxhash64("node"), "salts").cast("int").alias("salt"))
    far = salts.join(ids.withColumnRenamed("node", "pivot"), "pivot").select("doc_id", "pivot", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    near = with_texts(docs, near).select("node", "pivot", "salt", "text")
    far = with_texts(docs, far).select("pivot", "salt", F.col("text").alias("other"))
    both = near.hint("merge").join(far, ["pivot", "salt"]).select("node", "pivot", "text", "other")
    found = staged(both.mapInArrow(run, "node long, pivot long, same long, total long").distinct(), "distances")
    discard(pairs)
    return found


def labelled(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """``nodes`` with ``label``, the root of their component."""
    return nodes.join(roots, "node", "left").select(*nodes.columns, F.coalesce("root", "node").alias("label"))


def mixed(regions: DataFrame, *keys: str) -> DataFrame:
    """Rows of regions, named by ``keys``, that hold more than one label."""
    several = regions.groupBy(*keys).agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a <> b").select(*keys)
    return regions.join(several, list(keys), "left_semi")


def own_pairs(pivots: DataFrame, cells: DataFrame) -> DataFrame:
    """(node, pivot) without the regions whose sets all lie in the cell of one other pivot: they meet in that one's region."""
    homed = pivots.select("node", "pivot").join(cells.withColumnRenamed("pivot", "home"), "node", "left").withColumn("home", F.coalesce("home", "node"))
    kept = homed.groupBy("pivot").agg(F.min("home").alias("a"), F.max("home").alias("b")).where("a <> b OR a = pivot").select("pivot")
    return pivots.select("node", "pivot").join(kept, "pivot", "left_semi")


def rings(known: DataFrame, percent: int) -> DataFrame:
    """(region, node, label, pivot, ring) of (pivot, node, label, same, total): rings around each pivot, one join distance wide, with the next ring's sets.

    Two sets within the join distance differ by no more in their distances to
    the pivot, so they are in one ring or in neighbouring ones.
    """
    ring = F.expr(f"((total - same) * 100) DIV (total * {max(100 - percent, 1)})").cast("int")
    rows = known.withColumn("ring", ring).withColumn("at", F.explode(F.when(F.col("ring") > 0, F.array("ring", F.col("ring") - 1)).otherwise(F.array("ring"))))
    return mixed(rows.select(F.concat_ws("/", "pivot", "at").alias("region"), "node", "label", "pivot", "ring"), "region")


def with_hashes(docs: DataFrame, width: int) -> DataFrame:
    """(region, rep, label, n, hashes) of (region, node, label, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Words()
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                sets = [shingle_set(t, width, known) for t in part.column(3).to_pylist()]
                own = pa.array([node_of(h) == node for h, node in zip(sets, part.column(1).to_pylist(), strict=True)], pa.bool_())
                arrays = [*part.columns[:3], pa.array([len(h) for h in sets], pa.int64()), pa.array([pack(h) for h in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, ["region", "rep", "label", "n", "hashes"]).filter(own)

    return docs.mapInArrow(run, "region string, rep long, label long, n long, hashes binary")


def pack(h: np.ndarray) -> bytes:
    return h.astype("<u8").tobytes()


def unpack(b: bytes) -> np.ndarray:
    return np.frombuffer(b, "<u8")


def overlaps(flat: np.ndarray, lens: np.ndarray, one: np.ndarray) -> np.ndarray:
    """How many hashes each set (``lens`` of ``flat`` in a row) shares with the sorted set ``one``."""
    at = np.searchsorted(one, flat)
    at[at == len(one)] = 0
    hit = np.concatenate([[0], np.cumsum(one[at] == flat)])
    ends = np.cumsum(lens)
    return hit[ends] - hit[ends - lens]


def join_sets(sets: list[np.ndarray], percent: int, known: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that connect all sets whose likeness reaches ``percent``: enough for their components, not one for every pair.

    Sets of one value in ``known`` are connected already.
    """
    size = np.array([len(x) for x in sets])
    owner = np.repeat(np.arange(len(sets)), size)
    values, at, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    # each set's locally rarest hashes, as many as must meet those of every set alike
    order = np.lexsort((at, count[at], owner))
    start = np.cumsum(size) - size
    rank = np.arange(len(owner)) - np.repeat(start, size)
    most = size - (percent * size + 99) // 100 + 1
    first = order[rank < most[owner]]
    first = first[count[at[first]] > 1]
    if not len(first):
        return []
    by_hash = first[np.argsort(at[first], kind="stable")]
    listed, list_owner = at[by_hash], owner[by_hash]
    begin = np.flatnonzero(np.append(True, listed[1:] != listed[:-1]))
    end = np.append(begin[1:], len(listed))
    list_of = dict(zip(listed[begin].tolist(), range(len(begin)), strict=True))
    lists: list[list[int]] = [[] for _ in sets]
    for k, h in zip(owner[first].tolist(), at[first].tolist(), strict=True):
        lists[k].append(list_of[h])
    label = np.arange(len(sets)) if known is None else np.unique(known, return_inverse=True)[1]
    links: list[tuple[int, int]] = []

    def mixed() -> np.ndarray:
        on = label[list_owner]
        return np.minimum.reduceat(on, begin) != np.maximum.reduceat(on, begin)

    open_lists = mixed()
    for x in range(len(sets)):
        mine = [k for k in lists[x] if open_lists[k]]
        if not mine:
            continue
        near = np.unique(np.concatenate([list_owner[begin[k] : end[k]] for k in mine]))
        near = near[(label[near] != label[x]) & (100 * np.minimum(size[near], size[x]) >= percent * np.maximum(size[near], size[x]))]
        if not len(near):
            continue
        both = overlaps(np.concatenate([sets[k] for k in near.tolist()]), size[near], sets[x])
        found = near[100 * both >= percent * (size[near] + size[x] - both)]
        if len(found):
            links += [(x, k) for k in found.tolist()]
            labels = np.append(label[found], label[x])
            label[np.isin(label, labels)] = labels.min()
            open_lists = mixed()
    return links


def stars(members: DataFrame, percent: int) -> DataFrame:
    """(region, rep, n, label, linked, keys, indexed) of members (region, rep, label, n, hashes) of large regions.

    ``linked`` are pivots of the region alike to the set and not connected with
    it before; sets of one ``label`` are connected, by such links or before.  ``keys`` are as
    many of the set's hashes, those in the fewest pivots first, as must meet
    those of every set alike; the smaller set of two alike meets the other with
    one of its first ``indexed``.
    """
    counts = members.groupBy("region").agg(F.count("*").alias("in"))
    sized = members.join(F.broadcast(counts), "region").withColumn("salts", F.ceil(2 * F.col("in") / REGION_SETS).cast("int"))
    some = sized.where(F.pmod(F.xxhash64("rep", "region"), F.ceil(F.col("in") / (4 * SPLIT_PIVOTS))) == 0)
    some = some.withColumn("k", F.row_number().over(Window.partitionBy("region").orderBy(F.xxhash64("rep"), "rep"))).where(F.col("k") <= SPLIT_PIVOTS)
    salt = F.pmod(F.xxhash64("rep", F.lit(1)), F.col("salts")).cast("int")
    rows = sized.select("region", salt.alias("salt"), "rep", "label", "hashes", F.lit(False).alias("pivot"))
    rows = rows.unionByName(some.select("region", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "rep", "label", "hashes", F.lit(True).alias("pivot")))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        around = pdf[pdf["pivot"]].drop_duplicates("rep").sort_values("rep", kind="stable")
        pivots, names = [unpack(b) for b in around["hashes"]], around["rep"].to_numpy()
        own = pdf[~pdf["pivot"]].drop_duplicates("rep")
        sets, reps = [unpack(b) for b in own["hashes"]], own["rep"].to_numpy()
        out = {c: [] for c in ("label", "linked", "keys", "indexed")}
        size = np.array([len(x) for x in sets], np.int64)

        def alike(pivot: np.ndarray, flat: np.ndarray, lens: np.ndarray) -> np.ndarray:
            both = overlaps(flat, lens, pivot)
            return 100 * both >= percent * (lens + len(pivot) - both)

        before = around["label"].to_numpy()
        label = before.copy()
        for pivot in pivots:
            same = np.isin(label, label[alike(pivot, np.concatenate(pivots), np.array([len(x) for x in pivots]))])
            label[same] = label[same].min()
        held, often = np.unique(np.concatenate(pivots), return_counts=True) if pivots else (np.zeros(1, np.uint64), np.zeros(1, np.int64))
        flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        hits = np.array([alike(pivot, flat, size) for pivot in pivots]).reshape(len(pivots), len(sets))
        group = dict(zip(before.tolist(), label.tolist(), strict=True))
        for x, (rep, one, known) in enumerate(zip(reps.tolist(), sets, own["label"].tolist(), strict=True)):
            near = np.flatnonzero(hits[:, x])
            out["label"].append(group.get(known, int(label[near[0]]) if len(near) else known))
            near = near[before[near] != known]
            if rep not in names:  # one pivot of each label; a pivot keeps all, which connect its label
                near = near[np.unique(label[near], return_index=True)[1]]
            out["linked"].append([int(v) for v in names[near] if v != rep])
            at = np.minimum(np.searchsorted(held, one), len(held) - 1)
            order = np.lexsort((one, np.where(held[at] == one, often[at], 0)))
            n = len(one)
            out["keys"].append(one[order[: n + percent * n // -100 + 1]].astype(np.int64))
            out["indexed"].append(n + 2 * percent * n // -(100 + percent) + 1)
        return pd.DataFrame({"region": own["region"].to_numpy(), "rep": reps, "n": size, **out})

    return rows.groupBy("region", "salt").applyInPandas(run, "region string, rep long, n long, label long, linked array<long>, keys array<long>, indexed int")


def blocks(starred: DataFrame, percent: int) -> DataFrame:
    """(region, of, rep, label): what remains to be compared, in blocks of sets that share a key; ``of`` is the large region.

    Sets of one label need no comparison, so a block of one label is left out,
    and of equal blocks all but one.  A block above ``REGION_SETS`` is cut into
    windows of sizes, and these into salts of which each two meet in one task.
    """
    s = percent / 100
    rows = starred.select("region", "rep", "n", "label", "indexed", F.posexplode("keys").alias("pos", "key"))
    rows = staged(rows.select("region", "key", "rep", "n", "label", "pos", (F.col("pos") < F.col("indexed")).alias("index")), "keys")
    small = F.when(F.col("index"), F.col("n"))
    kept = rows.groupBy("region", "key").agg(F.min(small).alias("low"), F.max(small).alias("high"), F.min("label").alias("a"), F.max("label").alias("b")).where("low IS NOT NULL AND a < b")
    # the smaller the other set, the more first keys must meet it: none is smaller than "low"
    reach = F.col("n") - F.ceil((percent * (F.col("n") + F.col("low"))) / (100 + percent) - 1e-9)
    rows = rows.join(kept.drop("a", "b"), ["region", "key"]).where(F.col("index") | ((F.col("n") >= F.col("low")) & (F.col("n") <= F.col("high") / s + 1) & (F.col("pos") <= reach)))
    rows = staged(rows.select("region", "key", "rep", "n", "label"), "blocks")
    digests = [F.bit_xor(F.xxhash64("rep")).alias("x"), F.bit_xor(F.xxhash64(F.lit("other"), "rep")).alias("y")]
    found = rows.groupBy("region", "key").agg(F.count("*").alias("in"), F.min("label").alias("a"), F.max("label").alias("b"), *digests).where("a < b")
    found = staged(found.groupBy("region", "in", "x", "y").agg(F.min("key").alias("key")).select("region", "key", "in"), "found")
    rows = rows.join(found, ["region", "key"]).withColumn("of", F.col("region")).withColumn("region", F.concat_ws("/", "region", "key"))
    done = rows.where(F.col("in") <= REGION_SETS).select("region", "of", "rep", "label")
    if found.where(F.col("in") > REGION_SETS).isEmpty():
        return done
    step = F.floor(F.log(F.col("n")) / -np.log(s)).cast("int")
    wide = rows.where(F.col("in") > REGION_SETS).withColumn("step", step).withColumn("w", F.explode(F.array(F.col("step"), F.col("step") + 1)))
    wide = wide.select(F.concat_ws("#", "region", "w").alias("region"), "of", "rep", "label", (F.col("step") == F.col("w")).alias("own"))
    wide = staged(wide, "windows")
    counts = wide.groupBy("region").agg(F.ceil(2 * F.count("*") / REGION_SETS).cast("int").alias("salts"), F.min("label").alias("a"), F.max("label").alias("b"), F.max("own").alias("owned"))
    counts = counts.where("a < b AND owned").drop("a", "b", "owned")  # without sets of its own step, a window's pairs meet in the one below
    wide = wide.join(counts, "region").withColumn("mine", F.pmod(F.xxhash64("rep", F.lit(2)), F.col("salts")).cast("int"))
    wide = wide.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).where("mine <> other OR salts < 2")
    name = F.concat_ws("@", "region", F.least("mine", "other"), F.greatest("mine", "other"))
    return done.unionByName(wide.select(name.alias("region"), "of", "rep", "label"))


def large_links(members: DataFrame, percent: int) -> DataFrame:
    """(a, b) with a < b: links inside large regions; ``members`` has (region, rep, label, n, hashes)."""
    members = staged(members, "large")
    starred = staged(stars(members, percent), "stars")
    near = starred.select("rep", F.explode("linked").alias("pivot")).select(F.least("rep", "pivot").alias("a"), F.greatest("rep", "pivot").alias("b"))
    left = staged(blocks(starred, percent), "left")
    hashes = members.select(F.col("region").alias("of"), "rep", "hashes").dropDuplicates(["of", "rep"])
    return near.distinct().unionByName(region_links(left.join(hashes, ["of", "rep"]).drop("of"), percent))


def window_links(members: DataFrame, width: int, percent: int) -> DataFrame:
    """(a, b) with a < b: links of the sets around each pivot; ``members`` has (pivot, ring, node, label, text).

    One task takes the sets around a pivot once and joins each ring with the
    next one, so no set is sent to two rings, and texts are shorter than hashes.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        known = _Words()
        sets = [shingle_set(t, width, known) for t in pdf["text"]]
        own = [node_of(h) == node for h, node in zip(sets, pdf["node"].tolist(), strict=True)]  # rows that share an id may have other texts
        pdf = pdf.drop(columns="text").assign(place=np.arange(len(sets)))[own].drop_duplicates("node").sort_values("node", kind="stable")
        nodes, label, ring, place = (pdf[c].to_numpy() for c in ("node", "label", "ring", "place"))
        found = [np.zeros((0, 2), np.int64)]
        for at in sorted({max(r - k, 0) for r in ring.tolist() for k in (0, 1)}):
            some = np.flatnonzero((ring == at) | (ring == at + 1))
            if len(np.unique(label[some])) > 1:
                links = join_sets([sets[k] for k in place[some].tolist()], percent, label[some])
                found.append(nodes[some[np.array(links, np.int64).reshape(-1, 2)]])
        ends = np.sort(np.concatenate(found), axis=1)
        return pd.DataFrame({"a": ends[:, 0], "b": ends[:, 1]})

    return members.groupBy("pivot").applyInPandas(run, "a long, b long").distinct()


def region_links(members: DataFrame, percent: int) -> DataFrame:
    """(a, b) with a < b: links inside each region, joined by one task each; sets of one ``label``, if there, are connected already."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("rep").sort_values("rep", kind="stable")
        reps = pdf["rep"].to_numpy()
        found = join_sets([unpack(b) for b in pdf["hashes"]], percent, pdf["label"].to_numpy() if "label" in pdf else None) if len(reps) > 1 else []
        pairs = np.array(found, np.int64).reshape(-1, 2)
        ends = np.sort(reps[pairs], axis=1) if len(pairs) else np.zeros((0, 2), np.int64)
        return pd.DataFrame({"a": ends[:, 0], "b": ends[:, 1]})

    return members.groupBy("region").applyInPandas(run, "a long, b long").distinct()


def join(docs: DataFrame, id_column: str = "doc_id", text: str = "text", width: int = 3, percent: int = 90) -> DataFrame:
    """(doc_id, n_shingles, component_id): documents whose shingle sets are at least ``percent`` / 100 alike are linked."""
    return join_sets_of(docs, id_column, text, width, percent).drop("node", "label")


def join_sets_of(docs: DataFrame, id_column: str = "doc_id", text: str = "text", width: int = 3, percent: int = 90) -> DataFrame:
    """``join`` with ``node``, the name of each document's set, and ``label``, that of its component."""
    docs = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).alias("text"))
    sets = staged(shingle_sets(docs, width, percent), "sets")
    full = sets.where("n_shingles > 0 AND doc_id IS NOT NULL")
    need = F.array(*[F.max(F.col("need")[k]) for k in range(2)]).alias("need")
    classes = staged(full.groupBy("node").agg(F.min("doc_id").alias("rep"), need), "classes")
    pivots = staged(likely(known_pivots(sets), classes.select("node", "need")), "cells")
    lean = staged(sets.select("doc_id", "n_shingles", "node"), "lean")
    discard(sets)

    # cells: each set and the pivot that it shares most signatures with
    best = F.max(F.struct("shared", F.bitwise_not("pivot").alias("order"), "pivot"))
    cells = pivots.where("node <> pivot").groupBy("node").agg(best.alias("best")).select("node", "best.pivot")
    alike = f"100 * same >= {percent} * total"
    near = distances(docs, cells, classes, width)
    links = near.where(alike).select(F.col("node").alias("a"), F.col("pivot").alias("b"))
    roots = spanning_stars(links)

    # windows: regions that are not connected yet
    open_ = staged(mixed(labelled(own_pairs(pivots, cells), roots), "pivot"), "open")
    if not open_.isEmpty():
        others = open_.where("node <> pivot").join(near, ["node", "pivot"], "left_anti")
        near = near.unionByName(distances(docs, others, classes, width))
        links = roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(near.where(alike).select(F.col("node").alias("a"), F.col("pivot").alias("b")))
        roots = spanning_stars(links)
        own = open_.where("node = pivot").select("node", "pivot", F.lit(1).cast("long").alias("same"), F.lit(1).cast("long").alias("total"))
        around = open_.select("node", "pivot").join(near.unionByName(own), ["node", "pivot"])
        members = staged(rings(labelled(around, roots), percent), "rings")
        if not members.isEmpty():
            links = roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(ring_links(docs, members, classes, width, percent))
            roots = spanning_stars(links)
    named = labelled(classes.select("node", "rep"), roots)
    smallest = named.groupBy("label").agg(F.min("rep").alias("component_id"))
    named = named.join(smallest, "label").select("node", "component_id", "label")
    out = lean.join(named, "node", "left")
    alone = (F.col("n_shingles") == 0) | F.col("doc_id").isNull()
    return out.select("doc_id", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "node", "label")


def ring_links(docs: DataFrame, members: DataFrame, classes: DataFrame, width: int, percent: int) -> DataFrame:
    """(a, b): links inside rings (region, node, label, pivot, ring).

    The sets around a pivot, if no more than ``REGION_SETS``, are joined by one
    task; of others each ring is.
    """
    ids = classes.select("node", F.col("rep").alias("doc_id"))
    around = members.groupBy("pivot", "node").agg(F.min("ring").alias("ring"), F.min("label").alias("label"))
    wide = staged(around.groupBy("pivot").agg(F.count("*").alias("in")).where(F.col("in") > REGION_SETS).select("pivot"), "wide")
    near = with_texts(docs, around.join(wide, "pivot", "left_anti").join(ids, "node")).select("pivot", "ring", "node", "label", "text")
    links = window_links(near, width, percent)
    if wide.isEmpty():
        return links
    members = members.join(wide, "pivot", "left_semi").select("region", "node", "label")
    counts = members.groupBy("region").agg(F.count("*").alias("in"))
    large = counts.where(F.col("in") > REGION_SETS).drop("in")

    def fetched(part: DataFrame) -> DataFrame:
        return with_hashes(with_texts(docs, part.join(ids, "node")).select("region", "node", "label", "text"), width)

    links = links.unionByName(region_links(fetched(members.join(large, "region", "left_anti")), percent))
    if large.isEmpty():
        return links
    return links.unionByName(large_links(fetched(members.join(large, "region", "left_semi")), percent))
