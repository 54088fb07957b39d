"""Ranked lexical search over a bit-sliced impact index.

Documents become the counts of the terms that the queries ask for.  Blocks of
documents hold, for each term, bitmaps of the bits of its impacts (its weight
times its saturated count in the document).  A query adds the bitmaps of its
terms for all documents of a block at once: a carry-save adder keeps a bitmap
of sums and one of carries per bit, and one ripple pass at the end resolves
them.  The k highest scores come from walking down the slices of the sum, most
significant first.  Blocks' winners meet in one ranked window.

A bitmap holds only the 64-bit words in which its term occurs, so rare terms
stay small.  Queries are taken in blocks of a bounded number of terms; each
block of queries is a pass over all documents.

Defined cases: null texts have no terms and are never found; a null document
id sorts after the others; repeated rows of documents are ranked one by one;
each row of the queries is ranked, one without terms or matches gives no row,
and repeated query rows give their results as often; equal scores go by
ascending document id; an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lamina.llm.common import lean, staged
from lamina.llm.license_rules import folded

#: Distinct terms of one block of queries, which every task holds.
QUERY_TERMS = 100_000
#: Documents and postings of a block; a posting takes at most 8 bytes a slice.
BLOCK_DOCS = 1 << 15
BLOCK_POSTINGS = 1 << 20

_RESULT = "query int, doc_id long, score long"
_ONE = np.uint64(1)


def _query_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = [Counter(folded(t)) for t in batch.column(1).to_pylist()]
        rows = [batch.column(0), pa.array([[t.decode("utf-8", "surrogatepass") for t in c] for c in counts], pa.list_(pa.string())), pa.array([list(c.values()) for c in counts], pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(rows, ["item_id", "terms", "repeats"])


def term_counts(docs: DataFrame, terms: dict[bytes, int], id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """For each document with a term: how many terms it has, and the counts of those in ``terms`` by number."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        known = shared.value
        for batch in batches:
            ids, sizes, which, counts = [], [], [], []
            for doc, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = folded(body.as_py())
                if words:
                    found = Counter(filter(known.__contains__, words))
                    ids.append(doc)
                    sizes.append(len(words))
                    which.append([known[t] for t in found])
                    counts.append(list(found.values()))
            columns = [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(which, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "terms", "counts"])

    return docs.select(F.col(id_column).cast("long"), F.col(text)).mapInArrow(run, "doc_id long, n long, terms array<int>, counts array<long>")


class Slices:
    """The impacts of one term in a block: bitmaps of their bits over the 64-bit words ``at``."""

    def __init__(self, docs: np.ndarray, impacts: np.ndarray) -> None:
        words, place = docs >> 6, np.uint64(1) << (docs & 63).astype(np.uint64)
        starts = np.flatnonzero(np.diff(words, prepend=-1))
        self.at = words[starts]
        bits = np.arange(int(impacts.max()).bit_length(), dtype=np.uint64)[:, None]
        set_ = (impacts.astype(np.uint64)[None, :] >> bits) & _ONE
        self.bits = np.bitwise_or.reduceat(set_ * place[None, :], starts, axis=1)


def block_index(docs: np.ndarray, terms: np.ndarray, impacts: np.ndarray) -> dict[int, Slices]:
    """The bit-sliced index of a block from its postings; ``docs`` are places in the block."""
    keep = impacts > 0
    order = np.lexsort((docs[keep], terms[keep]))
    docs, terms, impacts = docs[keep][order], terms[keep][order], impacts[keep][order]
    cuts = np.flatnonzero(np.diff(terms)) + 1
    parts = zip(np.split(docs, cuts), np.split(terms, cuts), np.split(impacts, cuts), strict=True)
    return {int(t[0]): Slices(d, i) for d, t, i in parts if len(t)}


def added(parts: list[tuple[Slices, int]], n_words: int) -> np.ndarray:
    """Bitmaps of the bits of the sums of ``parts``, each as often as its number says.

    A repeated term is added once for each bit of its number, shifted up by it.
    """
    # a bit for the highest sum of any document, and one for the last carry
    most = sum(((1 << len(s.bits)) - 1) * times for s, times in parts)
    height = most.bit_length() + 1
    total = np.zeros((height, n_words), np.uint64)
    carry = np.zeros((height, n_words), np.uint64)
    for s, times in parts:
        for shift in range(times.bit_length()):
            if not times >> shift & 1:
                continue
            v = np.zeros((height, len(s.at)), np.uint64)
            v[shift : shift + len(s.bits)] = s.bits
            a, c = total[:, s.at], carry[:, s.at]
            either = a ^ v
            total[:, s.at] = either ^ c
            moved = (a & v) | (c & either)
            carry[1:, s.at] = moved[:-1]
            carry[0, s.at] = 0
    over = np.zeros(n_words, np.uint64)
    for b in range(height):
        a, c = total[b], carry[b]
        either = a ^ c
        total[b], over = either ^ over, (a & c) | (over & either)
    return total


def _places(bitmap: np.ndarray) -> np.ndarray:
    """Places of the set bits, ascending."""
    words = np.flatnonzero(bitmap)
    bits = np.unpackbits(bitmap[words].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    row, bit = np.nonzero(bits)
    return words[row] * 64 + bit


def highest(total: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and sums of the ``k`` highest sums above 0, equal ones by place.

    ``sure`` holds documents that are above all others left, ``open_`` those
    that agree with the k-th highest in all slices so far.
    """
    count = lambda x: int(np.bitwise_count(x).sum())
    open_ = np.bitwise_or.reduce(total, axis=0)
    sure = np.zeros_like(open_)
    have = 0
    if count(open_) > k:
        for s in total[::-1]:
            up = open_ & s
            n = count(up)
            if have + n > k:
                open_ = up
            else:
                sure, open_, have = sure | up, open_ & ~s, have + n
                if have == k:
                    open_ = np.zeros_like(open_)
                    break
    at = np.concatenate([_places(sure), _places(open_)[: k - have]])
    bits = (total[:, at >> 6] >> (at & 63).astype(np.uint64)) & _ONE
    sums = (bits.astype(np.int64) << np.arange(len(total), dtype=np.int64)[:, None]).sum(axis=0)
    return at, sums


def _impacts(counts: np.ndarray, sizes: np.ndarray, weights: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """Weight times saturated count, in whole numbers as the contract of scores says."""
    m = 75 + (25 * sizes * n_docs) // n_terms
    return weights * ((1_000_000_000 * counts) // (1000 * counts + 12 * m))


def _searched(counted: DataFrame, queries: list[tuple[list[int], list[int]]], weights: np.ndarray, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """The ``k`` best documents of each block for each query."""
    shared = counted.sparkSession.sparkContext.broadcast((queries, weights))

    def search(block: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        asked, weight = shared.value
        ids, known, sizes, lens, terms, counts = (np.concatenate(x) for x in zip(*block, strict=True))
        order = np.lexsort((ids, ~known))  # places ascend with ids, null ones last
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        doc = np.repeat(np.arange(len(ids)), lens)
        index = block_index(place[doc], terms, _impacts(counts, sizes[doc], weight[terms], n_docs, n_terms))
        out: list[list] = [[], [], []]
        for q, (which, times) in enumerate(asked):
            parts = [(index[t], n) for t, n in zip(which, times, strict=True) if t in index]
            if parts:
                at, sums = highest(added(parts, (len(ids) + 63) // 64), k)
                rows = order[at]
                out[0] += [q] * len(at)
                out[1] += [i if ok else None for i, ok in zip(ids[rows].tolist(), known[rows].tolist(), strict=True)]
                out[2] += sums.tolist()
        return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64())], ["query", "doc_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        block: list[tuple[np.ndarray, ...]] = []
        docs = postings = 0
        for whole in batches:
            for begin in range(0, whole.num_rows, 1000):
                batch = whole.slice(begin, 1000)
                ids = batch.column(0)
                lens = np.diff(batch.column(2).offsets.to_numpy())
                terms, counts = batch.column(2).flatten().to_numpy(), batch.column(3).flatten().to_numpy()
                if block and (docs + len(ids) > BLOCK_DOCS or postings + len(terms) > BLOCK_POSTINGS):
                    yield search(block)
                    block, docs, postings = [], 0, 0
                block.append((ids.fill_null(0).to_numpy(), ids.is_valid().to_numpy(zero_copy_only=False), batch.column(1).to_numpy(), lens, terms, counts))
                docs, postings = docs + len(ids), postings + len(terms)
        if block:
            yield search(block)

    return counted.select("doc_id", "n", "terms", "counts").mapInArrow(run, _RESULT)


def rank(docs: DataFrame, queries: DataFrame, k: int = 20, id_column: str = "doc_id", query_id: str = "item_id", text: str = "text") -> DataFrame:
    """The ``k`` highest-scoring documents of each query: item_id, rank, doc_id, score."""
    spark: SparkSession = docs.sparkSession
    asked = staged(queries.select(F.col(query_id).alias("item_id"), F.col(text)).mapInArrow(_query_rows, f"item_id {queries.schema[query_id].dataType.simpleString()}, terms array<string>, repeats array<long>"), "queries")
    n_terms = asked.agg(F.sum(F.size("terms"))).first()[0] or 0
    n_blocks = max(1, -(-2 * n_terms // QUERY_TERMS))
    item_type = asked.schema["item_id"].dataType.simpleString()
    result = spark.createDataFrame([], f"item_id {item_type}, rank int, doc_id long, score long")
    blocks = asked.withColumn("_block", F.pmod(F.xxhash64("item_id", "terms"), F.lit(n_blocks)))
    for b in range(n_blocks):
        rows = blocks.where(F.col("_block") == b).collect()  # a block of queries, bounded by QUERY_TERMS
        numbers: dict[bytes, int] = {}
        parts = [([numbers.setdefault(t.encode("utf-8", "surrogatepass"), len(numbers)) for t in r["terms"]], list(r["repeats"])) for r in rows]
        if not numbers:
            continue
        counted = staged(term_counts(docs, numbers, id_column, text), "counts")
        n_docs, length = counted.agg(F.count("n"), F.sum("n")).first()
        if not n_docs:
            continue
        weight = F.floor(1000 * F.log((F.lit(2.0) * n_docs + 2) / (2 * F.col("count") + 1))).cast("long")
        weights = np.zeros(len(numbers), np.int64)
        for r in counted.select(F.explode("terms").alias("t")).groupBy("t").count().select("t", weight.alias("w")).collect():  # a row for each term of the block
            weights[r["t"]] = r["w"]
        best = _searched(counted, parts, weights, n_docs, length, k)
        w = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
        best = staged(best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k), "ranked")
        names = spark.createDataFrame([(q, r["item_id"]) for q, r in enumerate(rows)], f"query int, item_id {item_type}")
        result = result.unionByName(best.join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score"))
    return result
