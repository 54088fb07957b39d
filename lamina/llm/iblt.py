"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A text is cut into paragraphs at sentence ends, separators and line breaks; the
k-th equal paragraph counts as another one.  A sketch adds each 64-bit digest to
one cell in each of three rows: a count, a sum of digests, a sum of check words.
Subtracting two sketches leaves what differs; peeling cells of count one
recovers those digests.  Where peeling stops early, larger sketches are tried.

Defined cases: null and empty texts have no paragraphs and are fully alike;
equal doc_ids follow one another by text, a null doc_id comes last; a single
document is its own next one; very long texts are compared by themselves;
columns other than id and text are not looked at; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cells of a fingerprint; larger sketches have four times as many each time.
CELLS = 48
#: Characters of text compared at a time.
SLICE = 2_000_000
_PARAGRAPH = re.compile(r"[^.!?|\n]+[.!?|]*")
_MIX = np.uint64(0x9E3779B97F4A7C15)
_LOW = np.uint64(0xFFFFFFFF)  # check words have 32 bits
_CELL = np.dtype([("n", "<u4"), ("k", "<u8"), ("c", "<u4")])


def digests(text: str) -> np.ndarray:
    """A 64-bit digest for each paragraph of ``text``; the k-th equal one is seeded by k."""
    parts = [p for p in map(str.strip, _PARAGRAPH.findall(text)) if p]
    if len(set(parts)) == len(parts):
        found = [xxhash.xxh64_intdigest(p) for p in parts]
    else:
        seen: dict[str, int] = {}
        found = []
        for p in parts:
            k = seen.get(p, 0)
            seen[p] = k + 1
            found.append(xxhash.xxh64_intdigest(p, k))
    return np.array(found, np.uint64)


def _mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    x = (keys + np.uint64((seed * 2 + 1) * 0xD1B54A32D192ED03 & 0xFFFFFFFFFFFFFFFF)) * _MIX
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ x >> np.uint64(32)


class Sketches:
    """Sketches of many sets side by side, all of ``cells`` cells."""

    def __init__(self, cells: int, seed: int, n: int) -> None:
        self.cells, self.seed = cells, seed
        self.count = np.zeros(n * cells, np.int64)
        self.keys = np.zeros(n * cells, np.uint64)
        self.check = np.zeros(n * cells, np.uint64)

    def _add(self, owner: np.ndarray, keys: np.ndarray, sign: np.ndarray) -> None:
        row = self.cells // 3
        times = sign.astype(np.uint64)  # -1 wraps
        word = _mixed(keys, 99) & _LOW
        for j in range(3):
            at = owner * self.cells + j * row + (_mixed(keys, 3 * self.seed + j) % np.uint64(row)).astype(np.int64)
            np.add.at(self.count, at, sign)
            np.add.at(self.keys, at, keys * times)
            np.add.at(self.check, at, word * times)

    @classmethod
    def of(cls, sets: list[np.ndarray], cells: int, seed: int) -> Sketches:
        s = cls(cells, seed, len(sets))
        lens = [len(x) for x in sets]
        keys = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        s._add(np.repeat(np.arange(len(sets)), lens), keys, np.ones(len(keys), np.int64))
        return s

    def minus(self, a: np.ndarray, b: np.ndarray) -> Sketches:
        """Sketches of set ``a[i]`` less set ``b[i]``."""
        s = Sketches(self.cells, self.seed, len(a))
        for name in ("count", "keys", "check"):
            mine = getattr(self, name).reshape(-1, self.cells)
            setattr(s, name, (mine[a] - mine[b]).reshape(-1))
        return s

    def peel(self) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
        """Whether each sketch came out empty, the digests found in each, and (owner, digest, sign) as found."""
        n = len(self.count) // self.cells
        found = np.zeros(n, np.int64)
        out = []
        look = np.flatnonzero(np.abs(self.count) == 1)
        while len(look):
            sign = self.count[look]
            keys = self.keys[look] * sign.astype(np.uint64)
            pure = (_mixed(keys, 99) * sign.astype(np.uint64) ^ self.check[look]) & _LOW == 0
            owner, keys, sign = look[pure] // self.cells, keys[pure], sign[pure]
            if not len(owner):
                break
            _, first = np.unique(np.stack([owner.astype(np.uint64), keys]), axis=1, return_index=True)
            owner, keys, sign = owner[first], keys[first], sign[first]
            self._add(owner, keys, -sign)
            np.add.at(found, owner, 1)
            out.append((owner, keys, sign))
            look = np.flatnonzero(np.abs(self.count) == 1)
        left = (self.count != 0) | (self.keys != 0) | (self.check & _LOW != 0)
        return ~left.reshape(n, self.cells).any(axis=1), found, out

    def strings(self, sizes: list[int]) -> list[str]:
        """A printable form of each sketch: the set's size and its cells."""
        cells = np.zeros(len(self.count), _CELL)
        cells["n"], cells["k"], cells["c"] = self.count.astype(np.uint32), self.keys, self.check & _LOW
        return [f"{n:x}:{base64.b64encode(row.tobytes()).decode()}" for n, row in zip(sizes, cells.reshape(-1, self.cells), strict=True)]


def read(names: list[str]) -> tuple[np.ndarray, Sketches]:
    """The sizes and sketches that printed fingerprints hold."""
    parts = [n.split(":", 1) for n in names]
    cells = np.frombuffer(b"".join(base64.b64decode(body) for _, body in parts), _CELL)
    s = Sketches(len(cells) // max(len(names), 1), 0, 0)
    s.count, s.keys, s.check = cells["n"].astype(np.int32).astype(np.int64), cells["k"].astype(np.uint64), cells["c"].astype(np.uint64)
    return np.array([int(n, 16) for n, _ in parts], np.int64), s


def compared(first: Column, second: Column) -> Column:
    """Likeness of two printed fingerprints from their difference alone; null where they differ in too many paragraphs to peel."""

    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        if not len(a):
            return pd.Series([], dtype="float64")
        sizes, both = read([*a, *b])
        n = len(a)
        ok, found, _ = both.minus(np.arange(n), np.arange(n, 2 * n)).peel()
        total = sizes[:n] + sizes[n:]
        return pd.Series(np.where(ok, np.where(total > 0, (total - found) / np.maximum(total + found, 1), 1.0), np.nan)).astype("Float64").mask(~ok)

    return F.pandas_udf(run, "double")(first, second)


def likeness(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray, first: Sketches | None = None) -> np.ndarray:
    """Jaccard likeness of sets ``a[i]`` and ``b[i]`` from peeled differences, retrying larger where peeling fails."""
    sizes = np.array([len(x) for x in sets])
    out = np.ones(len(a))
    todo = np.flatnonzero(sizes[a] + sizes[b] > 0)
    cells, seed = CELLS, 0
    while len(todo):
        kept: list[np.ndarray] = []
        step = max(1, 1_000_000 // cells)
        for at in range(0, len(todo), step):
            part = todo[at : at + step]
            if first is not None and seed == 0:
                diff = first.minus(a[part], b[part])
            else:
                used, where = np.unique(np.concatenate([a[part], b[part]]), return_inverse=True)
                diff = Sketches.of([sets[k] for k in used.tolist()], cells, seed).minus(where[: len(part)], where[len(part) :])
            ok, n, _ = diff.peel()
            good = part[ok]
            total = sizes[a[good]] + sizes[b[good]]
            out[good] = (total - n[ok]) / np.maximum(total + n[ok], 1)
            kept.append(part[~ok])
        todo = np.concatenate(kept)
        cells, seed = cells * 4, seed + 1
    return np.clip(out, 0.0, 1.0)


def _compared(rows: list[tuple[int | None, str]], after: str) -> pa.RecordBatch:
    """Results for ``rows``, of which each has the next one as its next document and the last has ``after``."""
    texts = [t for _, t in rows] + [after]
    edited = []
    for k in range(len(rows)):
        half = len(texts[k]) // 2
        edited.append(texts[k][: len(texts[k]) - half] + texts[k + 1][:half])
    sets = [digests(t) for t in texts] + [digests(t) for t in edited]
    n = len(rows)
    base = Sketches.of(sets, CELLS, 0)
    names = base.strings([len(s) for s in sets])
    me = np.arange(n)
    near = likeness(sets, np.concatenate([me, me]), np.concatenate([me + n + 1, me + 1]), base)
    columns = [
        pa.array([d for d, _ in rows], pa.int64()), pa.array([len(t) for t in texts[:n]], pa.int64()),
        pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited]), pa.array(names[:n]), pa.array(names[n + 1 :]), pa.array(near[:n]), pa.array(near[n:]),
    ]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compares neighbours of one range of ids in descending order; rows marked as border come last and give only the next text."""
    held: list[tuple[int | None, str]] = []
    chars, after = 0, None
    for batch in batches:
        for doc, text, border in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            text = text or ""
            if border:
                after = text if after is None else after
                continue
            if chars > SLICE:
                yield _compared(held, text)
                held, chars = [], 0
            held.append((doc, text))
            chars += len(text)
    if held:
        yield _compared(held, held[0][1] if after is None else after)


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text, and their likeness.

    Ids are cut into ranges at approximate quantiles.  Each range's first
    document is also dealt to the range before it, so every range is compared
    on its own after a single shuffle of the texts.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).alias("text"))
    n = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = docs.select("doc_id").approxQuantile("doc_id", [k / n for k in range(1, n)], 0.1 / n) if n > 1 else []
    cuts = sorted({int(c) for c in cuts})
    above = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]).cast("array<bigint>"), lambda c: c > F.col("doc_id")))
    ranged = docs.withColumn("range", F.when(F.col("doc_id").isNull(), len(cuts)).otherwise(above).cast("int"))
    heads = sorted((r["range"], r["head"]) for r in ranged.groupBy("range").agg(F.max("doc_id").alias("head")).collect())
    before = [(r, head, heads[k - 1][0]) for k, (r, head) in enumerate(heads)]
    if not before:
        return spark.createDataFrame([], "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    border = spark.createDataFrame(before, "range int, head long, target int")  # a row for each range
    dealt = ranged.join(F.broadcast(border), "range").select(
        "doc_id", "text",
        F.explode(F.when(F.col("doc_id").eqNullSafe(F.col("head")), F.array(F.struct(F.col("range").alias("to"), F.lit(False).alias("border")), F.struct(F.col("target").alias("to"), F.lit(True).alias("border"))))
                  .otherwise(F.array(F.struct(F.col("range").alias("to"), F.lit(False).alias("border"))))).alias("d"),
    )
    rows = dealt.select("doc_id", "text", "d.border", "d.to").repartitionById(len(cuts) + 1, "to")
    rows = rows.sortWithinPartitions("border", F.col("doc_id").desc_nulls_last(), F.col("text").asc_nulls_first()).select("doc_id", "text", "border")
    return rows.mapInArrow(_run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
