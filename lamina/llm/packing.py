"""Best-fit packing by hierarchical residuals.

Every task packs its own pieces best-fit, longest first, and lets nearly full
bins go.  Bins with room left become items themselves; fewer tasks pack those
again, as a tree.  The tree's width follows the number of open bins, so no
task is given more than a bounded number of them.

Defined cases: a null text is empty and gives one piece that holds the end id;
very long texts are cut into pieces and encoded slice by slice; repeated rows
are packed each by itself; a null doc_id stays null; of bins with equal room
that fits, the last one opened is filled; other columns are not looked at; an
empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm.common import lean, staged
from lamina.llm.tokenizing import SLICE_ROWS, encoder_for

#: Items one task packs, about.
TASK_ITEMS = 50_000
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_BINS = "bin long, level int, filled long, members array<struct<doc_id:long,piece:int,start:long,length:long,ids_crc32:long,offset:long>>"


def token_pieces(docs: DataFrame, tokenizer_path: str, size: int = 4096, end_id: int = 1, id_column: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces of at most ``size`` ids of each document with its end id; only longer documents are cut.  ``with_ids`` adds the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        encoder = encoder_for(tokenizer_path)
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
        for batch in batches:
            for first in range(0, batch.num_rows, SLICE_ROWS):
                rows = batch.slice(first, SLICE_ROWS)
                out: list[tuple] = []
                for doc, ids in zip(rows.column(0).to_pylist(), encoder.encode_all(rows.column(1).to_pylist()), strict=True):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    for k, at in enumerate(range(0, len(ids), size)):
                        part = ids[at : at + size]
                        out.append((doc, k, at, len(part), zlib.crc32(part.tobytes()), *([part.tolist()] if with_ids else [])))
                columns = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=False)], names[: len(columns)])

    return docs.select(F.col(id_column).cast("long"), text).mapInArrow(run, _PIECES + (", ids array<long>" if with_ids else ""))


def best_fit(lengths: list[int], size: int) -> tuple[list[int], list[int]]:
    """For each item the number of its bin, items taken longest first and put where least room is left; and the room left in each bin.

    Open bins are kept by their room; an integer's bits tell which rooms exist.
    """
    bins: list[int] = [0] * len(lengths)
    room: list[int] = []
    by_room: list[list[int]] = [[] for _ in range(size + 1)]
    there = 0
    for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        n = lengths[k]
        fit = there >> n
        if fit:
            r = n + (fit & -fit).bit_length() - 1
            b = by_room[r].pop()
            if not by_room[r]:
                there &= ~(1 << r)
        else:
            r, b = size, len(room)
            room.append(size)
        left = r - n
        room[b] = left
        bins[k] = b
        if left:
            by_room[left].append(b)
            there |= 1 << left
    return bins, room


def _packer(level: int, size: int, slack: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        frames = [b for b in batches if len(b)]
        if not frames:
            return
        items = pd.concat(frames, ignore_index=True)
        items = items.sort_values(["filled", "bin"], ascending=[False, True], kind="stable")
        bins, room = best_fit(items["filled"].astype(int).tolist(), size)
        members: list[list[dict]] = [[] for _ in room]
        filled = [0] * len(room)
        for b, n, inner in zip(bins, items["filled"].astype(int), items["members"], strict=True):
            members[b] += [{**m, "offset": m["offset"] + filled[b]} for m in inner]
            filled[b] += n
        numbers = ((level << 56) | (part << 28)) + np.arange(len(room))
        yield pd.DataFrame({"bin": numbers, "level": [level if r > slack else -1 for r in room], "filled": filled, "members": members})

    return run


def pack(pieces: DataFrame, size: int = 4096, slack: int = 4, fan_in: int = 8) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces (doc_id, piece, start, length, ids_crc32) of at most ``size``.

    A bin with at most ``slack`` ids of room is full and goes no further.
    """
    pieces = staged(pieces, "pieces")
    member = F.struct("doc_id", "piece", "start", "length", "ids_crc32", F.lit(0).cast("long").alias("offset"))
    whole = pieces.where(F.col("length") >= size).select(F.array(member).alias("members"), F.col("length").alias("filled"))
    rest = pieces.where(F.col("length") < size)
    number = F.monotonically_increasing_id()  # of a staged table; repeated rows go to different tasks
    items = rest.select(F.xxhash64("doc_id", "piece", number).alias("bin"), F.lit(0).alias("level"), F.col("length").alias("filled"), F.array(member).alias("members"))
    done: list[DataFrame] = []
    n = rest.count()
    tasks, level = max(1, -(-n // TASK_ITEMS)), 1
    while n:
        items = staged(items.repartition(tasks, F.xxhash64("bin", F.lit(level))).mapInPandas(_packer(level, size, slack), _BINS), "bins")
        done.append(items.where("level = -1"))
        open_bins = items.where("level <> -1")
        if tasks == 1:
            done.append(open_bins)
            break
        left = open_bins.count()
        narrower = max(-(-left // TASK_ITEMS), 1)
        tasks = min(narrower, max(1, -(-tasks // fan_in))) if left <= TASK_ITEMS else narrower
        # When a level merges hardly anything and its open bins need as many tasks again, further levels gain nothing.
        if left > 0.98 * n and tasks > 1:
            done.append(open_bins)
            break
        items, n, level = open_bins, left, level + 1
    # A sequence with one whole piece is numbered by itself, below zero, where no packed bin is.
    packed = whole.select("members", (F.monotonically_increasing_id() - F.lit((1 << 63) - 1)).alias("sequence_id"))
    for d in done:
        packed = packed.unionByName(d.select("members", F.col("bin").alias("sequence_id")))
    return packed.select("sequence_id", F.inline("members")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
