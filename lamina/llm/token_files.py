"""Files of token ids: frequency-ranked, byte-aligned variable length, control bytes apart from data bytes.

An id is replaced by its rank among all ids of the corpus, so frequent ids take
one byte.  Four ranks share a control byte that holds their lengths; reading
looks those up in a table of 256 rows and gathers with numpy.

File: magic, rank table, then blocks.  A block holds doc ids, null marks, token
counts, control bytes and data bytes.  A document longer than a block goes on
in the next one.

Defined cases: a null text is empty; a null doc_id sorts first and stays null;
equal doc_ids follow in order of a hash of their ids; very long texts go on over
blocks; columns other than id and text are not looked at; an empty table gives
no file.
"""

from __future__ import annotations

import gc
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lamina.llm.common import lean, new_path, staged
from lamina.llm.tokenizing import SLICE_ROWS, encoder_for
from lamina.llm.warc import _filesystem

MAGIC = b"LTOK0001"
#: Ids in a block and in a file, about.
BLOCK_IDS = 1 << 20
FILE_IDS = 1 << 23

#: For each control byte the four lengths.
LENGTHS = (np.arange(256)[:, None] >> (2 * np.arange(4)) & 3) + 1


def encode(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned ranks."""
    n = len(ranks)
    ranks = ranks.astype("<u4")
    size = 1 + (ranks > 0xFF) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    padded = np.zeros(-(-n // 4) * 4, np.uint8)
    padded[:n] = size - 1
    control = (padded.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1).astype(np.uint8)
    taken = np.arange(4) < size[:, None]
    return control.tobytes(), ranks.view(np.uint8).reshape(-1, 4)[taken].tobytes()


def decode(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` ranks of control and data bytes."""
    size = LENGTHS[control].reshape(-1)[:n]
    taken = np.arange(4) < size[:, None]
    out = np.zeros((n, 4), np.uint8)
    out[taken] = data[: int(size.sum())]
    return out.view("<u4").reshape(-1)


def tokenized(docs: DataFrame, tokenizer_path: str, end_id: int = 2, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids): the ids of each text and the end id, as little-endian unsigned 16 or 32 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        encoder = encoder_for(tokenizer_path)
        kind = _kind(max(encoder.size, end_id + 1))
        end = np.array([end_id], kind).tobytes()
        gc.disable()  # many small lists without cycles
        try:
            for batch in batches:
                for first in range(0, batch.num_rows, SLICE_ROWS):
                    rows = batch.slice(first, SLICE_ROWS)
                    found = [x.astype(kind).tobytes() + end for x in encoder.encode_all(rows.column(1).to_pylist())]
                    counts = pa.array([len(x) // len(end) for x in found], pa.int64())
                    yield pa.RecordBatch.from_arrays([rows.column(0), counts, pa.array(found, pa.binary())], ["doc_id", "n_tokens", "ids"])
        finally:
            gc.enable()

    return docs.select(F.col(id_column).cast("long"), text).mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def _kind(size: int) -> str:
    return "<u2" if size <= 1 << 16 else "<u4"


def id_counts(tokens: DataFrame, size: int) -> DataFrame:
    """(id, n) over all documents; a task gives at most ``size`` rows."""
    kind = _kind(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            joined = b"".join(batch.column(0).to_pylist())
            total += np.bincount(np.frombuffer(joined, kind), minlength=size)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], ["id", "n"])

    return tokens.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write_files(tokens: DataFrame, path: str, size: int) -> list[tuple[str, int, int]]:
    """Writes ``tokens`` in ascending order of doc_id; returns each file's path, ids before it and ids.

    Only the table of id counts, at most ``size`` rows, and a line for each file reach the driver.
    """
    tokens = staged(tokens, "tokens")
    counts = np.zeros(size, np.int64)
    for r in id_counts(tokens, size).toLocalIterator():
        counts[r["id"]] = r["n"]
    by_rank = np.lexsort((np.arange(size), -counts)).astype("<u4")
    rank = np.empty(size, np.uint32)
    rank[by_rank] = np.arange(size, dtype=np.uint32)
    shared = tokens.sparkSession.sparkContext.broadcast((by_rank, rank))  # bounded by the vocabulary
    files = max(1, -(-int(counts.sum()) // FILE_IDS))
    kind = _kind(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        by_rank, rank = shared.value
        fs, folder = _filesystem(path)
        fs.create_dir(folder, recursive=True)
        part = TaskContext.get().partitionId()
        name = f"{folder}/{part:06d}-{uuid.uuid4().hex}.tok"
        held: list[tuple[int | None, np.ndarray]] = []
        room, total = BLOCK_IDS, 0
        with fs.open_output_stream(name, compression=None) as out:
            out.write(MAGIC + np.uint32(len(by_rank)).astype("<u4").tobytes() + by_rank.tobytes())

            def flush() -> None:
                ranks = rank[np.concatenate([x for _, x in held])]
                control, data = encode(ranks)
                ids = np.array([d or 0 for d, _ in held], "<i8")
                nulls = np.array([d is None for d, _ in held], np.uint8)
                counts = np.array([len(x) for _, x in held], "<i8")
                goes_on = np.uint32(0 if done else 1)
                head = np.array([len(held), len(ranks), len(control), len(data), goes_on], "<i8")
                out.write(b"".join([head.tobytes(), ids.tobytes(), nulls.tobytes(), counts.tobytes(), control, data]))

            for batch in batches:
                for doc, ids in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    left = np.frombuffer(ids.as_buffer() or b"", kind)
                    total += len(left)
                    while True:
                        piece, left = left[:room], left[room:]
                        done = not len(left)
                        held.append((doc, piece))
                        room -= len(piece)
                        if room == 0 or not done:
                            flush()
                            held, room = [], BLOCK_IDS
                        if done:
                            break
            done = True
            if held:
                flush()
        yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([name]), pa.array([total])], ["part", "name", "total"])

    tie = F.xxhash64("ids").alias("tie")  # spreads rows of one id over files
    ordered = tokens.select("doc_id", tie, "ids").repartitionByRange(files, "doc_id", "tie").sortWithinPartitions("doc_id", "tie", "ids").select("doc_id", "ids")
    found = sorted(tuple(r) for r in ordered.mapInArrow(run, "part long, name string, total long").collect())
    before = np.cumsum([0, *[t for _, _, t in found]]).tolist()
    prefix = path.partition(":")[0] + "://" if ":" in path else ""
    return [(prefix + name, at, n) for (_, name, n), at in zip(found, before, strict=False) if n]


def read_file(path: str) -> Iterator[tuple[int | None, int, int]]:
    """(doc_id, ids, crc32 of the ids as little-endian unsigned 32 bits) of each document, in the file's order; one block is held at a time."""
    fs, name = _filesystem(path)
    with fs.open_input_stream(name, compression=None) as f:
        if f.read(8) != MAGIC:
            raise ValueError(f"not a token file: {path}")
        by_rank = np.frombuffer(f.read(4 * int(np.frombuffer(f.read(4), "<u4")[0])), "<u4")
        n_open, crc = 0, 0
        while head := f.read(40):
            docs, n, n_control, n_data, goes_on = np.frombuffer(head, "<i8").tolist()
            ids = np.frombuffer(f.read(8 * docs), "<i8").tolist()
            nulls = np.frombuffer(f.read(docs), np.uint8).tolist()
            counts = np.frombuffer(f.read(8 * docs), "<i8").tolist()
            tokens = by_rank[decode(np.frombuffer(f.read(n_control), np.uint8), np.frombuffer(f.read(n_data), np.uint8), n)]
            at = 0
            for k in range(docs):
                crc = zlib.crc32(tokens[at : at + counts[k]].tobytes(), crc)
                at += counts[k]
                n_open += counts[k]
                if k + 1 == docs and goes_on:
                    break
                yield (None if nulls[k] else ids[k]), n_open, crc
                n_open, crc = 0, 0


class TokenFile(InputPartition):
    def __init__(self, name: str, before: int) -> None:
        super().__init__(name)
        self.name, self.before = name, before


class TokenReader(DataSourceReader):
    def __init__(self, files: list[tuple[str, int]]) -> None:
        self.files = files

    def partitions(self) -> list[InputPartition]:
        return [TokenFile(*f) for f in self.files]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        at = partition.before if partition else 0
        for doc, n, crc in read_file(partition.name) if partition else []:
            yield doc, at, n, crc
            at += n


class TokenSource(DataSource):
    """``spark.read.format("token_files")``; option ``files``: lines of path, tab, ids before it."""

    @classmethod
    def name(cls) -> str:
        return "token_files"

    def schema(self) -> str:
        return "doc_id long, start long, n_tokens long, ids_crc32 long"

    def reader(self, schema) -> TokenReader:
        lines = [x.rpartition("\t") for x in self.options.get("files", "").split("\n") if x]
        return TokenReader([(name, int(before)) for name, _, before in lines])


def read_files(spark: SparkSession, files: list[tuple[str, int, int]]) -> DataFrame:
    spark.dataSource.register(TokenSource)
    return spark.read.format("token_files").option("files", "\n".join(f"{name}\t{at}" for name, at, _ in files)).load()


def round_trip(docs: DataFrame, tokenizer_path: str, size: int) -> DataFrame:
    """One row per document, from files written and read back."""
    spark = docs.sparkSession
    return read_files(spark, write_files(tokenized(docs, tokenizer_path), new_path(spark, "ids"), size))
