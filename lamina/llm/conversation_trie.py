"""Prefix trie of conversations in preorder-interval encoding.

A conversation is a path of turn digests.  Paths are sorted over range
partitions; along the order each node begins where a path leaves the one
before it, so distinct nodes get their preorder ranks, and the last rank below
each node, in one pass over sorted rows.  A task gives ranks relative to its
first path; where partitions begin and end in ranks follows from one row for
each partition.  Nodes that are open at a partition's border come in pieces and
are added up; all others are whole at once.

A node's subtree is the interval of ranks from its own to its end.  Leaves and
savings below it are differences of prefix sums over ranks, which are kept in
blocks: sums inside blocks, and sums of blocks before them.

Defined cases: a null role or text counts as empty; a null turn comes first;
turns alike in number go by the digest of their role and text; rows without a
conversation id belong to none and are left out; repeated rows are turns of
their own; an empty table has no nodes; other columns are not read.  One
conversation's digests (16 bytes a turn) are held by one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.llm.common import staged

#: Bytes of a turn's digest.
WIDE = 16
#: Characters of ids held for one node; more are written out in parts.
HELD = 100_000
#: Ranks of a block of prefix sums.
BLOCK = 1 << 18
NO_IDS = hashlib.sha256(b"").hexdigest()

_PIECES = (
    "part int, kind int, node binary, parent binary, depth long, chars long, n_convs long, conv_id long, rank long, last long, "
    "ends_sha256 string, seq long, ids string, first_path binary, last_path binary"
)
_NAMES = [f.split()[0] for f in _PIECES.split(", ")]
_TYPES = {"int": pa.int32(), "binary": pa.binary(), "long": pa.int64(), "string": pa.string()}
_SCHEMA = pa.schema([(n, _TYPES[f.split()[1]]) for n, f in zip(_NAMES, _PIECES.split(", "), strict=True)])
#: Kinds of rows: a whole node, a piece of a node at a border, a part of a node's ids, a partition.
_WHOLE, _PIECE, _IDS, _PART = range(4)


def turn_lists(turns: DataFrame) -> DataFrame:
    """For each conversation its turns in order: conv_id, turns array<struct<digest, chars>>."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.md5(F.concat(role, F.lit("\x00"), text).cast("binary"))
    rows = turns.where("conv_id IS NOT NULL").select("conv_id", F.struct("turn", digest.alias("digest"), F.length(text).cast("long").alias("chars")).alias("t"))
    listed = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    return listed.select("conv_id", F.transform("turns", lambda t: F.struct(t["digest"].alias("digest"), t["chars"].alias("chars"))).alias("turns"))


def shared_turns(conv_id: Column) -> Column:
    """How many turns a conversation takes from the one that its hundred begins with."""
    return (F.crc32(conv_id.cast("string").cast("binary")) % 6).cast("int")


def rebuilt(lists: DataFrame) -> DataFrame:
    """Conversations that begin with the first turns of the one that their hundred begins with."""
    lists = staged(lists, "turns")
    base = F.col("conv_id") - F.col("conv_id") % 100
    heads = lists.where(F.col("conv_id") % 100 == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, 5).alias("head"))
    h = shared_turns(F.col("conv_id"))
    own = F.slice("turns", h + 1, F.greatest(F.size("turns") - h, F.lit(0)))
    head = F.slice(F.coalesce("head", F.slice("turns", 1, 0)), F.lit(1), h)
    both = lists.withColumn("base", base).join(heads, "base", "left")
    return both.select("conv_id", F.concat(head, own).alias("turns"))


def _common(a: bytes, b: bytes) -> int:
    """How many whole digests two paths share from the start."""
    if a == b:
        return len(a) // WIDE
    most = min(len(a), len(b)) // WIDE
    low, high = 0, most
    while low < high:
        mid = (low + high + 1) // 2
        if a[: mid * WIDE] == b[: mid * WIDE]:
            low = mid
        else:
            high = mid - 1
    return low


class _Open:
    """A node on the present path: its key, members so far, and where it began."""

    __slots__ = ("conv_id", "chars", "edge", "key", "n", "rank", "sha")

    def __init__(self, key: bytes, chars: int, rank: int, edge: bool) -> None:
        self.key, self.chars, self.rank, self.edge = key, chars, rank, edge
        self.n, self.conv_id, self.sha = 0, None, None


class _Walk:
    """One partition's paths in order; ranks count from the last node of the first path."""

    def __init__(self, part: int) -> None:
        self.part = part
        self.rows: list[dict] = []
        self.stack: list[_Open] = []
        self.first: bytes | None = None
        self.path = b""
        self.last = 0
        self.ids: list[str] = []
        self.held = self.seq = 0

    def _write_ids(self) -> None:
        if self.ids:
            self.rows.append({"kind": _IDS, "node": self.stack[-1].key, "seq": self.seq, "ids": ",".join(self.ids)})
            self.seq += 1
        self.ids, self.held = [], 0

    def _end_run(self, at_border: bool) -> None:
        """All members that end at the present path have come; their hash is known unless ids were written out or go on elsewhere."""
        if at_border or self.seq:
            self._write_ids()
        elif self.ids:
            self.stack[-1].sha = hashlib.sha256(",".join(self.ids).encode()).hexdigest()
        self.ids, self.held, self.seq = [], 0, 0

    def _pop(self, border: bool) -> None:
        node = self.stack.pop()
        up = self.stack[-1] if self.stack else None
        if up:
            up.n += node.n
            up.conv_id = node.conv_id if up.conv_id is None else min(up.conv_id, node.conv_id)
        self.rows.append(
            {"kind": _PIECE if border or node.edge else _WHOLE, "node": node.key, "parent": up and up.key, "depth": len(self.stack), "chars": node.chars,
             "n_convs": node.n, "conv_id": node.conv_id, "rank": node.rank, "last": self.last, "ends_sha256": node.sha}
        )

    def add(self, conv_id: int, path: bytes, chars: list[int]) -> None:
        begin = self.first is None
        if begin:
            self.first = path
            self.stack = [_Open(b"", 0, -(len(path) // WIDE), True)]
            same = 0
        else:
            same = _common(self.path, path)
            if path != self.path:
                self._end_run(self.path == self.first)
                while len(self.stack) > same + 1:
                    self._pop(False)
        for d in range(same, len(path) // WIDE):
            key = hashlib.blake2b(self.stack[-1].key + path[d * WIDE : (d + 1) * WIDE], digest_size=WIDE).digest()
            if not begin:
                self.last += 1
            self.stack.append(_Open(key, chars[d], d + 1 - len(path) // WIDE if begin else self.last, begin))
        self.path = path
        node = self.stack[-1]
        node.n += 1
        node.conv_id = conv_id if node.conv_id is None else min(node.conv_id, conv_id)
        self.ids.append(str(conv_id))
        self.held += len(self.ids[-1]) + 1
        if self.held > HELD:
            self._write_ids()

    def end(self) -> None:
        if self.first is None:
            return
        last = self.path
        self._end_run(True)
        while self.stack:
            self._pop(True)
        self.rows.append({"kind": _PART, "last": self.last, "first_path": self.first, "last_path": last})

    def taken(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        for r in rows:
            r["part"] = self.part
        return pa.RecordBatch.from_pylist(rows, _SCHEMA)


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    walk = _Walk(TaskContext.get().partitionId())
    for batch in batches:
        for conv_id, path, chars in zip(*(batch.column(k) for k in range(3)), strict=True):
            walk.add(conv_id.as_py(), path.as_py(), chars.as_py())
            if len(walk.rows) >= 5000:
                yield walk.taken()
    walk.end()
    yield walk.taken()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of each node's ids, whose parts come one after another; only the hash's state is held."""
    node, state = None, None
    done: list[tuple[bytes, str]] = []

    def batch_of(rows: list[tuple[bytes, str]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.string())], ["node", "ends_sha256"])

    for batch in batches:
        for key, ids in zip(batch.column(0), batch.column(1), strict=True):
            key = key.as_py()
            if key != node:
                if state:
                    done.append((node, state.hexdigest()))
                node, state = key, hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.as_py().encode())
        yield batch_of(done)
        done = []
    if state:
        yield batch_of([(node, state.hexdigest())])


def _with_sums(df: DataFrame, rank: str, values: list[str]) -> DataFrame:
    """``df`` with the sums of ``values`` over all ranks up to each row's, as ``<value>_sum``; ranks are dense from 0."""
    block = F.floor(F.col(rank) / BLOCK)
    df = df.withColumn("_block", block)
    of_blocks = df.groupBy("_block").agg(*[F.sum(v).alias(v) for v in values])
    before = of_blocks.select("_block", *[F.expr(f"sum({v}) OVER (ORDER BY _block) - {v} AS _{v}") for v in values])  # a row for each BLOCK ranks
    sums = [F.expr(f"sum({v}) OVER (PARTITION BY _block ORDER BY {rank})").alias(f"{v}_in") for v in values]
    return df.select("*", *sums).join(before, "_block").select(*[c for c in df.columns if c != "_block"], *[(F.col(f"{v}_in") + F.col(f"_{v}")).alias(f"{v}_sum") for v in values])


def nodes(paths: DataFrame) -> DataFrame:
    """A row for each distinct beginning of the conversations ``paths`` (conv_id, turns), with its interval of preorder ranks.

    Nodes that share a parent are joined to it by a sort-merge join, in which
    Spark splits the partition of a parent with very many children.
    """
    spark = paths.sparkSession
    digests = F.transform("turns", lambda t: t["digest"])
    rows = staged(paths.select("conv_id", F.unhex(F.array_join(digests, "")).alias("path"), F.transform("turns", lambda t: t["chars"]).alias("chars")), "paths")
    ordered = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "path", "conv_id").sortWithinPartitions("path", "conv_id")
    pieces = staged(ordered.select("conv_id", "path", "chars").mapInArrow(_walk, _PIECES), "pieces")

    # where each partition's ranks begin: a row for each partition
    parts = sorted((r["part"], r["last"], bytes(r["first_path"]), bytes(r["last_path"])) for r in pieces.where(F.col("kind") == _PART).select("part", "last", "first_path", "last_path").collect())
    steps = [len(first) // WIDE - (_common(parts[k - 1][3], first) if k else 0) for k, (_, _, first, _) in enumerate(parts)]
    ends = list(accumulate(step + part[1] for step, part in zip(steps, parts, strict=True)))
    offsets = [(part[0], end - part[1]) for part, end in zip(parts, ends, strict=True)]
    shift = F.broadcast(spark.createDataFrame(offsets, "part int, shift long"))

    placed = pieces.where(F.col("kind") <= _PIECE).join(shift, "part").withColumns({"rank": F.col("rank") + F.col("shift"), "last": F.col("last") + F.col("shift")})
    columns = ["node", "parent", "depth", "chars", "n_convs", "conv_id", "rank", "last", "ends_sha256"]
    whole = placed.where(F.col("kind") == _WHOLE).select(columns)
    # a node's first piece has its true rank, later ones a higher one
    joined = placed.where(F.col("kind") == _PIECE).groupBy("node").agg(
        F.max("parent").alias("parent"), F.max("depth").alias("depth"), F.max("chars").alias("chars"), F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id"),
        F.min("rank").alias("rank"), F.max("last").alias("last"), F.max("ends_sha256").alias("ends_sha256"),
    )
    found = whole.unionByName(joined.select(columns))
    # ids that were written out; parts go by partition, then by their order in it
    listed = pieces.where(F.col("kind") == _IDS).select("node", "part", "seq", "ids").repartition("node").sortWithinPartitions("node", "part", "seq")
    hashed = listed.select("node", "ids").mapInArrow(_hashed, "node binary, ends_sha256 string").withColumnRenamed("ends_sha256", "_sha")
    found = found.join(hashed, "node", "left").withColumn("ends_sha256", F.coalesce("_sha", "ends_sha256", F.lit(NO_IDS))).drop("_sha")
    found = found.withColumns({"leaf": (F.col("rank") == F.col("last")).cast("long"), "saved": (F.col("n_convs") - 1) * F.col("chars")})
    summed = staged(_with_sums(found, "rank", ["leaf", "saved"]), "nodes")

    at_end = summed.select(F.col("rank").alias("last"), F.col("leaf_sum").alias("leaf_end"), F.col("saved_sum").alias("saved_end"))
    below = summed.join(at_end, "last").withColumns(
        {"n_leaves": F.col("leaf_end") - F.col("leaf_sum") + F.col("leaf"), "saved_tokens": F.col("saved_end") - F.col("saved_sum") + F.col("saved")}
    )
    children = summed.where("parent IS NOT NULL").groupBy("parent").agg(F.count("*").alias("n_children"))
    parents = summed.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    below = below.join(parents, "parent", "left").join(children.withColumnRenamed("parent", "node"), "node", "left")
    return below.select("conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), "n_leaves", "saved_tokens", "ends_sha256", "rank", F.col("last").alias("end_rank"))
