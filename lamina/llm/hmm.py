"""Hidden Markov language model with exact sequence likelihood.

The most frequent training words are symbols of their own; any other word
belongs to the symbol of its ending and follows it with add-one frequency.
Baum-Welch counts of latent states are gathered by tasks over all training
documents, in segments, and summed on the cluster; the scaled forward recursion
then gives the exact log10 likelihood of every whole text.

Texts are tokenized once, in blocks that hold each distinct word once.  A
word's count returns to the blocks that hold it by a join on the word.

Defined cases: a null or blank text is one end token; very long texts form a
block of their own; repeated rows count and score each by itself; without
training text every word is unknown; a null doc_id counts as empty text for
the folds; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm.common import staged

BLOCK_CHARS = 12_000_000
#: Words that are symbols of their own, symbols of word endings, hidden states, Baum-Welch rounds, length of training segments.
TOP_WORDS = 1500
ENDINGS = 1500
STATES = 8
ROUNDS = 8
SEGMENT = 64
#: Rows of blocks are large: the writer looks at their size after each and ends a row group there, so neither it nor a reader holds many.
BLOCK_FILES = {"parquet.page.size.row.check.min": 1, "parquet.block.size": 32 << 20}
_SIGNS = b".,;:!?|%#*$&\"'()[]"


def symbol(word: bytes, top: dict[bytes, int]) -> int:
    """0 is the end; then the top words; then the endings."""
    s = top.get(word)
    if s is not None:
        return s
    stem = word.rstrip(_SIGNS)
    return 1 + TOP_WORDS + zlib.crc32(stem[-3:] + (b"+" if len(stem) < len(word) else b"")) % ENDINGS


def blocks(docs: DataFrame) -> DataFrame:
    """(block, doc_ids, held, lens, words, train, at): texts of (doc_id, held, text) as numbers of the block's distinct words.

    ``train`` counts each word in documents that are not held out; ``at`` has
    the words of all documents in a row, as little-endian 32-bit numbers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, made = TaskContext.get().partitionId(), 0

        def emit() -> pa.RecordBatch:
            lens = [len(x) for x in rows]
            at = np.concatenate(rows) if rows else np.zeros(0, np.int32)
            seen = np.repeat(~np.array(held, bool), lens)
            train = np.bincount(at[seen], minlength=len(vocab)).astype("<i8")
            columns = [
                pa.array([(part << 32) + made], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([held], pa.list_(pa.bool_())), pa.array([lens], pa.list_(pa.int64())),
                pa.array([list(vocab)], pa.list_(pa.binary())), pa.array([train], pa.list_(pa.int64())), pa.array([at.astype("<i4").tobytes()], pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(columns, ["block", "doc_ids", "held", "lens", "words", "train", "at"])

        def fresh() -> dict[bytes, int]:
            return defaultdict(count().__next__)  # not the dict's own __len__: such a cycle would keep every block's words

        vocab, rows, ids, held, chars = fresh(), [], [], [], 0
        for batch in batches:
            for doc, out, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                tokens = (text or "").encode("utf-8", "replace").lower().split()  # of bytes: A-Z and the six ASCII spaces
                rows.append(np.array([vocab[w] for w in tokens], np.int32))
                ids.append(doc)
                held.append(bool(out))
                chars += len(text or "")
                if chars >= BLOCK_CHARS:
                    yield emit()
                    vocab, rows, ids, held, chars = fresh(), [], [], [], 0
                    made += 1
        if rows:
            yield emit()

    schema = "block long, doc_ids array<long>, held array<boolean>, lens array<long>, words array<binary>, train array<long>, at binary"
    return docs.select("doc_id", "held", "text").mapInArrow(run, schema)


def symbol_totals(counts: DataFrame, top: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and distinct words of every symbol, over all training words."""
    size = 1 + TOP_WORDS + ENDINGS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, kinds = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for batch in batches:
            s = np.array([symbol(w, top) for w in batch.column(0).to_pylist()], np.int64)
            c = batch.column(1).to_numpy()
            np.add.at(tokens, s, c)
            np.add.at(kinds, s, c > 0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(tokens), pa.array(kinds)], ["s", "tokens", "kinds"])

    tokens, kinds = np.zeros(size, np.int64), np.zeros(size, np.int64)
    for r in counts.select("word", "c").mapInArrow(run, "s long, tokens long, kinds long").groupBy("s").agg(F.sum("tokens").alias("tokens"), F.sum("kinds").alias("kinds")).collect():
        tokens[r["s"]], kinds[r["s"]] = r["tokens"], r["kinds"]
    return tokens, kinds


def training_symbols(block_rows: DataFrame, top: dict[bytes, int]) -> DataFrame:
    """(lens, symbols): the training documents of each block, each with its end, as 16-bit symbols in a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                held, lens, words, at = (batch.column(j)[k] for j in range(4))
                of = np.array([symbol(w, top) for w in words.as_py()] or [0], np.uint16)
                lens, keep = np.array(lens.as_py(), np.int64), ~np.array(held.as_py(), bool)
                at = np.frombuffer(at.as_py(), "<i4")
                ends = np.cumsum(lens + 1) - 1
                out = np.zeros(int((lens + 1).sum()), np.uint16)
                inner = np.ones(len(out), bool)
                inner[ends] = False
                out[inner] = of[at]
                out = out[np.repeat(keep, lens + 1)]
                yield pa.RecordBatch.from_arrays([pa.array([(lens + 1)[keep]], pa.list_(pa.int64())), pa.array([out.astype("<u2").tobytes()], pa.binary())], ["lens", "symbols"])

    return block_rows.select("held", "lens", "words", "at").mapInArrow(run, "lens array<long>, symbols binary")


class Model:
    """start (document, segment), move and emit probabilities; ``emit`` has a row for each symbol."""

    def __init__(self, symbols: np.ndarray, states: int = STATES, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        share = (symbols + 0.5) / (symbols + 0.5).sum()
        emit = share[:, None] * rng.uniform(0.2, 1.8, (len(symbols), states))
        self.emit = emit / emit.sum(axis=0)
        self.move = 0.85 * np.eye(states) + 0.15 / states
        self.start = np.full((2, states), 1.0 / states)

    def counts(self, lens: np.ndarray, stream: np.ndarray) -> np.ndarray:
        """Expected counts of starts, moves and emissions, and the log likelihood, of documents cut into segments."""
        k = self.move.shape[0]
        emit, move = self.emit.astype(np.float32), self.move.astype(np.float32)
        n = -(-lens // SEGMENT)
        offsets = np.cumsum(lens) - lens
        first = np.repeat(offsets, n) + SEGMENT * (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
        length = np.minimum(SEGMENT, np.repeat(offsets + lens, n) - first)
        inner = (first != np.repeat(offsets, n)).astype(np.int64)
        total_start, total_move = np.zeros((2, k)), np.zeros((k, k))
        total_emit = np.zeros((k, len(emit)))
        loglik = 0.0
        for at in range(0, len(first), 4096):
            order = np.argsort(-length[at : at + 4096], kind="stable") + at
            begin, size, kind = first[order], length[order], inner[order]
            steps = int(size[0])
            live = [int(np.searchsorted(-size, -t, side="left")) for t in range(steps)]  # segments longer than t
            alphas, scales, syms = [], [], []
            a = self.start[kind].astype(np.float32)
            for t in range(steps):
                m = live[t]
                s = stream[begin[:m] + t]
                a = (a if t == 0 else a[:m] @ move) * emit[s]
                c = a.sum(axis=1)
                a /= c[:, None]
                loglik += float(np.log(c.astype(np.float64)).sum())
                alphas.append(a)
                scales.append(c)
                syms.append(s)
            beta = np.ones((live[-1], k), np.float32)
            gammas: list[np.ndarray] = [None] * steps
            for t in range(steps - 1, -1, -1):
                if t < steps - 1:
                    ahead = beta * emit[syms[t + 1]] / scales[t + 1][:, None]
                    m = live[t + 1]
                    total_move += move * (alphas[t][:m].T @ ahead)
                    beta = np.ones((live[t], k), np.float32)
                    beta[:m] = ahead @ move.T
                gammas[t] = alphas[t] * beta
            for j in (0, 1):
                total_start[j] += gammas[0][kind == j].sum(axis=0)
            g, s = np.concatenate(gammas), np.concatenate(syms)
            for j in range(k):
                total_emit[j] += np.bincount(s, weights=g[:, j], minlength=len(emit))
        return np.concatenate([[loglik], total_start.ravel(), total_move.ravel(), total_emit.T.ravel()])

    def update(self, counts: np.ndarray, prior: np.ndarray) -> None:
        k, rest = self.move.shape[0], counts[1:]
        self.start = rest[: 2 * k].reshape(2, k) + 0.01
        self.start /= self.start.sum(axis=1, keepdims=True)
        self.move = rest[2 * k : 2 * k + k * k].reshape(k, k) + 0.01
        self.move /= self.move.sum(axis=1, keepdims=True)
        emit = rest[2 * k + k * k :].reshape(-1, k) + 0.5 * prior[:, None]
        self.emit = emit / emit.sum(axis=0)

    def forward(self, lens: np.ndarray, stream: np.ndarray) -> np.ndarray:
        """log10 likelihood of each whole document; all take their t-th step together."""
        order = np.argsort(-lens, kind="stable")
        begin, size = (np.cumsum(lens) - lens)[order], lens[order]
        out = np.zeros(len(lens))
        live = len(size)
        a = np.tile(self.start[0], (live, 1))
        for t in range(int(size[0]) if live else 0):
            while size[live - 1] <= t:
                live -= 1
            a = (a[:live] if t == 0 else a[:live] @ self.move) * self.emit[stream[begin[:live] + t]]
            c = a.sum(axis=1)
            a /= c[:, None]
            out[order[:live]] += np.log10(c)
        return out


def train(symbols: DataFrame, tokens: np.ndarray, rounds: int = ROUNDS) -> Model:
    """Baum-Welch over all training documents; each round sums the tasks' counts on the cluster."""
    model = Model(tokens.astype(float))
    prior = (tokens + 0.5) / (tokens + 0.5).sum()
    for _ in range(rounds if tokens.sum() else 0):

        def run(batches: Iterator[pa.RecordBatch], model: Model = model) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                for k in range(batch.num_rows):
                    lens, stream = np.array(batch.column(0)[k].as_py(), np.int64), np.frombuffer(batch.column(1)[k].as_py(), "<u2")
                    if len(lens):
                        c = model.counts(lens, stream)
                        total = c if total is None else total + c
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["at", "n"])

        found = symbols.mapInArrow(run, "at long, n double").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
        if not len(found):
            break
        counts = np.zeros(int(found["at"].max()) + 1)
        counts[found["at"]] = found["n"]
        model.update(counts, prior)
    return model


def score(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Base and model scores of (doc_id, held, text); learns from documents that are not held out."""
    rows = staged(blocks(docs), "blocks", **BLOCK_FILES)
    placed = rows.select("block", F.posexplode(F.arrays_zip("words", "train")).alias("pos", "w")).select("block", "pos", F.col("w.words").alias("word"), F.col("w.train").alias("n"))
    counts = staged(placed.groupBy("word").agg(F.sum("n").alias("c")), "counts")
    known = counts.where("c > 0")
    top = {bytes(r["word"]): k + 1 for k, r in enumerate(known.orderBy(F.desc("c"), "word").limit(TOP_WORDS).collect())}
    tokens, kinds = symbol_totals(known, top)
    # the end of each training document is a token of the training data too
    ends = rows.select(F.size(F.filter("held", lambda h: ~h)).alias("n")).agg(F.sum("n")).first()[0] or 0
    n_all, v_all = int(tokens.sum()) + ends, int(kinds.sum()) + (ends > 0)
    tokens[0] = ends
    model = train(staged(training_symbols(rows, top), "symbols", **BLOCK_FILES), tokens, rounds)
    lost = np.log10(tokens + kinds + 1.0)  # of a word within its symbol

    def run(block: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in block.itertuples():
            c = np.zeros(max(len(r.words), 1), np.int64)
            c[found["pos"].to_numpy()] = found["c"].to_numpy()
            of = np.array([symbol(bytes(w), top) for w in r.words] or [0], np.int64)
            alone = (of >= 1) & (of <= TOP_WORDS)
            base = np.log10(c + 1.0) - np.log10(n_all + v_all + 1.0)
            inner = np.where(alone, 0.0, np.log10(c + 1.0) - lost[of])
            lens = np.array(r.lens, np.int64)
            at = np.frombuffer(r.at, "<i4")
            bounds = np.concatenate([[0], np.cumsum(lens)])
            part = lambda x: np.diff(np.concatenate([[0], np.cumsum(x[at])])[bounds])  # noqa: E731,B023
            ends_at = np.cumsum(lens + 1) - 1
            stream = np.zeros(int((lens + 1).sum()), np.int64)
            within = np.ones(len(stream), bool)
            within[ends_at] = False
            stream[within] = of[at]
            end_base = np.log10(ends + 1.0) - np.log10(n_all + v_all + 1.0)
            out.append(
                pd.DataFrame(
                    {
                        "doc_id": pd.array(list(r.doc_ids), "Int64"), "held_out": list(r.held), "n_tokens": lens + 1, "n_known": part((c > 0).astype(np.int64)) + (ends > 0),
                        "train_tokens": n_all, "base_score": part(base) + end_base, "score": part(inner) + model.forward(lens + 1, stream),
                    }
                )
            )
        columns = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
        return pd.concat(out) if out else pd.DataFrame({c: [] for c in columns})

    back = placed.join(counts, "word").select(F.col("block").alias("of_block"), "pos", "c")
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return rows.drop("train").groupBy("block").cogroup(back.groupBy("of_block")).applyInPandas(run, schema)
