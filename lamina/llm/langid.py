"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads windows of a text's UTF-8 bytes in both directions, gives
every position a distribution over languages, and a document's probabilities
are the mean over all its positions.  It is trained in numpy by backpropagation
through time on windows of a bounded sample of labelled documents.

Defined cases: a null text and a text without a letter are ``und`` with score
0; very long texts are read whole, window by window; repeated rows get equal
results; of equally likely languages the first by name is taken; without
labelled rows, as in an empty table, every text is ``und``; other columns stay
as they are.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Documents of each language that are sampled before others.
LEAST_DOCS = 20
#: Documents sampled for training, windows of each, bytes of a window, units of each direction, steps of training.
SAMPLE_DOCS = 2000
DOC_WINDOWS = 6
WINDOW = 64
UNITS = 12
STEPS = 260
_BATCH = 1024
_LETTER = regex.compile(r"\p{L}")


class ByteNetwork:
    """Weights: tables z, r, n (2 directions x 256 bytes, units), recurrent z, r, n (2, units, units), output (2 units, classes)."""

    def __init__(self, labels: list[str], units: int = UNITS, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.labels, self.units = labels, units
        f = lambda *s, scale: (rng.standard_normal(s) * scale).astype(np.float32)
        self.w = {f"t{g}": f(512, units, scale=0.3) for g in "zrn"} | {f"u{g}": f(2, units, units, scale=units**-0.5) for g in "zrn"}
        self.w |= {"v": f(2 * units, len(labels), scale=0.2), "c": np.zeros(len(labels), np.float32)}
        self.w["tz"] -= 0.5

    def _run(self, x: np.ndarray) -> tuple[np.ndarray, list]:
        """States (T, 2, B, units) of windows ``x`` (B, T); direction 1 reads backwards."""
        w, (n_rows, n_steps) = self.w, x.shape
        x = x.T.astype(np.int64)
        at = np.stack([x, x[::-1] + 256], axis=1)
        h = np.zeros((2, n_rows, self.units), np.float32)
        states = np.empty((n_steps, 2, n_rows, self.units), np.float32)
        tape = []
        for t in range(n_steps):
            z = np.tanh(0.5 * (w["tz"][at[t]] + h @ w["uz"]))
            r = np.tanh(0.5 * (w["tr"][at[t]] + h @ w["ur"]))
            z *= 0.5
            z += 0.5
            r *= 0.5
            r += 0.5
            m = h @ w["un"]
            n = np.tanh(w["tn"][at[t]] + r * m)
            tape.append((at[t], h, z, r, m, n))
            h = h + z * (n - h)
            states[t] = h
        return states, tape

    def _states(self, x: np.ndarray) -> np.ndarray:
        """The states of ``_run`` without its tape, in reused buffers."""
        w, (n_rows, n_steps) = self.w, x.shape
        x = x.T.astype(np.int64)
        at = np.stack([x, x[::-1] + 256], axis=1)
        states = np.empty((n_steps, 2, n_rows, self.units), np.float32)
        h = np.zeros((2, n_rows, self.units), np.float32)
        z, r, n, m = (np.empty_like(h) for _ in range(4))
        half = {k: 0.5 * w[k] for k in ("tz", "tr", "uz", "ur")}
        for t in range(n_steps):
            for gate, name in ((z, "z"), (r, "r")):  # 2 sigmoid(a) = 1 + tanh(a / 2)
                np.matmul(h, half[f"u{name}"], out=m)
                np.take(half[f"t{name}"], at[t], axis=0, out=gate, mode="clip")
                gate += m
                np.tanh(gate, out=gate)
                gate += 1.0
                gate *= 0.5
            np.matmul(h, w["un"], out=m)
            m *= r
            np.take(w["tn"], at[t], axis=0, out=n, mode="clip")
            n += m
            np.tanh(n, out=n)
            n -= h
            n *= z
            h = np.add(h, n, out=states[t])
        return states

    def positions(self, x: np.ndarray) -> np.ndarray:
        """Probabilities (B, T, classes) of every position."""
        states = self._states(x)
        both = np.concatenate([states[:, 0], states[::-1, 1]], axis=-1)
        logits = both @ self.w["v"] + self.w["c"]
        logits -= logits.max(axis=-1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=-1, keepdims=True)
        return logits.transpose(1, 0, 2)

    def gradients(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross entropy of all positions of windows ``x`` with labels ``y``."""
        w, u = self.w, self.units
        states, tape = self._run(x)
        n_steps = len(tape)
        both = np.concatenate([states[:, 0], states[::-1, 1]], axis=-1)
        logits = both @ w["v"] + w["c"]
        p = np.exp(logits - logits.max(axis=-1, keepdims=True))
        p /= p.sum(axis=-1, keepdims=True)
        p[:, np.arange(len(y)), y] -= 1
        p *= (weight / (weight.sum() * n_steps))[None, :, None].astype(np.float32)
        g = {k: np.zeros_like(a) for k, a in w.items()}
        g["v"], g["c"] = both.reshape(-1, 2 * u).T @ p.reshape(-1, p.shape[-1]), p.sum(axis=(0, 1))
        back = p @ w["v"].T
        out = np.stack([back[..., :u], back[::-1, :, u:]], axis=1)
        dh = np.zeros_like(states[0])
        tables = {k: np.empty_like(states) for k in "zrn"}
        turned = {k: w[f"u{k}"].transpose(0, 2, 1) for k in "zrn"}
        for t in range(n_steps - 1, -1, -1):
            _, h, z, r, m, n = tape[t]
            d = dh + out[t]
            dn = d * z * (1 - n * n)
            dz = d * (n - h) * z * (1 - z)
            dr = dn * m * r * (1 - r)
            dm = dn * r
            ht = h.transpose(0, 2, 1)
            g["uz"] += ht @ dz
            g["ur"] += ht @ dr
            g["un"] += ht @ dm
            dh = d * (1 - z) + dz @ turned["z"] + dr @ turned["r"] + dm @ turned["n"]
            tables["z"][t], tables["r"][t], tables["n"][t] = dz, dr, dn
        at = np.concatenate([a.reshape(-1) for a, *_ in tape])
        hot = np.zeros((512, len(at)), np.float32)
        hot[at, np.arange(len(at))] = 1
        for k in "zrn":
            g[f"t{k}"] = hot @ tables[k].reshape(-1, u)
        return g

    def train(self, x: np.ndarray, y: np.ndarray, steps: int = STEPS, batch: int = 96, rate: float = 0.02, seed: int = 11) -> None:
        """Adam with a falling rate; labels weigh alike whatever their share."""
        rng = np.random.default_rng(seed)
        share = np.bincount(y, minlength=len(self.labels))
        weight = (1.0 / np.maximum(share, 1))[y] * len(y) / max(1, (share > 0).sum())
        m = {k: np.zeros_like(a) for k, a in self.w.items()}
        v = {k: np.zeros_like(a) for k, a in self.w.items()}
        for k in range(1, steps + 1):
            take = rng.integers(0, len(y), batch)
            now = rate * min(1.0, 2.0 * (1 - k / (steps + 1)))
            for name, g in self.gradients(x[take], y[take], np.minimum(weight[take], 10.0)).items():
                m[name] = 0.9 * m[name] + 0.1 * g
                v[name] = 0.99 * v[name] + 0.01 * g * g
                self.w[name] -= (now * (m[name] / (1 - 0.9**k)) / (np.sqrt(v[name] / (1 - 0.99**k)) + 1e-7)).astype(np.float32)

    def documents(self, texts: list[str]) -> np.ndarray:
        """Mean probabilities (documents, classes) over all positions of each non-empty text."""
        raw = [t.encode("utf-8", "replace") for t in texts]
        n = np.array([len(b) for b in raw])
        rows = -(-n // WINDOW)
        windows = np.zeros((int(rows.sum()), WINDOW), np.uint8)
        ends = np.cumsum(rows)
        flat = windows.reshape(-1)
        for b, first in zip(raw, (ends - rows).tolist(), strict=True):
            flat[first * WINDOW : first * WINDOW + len(b)] = np.frombuffer(b, np.uint8)
        filled = np.full(len(windows), WINDOW)
        filled[ends - 1] = n - (rows - 1) * WINDOW
        sums = np.empty((len(windows), len(self.labels)), np.float32)
        for at in range(0, len(windows), _BATCH):
            p = self.positions(windows[at : at + _BATCH])
            short = filled[at : at + _BATCH] < WINDOW
            p[short] *= (np.arange(WINDOW) < filled[at : at + _BATCH][short, None])[..., None]
            sums[at : at + _BATCH] = p.sum(axis=1)
        return np.add.reduceat(sums.astype(np.float64), ends - rows, axis=0) / n[:, None]


def training_windows(docs: DataFrame, text: str = "text", lang: str = "lang", order: str = "doc_id", sample: int = SAMPLE_DOCS) -> tuple[np.ndarray, list[str]]:
    """Windows (n, WINDOW) and their labels from at most ``sample`` labelled documents, chosen by a hash of ``order``.

    Each label's first ``LEAST_DOCS`` come before others; more labels than fit take turns.
    """
    chars = F.length(text)
    starts = F.array(*[F.floor(F.greatest(chars - WINDOW, F.lit(0)) * (k / max(DOC_WINDOWS - 1, 1))) for k in range(DOC_WINDOWS)])
    pieces = F.transform(starts, lambda s: F.substring(F.col(text), s.cast("int") + 1, F.lit(WINDOW)))
    usable = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}"))
    usable = usable.select(F.xxhash64(order).alias("h"), F.col(lang).alias("lang"), pieces.alias("pieces"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h"))  # cut to the first ones before rows are dealt
    chosen = usable.withColumn("rank", rank).where(F.col("rank") <= LEAST_DOCS).orderBy("rank", "h", "lang").limit(sample).collect()
    # rows of the lowest hashes, cut by a bound that some three times the sample lie under, so few rows leave each task
    n = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).count()
    bound = -(1 << 63) + (1 << 64) * 3 * sample // max(n, 1)
    near = usable.where(F.col("h") < bound).orderBy("h", "lang").limit(sample).collect() if bound < 1 << 63 else []
    if len(near) < sample:
        near = usable.orderBy("h", "lang").limit(sample).collect()
    first: Counter = Counter()
    for r in near:
        first[r["lang"]] += 1
        if first[r["lang"]] > LEAST_DOCS and len(chosen) < sample:
            chosen.append(r)
    x, y = [], []
    for r in sorted(chosen, key=lambda r: (r["h"], r["lang"])):
        for piece in sorted(set(r["pieces"])):
            b = piece.encode("utf-8", "replace")[:WINDOW]
            x.append(np.frombuffer(b.ljust(WINDOW, b"\0"), np.uint8))
            y.append(r["lang"])
    return (np.stack(x) if x else np.zeros((0, WINDOW), np.uint8)), y


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", order: str = "doc_id", sample: int = SAMPLE_DOCS, steps: int = STEPS) -> ByteNetwork:
    """A network trained on labelled rows of ``docs``."""
    x, y = training_windows(docs, text, lang, order, sample)
    labels = sorted(set(y))
    net = ByteNetwork(labels)
    if len(labels) > 1:
        net.train(x, np.array([labels.index(v) for v in y]), steps)
    return net


def predicted(net: ByteNetwork, text: Column) -> Column:
    """STRUCT<lang_pred, score> for a text column."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            langs, scores = np.full(len(batch), "und", object), np.zeros(len(batch))
            real = [k for k, t in enumerate(batch) if t is not None and _LETTER.search(t)] if net.labels else []
            at = 0
            while at < len(real):
                end, chars = at, 0
                while end < len(real) and (end == at or chars < 1_000_000):
                    chars += len(batch.iloc[real[end]])
                    end += 1
                p = net.documents([batch.iloc[k] for k in real[at:end]])
                best = p.argmax(axis=1)
                langs[real[at:end]] = np.array(net.labels, object)[best]
                scores[real[at:end]] = np.clip(p[np.arange(len(best)), best], 0, 1)
                at = end
            yield pd.DataFrame({"lang_pred": langs, "score": scores})

    return F.pandas_udf(run, "lang_pred string, score double")(text)
