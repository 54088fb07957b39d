"""Toxicity by a subsequence string kernel and a support vector machine on Nyström landmarks.

Landmarks are words and word beginnings that labelled toxic documents hold far
more often than others.  The gap-weighted subsequence kernel compares a word
with a landmark: each common subsequence of four characters counts, the less
the more characters lie between, so ``i.d.i.o.t`` and ``idiiot`` stay near
``idiot``.  A sentence is the largest kernel of its words with each landmark,
mapped by the inverse root of the landmarks' own kernel; a linear machine,
trained on sentences with the labels of their documents, marks sentences, and
a logistic fit on a document's marks gives its score.

Words are compared once while they are remembered, and only where they hold
all but one of a landmark's letters, without which the kernel is near zero.

Defined cases: null and empty texts have no sentence and get the score of a
text without any hit; very long words are compared in overlapping windows;
repeated rows get equal scores; without labels of both kinds every score is 0.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.llm.common import lean

#: Labelled documents sampled for training and the longest text among them.
SAMPLE_DOCS = 6000
SAMPLE_CHARS = 20_000
LANDMARKS = 48
#: Length of subsequences, weight of each character they span, least share of a landmark's own kernel that counts.
LENGTH, DECAY, LEAST = 4, 0.7, 0.3
WIDEST = 28
REMEMBERED = 200_000
_EDGE = ".,;:!?|%#*$&\"'()[]{}<>«»„“”…-_~"
_SENTENCES = re.compile(r"[.!?\n]+(?:\s|$)|\n+")
_DOTTED = re.compile(r"(?:[^\W_][\W_]+){2,}[^\W_]")
_SPELLED = re.compile(r"(?<!\S)(?:\S[ \t]){2,}\S(?!\S)")


def _codes(words: list[str], width: int) -> np.ndarray:
    """Code points (words, width), zero after the end."""
    return np.array(words, f"<U{width}").view(np.uint32).reshape(len(words), width).astype(np.int32)


def pair_kernels(a: list[str], b: list[str]) -> np.ndarray:
    """Gap-weighted subsequence kernel of ``a[i]`` with ``b[i]``, all pairs at once."""
    if not a:
        return np.zeros(0)
    s, t = _codes(a, max(map(len, a))), _codes(b, max(map(len, b)))
    t[t == 0] = -1  # padding meets nothing
    n, m, pairs = s.shape[1], t.shape[1], len(a)
    lam = np.float32(DECAY)
    before = [np.zeros((m + 1, pairs), np.float32) for _ in range(LENGTH)]  # K'_q(i - 1, .)
    before[0][:] = 1
    total = np.zeros(pairs, np.float32)
    for i in range(n):
        meets = [(s[:, i] == t[:, j]) * (lam * lam) for j in range(m)]
        for j in range(m):
            total += meets[j] * before[LENGTH - 1][j]
        for q in range(LENGTH - 1, 0, -1):
            run = np.zeros(pairs, np.float32)
            lower, mine = before[q - 1], before[q]
            for j in range(m):
                run = lam * run + meets[j] * lower[j]
                mine[j + 1] = lam * mine[j + 1] + run
    return total


def _mask(word: str) -> int:
    out = 0
    for c in word:
        out |= 1 << ((ord(c) * 0x9E3779B1 >> 7) & 63)
    return out


def unit(word: str) -> list[str]:
    """A lower-case word without outer marks, between edge signs; a long one in overlapping windows.

    Signs after every single letter go; between other letters the kernel bears them.
    """
    word = word.strip(_EDGE)
    if not word.isalnum() and _DOTTED.fullmatch(word):
        word = "".join(filter(str.isalnum, word))
    word = f"^{word}$"
    if len(word) <= WIDEST:
        return [word]
    return [word[k : k + WIDEST] for k in range(0, len(word) - WIDEST // 2, WIDEST // 2)]


class Scorer:
    """A trained machine; remembers the kernels of words it has seen."""

    def __init__(self, landmarks: list[str]) -> None:
        self.landmarks = landmarks
        n = len(landmarks)
        own = pair_kernels([a for a in landmarks for _ in landmarks], landmarks * n).reshape(n, n) if n else np.zeros((0, 0))
        self.own = own.diagonal().copy()
        norm = own / np.sqrt(np.outer(self.own, self.own)) if n else own
        values, vectors = np.linalg.eigh(norm + 1e-3 * np.eye(n)) if n else (np.zeros(0), np.zeros((0, 0)))
        self.root = vectors / np.sqrt(np.maximum(values, 1e-6)) @ vectors.T
        self.masks = np.array([_mask(x.strip("^$")) for x in landmarks], np.uint64)
        self.w, self.b = np.zeros(n), -1.0
        self.doc = np.array([-20.0, 0, 0, 0, 0])
        self.scale = np.ones(4)
        self._forget()

    def _forget(self) -> None:
        self.seen: set[str] = set()
        self.near: dict[str, np.ndarray] = {}

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("seen", "near")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state
        self._forget()

    def learn(self, words: set[str]) -> None:
        """Kernels of words not remembered; those near no landmark are only remembered as seen."""
        new = words - self.seen
        if len(self.seen) + len(new) > REMEMBERED:
            self._forget()
            new = words  # also those that were known until now
        self.seen |= new
        if not self.landmarks:
            return
        source = [(w, u) for w in new for u in unit(w) if len(u) > LENGTH]
        masks = np.array([_mask(u[1:-1] if len(u) < WIDEST else u) for _, u in source], np.uint64)
        left: list[str] = []
        right: list[int] = []
        for j, mark in enumerate(self.masks):
            lacking = mark & ~masks
            for k in np.flatnonzero((lacking & (lacking - np.uint64(1)) & np.uint64(0xFFFFFFFFFFFFFFFF)) * (lacking > 0) == 0).tolist():
                left.append(k)
                right.append(j)
        for at in range(0, len(left), 20_000):
            ks, js = left[at : at + 20_000], np.array(right[at : at + 20_000])
            share = pair_kernels([source[k][1] for k in ks], [self.landmarks[j] for j in js.tolist()]) / self.own[js]
            for p in np.flatnonzero(share >= LEAST).tolist():
                row = self.near.setdefault(source[ks[p]][0], np.zeros(len(self.landmarks)))
                row[js[p]] = max(row[js[p]], min(float(share[p]), 1.5))

    def sentences(self, text: str) -> tuple[int, np.ndarray]:
        """How many sentences a text has, and the kernel rows of those near a landmark; its words must have been learnt."""
        low = text.lower()
        spelled = _spelled(low)
        if self.near.keys().isdisjoint(low.split()) and self.near.keys().isdisjoint(spelled):
            return low.count(".") + low.count("\n") + 1, np.zeros((0, len(self.landmarks)))
        parts = [p for p in _SENTENCES.split(low) if p.strip()]
        rows = []
        for p in parts:
            hits = [self.near[w] for w in (*p.split(), *(_spelled(p) if spelled else ())) if w in self.near]
            if hits:
                rows.append(np.max(hits, axis=0))
        return max(len(parts), 1), np.array(rows).reshape(-1, len(self.landmarks))

    def marks(self, rows: np.ndarray) -> np.ndarray:
        return rows @ self.root @ self.w + self.b

    def pooled(self, n: int, rows: np.ndarray) -> list[float]:
        f = self.marks(rows)
        hits = np.clip(f + 1, 0, 2).sum() / 2 if len(f) else 0.0
        return [f.max() if len(f) else self.b, np.log1p(hits), hits / n, np.log1p(n)]

    def scores(self, texts: list[str]) -> np.ndarray:
        texts = [t or "" for t in texts]
        out = np.zeros(len(texts))
        at = 0
        while at < len(texts):
            end, chars = at, 0
            while end < len(texts) and (end == at or chars < 1_000_000):
                chars += len(texts[end])
                end += 1
            self.learn(set().union(*((x := t.lower()).split() + _spelled(x) for t in texts[at:end])))
            z = np.array([self.pooled(*self.sentences(t)) for t in texts[at:end]])
            out[at:end] = 1 / (1 + np.exp(-np.clip(z / self.scale @ self.doc[1:] + self.doc[0], -50, 50)))
            at = end
        return out


def _spelled(low: str) -> list[str]:
    """Words spelled out with a space after each character, joined."""
    return [m.replace(" ", "").replace("\t", "") for m in _SPELLED.findall(low)]


def choose_landmarks(texts: list[str], toxic: np.ndarray, most: int = LANDMARKS) -> list[str]:
    """Words and word beginnings that tell toxic texts apart, none too near another."""
    counts = [Counter(), Counter()]
    for text, y in zip(texts, toxic.tolist(), strict=True):
        low = text.lower()
        found = set()
        for word in set(low.split()) | set(_spelled(low)):
            word = unit(word)[0]
            if len(word) > 5:
                found.add(word)
                found.update(word[:k] for k in range(5, min(len(word) - 1, 10)))
        counts[y].update(found)
    n1, n0 = int(toxic.sum()) + 1, int((1 - toxic).sum()) + 1
    ranked = []
    for piece, a in counts[1].items():
        b = counts[0][piece]
        odds = np.log((a + 0.5) / n1 / ((b + 0.5) / n0))
        if a >= 4 and odds > 1.0:
            ranked.append((-round(a * odds, 3), -len(piece), piece))
    chosen: list[str] = []
    for strength, _, piece in sorted(ranked)[:400]:
        if len(chosen) == most or -strength < max(8.0, 0.06 * n1):  # weaker ones also come up by chance
            break
        if any(c.startswith(piece) for c in chosen):
            continue
        if chosen:
            both = pair_kernels([piece] * len(chosen), chosen)
            own = pair_kernels([piece], [piece])[0] * pair_kernels(chosen, chosen)
            if (both / np.sqrt(own)).max() > 0.8:
                continue
        chosen.append(piece)
    return chosen


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float = 1e-3, steps: int = 1500) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the weighted squared hinge loss."""
    w, b = np.zeros(x.shape[1]), 0.0
    share = weight / weight.sum()
    step = 1.0 / (cost + 2 * (share[:, None] * (x * x)).sum() + 2)
    vw, vb = w, b
    for k in range(steps):
        slack = np.maximum(0, 1 - y * (x @ vw + vb))
        g = -2 * share * y * slack
        nw, nb = vw - step * (x.T @ g + cost * vw), vb - step * g.sum()
        vw, vb = nw + k / (k + 3) * (nw - w), nb + k / (k + 3) * (nb - b)
        w, b = nw, nb
    return w, b


def _logistic(z: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    x = np.column_stack([np.ones(len(z)), z])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * len(y) * np.eye(len(w)) * 0.1 + 1e-9 * np.eye(len(w))
        d = np.linalg.solve(h, x.T @ (p - y) + ridge * 0.1 * len(y) * w)
        w = w - d
        if np.abs(d).max() < 1e-6:
            break
    return w


def train(texts: list[str], toxic: np.ndarray) -> Scorer:
    toxic = toxic.astype(int)
    if len(set(toxic.tolist())) < 2:
        return Scorer([])
    s = Scorer(choose_landmarks(texts, toxic))
    if not s.landmarks:
        return s
    rows, labels, docs = [], [], []
    for text, y in zip(texts, toxic.tolist(), strict=True):
        low = text.lower()
        s.learn(set(low.split()) | set(_spelled(low)))
        n, near = s.sentences(text)
        docs.append((n, near))
        rows.append(near)
        labels += [2 * y - 1] * len(near)
    x = np.concatenate([*rows, np.zeros((1, len(s.landmarks)))]) @ s.root
    y = np.array([*labels, -1.0])
    weight = np.ones(len(y))
    weight[-1] = max(1.0, 0.2 * len(y))
    s.w, s.b = _svm(x, y, weight)
    z = np.array([s.pooled(*d) for d in docs])
    s.scale = z.std(axis=0) + 1e-6
    s.doc = _logistic(z / s.scale, toxic)
    return s


def fit(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", toxic: str = "toxic", sample: int = SAMPLE_DOCS) -> Scorer:
    """A scorer from at most ``sample`` labelled documents of at most ``SAMPLE_CHARS`` characters, chosen by a hash of their ids."""
    ids = labels.where(F.col(toxic).isin(0, 1) & F.col(id_column).isNotNull()).select(F.col(id_column).alias("label_id"), F.col(toxic).cast("int").alias("toxic"))
    ids = ids.orderBy(F.xxhash64("label_id"), "label_id", "toxic").limit(sample)
    texts = docs.where(F.col(text).isNotNull() & (F.length(text) <= SAMPLE_CHARS)).select(F.col(id_column).alias("doc_id"), F.col(text).alias("text"))
    rows = texts.join(F.broadcast(ids), texts["doc_id"] == ids["label_id"]).select("doc_id", "text", "toxic").collect()  # the sample's size bounds both sides
    rows.sort(key=lambda r: (r["doc_id"], r["text"], r["toxic"]))
    return train([r["text"] for r in rows], np.array([r["toxic"] for r in rows], int))


def score(scorer: Scorer, text: Column) -> Column:
    """The probability that a text is toxic."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        lean()
        for batch in batches:
            yield pd.Series(np.concatenate([np.zeros(0), *(scorer.scores(batch.iloc[at : at + 500].tolist()) for at in range(0, len(batch), 500))]))

    return F.pandas_udf(run, "double")(text)
