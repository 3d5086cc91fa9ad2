"""Operator 3: quality classifier on averaged hashed word and character n-gram vectors."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ledgerloom.llm.hashing import mix, word_hashes
from ledgerloom.llm.labels import fetch_features, labelled_sample
from ledgerloom.llm.runtime import arrow_map, arrow_score, utf8_bytes

_STEP = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Features:
    """Hashed features of a text: half of the buckets for word n-grams, half for character n-grams."""

    bits: int = 18
    char_orders: tuple[int, ...] = (3, 4, 5)
    repeat_orders: tuple[int, ...] = (2, 3)

    @property
    def size(self) -> int:
        return 1 << self.bits

    def _bucket(self, h: np.ndarray, family: int) -> np.ndarray:
        return (h >> np.uint64(65 - self.bits)).astype(np.int32) + family * (self.size >> 1)

    def words(self, text: bytes) -> np.ndarray:
        """Buckets of words and word pairs; each n-gram that the text had before also counts as one shared repeat feature of its order."""
        h = word_hashes(text.split())
        out = [self._bucket(mix(h), 0)]
        grams = h
        for order in range(2, max(2, *self.repeat_orders) + 1):
            if len(h) < order:
                break
            grams = mix(grams[: len(h) - order + 1]) * _STEP + h[order - 1 :]
            if order == 2:
                out.append(self._bucket(mix(grams), 0))
            if order in self.repeat_orders:
                again = len(grams) - len(np.unique(grams))
                out.append(np.full(again, order, np.int32))
        return np.concatenate(out)

    def chars(self, text: bytes) -> np.ndarray:
        """Buckets of byte n-grams within words, a space at either end standing for the word's border."""
        raw = b" " + text + b" "
        b = np.frombuffer(raw, np.uint8)
        blank = (b <= 32)
        codes = np.where(blank, np.uint8(32), b).astype(np.uint64)
        inner = np.cumsum(blank)
        out = []
        for order in self.char_orders:
            n = len(b) - order + 1
            if n <= 0:
                break
            h = np.full(n, np.uint64(order))
            for k in range(order):
                h = h * _STEP + codes[k : n + k]
            whole = inner[order - 2 : n + order - 2] == inner[:n]  # no blank strictly inside
            out.append(self._bucket(mix(h[whole]), 1))
        return np.concatenate(out) if out else np.empty(0, np.int32)

    def sparse(self, text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
        """Distinct buckets and weights; each family's weights add up to one half."""
        ids, weights = [], []
        if text:
            for part in (self.words(text), self.chars(text)):
                if len(part):
                    u, c = np.unique(part, return_counts=True)
                    ids.append(u)
                    weights.append((0.5 / len(part)) * c)
        return (np.concatenate(ids), np.concatenate(weights).astype(np.float32)) if ids else (np.empty(0, np.int32),
            np.empty(0, np.float32))


@dataclass
class SubwordClassifier:
    """Softmax over the average of learned n-gram vectors."""

    features: Features
    vectors: np.ndarray  # bucket, dim
    output: np.ndarray  # dim, 2
    bias: np.ndarray

    @classmethod
    def fit(cls, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, features: Features, *, dim: int = 8,
        epochs: int = 12, rate: float = 4.0, seed: int = 11) -> SubwordClassifier:
        """Stochastic gradient descent with a rate that falls linearly, one document at a time."""
        rng = np.random.default_rng(seed)
        vectors = rng.uniform(-1 / dim, 1 / dim, (features.size, dim)).astype(np.float32)
        output = rng.normal(0, 0.5, (dim, 2)).astype(np.float32)
        share = np.clip(np.bincount(labels, minlength=2) / max(len(labels), 1), 1e-3, 1)
        bias = np.log(share / share.sum()).astype(np.float32)
        steps, done = max(1, epochs * len(rows)), 0
        for _ in range(epochs):
            for k in rng.permutation(len(rows)):
                ids, weights = rows[k]
                lr = rate * (1 - done / steps)
                done += 1
                own = vectors[ids]
                hidden = weights @ own
                z = hidden @ output + bias
                p = np.exp(z - z.max())
                p /= p.sum()
                p[labels[k]] -= 1
                back = output @ p
                output -= (0.1 * lr) * np.outer(hidden, p)
                bias -= (0.02 * lr) * p
                vectors[ids] = own - lr * np.outer(weights, back)
        return cls(features, vectors, output, bias)

    def projected(self) -> tuple[np.ndarray, float]:
        """What each bucket adds to the log odds of label 1: averaging and the output are linear, so this is exact."""
        return self.vectors @ (self.output[:, 1] - self.output[:, 0]), float(self.bias[1] - self.bias[0])


def train(docs: DataFrame, labels: DataFrame, label: str, *, id_col: str, text_col: str, limit: int, where=None,
    features: Features = Features()) -> SubwordClassifier:  # noqa: B008
    """Fit on at most ``limit`` labelled documents; their sparse features, bounded in number, are made on the executors."""

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [features.sparse(t) for t in utf8_bytes(batch.column("__text"))]
        return pa.RecordBatch.from_arrays(
            [batch.column("__id"), batch.column("label"), pa.array([r[0] for r in rows], pa.list_(pa.int32())),
                pa.array([r[1] for r in rows], pa.list_(pa.float32()))],
            names=["__id", "label", "ids", "weights"])

    sample = labelled_sample(docs, labels, label, id_col=id_col, text_col=text_col, limit=limit, where=where)
    got, order = fetch_features(arrow_map(sample, fn, "__id bigint, label int, ids array<int>, weights array<float>"))
    rows = [(got["ids"][k].values.to_numpy(), got["weights"][k].values.to_numpy()) for k in order]
    return SubwordClassifier.fit(rows, got["label"].to_numpy().astype(int)[order], features)


def score_quality(
    docs: DataFrame, labels: DataFrame, *, label: str = "quality", id_col: str = "doc_id", text_col: str = "text",
    limit: int = 4000, where=None, threshold: float = 0.7,
    keep_columns: bool = False,
) -> DataFrame:
    """Per row: ``id_col``, ``score`` (probability of label 1, double) and ``predicted`` (1 from ``threshold`` on);
    with ``keep_columns`` beside all columns of ``docs``.

    The model is fitted on at most ``limit`` rows of ``labels`` (doc_id, ``label``) that ``where`` admits, chosen by a hash of
    the id; it is a fixed 2**18 buckets, whatever the corpus. Every whole text is then scored in one pass without a shuffle.
    Only the text enters a score.

    Defined cases: null and empty texts score the bias alone; very long texts are read whole; a score equal to ``threshold`` counts as 1; a null id stays
    null; repeated rows score alike; without usable labels every score is 0.5;
    other columns are ignored; no rows give no rows.
    """
    model = train(docs, labels, label, id_col=id_col, text_col=text_col, limit=limit, where=where)
    gain, bias = model.projected()
    shared, features = docs.sparkSession.sparkContext.broadcast(gain), model.features

    def fn(texts: list[bytes | None]) -> list[pa.Array]:
        g = shared.value
        z = np.full(len(texts), bias)
        for k, text in enumerate(texts):
            if text:
                for part in (features.words(text), features.chars(text)):
                    if len(part):
                        z[k] += 0.5 * float(g[part].mean(dtype=np.float64))
        score = 1 / (1 + np.exp(-z))
        return [pa.array(score), pa.array((score >= threshold).astype(np.int32))]

    return arrow_score(docs, fn, [("score", "double"), ("predicted", "int")], id_col=id_col, text_col=text_col,
        keep_columns=keep_columns)
