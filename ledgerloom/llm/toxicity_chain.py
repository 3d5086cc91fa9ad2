"""Operator 4: toxicity by a chain of linear classifiers over hashed word and prefix features."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ledgerloom.llm.hashing import mix, word_hashes
from ledgerloom.llm.labels import fetch_features, labelled_sample
from ledgerloom.llm.runtime import arrow_map, arrow_score, utf8_bytes

_STEP = np.uint64(0x9E3779B97F4A7C15)

#: Kinds of toxic text that the chain predicts before it predicts toxicity.
KINDS = 4


@dataclass(frozen=True)
class Presence:
    """Which hashed words and word beginnings a text has."""

    bits: int = 20
    prefixes: tuple[int, ...] = (3, 4, 5, 6, 8)

    def of(self, text: bytes | None) -> np.ndarray:
        """Distinct buckets; case of A-Z and the punctuation around words do not count."""
        if not text:
            return np.empty(0, np.int32)
        shift = np.uint64(64 - self.bits)
        low = text.lower()
        b = np.frombuffer(low + b" " * max(self.prefixes), np.uint8)
        letter = (b >= 128) | ((b >= 97) & (b <= 122)) | ((b >= 48) & (b <= 57))
        edge = np.flatnonzero(np.diff(letter.astype(np.int8), prepend=np.int8(0)))
        starts, ends = edge[::2], edge[1::2]
        if not len(starts):
            return np.empty(0, np.int32)
        size = ends - starts
        out = [(mix(word_hashes([low[a:z] for a, z in zip(starts.tolist(), ends.tolist(), strict=True)])) >> shift)]
        h = np.full(len(starts), np.uint64(17))
        for k in range(max(self.prefixes)):
            h = h * _STEP + b[np.minimum(starts + k, len(b) - 1)]
            if k + 1 in self.prefixes:
                out.append(mix(h[size > k] + np.uint64(k)) >> shift)
        return np.unique(np.concatenate(out)).astype(np.int32)


def _pairs(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.repeat(np.arange(len(rows), dtype=np.int32), [len(r) for r in rows]), np.concatenate(rows)


def informative(owner: np.ndarray, ids: np.ndarray, y: np.ndarray, width: int, most: int, least_g: float) -> np.ndarray:
    """The buckets, at most ``most``, that tell the labels apart: by likelihood-ratio statistic, from ``least_g`` on, in four rows or more."""
    n1 = int(y.sum())
    n0 = len(y) - n1
    c1 = np.bincount(ids[y[owner] == 1], minlength=width)
    c0 = np.bincount(ids, minlength=width) - c1
    g = np.zeros(width)
    for part, whole in ((c1, n1), (c0, n0)):
        expected = (c1 + c0) * (whole / len(y))
        for seen, mean in ((part, expected), (whole - part, whole - expected)):
            g += 2 * seen * np.log(np.where(seen > 0, seen, 1) / np.maximum(np.where(seen > 0, mean, 1), 1e-9))
    g[c1 + c0 < 4] = 0
    chosen = np.argsort(-g, kind="stable")[:most]
    return np.sort(chosen[g[chosen] >= least_g])


def _spherical(x: np.ndarray, parts: int, rounds: int = 20) -> np.ndarray:
    """The part of each row of ``x`` (unit length or zero) by k-means on directions; centres start farthest first."""
    centres = x[[int(np.argmax(x @ x.mean(axis=0)))]]
    while len(centres) < parts:
        nearest = (x @ centres.T).max(axis=1)
        far = int(np.argmin(np.where(x.any(axis=1), nearest, 2.0)))
        if nearest[far] > 1 - 1e-9:
            break
        centres = np.vstack([centres, x[far]])
    for _ in range(rounds):
        part = (x @ centres.T).argmax(axis=1)
        sums = np.stack([x[part == k].sum(axis=0) for k in range(len(centres))])
        moved = np.where(sums.any(axis=1, keepdims=True),
            sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12), centres)
        if np.allclose(moved, centres):
            break
        centres = moved
    return (x @ centres.T).argmax(axis=1)


def manners_of(owner: np.ndarray, ids: np.ndarray, n: int, width: int, parts: int = 6, common: int = 128) -> np.ndarray:
    """Groups of ``n`` rows that share their commonest buckets, and so by and large a language."""
    top = np.argsort(-np.bincount(ids, minlength=width), kind="stable")[:common]
    place = np.full(width, -1)
    place[top] = np.arange(common)
    x = np.zeros((n, common))
    hit = place[ids] >= 0
    x[owner[hit], place[ids[hit]]] = 1
    return _spherical(x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12), parts)


def _standing(values: np.ndarray, group: np.ndarray) -> np.ndarray:
    """The share of its group that stands below each value, equal ones in order."""
    out = np.zeros(len(values))
    for k in np.unique(group):
        own = np.flatnonzero(group == k)
        out[own[np.argsort(values[own], kind="stable")]] = (np.arange(len(own)) + 0.5) / len(own)
    return out


def kinds_of(rows: list[np.ndarray], y: np.ndarray, width: int, kinds: int) -> np.ndarray:
    """The kind of each row that ``y`` marks, -1 for others: how long it is and how densely it shows what tells the labels apart.

    Both are taken relative to the marked rows of the row's own group (``manners_of``), so a kind is no language. There are two degrees
    of density and half as many of length as there are ``kinds``: an even number is a shorter or longer text with passing marks, an odd one a text
    full of them.
    """
    out = np.full(len(y), -1)
    marked = np.flatnonzero(y == 1)
    if not len(marked) or len(marked) == len(y):
        out[marked] = 0
        return out
    owner, ids = _pairs(rows)
    chosen = informative(owner, ids, y, width, 256, 12.0)
    share = lambda k: np.bincount(ids[y[owner] == k], minlength=width)[chosen] / max((y == k).sum(), 1)
    telling = np.zeros(width, bool)
    telling[chosen[share(1) > share(0)]] = True
    group = manners_of(owner, ids, len(rows), width)[marked]
    size = np.array([len(rows[k]) for k in marked], float)
    dense = np.array([telling[rows[k]].sum() for k in marked]) / np.maximum(size, 1)
    lengths = (_standing(size, group) * max(kinds // 2, 1)).astype(int)
    out[marked] = np.minimum(2 * lengths + (_standing(dense, group) > 0.5), kinds - 1)
    return out


class LinearModel:
    """Logistic regression on the features that tell the classes apart, plus the chain's earlier probabilities."""

    def __init__(self, width: int, chosen: np.ndarray, weights: np.ndarray, chain: np.ndarray, bias: float):
        self.width, self.chosen, self.weights, self.chain, self.bias = width, chosen, weights, chain, bias

    @classmethod
    def fit(cls, rows: list[np.ndarray], extra: np.ndarray, y: np.ndarray, width: int, *, most: int = 256,
        least_g: float = 12.0, ridge: float = 0.3, steps: int = 25) -> LinearModel:
        """Features are ranked by their likelihood-ratio statistic on these rows alone; weights come from Newton steps on the ridge-penalised likelihood."""
        n1 = int(y.sum())
        n0 = len(y) - n1
        if not n1 or not n0:
            return cls(width, np.empty(0, np.int64), np.empty(0), np.zeros(extra.shape[1]), 8.0 if n1 else -8.0)
        owner, ids = _pairs(rows)
        chosen = informative(owner, ids, y, width, most, least_g)
        place = np.full(width, -1)
        place[chosen] = np.arange(len(chosen))
        x = np.zeros((len(rows), len(chosen) + extra.shape[1] + 1))
        hit = place[ids] >= 0
        x[owner[hit], place[ids[hit]]] = 1
        x[:, len(chosen) : -1] = extra
        x[:, -1] = 1
        penalty = np.r_[np.full(x.shape[1] - 1, ridge), 1e-6]
        w = np.zeros(x.shape[1])
        w[-1] = np.log(n1 / n0)
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            grad = x.T @ (p - y) + penalty * w
            move = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-9), grad)
            w -= move * min(1.0, 4 / max(np.abs(move).max(), 1e-12))
            if np.abs(move).max() < 1e-3:
                break
        m = len(chosen)
        return cls(width, chosen, w[:m], w[m:-1], float(w[-1]))

    def table(self) -> np.ndarray:
        """The weight of every bucket."""
        out = np.zeros(self.width, np.float32)
        out[self.chosen] = self.weights
        return out

    def probability(self, sums: np.ndarray, extra: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(sums + extra @ self.chain + self.bias, -30, 30)))


class ClassifierChain:
    """One linear model per category; each sees the probabilities of the categories before it.

    In training those probabilities are out-of-fold: they come from models that did not see the row, as they will not have
    seen a new text.
    """

    def __init__(self, width: int, models: list[LinearModel]):
        self.models = models
        self.tables = np.stack([m.table() for m in models], axis=1) if models else np.zeros((width, 0), np.float32)

    @classmethod
    def fit(cls, rows: list[np.ndarray], targets: np.ndarray, width: int, folds: int = 5) -> ClassifierChain:
        fold = np.arange(len(rows)) % folds
        extra, models = np.zeros((len(rows), 0)), []
        for c in range(targets.shape[1]):
            y = targets[:, c]
            models.append(LinearModel.fit(rows, extra, y, width))
            if c + 1 == targets.shape[1]:
                break
            oof = np.zeros(len(rows))
            for f in range(folds):
                test = np.flatnonzero(fold == f)
                train = np.flatnonzero(fold != f)
                if not len(test):
                    continue
                m = LinearModel.fit([rows[k] for k in train], extra[train], y[train], width)
                t = m.table()
                oof[test] = m.probability(np.array([t[rows[k]].sum() for k in test]), extra[test])
            extra = np.column_stack([extra, oof])
        return cls(width, models)

    def predict(self, rows: list[np.ndarray]) -> np.ndarray:
        sums = np.array([self.tables[r].sum(axis=0) for r in rows]).reshape(len(rows), -1)
        p = np.zeros((len(rows), 0))
        for k, m in enumerate(self.models):
            p = np.column_stack([p, m.probability(sums[:, k], p)])
        return p


def train(docs: DataFrame, labels: DataFrame, *, label: str, id_col: str, text_col: str, limit: int, where=None,
    kinds: int = KINDS, features: Presence = Presence()) -> ClassifierChain:  # noqa: B008
    """Fit the chain on at most ``limit`` labelled documents, whose features, bounded in number, are made on the executors."""

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [features.of(t) for t in utf8_bytes(batch.column("__text"))]
        return pa.RecordBatch.from_arrays([batch.column("__id"), batch.column("label"), pa.array(found, pa.list_(pa.int32()))],
            names=["__id", "label", "ids"])

    sample = labelled_sample(docs, labels, label, id_col=id_col, text_col=text_col, limit=limit, where=where)
    got, order = fetch_features(arrow_map(sample, fn, "__id bigint, label int, ids array<int>"))
    rows, y = [got["ids"][k].values.to_numpy() for k in order], got["label"].to_numpy().astype(np.int64)[order]
    width = 1 << features.bits
    kind = kinds_of(rows, y, width, kinds) if rows else np.empty(0, np.int64)
    targets = np.column_stack([*((kind == k).astype(np.int64) for k in range(kinds)), y])
    return ClassifierChain.fit(rows, targets, width)


def score_toxicity(
    docs: DataFrame, labels: DataFrame, *, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text",
    limit: int = 6000, where=None,
    threshold: float = 0.3, kinds: int = KINDS, keep_columns: bool = False,
) -> DataFrame:
    """Per row: ``id_col``, a probability ``p_kind_<k>`` for each kind of toxic text and ``p_toxic``, ``score`` (the last one),
    ``predicted`` (1 if it reaches ``threshold``) and ``kept`` (the opposite); with ``keep_columns`` beside all columns of ``docs``.

    The labels have one bit, so the finer categories come from the data: the toxic training texts fall into ``kinds`` kinds by their
    length and by how densely they show what is telling, both relative to texts of their own language group (``kinds_of``). The chain
    predicts kind after kind and then toxicity.
    It is fitted on at most ``limit`` rows of ``labels`` (doc_id, ``label``), chosen by a hash of the id; its tables have a
    fixed 2**20 buckets. Every whole text is then scored in one pass, without a shuffle. Only the text enters a score.

    Defined cases: null and empty texts have no features and score the bias; very long texts are read whole, their features being at most the
    buckets; equal scores are treated alike (a score equal to ``threshold`` is toxic); a null id stays null; repeated rows score alike; a category without both
    kinds of training rows is constant; other columns are ignored; no rows give no rows.
    """
    features = Presence()
    chain = train(docs, labels, label=label, id_col=id_col, text_col=text_col, limit=limit, where=where, kinds=kinds,
        features=features)
    shared = docs.sparkSession.sparkContext.broadcast(chain)

    def fn(texts: list[bytes | None]) -> list[pa.Array]:
        p = shared.value.predict([features.of(t) for t in texts])
        hit = p[:, -1] >= threshold
        return [*(pa.array(p[:, k]) for k in range(p.shape[1])), pa.array(p[:, -1]), pa.array(hit.astype(np.int32)),
            pa.array(~hit)]

    fields = [*((f"p_kind_{k + 1}", "double") for k in range(kinds)), ("p_toxic", "double"), ("score", "double"),
        ("predicted", "int"), ("kept", "boolean")]
    return arrow_score(docs, fn, fields, id_col=id_col, text_col=text_col, keep_columns=keep_columns)
