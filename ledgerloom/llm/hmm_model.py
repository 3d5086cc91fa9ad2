"""Operator 9: a hidden Markov language model over words, trained by Baum-Welch on all training texts."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.hashing import words_of
from ledgerloom.llm.labels import crc_of_id
from ledgerloom.llm.runtime import arrow_map, hash_sample, id_and_text, materialize, ship, utf8_bytes

#: Tokens whose forward and backward values are in memory at once.
BLOCK_TOKENS = 250_000
#: Distinct words a task counts before it passes them on.
COUNT_LIMIT = 250_000


@dataclass
class Hmm:
    """``start`` (states), ``move`` (states, states), ``emit`` (symbols, states); each distribution adds up to 1."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray


class Sequences:
    """A block of symbol sequences laid out by time: all first symbols, all second ones, and so on, longest sequence first."""

    def __init__(self, parts: list[np.ndarray]):
        lens = np.array([len(p) for p in parts])
        self.order = np.argsort(-lens, kind="stable")
        lens = lens[self.order]
        self.active = np.searchsorted(-lens, -np.arange(lens[0]), side="left")  # sequences longer than t
        self.at = np.concatenate([[0], np.cumsum(self.active)])
        times = np.concatenate([np.arange(n) for n in lens])
        self.rank = np.repeat(np.arange(len(parts)), lens)
        place = self.at[times] + self.rank
        self.symbols = np.empty(len(place), np.int64)
        self.symbols[place] = np.concatenate([parts[k] for k in self.order])
        owner = np.empty(len(place), np.int64)
        owner[place] = self.order[self.rank]
        self.owner, self.n = owner, len(parts)

    def forward(self, m: Hmm) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scaled forward recursion: normalised values, scales, and emissions of each token."""
        em = m.emit[self.symbols]
        alpha, scale = np.empty_like(em), np.empty(len(em), em.dtype)
        for t, n in enumerate(self.active):
            a = self.at[t]
            prior = m.start if t == 0 else alpha[self.at[t - 1] : self.at[t - 1] + n] @ m.move
            now = prior * em[a : a + n]
            s = now.sum(axis=1)
            scale[a : a + n] = s
            alpha[a : a + n] = now / s[:, None]
        return alpha, scale, em

    def likelihoods(self, m: Hmm) -> np.ndarray:
        """log10 probability of each sequence, exactly: the sum of the logs of the scales."""
        _, scale, _ = self.forward(m)
        return np.bincount(self.owner, np.log10(scale), self.n)

    def expected(self, m: Hmm) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Baum-Welch counts of starts, moves and (symbol, state) emissions."""
        alpha, scale, em = self.forward(m)
        moves = np.zeros(m.move.shape)
        beta = np.ones_like(alpha)
        for t in range(len(self.active) - 2, -1, -1):
            a, b, n = self.at[t], self.at[t + 1], self.active[t + 1]
            ahead = em[b : b + n] * beta[b : b + n] / scale[b : b + n, None]
            beta[a : a + n] = ahead @ m.move.T
            moves += alpha[a : a + n].T @ ahead
        alpha *= beta
        emits = np.stack([np.bincount(self.symbols, alpha[:, s], len(m.emit)) for s in range(alpha.shape[1])], axis=1)
        return alpha[: self.active[0]].sum(axis=0, dtype=np.float64), moves * m.move, emits


def blocks(parts: list[np.ndarray]) -> Iterator[list[np.ndarray]]:
    """Blocks of about ``BLOCK_TOKENS``; sequences of like length share one, so that few steps have few sequences."""
    held, size = [], 0
    for p in sorted(parts, key=len):
        held.append(p)
        size += len(p)
        if size >= BLOCK_TOKENS:
            yield held
            held, size = [], 0
    if held:
        yield held


def updated(start: np.ndarray, moves: np.ndarray, emits: np.ndarray, base: np.ndarray, prior: float) -> Hmm:
    """The model of expected counts; emissions lean on the unigram distribution ``base`` by ``prior`` counts."""
    s = len(start)
    return Hmm((start + 0.1) / (start.sum() + 0.1 * s), (moves + 0.1) / (moves.sum(axis=1, keepdims=True) + 0.1 * s),
        (emits + prior * base[:, None]) / (emits.sum(axis=0) + prior))


def first_model(parts: list[np.ndarray], base: np.ndarray, states: int, prior: float, rounds: int, seed: int) -> Hmm:
    """A starting point: Baum-Welch on a bounded sample, from random emissions and sticky states."""
    rng = np.random.default_rng(seed)
    move = np.full((states, states), 0.1 / max(states - 1, 1)) if states > 1 else np.ones((1, 1))
    if states > 1:
        np.fill_diagonal(move, 0.9)
    emit = base[:, None] * rng.uniform(0.3, 1.7, (len(base), states))
    m = Hmm(np.full(states, 1 / states), move, emit / emit.sum(axis=0))
    for _ in range(rounds if parts else 0):
        totals = [sum(x) for x in zip(*(Sequences(b).expected(m) for b in blocks(parts)), strict=True)]
        m = updated(*totals, base, prior)
    return m


class Places(dict):
    """Places of words in the dictionary, -1 for others."""

    def __missing__(self, word: bytes) -> int:
        return -1


@dataclass(frozen=True)
class Symbols:
    """0 is the end; then ``top`` frequent words; then ``classes`` classes of all other words by their first and last two bytes."""

    top: int
    classes: int

    @property
    def size(self) -> int:
        return 1 + self.top + self.classes

    def of_class(self, word: bytes) -> int:
        return 1 + self.top + zlib.crc32(word[:2] + word[-2:]) % self.classes


def word_counts(rows: DataFrame, symbols: Symbols) -> DataFrame:
    """(word, class, c): counts over all rows, combined in each task and then by word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def flush() -> Iterator[pa.RecordBatch]:
            words = list(counts)
            for a in range(0, len(words), 50_000):
                w = words[a : a + 50_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(w, pa.binary()).cast(pa.string()),
                        pa.array([symbols.of_class(x) for x in w], pa.int32()),
                        pa.array([counts[x] for x in w], pa.int64())], names=["word", "class", "c"])
            counts.clear()

        for batch in batches:
            for text in utf8_bytes(batch.column("__text")):
                counts.update(words_of(text))
                if len(counts) >= COUNT_LIMIT:
                    yield from flush()
        yield from flush()

    ship(rows.sparkSession)
    return rows.mapInArrow(run,
        "word string, class int, c bigint").groupBy("word").agg(F.first("class").alias("class"), F.sum("c").alias("c"))


def _level(count: Column) -> Column:
    """A bucket of counts: exact below 64, then 32 to each power of two."""
    shift = F.greatest(F.length(F.bin(count)) - 6, F.lit(0))
    return (shift * 32 + F.call_function("shiftright", count, shift)).cast("int")


def most_frequent(counts: DataFrame, limit: int) -> pa.Table:
    """(word, c) of at most ``limit`` words, the most frequent first; of the words at the last level of counts, those of the smallest hash.

    A histogram of the counts (under 2,000 rows) tells where to cut, so what is sorted and sent is no more than the result.
    """
    levels = counts.groupBy(_level(F.col("c")).alias("level")).agg(F.count("*")
        .alias("n")).orderBy(F.desc("level")).collect()
    above, cut, at_cut = 0, None, 0
    for r in levels:
        if above + r.n > limit:
            cut, at_cut = r.level, r.n
            break
        above += r.n
    if cut is None:
        found = counts.select("word", "c").toArrow()
    else:
        level = _level(F.col("c"))
        edge = hash_sample(counts.where(level == cut).select("word", "c"), limit - above, at_cut, "word")
        found = counts.where(level > cut).select("word", "c").union(edge).toArrow()
    return found.sort_by([("c", "descending"), ("word", "ascending")])


def train_and_score(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", held_out=None, states: int = 8,
    top: int = 8192, classes: int = 2048,
    dictionary: int = 200_000, longest: int = 64, sample_rows: int = 1500, sample_rounds: int = 15, rounds: int = 3,
    prior: float = 200.0, seed: int = 3,
) -> DataFrame:
    """Score whole texts by a word HMM learned from those that are not ``held_out``.

    Tokens are the words, A-Z lower-cased, and one end. Returns ``id_col``, ``held_out``, ``n_tokens``, ``n_known``,
    ``train_tokens`` (N), ``base_score`` (log10 of the add-one unigram probability) and ``score`` (log10 of the model's).

    1. Words of all training texts are counted: in tasks, then by word. N and V are exact.
    2. The ``dictionary`` most frequent words (of up to ``longest`` bytes, so of a bounded size; found by a histogram of the counts) are broadcast. Each text becomes symbols of the
       HMM; its words outside of the dictionary are joined with the counts.
    3. The HMM starts from Baum-Welch on ``sample_rows`` texts, by a hash of id and symbols; then ``rounds`` rounds add
       up the expected counts of every training text, summed by (symbol, state) over all partitions.
    4. The scaled forward recursion gives each text's exact likelihood.

    A word that is no symbol itself has the probability of its class given the state times its share of the class's
    add-one counts, where one share is left for words never seen. So each state's distribution adds up to 1.

    Defined cases: null and empty texts are one end token; very long texts are scored whole; a null id is not held out and stays null; repeated rows count each; without
    training rows all tokens are unknown; other columns are ignored; no rows give no rows.
    """
    spark = docs.sparkSession
    held = F.coalesce(F.pmod(crc_of_id("__id"), F.lit(7)) == 2, F.lit(False)) if held_out is None else held_out
    symbols = Symbols(top, classes)
    rows = id_and_text(docs, id_col, text_col).withColumn("held", held)
    counts = materialize(word_counts(rows.where("not held"), symbols), "word-counts")
    ends = rows.where("not held").count()
    n_words, v_words = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    n_all, v_all = n_words + ends, v_words + (ends > 0)
    denominator = n_all + v_all + 1

    frequent = most_frequent(counts.where(F.octet_length("word") <= longest), dictionary)
    words = frequent["word"].cast(pa.large_binary()).to_pylist()
    known = frequent["c"].to_numpy().astype(np.int64)
    # a class's add-one total, over its words that are no symbols themselves, and one share for unseen words
    totals = np.ones(classes, np.int64)
    for r in counts.groupBy("class").agg(F.sum(F.col("c") + 1).alias("t")).collect():  # at most ``classes`` rows
        totals[r["class"] - 1 - top] += r.t
    own_class = np.array([symbols.of_class(w) for w in words], np.int64)
    np.subtract.at(totals, own_class[:top] - 1 - top, known[:top] + 1)
    base = np.zeros(symbols.size)
    base[0] = ends + 1
    base[1 : 1 + len(known[:top])] = known[:top] + 1
    base[1 + top :] = totals
    base /= base.sum()
    symbol_of = own_class.copy()
    symbol_of[:top] = 1 + np.arange(len(words[:top]))
    base_log = np.log10((known + 1) / denominator)
    share_log = np.where(np.arange(len(words)) < top, 0.0,
        np.log10((known + 1) / np.maximum(totals[own_class - 1 - top], 1)))
    book = spark.sparkContext.broadcast((words, symbol_of.astype(np.uint16), base_log, share_log))
    end_log, end_known = float(np.log10((ends + 1) / denominator)), int(ends > 0)
    cache: dict = {}

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if "index" not in cache:
            cache["index"] = Places((w, k) for k, w in enumerate(book.value[0]))
        index, (_, symbol, logs, shares) = cache["index"], book.value
        uid = TaskContext.get().partitionId() << 40
        for batch in batches:
            out = []
            for i, text, h in zip(batch.column("__id").to_pylist(), utf8_bytes(batch.column("__text")),
                batch.column("held").to_pylist(), strict=True):
                uid += 1
                tokens = words_of(text)
                at = np.fromiter(map(index.__getitem__, tokens), np.int64, len(tokens))
                seq = np.zeros(len(tokens) + 1, np.uint16)
                hit = at >= 0
                found = at[hit]
                seq[:-1][hit] = symbol[found]
                rare: Counter[bytes] = Counter()
                if len(found) < len(tokens):
                    missing = np.flatnonzero(~hit)
                    lost = [tokens[k] for k in missing.tolist()]
                    seq[missing] = [symbols.of_class(w) for w in lost]
                    rare.update(lost)
                words = list(rare)
                out.append((uid, i, h, len(tokens) + 1, len(found) + end_known, float(logs[found].sum()) + end_log,
                    float(shares[found].sum()), seq.tobytes(), words, [symbols.of_class(w) - 1 - top for w in words],
                    list(rare.values())))
            cols = list(zip(*out, strict=True))
            kinds = [pa.int64(), batch.column("__id").type, pa.bool_(), pa.int64(), pa.int64(), pa.float64(),
                pa.float64(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.list_(pa.int64())]
            arrays = [pa.array(c, t) for c, t in zip(cols, kinds, strict=True)]
            arrays[8] = arrays[8].cast(pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays(arrays,
                names=["uid", "id", "held", "n_tokens", "n_known", "base", "share", "seq", "words", "classes", "tf"])

    ship(spark)
    kind = rows.schema["__id"].dataType.simpleString()
    coded = materialize(rows.mapInArrow(encode,
        f"uid bigint, id {kind}, held boolean, n_tokens bigint, n_known bigint, base double, share double, seq binary, words array<string>, classes array<int>, tf array<bigint>"), "coded")
    texts = coded.drop("words", "classes", "tf")
    training = texts.where("not held").select("seq")

    sample = hash_sample(texts.where("not held").select("id", "seq"), sample_rows, ends, "id",
        "seq").toArrow()["seq"].to_pylist()
    model = first_model([np.frombuffer(s, np.uint16) for s in sample], base, states,
        prior * min(1.0, len(sample) / max(ends, 1)), sample_rounds, seed)
    if ends:
        for _ in range(rounds):
            model = updated(*expected_counts(training, model), base, prior)

    shared = spark.sparkContext.broadcast(model)

    def likelihood(batch: pa.RecordBatch) -> pa.RecordBatch:
        parts = [np.frombuffer(s, np.uint16) for s in batch.column("seq").to_pylist()]
        order = np.argsort([len(p) for p in parts], kind="stable")
        got = np.empty(len(parts))
        got[order] = np.concatenate([Sequences(b).likelihoods(shared.value) for b in blocks(parts)])
        rest = [c for c in batch.schema.names if c != "seq"]
        return batch.select(rest).append_column("forward", pa.array(got))

    scored = arrow_map(texts, likelihood,
        f"uid bigint, id {kind}, held boolean, n_tokens bigint, n_known bigint, base double, share double, forward double")
    class_totals = F.broadcast(
        spark.createDataFrame([(k, int(t)) for k, t in enumerate(totals)], "class int, total bigint"))
    c = F.coalesce("c", F.lit(0))
    each = coded.select("uid", F.inline(F.arrays_zip("words", "classes", "tf"))).toDF("uid", "word", "class", "tf")
    rare = (each.join(counts.select("word", "c"), "word", "left").join(class_totals, "class")
            .groupBy("uid").agg(
                F.sum(F.col("tf") * F.log10((c + 1) / F.lit(float(denominator)))).alias("rare_base"),
                F.sum(F.col("tf") * F.log10((c + 1) / F.col("total"))).alias("rare_share"),
                F.sum(F.when(c > 0, F.col("tf")).otherwise(0)).alias("rare_known")))
    zero = lambda x: F.coalesce(x, F.lit(0))
    return scored.join(rare, "uid", "left").select(
        F.col("id").alias(id_col), F.col("held").alias("held_out"), "n_tokens",
        (F.col("n_known") + zero("rare_known")).alias("n_known"), F.lit(n_all).cast("bigint").alias("train_tokens"),
        (F.col("base") + zero("rare_base")).alias("base_score"),
        (F.col("forward") + F.col("share") + zero("rare_share")).alias("score"))


def expected_counts(training: DataFrame, model: Hmm) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One Baum-Welch round: every task adds up its texts' counts, and the tasks' sums are added by (symbol, state).

    What reaches the driver is the size of the model.
    """
    states, size = len(model.start), len(model.emit)
    shared = training.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # single precision is enough for counts; they are added up in double
        m = Hmm(*(x.astype(np.float32) for x in (shared.value.start, shared.value.move, shared.value.emit)))
        total = np.zeros((1 + states + size, states))
        for batch in batches:
            for b in blocks([np.frombuffer(s, np.uint16) for s in batch.column("seq").to_pylist()]):
                start, moves, emits = Sequences(b).expected(m)
                total[0] += start
                total[1 : 1 + states] += moves
                total[1 + states :] += emits
        flat = total.ravel()
        at = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(flat[at])], names=["at", "n"])

    got = training.mapInArrow(run, "at bigint, n double").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros((1 + states + size) * states)
    total[got["at"].to_numpy()] = got["n"].to_numpy()
    total = total.reshape(-1, states)
    return total[0], total[1 : 1 + states], total[1 + states :]
