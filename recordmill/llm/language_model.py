"""Log-probabilities of whole texts: add-one unigrams, and a log-bilinear neural model.

The neural model predicts classes. The most frequent tokens are a class each; every other
token belongs to one of ``BUCKETS`` classes by its last characters, and has its add-one share of
the class, where all tokens never seen in training are one more member. A class's score
after two others is bilinear in their vectors, so the exponentials factor into one table
per context position, and the normalising sums of all pairs of contexts are one matrix product of
these tables: every log-probability is normalised exactly.

Counting covers every training text, and so does training: tasks run noise-contrastive
estimation over their texts from common parameters, and the results are averaged, for
``ROUNDS`` rounds. Only tables whose size is bounded by parameters reach the driver: at most
``KNOWN`` tokens can hold one ``KNOWN``-th of all tokens each; the counts of all the others are joined.
"""

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordmill.llm.text import received, sent
from recordmill.llm.words import spaced_words
from recordmill.plans.pins import pin

END = b" "  # no word holds a space
KNOWN = 1 << 19
WORD_CLASSES = 1000
BUCKETS = 64
DIM = 24
NOISE = 64
BATCH = 2048
ROUNDS = 1
FLUSH = 300_000
SLICE = 1024


def held_out(doc_id: Column) -> Column:
    """Rows that nothing is learnt from; a row without id is learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def bucket_of(token: bytes) -> int:
    return zlib.crc32(token[-3:]) % BUCKETS


def count_tokens(texts: DataFrame) -> DataFrame:
    """``(token, c)`` over the rows of ``texts(text)``; each text ends with one end token."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def flush() -> pa.RecordBatch:
            found = pa.RecordBatch.from_arrays(
                [pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["token", "n"])
            counts.clear()
            return found

        for part in parts:
            for text in part.column(0):
                counts.update(spaced_words(text.as_py()))
                counts[END] += 1
                if len(counts) > FLUSH:
                    yield flush()
        yield flush()

    return texts.mapInArrow(batches, "token binary, n long").groupBy("token").agg(F.sum("n").alias("c"))


@dataclass
class Vocabulary:
    """Tokens that hold a ``KNOWN``-th of all tokens or more, the classes, and the sizes of the buckets."""

    tokens: int
    distinct: int
    known: dict[bytes, int]  # token -> place in `counts` and `classes`
    counts: np.ndarray
    classes: np.ndarray
    class_counts: np.ndarray  # training tokens of each class
    bucket_sizes: np.ndarray  # for each bucket, its tokens and its different ones and one more

    @property
    def size(self) -> int:
        return len(self.class_counts)

    @property
    def first_bucket(self) -> int:
        return self.size - BUCKETS


def vocabulary(counts: DataFrame, known: int = KNOWN, word_classes: int = WORD_CLASSES) -> Vocabulary:
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    # tokens with a `known`-th of all: no more than `known` of them
    frequent = counts.where((F.col("c") * known >= total.n) | (F.col("token") == F.lit(END))).collect()
    frequent.sort(key=lambda r: (bytes(r.token) != END, -r.c, bytes(r.token)))
    names = [bytes(r.token) for r in frequent] or [END]
    c = np.array([r.c for r in frequent] or [0], np.int64)
    first = min(word_classes, len(names))
    own = dict.fromkeys(names[:first])

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((BUCKETS, 2), np.int64)
        for part in parts:
            for token, n in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                if token not in own:
                    sums[bucket_of(token)] += (n, 1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(BUCKETS)), pa.array(sums[:, 0]), pa.array(sums[:, 1])], ["bucket", "n", "v"])

    sums = counts.mapInArrow(batches, "bucket long, n long, v long").groupBy("bucket").agg(
        F.sum("n").alias("n"), F.sum("v").alias("v")).collect()
    by_bucket = np.zeros(BUCKETS, np.int64)
    sizes = np.ones(BUCKETS, np.int64)
    for row in sums:
        by_bucket[row.bucket], sizes[row.bucket] = row.n, row.n + row.v + 1
    classes = np.array([k if k < first else first + bucket_of(t) for k, t in enumerate(names)], np.int16)
    return Vocabulary(total.n, total.v, {t: k for k, t in enumerate(names)}, c, classes,
                      np.concatenate([c[:first], by_bucket]), sizes)


def encoded(docs: DataFrame, words: Vocabulary) -> DataFrame:
    """Each row of ``docs(doc_id, text)`` as classes, its tokens that are not in ``words.known``, and its known sums.

    ``(row, doc_id, held_out, n_tokens, n_known, log_known, log_other, classes, rare)``: ``log_known``
    sums log10(c+1) over the known tokens, ``log_other`` over those without a class of their own.
    """
    shared = sent(docs.sparkSession, words)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = received(shared)
        logs = np.log10(v.counts + 1)
        other = np.where(v.classes >= v.first_bucket, logs, 0)
        seen = v.counts > 0
        place = v.known.get
        for part in parts:
            rows = []
            for text in part.column(2):
                tokens = [*spaced_words(text.as_py()), END]
                at = np.array([place(t, -1) for t in tokens], np.int64)
                missing = np.flatnonzero(at < 0)
                rare = [tokens[k] for k in missing.tolist()]
                classes = v.classes[at]
                classes[missing] = [v.first_bucket + bucket_of(t) for t in rare]
                at = at[at >= 0]
                rows.append((len(tokens), int(seen[at].sum()), float(logs[at].sum()), float(other[at].sum()),
                             classes.tobytes(), rare))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
            types = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.list_(pa.binary())]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))],
                ["doc_id", "held_out", "n_tokens", "n_known", "log_known", "log_other", "classes", "rare"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    source = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string"))
    return pin(source.mapInArrow(
        batches, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, log_known double, log_other double, "
                 "classes binary, rare array<binary>").withColumn("row", F.monotonically_increasing_id()))


class LogBilinear:
    """Scores of classes after two others; context ``size`` stands for before the text."""

    def __init__(self, size: int, log_unigram: np.ndarray, dim: int = DIM, seed: int = 3) -> None:
        rng = np.random.default_rng(seed)
        self.size = size
        self.output = rng.normal(0, 0.1, (size, dim)).astype(np.float32)
        self.context = rng.normal(0, 0.1, (size + 1, dim)).astype(np.float32)
        self.turn = np.stack([np.eye(dim), np.eye(dim)]).astype(np.float32)  # one matrix per context position
        self.bias = log_unigram.astype(np.float32)

    def parts(self) -> list[np.ndarray]:
        return [self.output, self.context, self.turn, self.bias]

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts()])

    def load(self, flat: np.ndarray) -> None:
        at = 0
        for part in self.parts():
            part[...] = flat[at : at + part.size].reshape(part.shape)
            at += part.size

    def learn(self, word: np.ndarray, before: np.ndarray, rates: list[np.ndarray], noise: np.ndarray,
              log_noise: np.ndarray, rate: float) -> None:
        """One step of noise-contrastive estimation; all tokens of the batch share the ``noise`` drawn for it."""
        q1, q2 = self.context[before[:, 0]], self.context[before[:, 1]]
        hidden = q1 @ self.turn[0] + q2 @ self.turn[1]
        r_word, r_noise = self.output[word], self.output[noise]
        right = np.einsum("bd,bd->b", hidden, r_word) + self.bias[word] - log_noise[word]
        wrong = hidden @ r_noise.T + (self.bias[noise] - log_noise[noise])
        up = 1 / (1 + np.exp(np.clip(right, -30, 30)))
        down = -1 / (1 + np.exp(np.clip(-wrong, -30, 30)))
        back = up[:, None] * r_word + down @ r_noise
        grads = [np.zeros_like(p) for p in self.parts()]
        _add_rows(grads[0], word, up[:, None] * hidden)
        _add_rows(grads[0], noise, down.T @ hidden)
        _add_rows(grads[1], before[:, 0], back @ self.turn[0].T)
        _add_rows(grads[1], before[:, 1], back @ self.turn[1].T)
        grads[2][0], grads[2][1] = q1.T @ back, q2.T @ back
        grads[3] += np.bincount(word, up, self.size) + np.bincount(noise, down.sum(axis=0), self.size)
        for part, grad, seen in zip(self.parts(), grads, rates, strict=True):
            seen += grad * grad
            part += rate * grad / np.sqrt(seen)

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores after the last and the last but one class, and the log of the normalising sum of each pair."""
        near = (self.context @ self.turn[0]) @ self.output.T + self.bias
        far = (self.context @ self.turn[1]) @ self.output.T
        top, top_far = near.max(axis=1, keepdims=True), far.max(axis=1, keepdims=True)
        sums = np.exp(near - top) @ np.exp(far - top_far).T
        return near, far, np.log(np.maximum(sums, 1e-37)) + top + top_far.T


def _add_rows(total: np.ndarray, index: np.ndarray, rows: np.ndarray) -> None:
    order = np.argsort(index, kind="stable")
    index = index[order]
    start = np.flatnonzero(np.concatenate(([True], index[1:] != index[:-1])))
    total[index[start]] += np.add.reduceat(rows[order], start, axis=0)


def contexts(classes: np.ndarray, start: int) -> np.ndarray:
    """For each token of a text the classes of the one before it and the one before that."""
    padded = np.concatenate([[start, start], classes]).astype(np.int64)
    return np.stack([padded[1:-1], padded[:-2]], axis=1)


def _train_round(rows: DataFrame, model: LogBilinear, unigram: np.ndarray, rate: float) -> bool:
    """Each task trains on its texts; the model becomes the mean by tokens. False without any text."""
    shared = sent(rows.sparkSession, (model, unigram))

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, unigram = received(shared)
        own = LogBilinear(start.size, start.bias, start.output.shape[1])
        own.load(start.flat())
        rates = [np.full_like(p, 20.0) for p in own.parts()]
        log_noise = np.log(NOISE * unigram).astype(np.float32)
        rng = np.random.default_rng(11)
        words, before, held, total = [], [], 0, 0

        def learn() -> None:
            word, past = np.concatenate(words), np.concatenate(before)
            order = rng.permutation(len(word))
            for k in range(0, len(order), BATCH):
                at = order[k : k + BATCH]
                own.learn(word[at], past[at], rates, rng.choice(len(unigram), NOISE, p=unigram), log_noise, rate)

        for part in parts:
            for text in part.column(0):
                classes = np.frombuffer(text.as_py(), np.int16)
                for k in range(0, len(classes), 1 << 16):  # a very long text in pieces, each with its context
                    piece = contexts(classes[max(k - 2, 0) : k + (1 << 16)], own.size)
                    piece = piece[min(k, 2) :]
                    words.append(classes[k : k + (1 << 16)].astype(np.int64))
                    before.append(piece)
                    held += len(piece)
                    if held >= 1 << 16:
                        learn()
                        words, before, held, total = [], [], 0, total + held
        if held:
            learn()
            total += held
        if total:
            flat = own.flat().astype(np.float64) * total
            cuts = range(0, len(flat), SLICE)
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(range(len(cuts))), pa.int64()), pa.array([total] * len(cuts), pa.int64()),
                 pa.array([flat[k : k + SLICE].tobytes() for k in cuts], pa.binary())], ["slice", "tokens", "sums"])

    def added(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for part in parts:
            for k, tokens, values in zip(*(c.to_pylist() for c in part.columns), strict=True):
                one = sums.setdefault(k, [0, 0.0])
                one[0] += tokens
                one[1] = one[1] + np.frombuffer(values)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int64()), pa.array([s[0] for s in sums.values()], pa.int64()),
             pa.array([s[1].tobytes() for s in sums.values()], pa.binary())], ["slice", "tokens", "sums"])

    kind = "slice long, tokens long, sums binary"
    found = rows.select("classes").mapInArrow(batches, kind).repartition("slice").mapInArrow(added, kind).collect()
    if not found:
        return False
    found.sort(key=lambda r: r.slice)
    model.load(np.concatenate([np.frombuffer(r.sums) / r.tokens for r in found]))
    return True


def train(rows: DataFrame, words: Vocabulary, rounds: int = ROUNDS) -> LogBilinear:
    """A model from the rows of ``encoded`` that are not held out."""
    unigram = (words.class_counts + 1) / (words.class_counts.sum() + words.size)
    model = LogBilinear(words.size, np.log(unigram))
    for k in range(rounds):
        if not _train_round(rows.where("not held_out"), model, unigram, 0.1 / (1 + k)):
            break
    return model


def class_log10(tables: tuple[np.ndarray, ...], classes: np.ndarray) -> np.ndarray:
    """log10 probability of each class of a text after the two before it."""
    near, far, norm = tables
    past = contexts(classes, near.shape[1])
    a, b = past[:, 0], past[:, 1]
    at = classes.astype(np.int64)
    return (near[a, at] + far[b, at] - norm[a, b]) / math.log(10)


def scored(docs: DataFrame, known: int = KNOWN, word_classes: int = WORD_CLASSES, rounds: int = ROUNDS) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)``, one row per row of ``docs``.

    Tokens are words (runs of anything but ASCII white space, A-Z lower-cased) and one end. A null text
    counts as empty and is its end alone. Rows may repeat or lack an id. Without training rows the
    counts are zero and the classes are about equally likely. Other columns are ignored.
    """
    counts = pin(count_tokens(docs.where(~held_out(F.col("doc_id"))).select(F.col("text").cast("string"))))
    words = vocabulary(counts, known, word_classes)
    rows = encoded(docs, words)
    model = train(rows, words, rounds)
    share = np.zeros(words.size)
    share[words.first_bucket :] = np.log10(words.bucket_sizes)
    shared = sent(docs.sparkSession, (model.tables(), share))

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, share = received(shared)
        for part in parts:
            found = [0.0] * part.num_rows
            for k, text in enumerate(part.column(6)):
                classes = np.frombuffer(text.as_py(), np.int16)
                found[k] = float(class_log10(tables, classes).sum(dtype=np.float64) - share[classes].sum())
            total = np.array(found) + part.column(7).to_numpy()
            yield pa.RecordBatch.from_arrays([*part.columns[:6], pa.array(total)], [*columns, "class_score"])

    # a token that is not known has c = 0 and adds log10(1) = 0, so only the counted ones matter
    asked = rows.select("row", F.explode("rare").alias("token"))
    rare = (
        asked.join(counts.where(F.col("c") * known < words.tokens), "token")
        .groupBy("row").agg(F.count(F.lit(1)).alias("rare_known"), F.sum(F.log10(F.col("c") + 1)).alias("rare_log"))
        .withColumnRenamed("row", "rare_row")
    )
    kind = docs.schema["doc_id"].dataType.simpleString()
    columns = ["row", "doc_id", "held_out", "n_tokens", "n_known", "log_known"]
    model_rows = rows.select(*columns, "classes", "log_other").mapInArrow(
        batches, f"row long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, log_known double, "
                 "class_score double")
    log_rare = F.coalesce("rare_log", F.lit(0.0))
    floor = math.log10(words.tokens + words.distinct + 1)
    return model_rows.join(rare, F.col("row") == F.col("rare_row"), "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(words.tokens).cast("long").alias("train_tokens"),
        (F.col("log_known") + log_rare - F.col("n_tokens") * floor).alias("base_score"),
        (F.col("class_score") + log_rare).alias("score"))
