"""Quality classifier with supervised subword embeddings.

Every word has hashed features: the word itself and its character 3- and 4-grams with borders; a word that repeats
its predecessor adds one shared word-bigram feature. Each feature has a learned vector. A document is the average of its
features' vectors; a softmax over two classes gives the score. Vectors and output weights are trained together by
numpy stochastic gradient descent on the driver, from at most MAX_TRAIN labelled rows (those with the smallest hash
of their id): a bound that doesn't grow with the data. The score is linear in the average, so after training each
bucket folds into one number; executors keep the sum for each word and read every whole text once, without a shuffle.

Null and empty texts have no feature and get the class prior's score. Labels with a null id or quality, and labels
of unknown documents, are left out; of repeated labels of one id the largest counts, of its texts the smallest. Without any usable label all scores
are 0.5. A null id counts as not held out.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

MAX_TRAIN, BUCKETS, DIM, EPOCHS, RATE, BATCH, SEED = 4000, 1 << 17, 12, 10, 40.0, 64, 7
THRESHOLD, MAX_CACHE = 0.7, 300_000
#: Bits of a feature's count beside its bucket in one number.
COUNT = 15
words_of = re.compile(r"[^\x20\x09-\x0D]+").findall
REPEAT = zlib.crc32(b"\x00repeat") & (BUCKETS - 1)


def features(word: str) -> list[int]:
    """Buckets of a word and of its character 3- and 4-grams."""
    raw = f"<{word}>"
    return [zlib.crc32(x.encode("utf-8", "replace")) & (BUCKETS - 1) for x in (raw, *(raw[i : i + n] for n in (3, 4) for i in range(len(raw) - n + 1) if n < len(raw)))]


def bag(text: str | None, known: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """A text's buckets and their counts."""
    words = words_of(text or "")
    for w in set(words):
        if w not in known:
            known[w] = np.array(features(w), np.int32)
    again = sum(a == b for a, b in zip(words, words[1:]))
    every = np.concatenate([*(known[w] for w in words), np.full(again, REPEAT, np.int32)]) if words else np.empty(0, np.int32)
    return np.unique(every, return_counts=True)


class Words(dict):
    """Numbers of words, and for each number the sum of its features' weights and how many they are."""

    def __init__(self, weight: np.ndarray):
        super().__init__()
        self.weight, self.sums, self.sizes = weight, np.empty(1 << 12), np.empty(1 << 12, np.int64)

    def __missing__(self, word: bytes) -> int:
        ids, k = features(word.decode("utf-8")), len(self)
        if k == len(self.sums):
            self.sums, self.sizes = (np.concatenate([x, np.empty_like(x)]) for x in (self.sums, self.sizes))
        self.sums[k], self.sizes[k] = float(self.weight[ids].sum(dtype=np.float64)), len(ids)
        self[word] = k
        return k


class Model:
    """weight: what each bucket adds to the logit of class 1; bias: the logit of a text without features."""

    def __init__(self, weight: np.ndarray, bias: float):
        self.weight, self.bias, self.words = weight, bias, Words(weight)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        out = np.full(len(texts), float(self.bias))
        for k, text in enumerate(texts):
            words = (text or "").encode("utf-8", "replace").split()  # bytes: only ASCII blanks split
            if not words:
                continue
            book = self.words
            numbers = np.fromiter(map(book.__getitem__, words), np.int64, len(words))
            again = int((numbers[1:] == numbers[:-1]).sum())
            total, n = book.sums[numbers].sum(), book.sizes[numbers].sum()
            out[k] += (total + again * float(self.weight[REPEAT])) / (n + again)
            if len(book) > MAX_CACHE:
                self.words = Words(self.weight)
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def packed(ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Buckets and counts as one number each; a count of more than COUNT bits becomes several numbers of one bucket."""
    most = (1 << COUNT) - 1
    full = counts // most
    ids = np.concatenate([ids, np.repeat(ids, full)])
    counts = np.concatenate([counts % most, np.full(int(full.sum()), most)])
    there = counts > 0
    return ids[there].astype(np.uint32) << np.uint32(COUNT) | counts[there].astype(np.uint32)


def train(bags: list[np.ndarray], labels: list[int], epochs: int = EPOCHS, seed: int = SEED) -> Model:
    """Embeddings and softmax weights by stochastic gradient descent over small batches of documents (their buckets and counts, packed)."""
    if not bags:
        return Model(np.zeros(BUCKETS, np.float32), 0.0)
    rng = np.random.default_rng(seed)
    y = np.asarray(labels, np.int64)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    out = np.zeros((DIM, 2), np.float32)
    prior = np.array([np.log((np.sum(y == c) + 1) / (len(y) + 2)) for c in (0, 1)], np.float32)
    steps, done = epochs * (len(y) // BATCH + 1), 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), BATCH):
            pick = order[at : at + BATCH]
            ids = np.concatenate([bags[i] >> COUNT for i in pick]).astype(np.int64)
            counts = [bags[i] & ((1 << COUNT) - 1) for i in pick]
            share = np.concatenate([c / max(1, c.sum()) for c in counts]).astype(np.float32)
            row = np.repeat(np.arange(len(pick)), [len(c) for c in counts])
            part = vectors[ids] * share[:, None]
            hidden = np.stack([np.bincount(row, part[:, d], len(pick)) for d in range(DIM)], 1).astype(np.float32)
            z = hidden @ out + prior
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(pick)), y[pick]] -= 1
            rate = RATE * (1 - done / steps) / len(pick)
            back = p @ out.T
            out -= rate * hidden.T @ p
            step = rate * back[row] * share[:, None]
            uniq, inv = np.unique(ids, return_inverse=True)
            vectors[uniq] -= np.stack([np.bincount(inv, step[:, d], len(uniq)) for d in range(DIM)], 1).astype(np.float32)
            done += 1
    diff = out[:, 1] - out[:, 0]
    return Model((vectors @ diff).astype(np.float32), float(prior[1] - prior[0]))


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, target: str = "quality") -> Model:
    """A model from the bounded sample; rows held out are never read as labels."""
    sample = (
        labels.select("doc_id", F.col(target).alias("label")).where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & ~held_out("doc_id"))
        .groupBy("doc_id").agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    )
    common.small_batches(docs.sparkSession)

    def bags(batches):
        known: dict = {}
        for b in batches:
            found = []
            for t in b.column(1).to_pylist():
                found.append(packed(*bag(t, known)).tobytes())
                if len(known) > MAX_CACHE:
                    known.clear()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(found, pa.binary())], names=["doc_id", "label", "bag"])

    # at most max_train rows of two numbers: bounded, so broadcasting them is safe
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id")
    texts = texts.groupBy("doc_id").agg(F.min(F.struct("text", "label")).alias("x")).select("doc_id", "x.text", F.col("x.label").cast("int").alias("label"))
    # the driver gets at most max_train rows of hardly more than BUCKETS numbers, however long the texts are and however often they repeat
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = texts.mapInArrow(bags, f"doc_id {kind}, label int, bag binary").toArrow()
    order, found, given = pa.compute.sort_indices(rows, [("doc_id", "ascending")]).to_pylist(), rows.column("bag"), rows.column("label").to_pylist()
    return train([np.frombuffer(found[i].as_buffer(), np.uint32) for i in order], [given[i] for i in order])


def score(df: DataFrame, model: Model) -> DataFrame:
    """df with a column score (replacing any of that name), in one pass over the texts."""
    spark = df.sparkSession
    common.small_batches(spark)
    shared = spark.sparkContext.broadcast((model.weight, model.bias))
    base = df.drop("score")
    at = base.columns.index("text")

    def run(batches):
        m = Model(*shared.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(m.scores(b.column(at).to_pylist()), pa.float64())], names=[*b.schema.names, "score"])

    return base.mapInArrow(run, T.StructType([*base.schema.fields, T.StructField("score", T.DoubleType())]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    model = fit(docs, common.table(spark, sf_dir, "labels"))
    scored = score_only(docs, model)
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def score_only(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every document; the text itself doesn't come back from Python."""
    spark = docs.sparkSession
    common.small_batches(spark)
    shared = spark.sparkContext.broadcast((model.weight, model.bias))

    def run(batches):
        m = Model(*shared.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(m.scores(b.column(1).to_pylist()), pa.float64())], names=["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, score double")
