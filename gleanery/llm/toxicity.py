"""Toxicity scores from a linear classifier over character n-grams.

Features are the character n-grams of lower-case words, hashed, present or not. Each is
scaled by its naive Bayes log-count ratio, the logarithm of how much likelier it is in
toxic than in other texts, and a logistic regression is fitted to the scaled features.
A score adds up the weights of all n-grams that a whole text has, so one toxic word
counts as much in a long text as in a short one.

The classifier is fitted on at most ``MAX_TRAIN`` labelled rows, half of each label,
those with the smallest hashes of their ids; a labelled row weighs as many as it stands
for. Rows held out for tests are never among them. Without labelled rows of both kinds,
every score is the share of toxic rows (0 if there are none).

Null texts count as empty; repeated rows get equal scores; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import map_batches, texts

MAX_TRAIN = 6000
SIZES = (3, 4, 5, 6)
BUCKET_BITS = 20
#: A feature is kept if so many texts of the sample have it and its difference between the labels is this significant (chi square).
MIN_TEXTS, MIN_CHI = 3, 11.0
PENALTY, STEPS = 1e-3, 300
#: Fixed folds: an id belongs to the test rows if this remainder is 0.
FOLDS = 5

PLAIN = np.arange(128, dtype=np.uint32)
PLAIN[[c for c in range(128) if not chr(c).isalnum() and chr(c) != "'"]] = 32
FACTOR = np.uint64(0x9E3779B97F4A7C15)


def ngram_buckets(text: str) -> list[np.ndarray]:
    """Buckets of the n-grams at every place, by size; none crosses a word's border, which itself counts as a character."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le"), np.uint32)
    codes = np.where(codes < 128, PLAIN[np.minimum(codes, 127)], codes).astype(np.uint64)
    space = codes == 32
    inner = np.cumsum(space)
    out = []
    h = codes.copy()
    for n in range(2, max(SIZES) + 1):
        if len(codes) < n:
            break
        h = (h[: len(codes) - n + 1] * np.uint64(0x100000001B3)) ^ (codes[n - 1 :] * FACTOR)
        if n in SIZES:
            last = len(codes) - n
            whole = inner[n - 2 : n - 1 + last] - inner[: last + 1] == 0  # no space strictly inside
            out.append((((h ^ (h >> np.uint64(29))) * FACTOR) >> np.uint64(64 - BUCKET_BITS))[whole].astype(np.int64))
    return out


@dataclass
class Model:
    bias: float
    weights: np.ndarray  # float32, a bucket each

    def score(self, text: str) -> float:
        margin = self.bias
        found = [b[self.weights[b] != 0] for b in ngram_buckets(text)]
        if found and sum(map(len, found)):
            margin += float(self.weights[np.unique(np.concatenate(found))].sum(dtype=np.float64))
        return 1 / (1 + float(np.exp(-max(-500.0, min(500.0, margin)))))


def fit(rows: list[str], toxic: np.ndarray, weight: np.ndarray) -> Model:
    """From whole texts with labels 0 and 1, a weight each."""
    size = 1 << BUCKET_BITS
    weights = np.zeros(size, np.float32)
    share = float(weight[toxic == 1].sum() / max(weight.sum(), 1e-9))
    if not 0 < share < 1:
        return Model(500.0 if share else -500.0, weights)
    flags = np.zeros(size, bool)
    have = [np.zeros(size, np.float32), np.zeros(size, np.float32)]
    features = []
    for text, label in zip(rows, toxic, strict=True):
        for b in ngram_buckets(text):
            flags[b] = True
        own = np.flatnonzero(flags)
        flags[own] = False
        features.append(own.astype(np.uint32))
        have[int(label)][own] += 1
    n = [float((toxic == k).sum()) for k in (0, 1)]
    ratio = np.log((have[1] + 1) / (n[1] + 2)) - np.log((have[0] + 1) / (n[0] + 2))
    total = have[0] + have[1]
    p = total / sum(n)
    spread = np.maximum(p * (1 - p), 1e-12) * (1 / n[0] + 1 / n[1])
    chi = (have[1] / n[1] - have[0] / n[0]) ** 2 / spread
    chosen = np.flatnonzero((total >= MIN_TEXTS) & (chi >= MIN_CHI))
    place = np.full(size, -1, np.int64)
    place[chosen] = np.arange(len(chosen))
    text_of, at = [], []
    for i, own in enumerate(features):
        mine = place[own]
        mine = mine[mine >= 0]
        at.append(mine)
        text_of.append(np.full(len(mine), i))
    at, text_of = np.concatenate([*at, []]).astype(np.int64), np.concatenate([*text_of, []]).astype(np.int64)
    value = ratio[chosen][at].astype(np.float64)
    w, bias = np.zeros(len(chosen)), float(np.log(share / (1 - share)))
    scale = weight / weight.sum()
    # accelerated gradient descent; the step follows from a bound of the curvature
    mass = np.bincount(text_of, value**2, len(rows))
    step = 1 / (0.25 * float((scale * (mass + 1)).sum()) + PENALTY)
    w0, b0 = w, bias
    for k in range(STEPS):
        ahead = k / (k + 3)
        yw, yb = w + ahead * (w - w0), bias + ahead * (bias - b0)
        margin = np.bincount(text_of, value * yw[at], len(rows)) + yb
        slope = scale * (1 / (1 + np.exp(-np.clip(margin, -500, 500))) - toxic)
        w0, b0 = w, bias
        w = yw - step * (np.bincount(at, value * slope[text_of], len(chosen)) + PENALTY * yw)
        bias = yb - step * float(slope.sum())
    weights[chosen] = (w * ratio[chosen]).astype(np.float32)
    return Model(bias, weights)


def held_out(id_col: str):
    """True for test rows; a null id is one."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fits the classifier on at most ``max_train`` labelled rows that aren't held out."""
    known = labels.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{label_col}`").cast("int").alias("toxic")).filter(F.col("toxic").isin(0, 1) & ~held_out("doc_id")).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = dict.fromkeys((0, 1), 0) | {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    half = max(1, max_train // 2)
    take = lambda k: known.filter(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(half)
    sample = F.broadcast(take(0).unionByName(take(1)))  # max_train rows at most
    rows = texts(docs, id_col, text_col)
    # of rows with one id, one text, so that the sample's bound holds for them too
    picked = rows.join(sample, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic")).select("text", "toxic")
    stands_for = {k: counts[k] / max(1, min(half, counts[k])) for k in (0, 1)}

    def learn(batches):
        held, toxic = [], []
        for b in batches:
            held += b.column(0).to_pylist()
            toxic += b.column(1).to_pylist()
        order = sorted(range(len(held)), key=lambda i: (toxic[i], held[i]))  # the same sums in any order of arrival
        y = np.array([toxic[i] for i in order], np.float64)
        model = fit([held[i] for i in order], y, np.array([stands_for[int(k)] for k in y], np.float64))
        kept = np.flatnonzero(model.weights)
        yield pa.RecordBatch.from_arrays([pa.array([model.bias]), pa.array([kept.astype(np.int32).tobytes()], pa.binary()), pa.array([model.weights[kept].tobytes()], pa.binary())], ["bias", "places", "weights"])

    # only the sample goes to one task: the scan stays in its own stage
    row = picked.repartition(1).mapInArrow(learn, "bias double, places binary, weights binary").first()
    weights = np.zeros(1 << BUCKET_BITS, np.float32)
    if row is None:
        return Model(-500.0, weights)
    weights[np.frombuffer(row["places"], np.int32)] = np.frombuffer(row["weights"], np.float32)
    return Model(row["bias"], weights)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row by its whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 2 ** BUCKET_BITS weights

    def make():
        m = sent.value

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array([m.score(t) for t in batch.column(1).to_pylist()], pa.float64())], ["doc_id", "score"])

        return step

    rows = texts(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return map_batches(rows, make, f"doc_id {kind}, score double")


def keep_clean(docs: DataFrame, model: Model, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows whose score is below the threshold, with all their columns."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def make():
        m = sent.value

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            return batch.filter(pa.array([m.score(t or "") < threshold for t in batch.column(at).to_pylist()], pa.bool_()))

        return step

    return map_batches(docs, make, docs.schema)
