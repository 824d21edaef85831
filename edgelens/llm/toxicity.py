"""Toxicity grades by cumulative-link ordinal regression on sparse text features.

Features are a document's words and their beginnings of 4 to 6 bytes (roots keep their
meaning under endings that the sample never showed). A labelled sample of at most
``SAMPLE`` documents, those of lowest hash, gives for each feature the number of toxic
and clean documents that hold it; the ``FEATURES`` features that most clearly speak for
toxic are kept. (Features that speak for clean are mostly common words; in a long text
their sum would hide what is toxic.)

Labels say toxic or not. Severity is graded from them: 0 is not toxic, and 1 to 3 are
the thirds of the toxic sample by held-out odds: each half of the sample gives every
word its log odds of being toxic, and a document's is the mean over its words by the
half it is not in. So grades come from all words, not from the features of the model,
and from none of the document's own label; and long texts do not grade higher. The model is

    P(grade > k) = sigmoid(w . x - theta_k),   theta_0 < theta_1 < theta_2

with one weight vector for all thresholds. Every document is scored with its expected
severity, the sum over k of P(grade > k), and is toxic if P(grade > 0) is at least 1/2.

Null and empty texts hold no feature and get the severity of such a text. Labels that
are null or name no document do not count; a document labelled twice has the higher
label. Without both labels in the sample nothing is toxic and severity is 0. Rows that
repeat a doc_id are scored one by one. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from edgelens.llm.common import bound_batches, broadcast_object, fresh, with_columns
from edgelens.llm.decontaminate import words_of
from edgelens.session import written

SAMPLE = 16_384
SAMPLE_TASKS = 32
FEATURES = 2048
FEATURE_BYTES = 64
# Standard errors by which the log odds of a feature must differ.
TELLING = 4.0
BEGINNINGS = (4, 5, 6)
GRADES = 3
# Few steps: the fit is stopped before it explains single documents of the sample.
STEPS = 200
RIDGE = 1e-4
SEED = 10
# Features a task holds before it passes their counts on, and words it remembers.
HELD = 200_000


def whole(word: bytes) -> bytes:
    """The word; a digest stands for one of more than ``FEATURE_BYTES`` bytes."""
    return word if len(word) <= FEATURE_BYTES else b"=" + hashlib.sha256(word).digest()


def features_of(word: bytes) -> list[bytes]:
    """The word, and its beginnings marked by a star."""
    return [whole(word), *(word[:n] + b"*" for n in BEGINNINGS if len(word) > n)]


class Vectors:
    """Texts to the kept features that they hold."""

    def __init__(self, names: list[bytes]):
        self.place = {f: i for i, f in enumerate(names)}
        self.seen: dict[bytes, tuple[int, ...]] = {}

    def _of(self, word: bytes) -> tuple[int, ...]:
        found = self.seen.get(word)
        if found is None:
            found = tuple(self.place[f] for f in features_of(word) if f in self.place)
            if len(self.seen) >= HELD:
                self.seen.clear()
            self.seen[word] = found
        return found

    def __call__(self, text: bytes | None) -> tuple[list[int], list[float]]:
        """Places and values: 1 for presence, and more the denser the feature is."""
        words, hits = words_of(text), Counter()
        get = self.seen.get
        for word in words:
            found = get(word)
            if found is None:
                found = self._of(word)
            if found:
                hits.update(found)
        places = sorted(hits)
        return places, [1.0 + float(np.log1p(1000.0 * hits[p] / len(words))) for p in places]


def labelled_sample(docs: DataFrame, labels: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Text and label of at most ``SAMPLE`` labelled documents."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    drawn = F.xxhash64(F.lit(SEED), F.col("doc_id"))
    picked = F.broadcast(known.orderBy(drawn, "doc_id").limit(SAMPLE))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(picked, "doc_id")
    return rows.orderBy(F.xxhash64(F.lit(SEED), "doc_id"), F.xxhash64("text")).limit(SAMPLE)


def held_out_odds(sample: DataFrame) -> DataFrame:
    """``sample`` (number, text, toxic) with ``odds``: the mean log odds of a text's words
    by the half of the sample that it is not in; 0 without words."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers, labels = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            rows = [Counter(map(whole, words_of(t))) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            flat = [(n, int(label > 0), w, k) for n, label, row in zip(numbers, labels, rows, strict=True) for w, k in row.items()]
            types = pa.int64(), pa.int32(), pa.binary(), pa.int64()
            columns = zip(*flat) if flat else [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)], names=["number", "label", "word", "times"]
            )

    words = sample.select("number", "text", "toxic").mapInArrow(counted, "number bigint, label int, word binary, times bigint")
    words = written(words.withColumn("half", F.pmod("number", F.lit(2))), "sample-words")
    halves = sample.groupBy(F.pmod("number", F.lit(2)).alias("half")).agg(
        F.count_if(F.col("toxic") > 0).alias("n_toxic"), F.count_if(F.col("toxic") <= 0).alias("n_clean")
    )
    by_word = words.groupBy("half", "word").agg(F.sum("label").alias("a"), F.count_if(F.col("label") == 0).alias("b"))
    rate = [F.log((F.col(c) + 0.5) / (F.col(n) + 1)) for c, n in (("a", "n_toxic"), ("b", "n_clean"))]
    odds = by_word.join(halves, "half").select((1 - F.col("half")).alias("half"), "word", (rate[0] - rate[1]).alias("odds"))
    mean = F.sum(F.col("times") * F.coalesce("odds", F.lit(0.0))) / F.sum("times")
    per_text = words.join(odds, ["half", "word"], "left").groupBy("number").agg(mean.alias("odds"))
    return sample.join(per_text, "number", "left").withColumn("odds", F.coalesce("odds", F.lit(0.0)))


def telling_features(sample: DataFrame) -> list[bytes]:
    """The kept features, most telling first."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic, clean = Counter(), Counter()

        def passed_on() -> pa.RecordBatch:
            names = [*toxic.keys(), *clean.keys()]
            counts = [[*toxic.values(), *([0] * len(clean))], [*([0] * len(toxic)), *clean.values()]]
            arrays = [pa.array(names, pa.binary()), *(pa.array(c, pa.int64()) for c in counts)]
            return pa.RecordBatch.from_arrays(arrays, names=["feature", "toxic", "clean"])

        for batch in batches:
            texts, labels = batch.column(0).cast(pa.binary()).to_pylist(), batch.column(1).to_pylist()
            for text, label in zip(texts, labels, strict=True):
                (toxic if label else clean).update({f for w in set(words_of(text)) for f in features_of(w)})
                if len(toxic) + len(clean) > HELD:
                    yield passed_on()
                    toxic.clear()
                    clean.clear()
        yield passed_on()

    n = sample.agg(F.count_if(F.col("toxic") > 0), F.count_if(F.col("toxic") <= 0)).first()
    if not (n[0] and n[1]):
        return []
    flagged = sample.select("text", (F.col("toxic") > 0).cast("int").alias("label"))
    counts = flagged.mapInArrow(counted, "feature binary, toxic bigint, clean bigint").groupBy("feature")
    counts = counts.agg(F.sum("toxic").alias("a"), F.sum("clean").alias("b"))
    odds = F.log((F.col("a") + 0.5) / (n[0] - F.col("a") + 0.5)) - F.log((F.col("b") + 0.5) / (n[1] - F.col("b") + 0.5))
    z = (odds / F.sqrt(1 / (F.col("a") + 0.5) + 1 / (F.col("b") + 0.5))).alias("z")
    best = counts.select("feature", z).where(F.col("z") >= TELLING).orderBy(F.desc("z"), "feature")
    return [bytes(r["feature"]) for r in best.limit(FEATURES).collect()]


class Sparse:
    """Rows of (place, value) pairs."""

    def __init__(self, rows: list[tuple[list[int], list[float]]], width: int):
        self.row = np.repeat(np.arange(len(rows)), [len(p) for p, _ in rows])
        self.place = np.array([i for p, _ in rows for i in p], np.int64)
        self.value = np.array([x for _, v in rows for x in v])
        self.shape = (len(rows), width)

    def dot(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * weights[self.place], self.shape[0])

    def back(self, errors: np.ndarray) -> np.ndarray:
        return np.bincount(self.place, self.value * errors[self.row], self.shape[1])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


def thresholds(free: np.ndarray) -> np.ndarray:
    """Ordered thresholds from free numbers: a start and the logs of the gaps."""
    return np.cumsum(np.concatenate([free[:1], np.exp(free[1:])]))


def above(scores: np.ndarray, theta: np.ndarray) -> np.ndarray:
    """P(grade > k), one column per k."""
    return sigmoid(scores[:, None] - theta)


def fit(x: Sparse, grades: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of highest likelihood, by Adam on the whole sample."""
    share = np.clip([np.mean(grades > k) for k in range(GRADES)], 1e-3, 1 - 1e-3)
    start = np.log((1 - share) / share)
    p = np.concatenate([np.zeros(x.shape[1]), start[:1], np.log(np.maximum(np.diff(start), 1e-2))])
    width, m, v = x.shape[1], np.zeros(len(p)), np.zeros(len(p))
    everyone = np.arange(len(grades))
    for step in range(1, STEPS + 1):
        theta = thresholds(p[width:])
        q = above(x.dot(p[:width]), theta)
        edge = np.column_stack([np.ones(len(q)), q, np.zeros(len(q))])
        chance = np.maximum(edge[everyone, grades] - edge[everyone, grades + 1], 1e-12)
        slope = edge * (1 - edge)
        upper, lower = slope[everyone, grades] / chance, slope[everyone, grades + 1] / chance
        by_theta = np.array(
            [np.sum(upper[grades == k + 1]) - np.sum(lower[grades == k]) for k in range(GRADES)]
        )
        gaps = np.exp(p[width + 1 :])
        later = np.cumsum(by_theta[::-1])[::-1]
        by_free = np.concatenate([later[:1], later[1:] * gaps])
        g = np.concatenate([-x.back(upper - lower), by_free]) / len(q)
        g[:width] += RIDGE * p[:width]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        p = p - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    return p[:width], thresholds(p[width:])


def grades_of(odds: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """0 for clean rows, thirds of the toxic ones by their held-out odds."""
    cuts = np.quantile(odds[labels > 0], np.arange(1, GRADES) / GRADES)
    return np.where(labels > 0, 1 + np.searchsorted(cuts, odds, "left"), 0).astype(np.int64)


class Model:
    """Feature names, weights and thresholds; at most ``FEATURES`` of ``FEATURE_BYTES``."""

    def __init__(self, names: list[bytes], weights: np.ndarray, theta: np.ndarray):
        self.names, self.weights, self.theta = names, weights, theta

    def above(self, rows: list[tuple[list[int], list[float]]]) -> np.ndarray:
        if not self.names:
            return np.zeros((len(rows), GRADES))
        return above(Sparse(rows, len(self.names)).dot(self.weights), self.theta)


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Model:
    bound_batches(docs.sparkSession)
    drawn = labelled_sample(docs, labels, doc_id, text).select("text", "toxic")
    # The limit leaves one task; from here on all have their part. Equal texts share a number.
    numbered = drawn.withColumn("number", F.xxhash64("text")).repartition(SAMPLE_TASKS, "number")
    sample = written(numbered.select("number", "text", "toxic"), "sample")
    names = telling_features(sample.select("text", "toxic"))
    if not names:
        return Model([], np.zeros(0), np.full(GRADES, np.inf))
    vectors = Vectors(names)
    kind = T.StructType(
        [T.StructField("places", T.ArrayType(T.IntegerType())), T.StructField("values", T.ArrayType(T.DoubleType()))]
    )

    def compute(texts: list[bytes]) -> list[pa.Array]:
        rows = [vectors(t) for t in texts]
        return [pa.array([p for p, _ in rows], pa.list_(pa.int32())), pa.array([v for _, v in rows], pa.list_(pa.float64()))]

    graded = held_out_odds(sample).withColumn("odds", F.round("odds", 9))
    seen = with_columns(graded, "text", kind, compute).select("toxic", "places", "values", "odds")
    found = seen.orderBy("toxic", "places", "values", "odds").collect()
    rows = [(list(r["places"]), list(r["values"])) for r in found]
    toxic, odds = np.array([r["toxic"] > 0 for r in found], np.int64), np.array([r["odds"] for r in found])
    return Model(names, *fit(Sparse(rows, len(names)), grades_of(odds, toxic)))


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with severity, p_toxic, grade and toxic (underscores added if taken)."""
    names = [fresh(docs, n) for n in ("severity", "p_toxic", "grade", "toxic")]
    types = [T.DoubleType(), T.DoubleType(), T.IntegerType(), T.BooleanType()]
    sent = broadcast_object(docs.sparkSession, model)

    def compute(texts: list[bytes]) -> list[pa.Array]:
        vectors = Vectors(sent().names)
        q = sent().above([vectors(t) for t in texts])
        chance = -np.diff(np.column_stack([np.ones(len(q)), q, np.zeros(len(q))]), axis=1)
        return [
            pa.array(q.sum(axis=1)),
            pa.array(q[:, 0]),
            pa.array(chance.argmax(axis=1).astype(np.int32)),
            pa.array(q[:, 0] >= 0.5),
        ]

    added = T.StructType([T.StructField(n, t) for n, t in zip(names, types, strict=True)])
    return with_columns(docs, text, added, compute)


def toxicity(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, expected severity, P(toxic), most likely grade and the flag of every row."""
    model = train(docs, labels, doc_id, text)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return score(rows, model).drop("text")
