"""Quality classifier by co-training of a text view and a metadata view.

The text view sees counts over the whole text (letters by case, digits, marks, line and
word lengths, repeated and different words); the metadata view sees language, source
and stated length. Each number is cut into ``BINS`` bins at quantiles of the sample, and
each view is a ridge logistic regression over its bins.

Training uses at most ``LABELLED`` labelled documents, those of lowest hash, one row of
each. A third of them is held out. In each of ``ROUNDS`` rounds each view gives the
other the labels it is most sure of: those of unlabelled documents that score beyond the
point down to which, on held-out documents, at least ``SURE`` of any ``NEIGHBOURS`` in a
row have that label. A view that is never so sure gives none.

All unlabelled documents of the corpus take part, where they are: what the views see of
them is stored once, and each of the ``STEPS`` Newton steps of a round adds up, in their
tasks, the slope and curvature of the pseudo-labelled ones. The driver gets these sums,
whose size hangs on the bins alone. Pseudo-labels weigh ``PSEUDO_WEIGHT`` each, and at
most that much of the labelled sample together, however many they are. At the end the
held-out third calibrates both scores and weighs them against each other, by one more
logistic regression over the two. Every document is scored with both views; it is kept
if P(good) is at least ``KEEP``.

Nulls in any metadata column are a category of their own, a null text counts as empty.
Null labels and labels without document do not count; a document labelled twice is good
if one label says so. Without both labels in the sample all documents get the sample's
share of good ones (1 without labels). Rows that repeat a doc_id are scored one by one.
An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from edgelens.llm.common import bound_batches, broadcast_object, fresh
from edgelens.session import written

LABELLED = 12_000
BINS = 12
CATEGORIES = 64
ROUNDS = 3
STEPS = 3
SURE = 0.96
NEIGHBOURS = 50
PSEUDO_WEIGHT = 0.5
RIDGE = 1.0
NEWTON = 12
KEEP = 0.5
SEED = 2
METADATA = ("lang", "source", "n_chars")

_KIND = np.full(256, 4)
_KIND[[9, 10, 11, 12, 13, 32]] = 0
_KIND[48:58] = 1
_KIND[65:91] = 2
_KIND[97:123] = 3
_KIND[128:] = 5
N_TEXT = 14


def text_numbers(text: bytes | None) -> list[float]:
    """What the text view sees of a text."""
    text = text or b""
    n = max(len(text), 1)
    bytes_seen = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    blank, digit, upper, lower, mark, beyond = np.bincount(_KIND, bytes_seen, 6)
    words = text.split()
    m = max(len(words), 1)
    stops = bytes_seen[ord(".")] + bytes_seen[ord(",")]
    return [
        digit / n,
        upper / max(upper + lower, 1),
        (mark - stops) / n,
        stops / m,
        beyond / n,
        bytes_seen[ord("|")] / m,
        bytes_seen[ord("!")] / m,
        bytes_seen[10] / m,
        (n - blank) / m,
        len(set(words)) / m,
        sum(map(eq, words, words[1:])) / m,
        sum(map(eq, words, words[2:])) / m,
        bytes_seen.max() / n,
        np.log1p(m),
    ]


def _with_constant(x: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(x)), x])


def _sums(x: np.ndarray, y: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slope and curvature of the log likelihood; column 0 of ``x`` is the constant."""
    p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
    return x.T @ (y - p), (x * (p * (1 - p))[:, None]).T @ x


class Logistic:
    """Ridge logistic regression; weight 0 is the free constant."""

    def __init__(self, weights: np.ndarray, ridge: float = RIDGE):
        self.weights = weights
        self.keep = np.full(len(weights), ridge)
        self.keep[0] = 1e-6

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, ridge: float = RIDGE) -> Logistic:
        model = cls(np.zeros(x.shape[1] + 1), ridge)
        for _ in range(NEWTON):
            model = model.step(x, y)
        return model

    def step(self, x: np.ndarray, y: np.ndarray, slope: np.ndarray | float = 0.0, curve: np.ndarray | float = 0.0) -> Logistic:
        """One Newton step on ``x`` and ``y`` and on sums that come from elsewhere."""
        own_slope, own_curve = _sums(_with_constant(x), y, self.weights)
        move = np.linalg.solve(own_curve + curve + np.diag(self.keep), own_slope + slope - self.keep * self.weights)
        return Logistic(self.weights + move, self.keep[1])

    def score(self, x: np.ndarray) -> np.ndarray:
        return self.weights[0] + x @ self.weights[1:]


class TextView:
    def __init__(self, numbers: np.ndarray):
        self.cuts = [np.unique(np.quantile(c, np.arange(1, BINS) / BINS)) for c in numbers.T]

    def columns(self, numbers: np.ndarray) -> np.ndarray:
        """One column per cut: whether the number is above it."""
        return np.column_stack([(c[:, None] > cut) for c, cut in zip(numbers.T, self.cuts, strict=True)]).astype(float)


class MetadataView:
    def __init__(self, lengths: np.ndarray):
        known = lengths[np.isfinite(lengths)]
        self.cuts = np.unique(np.quantile(known, np.arange(1, BINS) / BINS)) if len(known) else np.zeros(0)

    def columns(self, places: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Hashed categories, whether a length is stated, and its place among the cuts."""
        one_hot = np.zeros((len(places), 2 * CATEGORIES))
        rows = np.arange(len(places))
        one_hot[rows, places[:, 0]] = 1.0
        one_hot[rows, CATEGORIES + places[:, 1]] = 1.0
        known = np.isfinite(lengths)
        above = np.where(known, lengths, -np.inf)[:, None] > self.cuts
        return np.column_stack([one_hot, known, above])


def sure_limit(held_scores: np.ndarray, held_y: np.ndarray, label: int) -> float:
    """Score beyond which (above for 1, below for 0) held-out labels surely agree."""
    sign = 1.0 if label else -1.0
    order = np.argsort(-sign * held_scores, kind="stable")
    right = np.concatenate([[0], np.cumsum(held_y[order] == label)])
    if len(order) < NEIGHBOURS:
        return sign * np.inf
    surely = (right[NEIGHBOURS:] - right[:-NEIGHBOURS]) >= SURE * NEIGHBOURS
    runs = len(surely) if surely.all() else int(np.argmin(surely))
    return float(held_scores[order[runs + NEIGHBOURS - 2]]) if runs else sign * np.inf


class Lesson:
    """What each view teaches the other in one step: sums over unlabelled documents."""

    def __init__(self, text, metadata, teachers: list[Logistic], limits: list[tuple[float, float]], pupils: list[Logistic]):
        self.text, self.metadata = text, metadata
        self.teachers, self.limits, self.pupils = teachers, limits, pupils

    def sums(self, numbers: np.ndarray, places: np.ndarray, lengths: np.ndarray) -> list[np.ndarray]:
        """Per pupil the slope, the curvature and the number of its pseudo-labels."""
        x = [self.text.columns(numbers), self.metadata.columns(places, lengths)]
        out = []
        for pupil, teacher in ((0, 1), (1, 0)):
            scores, (below, above) = self.teachers[teacher].score(x[teacher]), self.limits[teacher]
            bad = scores <= below
            told = bad | (scores >= above)
            own = _with_constant(x[pupil][told])
            out += [*_sums(own, (~bad[told]).astype(float), self.pupils[pupil].weights), np.array([told.sum()], float)]
        return out


class Model:
    """Both views, and how their scores combine."""

    def __init__(self, numbers, places, lengths, y, pool=None):
        """``y`` holds 1 good, 0 bad; rows come in a fixed random order. ``pool`` gives the
        sums of a ``Lesson`` over the unlabelled documents."""
        self.constant, self.given = None, []
        if len(np.unique(y)) < 2 or len(y) < 6:
            self.constant = float(np.mean(y)) if len(y) else 1.0
            return
        rows = np.arange(len(y))
        held, taught = rows[::3], np.delete(rows, np.s_[::3])
        if len(np.unique(y[held])) < 2 or len(np.unique(y[taught])) < 2:
            held = taught = rows
        self.text, self.metadata = TextView(numbers), MetadataView(lengths)
        x = [self.text.columns(numbers), self.metadata.columns(places, lengths)]
        y = y.astype(float)
        self.views = [Logistic.fit(x[v][taught], y[taught]) for v in (0, 1)]
        for _ in range(ROUNDS if pool else 0):
            checked = [self.views[v].score(x[v][held]) for v in (0, 1)]
            limits = [tuple(sure_limit(scores, y[held], label) for label in (0, 1)) for scores in checked]
            pupils = self.views
            for _ in range(STEPS):
                sums = pool(Lesson(self.text, self.metadata, self.views, limits, pupils))
                given = [int(sums[2][0]), int(sums[5][0])]
                weights = [PSEUDO_WEIGHT * min(1.0, len(taught) / max(n, 1)) for n in given]
                pupils = [
                    pupils[v].step(x[v][taught], y[taught], weights[v] * sums[3 * v], weights[v] * sums[3 * v + 1])
                    for v in (0, 1)
                ]
            self.views = pupils
            self.given.append((given[1], given[0]))
            if not any(given):
                break
        both = np.column_stack([view.score(x[v][held]) for v, view in enumerate(self.views)])
        self.combined = Logistic.fit(both, y[held], ridge=1e-2)

    def chance(self, numbers: np.ndarray, places: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Combined P(good) of documents."""
        if self.constant is not None:
            return np.full(len(numbers), self.constant)
        x = [self.text.columns(numbers), self.metadata.columns(places, lengths)]
        both = np.column_stack([view.score(x[v]) for v, view in enumerate(self.views)])
        return 1 / (1 + np.exp(-np.clip(self.combined.score(both), -35, 35)))


def _views(docs: DataFrame, metadata: tuple[str, str, str], text: str) -> list:
    """The columns a task reads: text, two hashed categories and the stated length."""
    lang, source, length = metadata
    place = [
        F.pmod(F.xxhash64(F.lit(SEED), F.coalesce(F.col(c).cast("string"), F.lit("\0"))), F.lit(CATEGORIES)).cast("int")
        for c in (lang, source)
    ]
    return [F.col(text).cast("string"), *place, F.coalesce(F.col(length).cast("double"), F.lit(float("nan")))]


def _numbers(texts: list[bytes | None]) -> np.ndarray:
    return np.array([text_numbers(t) for t in texts]).reshape(len(texts), N_TEXT)


SEEN = "h bigint, numbers array<double>, a int, b int, c double"


def seen_by_views(docs: DataFrame, doc_id: str, text: str, metadata: tuple[str, str, str]) -> DataFrame:
    """What both views see of every document: some hundred bytes each, whatever its text."""
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.xxhash64(F.col(text)).alias("h"),
        *(c.alias(n) for c, n in zip(_views(docs, metadata, text), "tabc", strict=True)),
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = _numbers(batch.column(2).cast(pa.binary()).to_pylist())
            arrays = [*batch.columns[:2], pa.array(numbers.tolist(), pa.list_(pa.float64())), *batch.columns[3:]]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "h", "numbers", "a", "b", "c"])

    return rows.mapInArrow(read, f"doc_id {docs.schema[doc_id].dataType.simpleString()}, {SEEN}")


def _arrays(numbers, a, b, c) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return (
        np.array(numbers, float).reshape(len(numbers), N_TEXT),
        np.column_stack([a, b]).astype(np.int64).reshape(len(numbers), 2),
        np.array(c, float),
    )


def _pool(free: DataFrame):
    """Sums of a lesson over stored rows, added up by Spark."""
    spark = free.sparkSession

    def sums(lesson: Lesson) -> list[np.ndarray]:
        sent, sizes = broadcast_object(spark, lesson), [len(p.weights) for p in lesson.pupils]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                if len(batch):
                    found = sent().sums(*_arrays(*(batch.column(i).to_pylist() for i in range(4))))
                    flat = np.concatenate([f.ravel() for f in found])
                    total = flat if total is None else total + flat
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["at", "value"])

        added = free.select("numbers", "a", "b", "c").mapInArrow(run, "at bigint, value double")
        rows = added.groupBy("at").agg(F.sum("value").alias("value")).toArrow()
        flat = np.zeros(sum(n + n * n + 1 for n in sizes))
        flat[rows.column("at").to_numpy()] = rows.column("value").to_numpy()
        out, at = [], 0
        for n in sizes:
            for shape in ((n,), (n, n), (1,)):
                size = int(np.prod(shape))
                out.append(flat[at : at + size].reshape(shape))
                at += size
        return out

    return sums


def train(
    docs: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    metadata: tuple[str, str, str] = METADATA,
    seen: DataFrame | None = None,
) -> Model:
    """A model of ``labels`` and of all other documents; ``seen`` is what the views see, if stored."""
    bound_batches(docs.sparkSession)
    if seen is None:
        seen = written(seen_by_views(docs, doc_id, text, metadata), "seen")
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
    known = known.groupBy("doc_id").agg(F.max(F.when(F.col("quality") > 0, 1).otherwise(0)).alias("y"))
    picked = F.broadcast(known.orderBy(F.xxhash64(F.lit(SEED), "doc_id"), "doc_id").limit(LABELLED))
    one = F.min(F.struct("h", "c", "a", "b", "numbers")).alias("one")
    sample = seen.join(picked, "doc_id").groupBy("doc_id", "y").agg(one).select("doc_id", "y", "one.*")
    # At most LABELLED rows of N_TEXT + 4 numbers.
    rows = sample.orderBy(F.xxhash64(F.lit(SEED + 1), "doc_id"), "doc_id").collect()
    taught = _arrays(*([r[c] for r in rows] for c in ("numbers", "a", "b", "c")))
    free = written(seen.join(known, "doc_id", "left_anti"), "unlabelled")
    return Model(*taught, np.array([r["y"] for r in rows], np.int64), None if free.isEmpty() else _pool(free))


def score(docs: DataFrame, model: Model, text: str = "text", metadata: tuple[str, str, str] = METADATA) -> DataFrame:
    """``docs`` with p_good and good (underscores added if taken)."""
    sent = broadcast_object(docs.sparkSession, model)
    bound_batches(docs.sparkSession)
    chance, seen = fresh(docs, "p_good"), [fresh(docs, f"view_{n}") for n in "tabc"]
    wide = docs.select("*", *(c.alias(n) for c, n in zip(_views(docs, metadata, text)[1:], seen[1:], strict=True)))
    at, kept, names = wide.columns.index(text), len(docs.columns), [*docs.columns, chance]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, c = (batch.column(kept + i).to_numpy(zero_copy_only=False) for i in range(3))
            numbers = _numbers(batch.column(at).cast(pa.binary()).to_pylist())
            p = sent().chance(numbers, np.column_stack([a, b]).astype(np.int64), c)
            yield pa.RecordBatch.from_arrays([*batch.columns[:kept], pa.array(p)], names=names)

    schema = T.StructType([*docs.schema.fields, T.StructField(chance, T.DoubleType())])
    return wide.mapInArrow(run, schema).withColumn(fresh(docs, "good"), F.col(chance) >= KEEP)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, P(good) and the decision for every row; texts are read once."""
    bound_batches(docs.sparkSession)
    seen = written(seen_by_views(docs, "doc_id", "text", METADATA), "seen")
    sent = broadcast_object(docs.sparkSession, train(docs, labels, seen=seen))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = sent().chance(*_arrays(*(batch.column(i).to_pylist() for i in range(1, 5))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p, pa.float64())], names=["doc_id", "p_good"])

    kind = seen.schema["doc_id"].dataType.simpleString()
    scored = seen.select("doc_id", "numbers", "a", "b", "c").mapInArrow(run, f"doc_id {kind}, p_good double")
    return scored.withColumn("good", F.col("p_good") >= KEEP)


def good_only(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, unchanged."""
    return score(docs, train(docs, labels)).where(fresh(docs, "good")).select(*docs.columns)
