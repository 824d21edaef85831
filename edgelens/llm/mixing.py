"""Mixing sources to target weights by the cube method.

Sources in code point order (null last) weigh 5, 2, 1, repeating, and share 150 % of
all words; a source gives at most twice its words, and what it cannot give is shared
by weight among the others. Every document of a source is to be taken target / size
times: the whole part for certain, the rest is an inclusion probability.

Samples are balanced on documents and words. The flight moves three probabilities at a
time along the one direction that changes neither total, until one of them is 0 or 1;
so at most two of a cell stay open. Cells of at most about ``CELL`` documents fly side by
side, and what they leave open flies on in fewer cells. When a source is down to one
cell, ``LANDING`` documents of all lengths wait; with the two left open they are the
landing problem, settled so that the totals come nearest to what they should be.

Sizes are words (runs outside ASCII blanks); null text has none. Random choices hang on
hashes of the documents, so reruns and other partitionings agree. Rows that agree in
doc_id, source and text are counted first and then numbered, each with a draw of its
own, so that they spread over cells however many they are. A source without words takes nothing. An empty table
gives no rows.
"""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from edgelens.llm.common import fresh, word_count
from edgelens.session import checkpoint, written

# Weights of the sources in order, repeated.
WEIGHTS = [5.0, 2.0, 1.0]
SHARE = 1.5
MOST = 2.0
CELL = 4096
# Alike rows that one row fans out to.
FAN = 1 << 16
SEED = 17
# Documents of all lengths that a source's last cell leaves to the landing, and the
# weight of words against documents there.
LANDING = 12
WORDS_FIRST = 8.0
# Probabilities this near to 0 or 1 are there.
NEAR = 1e-9


def source_targets(sizes: DataFrame, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``sizes`` (source, source_size, n) with ``place`` and ``target``.

    One row per source; the rounds end when a sharing caps no further source, and
    the driver sees three sums per round.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    place = F.row_number().over(order) - 1
    weight = F.get(F.array(*map(F.lit, WEIGHTS)), F.col("place") % len(WEIGHTS))
    table = checkpoint(sizes.withColumn("place", place).withColumn("weight", weight))
    limit = F.col("source_size") * most
    total = table.agg(F.sum("source_size")).first()[0] or 0
    capped, rate = -1, 0.0
    while True:
        full = limit < F.col("weight") * rate
        taken, open_weight, n = table.agg(
            F.sum(F.when(full, limit).otherwise(0.0)),
            F.sum(F.when(full, 0.0).otherwise(F.col("weight"))),
            F.count_if(full),
        ).first()
        if n == capped or not open_weight:
            break
        capped, rate = n, (share * total - taken) / open_weight
    return table.withColumn("target", F.least(limit, F.col("weight") * rate).cast("double"))


def flight(sizes: list[float], chances: list[float], draw: random.Random) -> list[float]:
    """Move probabilities until at most two are neither 0 nor 1; both totals stay."""
    chances = list(chances)
    held: list[int] = []
    for i in range(len(chances)):
        held.append(i)
        if len(held) < 3:
            continue
        a, b, c = (sizes[j] for j in held)
        along = (c - b, a - c, b - a)
        if not any(along):
            along = (1.0, -1.0, 0.0)
        ahead = back = float("inf")
        for j, step in zip(held, along, strict=True):
            if step > 0:
                ahead, back = min(ahead, (1 - chances[j]) / step), min(back, chances[j] / step)
            elif step < 0:
                ahead, back = min(ahead, chances[j] / -step), min(back, (1 - chances[j]) / -step)
        move = ahead if draw.random() * (ahead + back) < back else -back
        for j, step in zip(held, along, strict=True):
            p = chances[j] + move * step
            chances[j] = 0.0 if p < NEAR else 1.0 if p > 1 - NEAR else p
        held = [j for j in held if 0.0 < chances[j] < 1.0]
    return chances


def land(sizes: list[float], chances: list[float]) -> list[float]:
    """Settle the open ones, near to what they are expected to give.

    All choices are weighed: the miss in words, in average documents, counts
    ``WORDS_FIRST`` times the miss in documents.
    """
    spots = [i for i, p in enumerate(chances) if 0.0 < p < 1.0]
    size, chance = np.array([sizes[i] for i in spots]), np.array([chances[i] for i in spots])
    choice = np.arange(1 << len(spots))[:, None] >> np.arange(len(spots)) & 1
    words = np.abs(choice @ size - chance @ size) / max(float(np.mean(sizes)), 1.0)
    docs = np.abs(choice.sum(axis=1) - chance.sum())
    best = choice[int(np.argmin(WORDS_FIRST * words + docs))]
    out = list(chances)
    for i, taken in zip(spots, best.tolist(), strict=True):
        out[i] = float(taken)
    return out


def waiting_places(n: int) -> set[int]:
    """Which of ``n`` documents, longest first, wait for the landing: more of the long
    ones, as the longest tend to stay open, but none so long that it leaves a gap."""
    if n <= LANDING:
        return set(range(n))
    return {int(n * 0.02 * 30 ** (k / (LANDING - 1))) for k in range(LANDING)}


def _fly(batch: pd.DataFrame) -> pd.DataFrame:
    # Long documents fly first, so that short ones stay open.
    order = ["size", "draw", "doc_id", "number"]
    batch = batch.sort_values(order, ascending=[False, True, True, True], ignore_index=True)
    first, n = batch.iloc[0], len(batch)
    draw = random.Random(f"{SEED} {first['place']} {first['cell']} {first['level']}")
    sizes, chances = batch["size"].astype(float).tolist(), batch["chance"].tolist()
    waiting = waiting_places(n) if first["last"] else set()
    flying = [i for i in range(n) if i not in waiting]
    moved = flight([sizes[i] for i in flying], [chances[i] for i in flying], draw)
    for i, p in zip(flying, moved, strict=True):
        chances[i] = p
    batch["chance"] = land(sizes, chances) if first["last"] else chances
    return batch


def sampled(units: DataFrame) -> DataFrame:
    """``units`` (place, draw, chance, ...) with every chance at 0 or 1."""
    settled = []
    open_units, level = units, 0
    while True:
        counts = open_units.groupBy("place").agg(F.count(F.lit(1)).alias("open"))
        cells = F.ceil(F.col("open") / CELL)
        dealt = (
            open_units.join(counts, "place")
            .withColumn("cell", F.pmod(F.xxhash64("draw", "number", F.lit(level)), cells))
            .withColumn("last", cells == 1)
            .withColumn("level", F.lit(level))
            .drop("open")
        )
        flown = written(dealt.groupBy("place", "cell").applyInPandas(_fly, dealt.schema), "flight")
        flown = flown.drop("cell", "last", "level")
        done = F.col("chance").isin(0.0, 1.0)
        settled.append(flown.where(done))
        open_units = flown.where(~done)
        level += 1
        if open_units.isEmpty():
            break
    out = settled[0]
    for part in settled[1:]:
        out = out.unionByName(part)
    return out


def numbered(alike: DataFrame) -> DataFrame:
    """One row per document of rows that count ``n`` alike ones, with its ``number``.

    Counts fan out in two steps, so that many alike rows are made by many tasks.
    """
    blocks = F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / FAN))
    first = F.col("block") * FAN
    last = F.least(F.col("n"), first + FAN) - 1
    single, many = alike.where(F.col("n") <= FAN), alike.where(F.col("n") > FAN)
    dealt = many.withColumn("block", F.explode(blocks)).repartition("draw", "block")
    listed = single.withColumn("block", F.lit(0).cast("bigint")).unionByName(dealt)
    return listed.withColumn("number", F.explode(F.sequence(first, last))).drop("n", "block")


def copies(docs: DataFrame, doc_id: str, source: str, text: str) -> DataFrame:
    """doc_id, source, size, source_size, target, draw and how often each row is taken."""
    alike = docs.groupBy(
        F.col(doc_id).alias("doc_id"),
        F.col(source).alias("source"),
        word_count(F.col(text)).alias("size"),
        F.xxhash64(F.lit(SEED), F.col(doc_id), F.col(text)).alias("draw"),
    )
    rows = written(numbered(alike.agg(F.count(F.lit(1)).alias("n"))), "sizes")
    sizes = rows.groupBy("source").agg(F.sum("size").cast("bigint").alias("source_size"))
    targets = written(source_targets(sizes), "targets")
    times = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(times + NEAR)
    part = F.greatest(times - whole, F.lit(0.0))
    same = rows["source"].eqNullSafe(targets["source"])
    units = rows.join(targets, same).select(
        rows["*"], "place", "source_size", "target", whole.alias("whole"),
        F.when(part > NEAR, part).otherwise(0.0).alias("chance"),
    )
    units = written(units, "units")
    certain = F.col("chance") == 0.0
    return units.where(certain).unionByName(sampled(units.where(~certain))).withColumn(
        "times", (F.col("whole") + F.col("chance")).cast("int")
    )


def mix(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """One row per document row: size, its source's size and target, words taken."""
    return copies(docs, doc_id, source, text).select(
        "doc_id",
        "size",
        "source_size",
        "target",
        (F.col("size") * F.col("times")).cast("bigint").alias("taken"),
        "source",
        "times",
    )


def mixed(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """The rows of ``docs`` the mix takes, each as often as it takes them.

    Rows that agree in doc_id, source and text share out the times their group takes:
    all get the least, and those of lowest number once more, as many as it needs.
    """
    draw, times, part, place = (fresh(docs, c) for c in ("draw", "times", "part", "place"))
    taken = copies(docs, doc_id, source, text).select(
        F.col("draw").alias("key_draw"), F.col("doc_id").alias("key_id"), F.col("source").alias("key_source"), "times"
    )
    key = ["key_draw", "key_id", "key_source"]
    # A document of a source is taken ``whole`` or ``whole + 1`` times.
    least = taken.groupBy(*key).agg(
        F.min("times").alias("key_least"), F.sum("times").alias("key_sum"), F.count(F.lit(1)).alias("key_n")
    )
    least = written(least.withColumn("key_more", F.col("key_sum") - F.col("key_least") * F.col("key_n")), "times")
    # The part of the input a row comes from numbers rows without gathering a group.
    keyed = docs.withColumn(draw, F.xxhash64(F.lit(SEED), F.col(doc_id), F.col(text))).withColumn(
        part, F.shiftright(F.monotonically_increasing_id(), 33)
    )
    same = [keyed[a].eqNullSafe(F.col(b)) for a, b in zip((draw, doc_id, source), key)]
    joined = keyed.join(least, same)
    even = joined.where(F.col("key_more") == 0).withColumn(times, F.col("key_least"))
    uneven = written(joined.where(F.col("key_more") > 0), "shared-out")
    per_part = uneven.groupBy(*key, part).agg(F.count(F.lit(1)).alias("key_here"))
    ahead = Window.partitionBy(*key).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    per_part = per_part.withColumn("key_before", F.coalesce(F.sum("key_here").over(ahead), F.lit(0)))
    per_part = per_part.select(*(F.col(k).alias(f"{k}_") for k in key), F.col(part).alias("key_part"), "key_before")
    meets = [uneven[k].eqNullSafe(per_part[f"{k}_"]) for k in key] + [uneven[part] == per_part["key_part"]]
    rank = F.row_number().over(Window.partitionBy(*key, part).orderBy(F.lit(1)))
    shared = uneven.withColumn(place, rank).join(per_part, meets)
    shared = shared.withColumn(
        times, F.col("key_least") + F.when(F.col(place) + F.col("key_before") <= F.col("key_more"), 1).otherwise(0)
    )
    wanted = [*docs.columns, times]
    rows = even.select(*wanted).unionByName(shared.select(*wanted)).where(F.col(times) > 0)
    return rows.withColumn(times, F.explode(F.array_repeat(F.lit(1), F.col(times).cast("int")))).select(*docs.columns)
