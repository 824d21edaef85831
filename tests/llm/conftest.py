"""Small fixtures of the operators' tests."""

import random

import pytest

# Columns that an input may have besides, under names the operators use themselves.
EXTRA = ["print", "row", "size", "n", "tokens", "found", "p_good", "good", "severity", "shard", "draw", "times", "key"]


@pytest.fixture
def documents(spark, tmp_path):
    """A stored documents table from (doc_id, text) pairs or (doc_id, text, lang, source, n_chars)."""
    made = iter(range(1000))

    def make(rows, parts=3, extra=False):
        full = [(*r, *("en", "s", None if r[1] is None else len(r[1])))[:5] for r in rows]
        df = spark.createDataFrame(full, "doc_id bigint, text string, lang string, source string, n_chars bigint")
        if extra:
            df = df.selectExpr("*", *(f"{i} as {c}" for i, c in enumerate(EXTRA)))
        path = str(tmp_path / f"documents-{next(made)}.parquet")
        df.repartition(parts).write.parquet(path)
        return spark.read.parquet(path)

    return make


@pytest.fixture(scope="session")
def prose():
    """Reproducible sentences of invented words."""

    def make(seed, words):
        rng = random.Random(seed)
        parts = ["an", "ber", "cor", "dil", "er", "fen", "gor", "hal", "ing", "jot"]
        return " ".join("".join(rng.choices(parts, k=rng.randint(1, 3))) for _ in range(words))

    return make
