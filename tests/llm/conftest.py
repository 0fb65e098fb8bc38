import random

import pytest

from scopelens.llm import memory

WORDS = [a + b for a in ("ka", "lo", "mi", "ru", "te", "so") for b in ("n", "ra", "st", "vel", "dor", "pi", "x")]


@pytest.fixture(autouse=True)
def fresh_caches():
    """Caches of the test process start empty, as a task's do, whatever other tests left in them."""
    memory.released()


@pytest.fixture
def prose():
    """A maker of texts of so many words, the same for the same seed."""

    def make(count, seed=0):
        source = random.Random(seed)
        return " ".join(source.choice(WORDS) for _ in range(count))

    return make


@pytest.fixture
def documents(spark):
    """Documents from (id, text) pairs, with columns whose names operators use themselves."""

    def make(*rows, extra=True):
        df = spark.createDataFrame(list(rows), "doc_id long, text string")
        return df.selectExpr("doc_id", "text", "'x' AS lang", "'s' AS id", "1 AS size", "2.0 AS score", "'y' AS ids") if extra else df

    return make


def rows_of(df, key, *columns):
    return {row[key]: tuple(row[c] for c in columns) for row in df.collect()}
