import random
import re

import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                     T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="session")
def make_docs(spark):
    def build(texts, sources=None):
        """texts: a list (ids count from 0) or pairs of id and text."""
        pairs = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
        sources = sources or ["a"] * len(pairs)
        rows = [(i, t, "en", s, len(t or "")) for (i, t), s in zip(pairs, sources)]
        return spark.createDataFrame(rows, DOCS)

    return build


@pytest.fixture(scope="session")
def prose():
    def build(seed, n):
        """n words that hardly repeat."""
        pick = random.Random(seed)
        return [pick.choice(["ka", "lo", "mi", "ré"]) + "".join(pick.choices("abdegiklmnoprstuvz", k=6)) for _ in range(n)]

    return build
