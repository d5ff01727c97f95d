import random

import pytest
from pyspark.sql import types as T

DOCUMENTS = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
)
#: Names that operators use themselves.
CLASHES = ["score", "kept", "held_out", "fp", "component_id", "rank", "size", "part", "place", "rule", "host", "n", "a", "b", "quality", "fit", "bucket", "cells"]

EN = "the of and to in that is for it as was with be by on thing order tion water people never always small house".split()
DE = "der die und den von zu das mit sich des auf für ist im dem nicht ein eine Häuser Straße Wasser immer klein".split()


def prose(rnd, words, n):
    return " ".join(rnd.choice(words) + rnd.choice(["", "", "", "er", "ing", "s", "lich"]) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Prose in two languages, junk, copies, near copies, empty, null, wordless, long and repeated rows."""
    rnd = random.Random(11)
    out = [(i, prose(rnd, EN, rnd.randint(60, 200)) + ".", "en") for i in range(40)]
    out += [(i, prose(rnd, DE, rnd.randint(60, 200)) + ".", "de") for i in range(40, 70)]
    out += [(i, " ".join(w + "&&&" for w in prose(rnd, EN, 80).split()), "en") for i in range(70, 78)]
    out += [(78, out[3][1], "en"), (79, out[3][1].upper(), "en"), (80, out[50][1], "de"), (81, out[50][1], None)]
    out += [(82, None, "en"), (83, "", "en"), (84, " \t\n ", None), (85, "12 34 -- ==", "en"), (86, "Word", "en"), (87, "x" * 5000, "en")]
    out += [(88, "\n".join(prose(rnd, EN, 20) for _ in range(1500)), "en"), (89, "same words " * 400, "en"), (5, out[5][1], "en"), (5, out[5][1], "en")]
    return out


@pytest.fixture(scope="session")
def documents(spark, rows):
    return spark.createDataFrame([(i, t, lang, f"src{i % 3}", len(t) if t else None) for i, t, lang in rows], DOCUMENTS).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCUMENTS)


@pytest.fixture(scope="session")
def clashing(documents):
    from pyspark.sql import functions as F

    return documents.withColumns({c: F.lit("x") for c in CLASHES})


def plain(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
