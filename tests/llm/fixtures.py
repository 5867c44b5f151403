"""Small tables with the odd cases: nulls, empty and long texts, ties, repeated rows, clashing column names."""

import random

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("kept", T.StringType()), T.StructField("host", T.StringType()), T.StructField("print", T.LongType()), T.StructField("value", T.LongType())])


def sentence(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice("the boat came before noon nobody asked why rain fell road soft carts stood left people spoke years stone wall über señor 梦".split()) + rng.choice(["", "", "", ","]) for _ in range(n))


def documents(spark, seed: int = 5, n: int = 60):
    rng = random.Random(seed)
    shared = [sentence(rng, 30) for _ in range(4)]
    base = sentence(rng, 200)
    rows = [(None, "a row without an id " + base, "s0"), (1, None, "s0"), (2, "", None), (3, " \n\t ", "s1"), (4, "one", "s1"), (5, "one", "s2"), (6, "Two words", "s2"), (7, "two WORDS", "s2")]
    for i in range(8, n):
        kind = rng.randrange(5)
        words = base.split()
        if kind == 0:
            text = base
        elif kind == 1:
            for _ in range(rng.randrange(1, 12)):
                words[rng.randrange(len(words))] = rng.choice(["x1", "y2", "z3"]) + str(i)
            text = " ".join(words)
        elif kind == 2:
            text = sentence(rng, 20) + "\n" + rng.choice(shared) + "\n" + sentence(rng, 20)
        elif kind == 3:
            text = "\n".join(rng.choice(shared) for _ in range(3))
        else:
            text = sentence(rng, rng.randrange(1, 400))
        rows.append((i * 3 % n + 100 * (i % 2), text, f"s{i % 3}"))
    rows.append((500, sentence(rng, 9000), "s0"))
    rows.append(rows[-3])  # a row that repeats whole
    return spark.createDataFrame([(i, t, s, "x", "h", 1, 2) for i, t, s in rows], DOCS)


def empty(spark, schema=DOCS):
    return spark.createDataFrame([], schema)
