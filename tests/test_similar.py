"""Similar names: exact in every step, and no step sends what names leave to the driver."""

import random

from pyspark.sql import functions as F

from varloom.operators import suggest


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        last, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], min(row[j] + 1, row[j + 1] + 1, last + (x != y))
    return row[-1]


def tables(spark, names, index):
    known = spark.createDataFrame([(n, 0, "/v.css", k) for k, n in enumerate(index)], "name string, pattern_ord int, path string, offset int")
    return spark.createDataFrame([(n,) for n in names], "name string"), known


def test_all_steps_against_brute_force(spark):
    make = random.Random(4)
    word = lambda: "--" + "".join(make.choice("ab-12") for _ in range(make.randint(1, 12)))
    index, names = sorted({word() for _ in range(150)}), sorted({word() for _ in range(60)} | {"--gone-123", "--a", "--aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa"})
    want = set()
    for a in names:
        scored = sorted((-(max(len(a), len(b)) - distance(a, b)) / max(len(a), len(b)), k, b) for k, b in enumerate(index))
        want |= {(a, r + 1, b) for r, (s, _, b) in enumerate(scored[:3]) if -s > 0.5}
    assert {(r["var_name"], r["rank"], r["candidate"]) for r in suggest.similar_names(*tables(spark, names, index)).collect()} == want


def test_bits_alone_are_at_most_the_edits(spark):
    make = random.Random(7)
    pairs = [tuple("".join(make.choice("abc\u00e9-1") for _ in range(make.randint(0, 80))) for _ in range(2)) for _ in range(200)]
    df = spark.createDataFrame(pairs, "a string, b string").select(F.levenshtein("a", "b").alias("lev"), suggest._letters(F.col("a")).alias("x"), suggest._letters(F.col("b")).alias("y"))
    assert all(bin(r["x"] & ~r["y"] & (2**64 - 1)).count("1") <= r["lev"] for r in df.collect())


def test_what_names_leave_is_not_broadcast(spark):
    names, index = tables(spark, ["--ab"], ["--abc"])
    wanted, known = names.select(F.col("name").alias("var_name"), F.length("name").alias("n")), index.select(F.col("name").alias("candidate"))
    plan = suggest._within(wanted, known, 2)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan
