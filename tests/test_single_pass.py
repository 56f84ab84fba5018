"""Costly expressions are worked out once a row, and give what they gave."""

import datetime

from pyspark.sql import functions as F

from scriptorium.functions import dates
from scriptorium.functions import text as T
from scriptorium.operators import search


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_name_is_scored_once(spark):
    names = spark.createDataFrame([(1, "Customer 42"), (2, ""), (3, None), (4, "--"), (5, "customer"), (6, "zz")], "id long, name string")
    found = search.fuzzy_names(names, "customer 42", 10)
    assert plan(found).count("array_intersect") == 1
    assert [(r.id, round(r.score, 3)) for r in found.collect()] == [(1, 1.0), (5, 0.75)]


def test_trigrams_of_odd_words(spark):
    rows = spark.createDataFrame([("a\nBc, a",), ("-É2-",), ("\U00020000\U00020001",), ("",), (" ",), (None,)], "name string").select(T.trigrams(F.col("name")).alias("g")).collect()
    assert [r.g for r in rows] == [["  a", " a ", "  b", " bc", "bc "], ["  é", " é2", "é2 "], ["  \U00020000", " \U00020000\U00020001", "\U00020000\U00020001 "], [], [], None]


def test_an_anchored_phrase_is_parsed_once(spark):
    rows = spark.createDataFrame([("the 15th ult.",), ("May 3, 1862",), ("week of the 3d inst.",), ("the 31st prox.",), ("nothing",), (None,)], "p string").withColumn("a", F.lit(datetime.date(1862, 3, 20)))
    found = rows.select(dates.anchored(F.col("p"), F.col("a")).alias("day"))
    assert plan(found).count("^yesterday$") == 1
    assert [r.day for r in found.collect()] == [datetime.date(1862, 2, 15), None, None, None, None, None]
