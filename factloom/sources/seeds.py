"""Rows that every new memory begins with: signs of negation, correction and retraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Fixed values.
#: (phrase, kind, confidence)
NEGATIONS = [
    ("is not", "retraction", 0.95),
    ("is not a", "retraction", 0.95),
    ("is not an", "retraction", 0.95),
    ("no longer", "retraction", 0.95),
    ("not anymore", "retraction", 0.95),
    ("never", "retraction", 0.90),
    ("forget", "retraction", 0.92),
    ("delete", "retraction", 0.92),
    ("remove", "retraction", 0.90),
    ("erase", "retraction", 0.90),
    ("wrong", "correction", 0.88),
    ("actually", "correction", 0.82),
    ("i meant", "correction", 0.85),
    ("changed my mind", "correction", 0.90),
    ("mistake", "correction", 0.88),
    ("incorrect", "correction", 0.88),
    ("typo", "correction", 0.80),
    ("not true", "retraction", 0.92),
    ("that is wrong", "correction", 0.88),
    ("not the case", "retraction", 0.90),
]
#: (pattern, confidence)
CORRECTIONS = [("is .+, not (a |an )?", 0.9), ("is (actually|really) .+ not", 0.9), ("does not have", 0.85), ("is not (a |an )", 0.9)]
#: (phrase, category, priority)
RETRACTIONS = [
    ("forget", "explicit", 95),
    ("delete", "explicit", 95),
    ("remove", "explicit", 90),
    ("erase", "explicit", 90),
    ("is not", "implicit_negation", 92),
    ("no longer", "implicit_negation", 92),
    ("not anymore", "implicit_negation", 90),
    ("wrong", "correction", 88),
    ("actually", "correction", 82),
    ("i meant", "correction", 85),
]


def negations(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(NEGATIONS, "phrase string, kind string, confidence double")


def corrections(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CORRECTIONS, "pattern string, confidence double")


def retractions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RETRACTIONS, "phrase string, category string, priority int")
