"""Which stages a target needs, for very many graphs at once: graphs are tables of stages and of what each needs.

Reachable stages are found round by round, each round meeting only the pairs that the last one found anew; their number
is that of the longest chain. Pairs are distinct, so a stage that is reached on many ways is followed once (a recursive
common table expression without distinct rows follows every way, of which a graph of thirty stages can have millions).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.sources import tables


def closure(needs: DataFrame, targets: DataFrame) -> DataFrame:
    """``graph, target, stage``: each target and all that it needs, by ``needs (graph, stage, need)``; cycles end where
    they meet themselves."""
    edges = tables.written(needs.select("graph", F.col("stage").alias("at"), F.col("need").alias("next")).where("next IS NOT NULL").distinct(), "needs")
    new = tables.written(targets.select("graph", F.col("stage").alias("target"), "stage").distinct(), "reached")
    rounds = [new]
    while True:
        found = new.withColumnRenamed("stage", "at").join(edges, ["graph", "at"]).select("graph", "target", F.col("next").alias("stage")).distinct()
        for old in rounds:
            found = found.join(old, ["graph", "target", "stage"], "left_anti")
        new = tables.written(found, "reached")
        if new.isEmpty():
            break
        rounds.append(new)
        if len(rounds) > 8:  # the plan stays short
            rounds = [tables.written(_union(rounds), "reached")]
    return _union(rounds)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def problems(stages: DataFrame, needs: DataFrame) -> DataFrame:
    """``graph, stage, problem`` of graphs ``stages (graph, stage)`` and ``needs (graph, stage, need)``: a stage that is there
    twice, a need that is no stage, and a stage that needs itself, over others or not."""
    twice = stages.groupBy("graph", "stage").count().where("count > 1").select("graph", "stage", F.lit("it is defined twice").alias("problem"))
    known = stages.select("graph", F.col("stage").alias("need")).distinct()
    unknown = needs.join(known, ["graph", "need"], "left_anti").select("graph", "stage", F.concat(F.lit("it needs "), F.col("need").cast("string"), F.lit(", which isn't a stage")).alias("problem")).distinct()
    own = needs.select("graph", "stage", "need").distinct()
    # only stages that still need and are needed when all others are gone can be on a cycle
    left = tables.written(own, "on-cycles")
    while True:
        before = left.count()
        left = left.join(left.select("graph", F.col("stage").alias("need")).distinct(), ["graph", "need"], "left_semi")
        left = tables.written(left.join(left.select("graph", F.col("need").alias("stage")).distinct(), ["graph", "stage"], "left_semi"), "on-cycles")
        if left.count() == before:
            break
    reached = closure(left, left.select("graph", F.col("need").alias("stage")))  # what is reached from each need
    cycle = left.join(reached.select("graph", F.col("target").alias("need"), "stage"), ["graph", "need", "stage"], "left_semi").select("graph", "stage", F.lit("it needs itself").alias("problem")).distinct()
    return twice.unionByName(unknown).unionByName(cycle)


def selected(stages: DataFrame, needs: DataFrame, targets: DataFrame) -> DataFrame:
    """``graph, stage`` of all stages to run for ``targets (graph, stage)``; a graph without targets runs all of them."""
    some = closure(needs, targets).select("graph", "stage").distinct()
    every = stages.join(targets.select("graph").distinct(), "graph", "left_anti").select("graph", "stage").distinct()
    return some.join(stages.select("graph", "stage").distinct(), ["graph", "stage"], "left_semi").unionByName(every)
