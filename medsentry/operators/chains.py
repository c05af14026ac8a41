"""Where duplicate pointers lead: roots, cycles and components, by pointer doubling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import EngineError
from ..storage import written


def check_single(edges: DataFrame) -> None:
    """Raise if a record points to two canonical records."""
    bad = edges.groupBy("primaryid").agg(F.count_distinct("canonical_primaryid").alias("n")).filter("n > 1").limit(5).collect()
    if bad:
        raise EngineError(f"records with two canonical records: {[r.primaryid for r in bad]}")


def resolve(edges: DataFrame) -> DataFrame:
    """(node, root, component, on_cycle, closed) for every record in a pointer or pointed to.

    Each round doubles how far a pointer reaches, so a chain or cycle of length n takes about log2(n) joins.
    The joins are merges: pointers take little room as files, so Spark would send them through the driver in each round.
    A root points nowhere. Records that never reach one lead into a cycle: their root is null,
    their component is the smallest id of the cycle, and the component is closed.
    """
    check_single(edges)
    edges = edges.select(F.col("primaryid").alias("node"), F.col("canonical_primaryid").alias("to")).distinct()
    nodes = edges.select("node").union(edges.select(F.col("to").alias("node"))).distinct()
    ends = nodes.join(edges.hint("merge"), "node", "left_anti").select("node", F.col("node").alias("to"))
    # low: the smallest id among the records passed so far.
    now = written(edges.unionByName(ends).withColumn("low", F.least("node", "to")), "pointers")
    total, reach, met = now.count(), 1, -1
    while reach < 2 * total:
        ahead = now.select(F.col("node").alias("to"), F.col("to").alias("next"), F.col("low").alias("next_low"))
        low = F.least("low", "next_low")
        new = written(now.join(ahead.hint("merge"), "to").select("node", F.col("next").alias("to"), low.alias("low"), (F.col("to") != F.col("next")).alias("moved"), (low != F.col("low")).alias("lower")), "pointers")
        now, reach = new.drop("moved", "lower"), reach * 2
        seen = new.agg(F.coalesce(F.bool_or("moved"), F.lit(False)), F.coalesce(F.bool_or("lower"), F.lit(False)), F.count_distinct("to")).first()
        # As many ends as a round before: the round only permutes them, so all are roots or stand on cycles. Lows
        # that don't fall either are the same all along the strides of a cycle, so they are its smallest id.
        if not seen[0] or (seen[2] == met and not seen[1]):
            break
        met = seen[2]
    tops = ends.select(F.col("node").alias("to")).hint("merge")
    rooted = now.join(tops, "to", "left_semi").select("node", F.col("to").alias("root"), F.col("to").alias("component"), F.lit(False).alias("on_cycle"), F.lit(False).alias("closed"))
    # Whoever has not come to a root stands on a cycle by now, or points to one, and that has passed all of it.
    looping = written(now.join(tops, "to", "left_anti"), "looping")
    cycle = looping.select(F.col("to").alias("node")).distinct()
    lows = looping.join(cycle.hint("merge"), "node", "left_semi").select(F.col("node").alias("to"), F.col("low").alias("component"))
    flagged = looping.select("node", "to").join(lows.hint("merge"), "to").join(cycle.withColumn("on_cycle", F.lit(True)).hint("merge"), "node", "left")
    return rooted.unionByName(flagged.select("node", F.lit(None).cast("bigint").alias("root"), "component", F.coalesce("on_cycle", F.lit(False)).alias("on_cycle"), F.lit(True).alias("closed")))


def report(resolved: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: pointers, components, cycles, closed components, and whether the graph is sound."""
    parts = resolved.groupBy("component").agg(F.bool_or("closed").alias("closed"))
    figures = parts.agg(F.count("*").alias("components"), F.count_if("closed").alias("closed_components"))
    cycles = resolved.filter("on_cycle").agg(F.count_distinct("component").alias("cycles"))
    pointers = edges.agg(F.count("*").alias("pointers"))
    return pointers.join(figures, F.lit(True)).join(cycles, F.lit(True)).withColumn("sound", (F.col("cycles") == 0) & (F.col("closed_components") == 0))
