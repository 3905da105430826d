"""Places in chains by pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanegraph.stage import discard, materialize


def rank_chains(items: DataFrame, by: list[str]) -> DataFrame:
    """``by``, id, chain, pos, closed for items (``by``, id, prev: the item before it, or null).

    Every item follows at most one and is followed by at most one, so items are chains or rings.
    ``chain`` is the id of the first item, of a ring the least, and ``pos`` the steps from there.

    Each item points back and knows the steps to where it points and the least id on the way;
    a round lets it take over the pointer of the item it points to, which doubles the way. A
    chain's items end at its first; a ring is known when a round finds no lesser id. The rounds
    are the logarithm of the longest chain. Items that have ended are looked up but not written
    again; a round is one join and one stage table.
    """
    start = F.col("prev").isNull()
    first = items.select(
        *by, "id", F.coalesce("prev", "id").alias("up"), F.when(start, 0).otherwise(1).cast("bigint").alias("n"), start.alias("done"), F.col("id").alias("least"), F.lit(0).cast("bigint").alias("at"), F.lit(True).alias("moved")
    )
    tables = [materialize(first, "chains")]
    while True:
        active = tables[-1].filter("not done")
        if active.isEmpty():
            break
        known = active
        for t in tables:
            known = known.unionByName(t.filter("done"))
        ahead = known.select(*by, F.col("id").alias("up"), *[F.col(c).alias(f"{c}2") for c in ("up", "n", "done", "least", "at")])
        own, other = F.struct("least", "at"), F.struct(F.col("least2").alias("least"), (F.col("n") + F.col("at2")).alias("at"))
        jumped = active.join(ahead, [*by, "up"]).withColumn("best", F.least(own, other))
        step = jumped.select(*by, "id", F.col("up2").alias("up"), (F.col("n") + F.col("n2")).alias("n"), F.col("done2").alias("done"), F.col("best.least").alias("least"), F.col("best.at").alias("at"), (F.col("best.least") < F.col("least")).alias("moved"))
        tables.append(materialize(step, "chains"))
        if tables[-1].filter("done or moved").isEmpty():
            break
    out = None
    for k, t in enumerate(tables):
        last = t if k == len(tables) - 1 else t.filter("done")
        one = last.select(*by, "id", F.when(F.col("done"), F.col("up")).otherwise(F.col("least")).alias("chain"), F.when(F.col("done"), F.col("n")).otherwise(F.col("at")).alias("pos"), (~F.col("done")).alias("closed"))
        out = one if out is None else out.unionByName(one)
    ranked = materialize(out, "chains-ranked")
    discard(*tables)
    return ranked
