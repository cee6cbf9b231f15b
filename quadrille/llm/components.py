"""Connected components of a table of links, on tables only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.llm.common import discard, stored

ROUNDS = 60


def components(links: DataFrame) -> DataFrame:
    """links: a, b (long). (id, root): the least id that each linked id reaches.

    Each round every id takes the least root around it, its old root is hooked there too, and roots are followed one
    step further; the number of rounds grows with the logarithm of the longest path. The least root around an id is
    a partial aggregate, so an id with very many links is no hot group."""
    both = links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct()
    both = stored(both, "links")
    roots = stored(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("root")), "roots")
    table = roots
    for _ in range(ROUNDS):
        around = both.join(roots.select(F.col("id").alias("b"), F.col("root").alias("rb")), "b").groupBy("a").agg(F.min("rb").alias("rb"))
        near = roots.join(around, roots["id"] == around["a"], "left").select("id", "root", F.least("root", F.coalesce("rb", "root")).alias("to"))
        hooks = near.where("to < root").groupBy(F.col("root").alias("id")).agg(F.min("to").alias("hook"))
        near = near.join(hooks, "id", "left").select("id", "root", F.least("to", F.coalesce("hook", "to")).alias("to"))
        near = stored(near, "near")
        onward = near.select(F.col("id").alias("to"), F.col("to").alias("further"))
        moved = near.join(onward, "to", "left").select("id", "root", F.least("to", F.coalesce("further", "to")).alias("to"))
        moved = stored(moved, "roots")
        discard(near)
        discard(table)
        table, roots = moved, moved.select("id", F.col("to").alias("root"))
        if moved.where("to <> root").isEmpty():
            discard(both)
            return roots
    raise RuntimeError("the components did not settle")
