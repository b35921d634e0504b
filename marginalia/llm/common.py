"""What several operators of this subpackage share: columns, components."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.storage import freed, stored


def free_name(df: DataFrame, *wanted: str) -> list[str]:
    """The wanted column names, with underscores before those that df already has (in any case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


#: Rows that one task of a round of components() takes, about.
COMPONENT_ROWS = 50_000


def components(edges: DataFrame, tag: str = "cc") -> DataFrame:
    """Connected components of edges(a, b), any orderable type: (node, root), root being the component's least node. Only
    nodes with an edge are returned; self edges count as none, nulls are left out.

    In each round every node points at its least neighbour. Such pointers run in circles of two nodes only, of which the lesser
    becomes a root; jumping doubles the reach of the pointers until all show roots. Then roots take the place of nodes in the
    edges. As every node joins another one, each round leaves half of the nodes at most, whatever the names and the shape:
    rounds end by themselves, after log2 of the nodes at the latest, and the tables shrink.

    Tables between steps are written to the shared folder. Stages get as many tasks as the number of edges asks for. A hub's rows
    are met only in sums with partial aggregation and in joins that AQE may split."""
    e = edges.select("a", "b").where("a is not null and b is not null and a <> b")
    e = stored(e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{tag}-edges")
    label = e.select(F.col("a").alias("node"), F.col("a").alias("root")).limit(0)
    for turn in itertools.count():
        n = e.count()
        if not n:
            break
        tasks = max(2, -(-n // COMPONENT_ROWS))
        near = stored(e.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("to")).coalesce(tasks), f"{tag}-near")
        seen = lambda up: up.select(F.col("node").alias("at"), F.col("to").alias("next"))
        low = (F.col("next") == F.col("node")) & (F.col("node") < F.col("to"))
        up = stored(near.join(seen(near), F.col("to") == F.col("at")).select("node", F.when(low, F.col("node")).otherwise(F.col("to")).alias("to")).coalesce(tasks), f"{tag}-up")
        freed(near)
        while True:
            jump = stored(up.join(seen(up), F.col("to") == F.col("at")).select("node", F.col("next").alias("to"), (F.col("to") != F.col("next")).alias("moved")).coalesce(tasks), f"{tag}-up")
            freed(up)
            up = jump
            if up.where("moved").isEmpty():
                break
        a, b = (up.select(F.col("node").alias(f"_{x}"), F.col("to").alias(f"r{x}")) for x in "ab")
        rest = e.join(a, F.col("a") == F.col("_a")).join(b, F.col("b") == F.col("_b")).where("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct()
        rest = stored(rest.coalesce(tasks), f"{tag}-edges")
        if turn:
            joined = stored(label.join(seen(up), F.col("root") == F.col("at"), "left").select("node", F.coalesce("next", "root").alias("root")), f"{tag}-label")
        else:
            joined = stored(up.select("node", F.col("to").alias("root")), f"{tag}-label")
        freed(e, up, label)
        e, label = rest, joined
    least = label.groupBy(F.col("root").alias("_root")).agg(F.min("node").alias("least"))
    out = stored(label.join(least, F.col("root") == F.col("_root")).select("node", F.col("least").alias("root")), f"{tag}-label")
    freed(label)
    return out
