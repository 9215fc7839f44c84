"""Spanning forests and components by repeated contraction along least edges (Borůvka)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm.setjoin import spread
from quillspan.session import materialize


def spanning_forest(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(labels, forest)`` of an undirected graph with edges ``a, b``.

    ``labels`` has ``v, root`` for each vertex with an edge, ``root`` being the
    least vertex of its component; ``forest`` has the ``a, b`` of a spanning
    forest. Loops, repeated edges and edges with a null end are left out.

    In each round every component picks its least edge (edges are ordered by
    their ends, so there are no ties), the picked edges join the forest, and
    components contract along them. The number of components at least halves in
    a round. Each round's tables are written to the shared folder.
    """
    clean = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    live = materialize(clean.select(F.col("a").alias("x"), F.col("b").alias("y"), "a", "b"), "forest-edges")
    vertices = live.select(F.col("x").alias("v")).unionAll(live.select(F.col("y").alias("v"))).distinct()
    labels = materialize(vertices.select("v", F.col("v").alias("root")), "forest-labels")
    forest = None
    while not live.isEmpty():
        both = live.select("x", F.struct("a", "b", F.col("y").alias("to")).alias("e")).unionAll(live.select(F.col("y").alias("x"), F.struct("a", "b", F.col("x").alias("to")).alias("e")))
        picked = materialize(both.groupBy("x").agg(F.min("e").alias("e")).select("x", F.col("e.to").alias("to"), F.col("e.a").alias("a"), F.col("e.b").alias("b")), "forest-picked")
        chosen = picked.select("a", "b").distinct()
        forest = chosen if forest is None else forest.unionByName(chosen)
        # picked edges lead to a pair of components that picked each other; the lesser of the two is the root
        back = picked.select(F.col("x").alias("to"), F.col("to").alias("back"))
        parent = picked.join(spread(back), "to", "left").select("x", F.when((F.col("back") == F.col("x")) & (F.col("x") < F.col("to")), F.col("x")).otherwise(F.col("to")).alias("p"))
        parent = materialize(parent, "forest-parents")
        while True:
            up = parent.select(F.col("x").alias("p"), F.col("p").alias("pp"))
            jumped = materialize(parent.join(spread(up), "p").select("x", F.col("pp").alias("p"), (F.col("pp") != F.col("p")).alias("moved")), "forest-parents")
            parent = jumped.select("x", "p")
            if jumped.where("moved").isEmpty():
                break
        labels = materialize(labels.join(spread(parent.select(F.col("x").alias("root"), F.col("p").alias("to"))), "root", "left").select("v", F.coalesce("to", "root").alias("root")), "forest-labels")
        px, py = parent.select("x", F.col("p").alias("px")), parent.select(F.col("x").alias("y"), F.col("p").alias("py"))
        moved = live.join(spread(px), "x").join(spread(py), "y").where("px <> py")
        live = materialize(moved.groupBy(F.least("px", "py").alias("x"), F.greatest("px", "py").alias("y")).agg(F.min(F.struct("a", "b")).alias("e")).select("x", "y", "e.a", "e.b"), "forest-edges")
    least = labels.groupBy("root").agg(F.min("v").alias("least"))
    named = labels.join(spread(least), "root").select("v", F.col("least").alias("root"))
    return named, clean.limit(0) if forest is None else forest


def components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """``v, root`` for each different vertex, those without edges included; ``root`` is the least vertex of the component."""
    labels, _ = spanning_forest(edges)
    return vertices.select("v").where("v IS NOT NULL").distinct().join(spread(labels), "v", "left").select("v", F.coalesce("root", "v").alias("root"))
