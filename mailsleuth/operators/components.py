"""Connected components of large graphs by alternating large and small stars; nothing comes to the driver but two
numbers a round."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import stored


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("s")).first()
    return r["n"], r["s"]


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``edges``: a, b (long). Returns v, root for every vertex that is not itself the smallest of its component.
    The number of rounds is logarithmic in practice and has no limit; each is written to the shared folder."""
    edges = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    before = _state(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # every larger neighbour goes to the smallest vertex around
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.where("m < a").select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        large = stored(large, name)
        # every smaller neighbour, and the vertex itself, goes to the smallest of them
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        edges = stored(large.join(small, "a").select(F.explode(F.array(F.struct("a", "m"), F.struct(F.col("b").alias("a"), "m"))).alias("e"))
                       .select("e.a", F.col("e.m").alias("b")).where("a <> b").distinct(), name)
        after = _state(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("a").alias("v"), F.col("b").alias("root"))


PARENT_ROW = "v long, root long, step long"


def roots_of(table, vertices: DataFrame) -> DataFrame:
    """v, root of distinct vertices (column v) in a kept forest (a ``KeyedTable`` of the row above, by ``v``): pointers are
    followed until none leads on, at most once for each batch that has merged a component."""
    found = stored(vertices.select("v", F.col("v").alias("root")), "roots")
    while True:
        step = table.read(found.select(F.col("root").alias("v")).distinct()).select(F.col("v").alias("root"), F.col("root").alias("up"))
        found = stored(found.join(step, "root", "left").select("v", F.coalesce("up", "root").alias("root"), F.col("up").isNotNull().alias("moved")), "roots")
        if not found.where("moved").take(1):
            return found.select("v", "root")


def grow_components(table, edges: DataFrame, batch_id: int) -> bool:
    """Add the edges (a, b) of a batch to the components kept in ``table``. Only the roots of the vertices that the batch
    touches are looked up, joined among themselves and written: a component that grows or merges gets a pointer for
    its new vertices and its old root, and the others nothing. False for a batch that is there already."""
    edges = stored(edges.where("a <> b").select("a", "b").distinct(), "new-edges")
    ends = stored(edges.select(F.col("a").alias("v")).union(edges.select(F.col("b").alias("v"))).distinct(), "touched")
    roots = roots_of(table, ends)
    lifted = edges.join(roots.select(F.col("v").alias("a"), F.col("root").alias("ra")), "a").join(roots.select(F.col("v").alias("b"), F.col("root").alias("rb")), "b")
    merged = components(lifted.select(F.col("ra").alias("a"), F.col("rb").alias("b")), "merged")
    return table.upsert(merged.select("v", "root", F.lit(batch_id).cast("long").alias("step")), batch_id)


def kept_components(table) -> DataFrame:
    """v, root of every vertex in the kept forest that is not a root, by pointer doubling."""
    found = stored(table.read().select("v", "root"), "pointers")
    while True:
        up = found.select(F.col("v").alias("root"), F.col("root").alias("up"))
        found = stored(found.join(up, "root", "left").select("v", F.coalesce("up", "root").alias("root"), F.col("up").isNotNull().alias("moved")), "pointers")
        if not found.where("moved").take(1):
            return found.select("v", "root")
