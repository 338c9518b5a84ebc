"""Consolidating pairwise matches into groups.

Edges are reduced to spanning forests inside bounded partitions, the forests are merged level by level
until one bounded partition holds what is left.  A forest is kept as stars, one row for each vertex but the root, so
a level that brings the rows of a vertex together gets at most one of each partition: vertices with very many
neighbours, which are roots or spread over as many rows, never fill a partition.  Where several partitions saw a vertex,
their forests are joined by it and shrink to one row a vertex.  A graph with more vertices than one partition may hold
cannot shrink further that way: its vertices are contracted onto a random neighbour (plain aggregations and joins,
whose skewed keys are split by adaptive execution) and the merging goes on over the smaller graph; the contraction is
undone at the end.  No task and no driver ever holds more than ``bound`` edges.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.plans.cut import cut

BOUND = 1_000_000
_BIAS = Decimal("9223372036854775808")
_EDGES = "node string, root string"


def vertex(seq: str | Column, number: str | Column) -> Column:
    """One string per (text, long) whose byte order is the order of (text, long)."""
    seq, number = (F.col(c) if isinstance(c, str) else c for c in (seq, number))
    digits = F.lpad((number.cast("decimal(20,0)") + F.lit(_BIAS)).cast("decimal(20,0)").cast("string"), 20, "0")
    return F.concat(seq, F.lit("\x00"), digits)


def vertex_text(v: str) -> Column:
    return F.expr(f"substring({v}, 1, length({v}) - 21)")


def vertex_number(v: str) -> Column:
    return (F.expr(f"right({v}, 20)").cast("decimal(20,0)") - F.lit(_BIAS)).cast("long")


def union_find(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """Smallest member of every vertex's set, for vertices 0..n-1."""
    parent = np.arange(n)
    while len(u):
        a, b = parent[u], parent[v]
        open_ = a != b
        u, v, a, b = u[open_], v[open_], a[open_], b[open_]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up
    return parent


def _reduce(u: list[pa.Array], v: list[pa.Array]) -> tuple[pa.Array, np.ndarray]:
    """Distinct vertices in byte order and, for each, the place of its root."""
    coded = pa.chunked_array([*u, *v], pa.string()).combine_chunks().dictionary_encode()
    order = pc.array_sort_indices(coded.dictionary).to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    codes = place[coded.indices.to_numpy()]
    half = len(codes) // 2
    return coded.dictionary.take(pa.array(order)), union_find(codes[:half], codes[half:], len(order))


def _forests(bound: int, whole: bool):
    """Spanning forest of a partition as stars; ``whole`` keeps the roots' own rows."""

    def stars(u: list[pa.Array], v: list[pa.Array]) -> pa.RecordBatch:
        names, root = _reduce(u, v)
        keep = np.arange(len(root)) if whole else np.flatnonzero(root != np.arange(len(root)))
        return pa.RecordBatch.from_arrays([names.take(pa.array(keep)), names.take(pa.array(root[keep]))], ["node", "root"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u, v, held = [], [], 0
        for b in batches:
            u.append(b.column(0))
            v.append(b.column(1))
            held += b.num_rows
            if held > bound and not whole:
                out = stars(u, v)
                u, v, held = [out.column(0)], [out.column(1)], out.num_rows
                if held > bound // 2:
                    yield out
                    u, v, held = [], [], 0
        if held:
            yield stars(u, v)

    return run


def _contract(edges: DataFrame, seed: int) -> tuple[DataFrame, DataFrame]:
    """Every vertex goes onto the neighbour (or itself) with the smallest random rank."""
    rank = lambda c: F.struct(F.xxhash64(F.lit(seed), F.col(c)).alias("rank"), F.col(c).alias("id"))
    both = edges.select("node", "root").union(edges.select(F.col("root").alias("node"), F.col("node").alias("root")))
    to = both.groupBy("node").agg(F.min(rank("root")).alias("best"))
    to = cut(to.select("node", F.when(rank("node") < F.col("best"), F.col("node")).otherwise(F.col("best")["id"]).alias("onto")))
    a = to.select(F.col("node").alias("root"), F.col("onto").alias("root_onto"))
    small = edges.join(to, "node").join(a, "root").select(F.col("onto").alias("node"), F.col("root_onto").alias("root"))
    return to, small.where("node <> root").distinct()


def connected_components(edges: DataFrame, u: str = "u", v: str = "v", *, bound: int = BOUND) -> DataFrame:
    """(node, root) for every vertex of an edge between two different vertices; root is the smallest vertex of its component.

    ``edges`` may hold other columns, repeated, reversed, looping and null-ended rows; loops and null ends
    link nothing.  An empty input gives an empty result.  Vertices are strings compared by byte.
    ``bound``: most edges any task holds.
    """
    e = edges.select(F.col(u).alias("node"), F.col(v).alias("root")).where("node <> root")
    e = e.select(F.greatest("node", "root").alias("node"), F.least("node", "root").alias("root"))
    forest, undo = cut(e.mapInArrow(_forests(bound, False), _EDGES)), []
    n, before, seed = forest.count(), None, 0
    while n > bound:
        if before is not None and n > 0.7 * before:
            to, forest = _contract(forest, seed)
            undo.append(to)
            seed += 1
        parts = max(1, ceil(n / bound))
        before, forest = n, cut(forest.repartition(parts, "node").mapInArrow(_forests(bound, False), _EDGES))
        n = forest.count()
    labels = forest.repartition(1).mapInArrow(_forests(bound, True), _EDGES)
    if not undo:
        return labels
    for to in reversed(undo):
        labels = labels.withColumnRenamed("node", "onto")
        labels = cut(to.join(labels, "onto", "left").select("node", F.coalesce("root", "onto").alias("root")))
    least = labels.groupBy("root").agg(F.min("node").alias("least"))
    return labels.join(least, "root").select("node", F.col("least").alias("root"))


def group_records(records: DataFrame, pairs: DataFrame, *, record=("seq", "track_id"), left=("seq_a", "track_a"), right=("seq_b", "track_b"), bound: int = BOUND) -> DataFrame:
    """Groups of at least two records: (node, root) as ``vertex`` strings.

    A pair counts only if both ends are records; null-keyed records and pairs count for nothing.
    Both inputs are reduced to distinct keys before the joins, so repeated rows cost one shuffle row each.
    """
    rec = records.select(vertex(*record).alias("k")).where("k is not null").distinct()
    e = pairs.select(vertex(*left).alias("u"), vertex(*right).alias("v")).where("u <> v")
    e = e.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    e = e.join(rec.withColumnRenamed("k", "u"), "u", "left_semi").join(rec.withColumnRenamed("k", "v"), "v", "left_semi")
    return connected_components(e, bound=bound)
