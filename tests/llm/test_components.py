import random

import pytest

from pyspark.sql import functions as F

from trackloom.llm import components as C
from trackloom.llm.components import connected_components, group_records, vertex, vertex_number, vertex_text


def brute(edges):
    parent = {}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is None or b is None or a == b:
            continue
        parent.setdefault(a, a), parent.setdefault(b, b)
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    return {(x, find(x)) for x in parent}


def run(spark, edges, **kw):
    got = [tuple(r) for r in connected_components(spark.createDataFrame(edges, "u string, v string"), **kw).collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize("bound", [1_000_000, 40, 12])
def test_random_graphs_match_union_find(spark, bound):
    rng = random.Random(bound)
    edges = [(f"n{rng.randrange(150):03d}", f"n{rng.randrange(150):03d}") for _ in range(90)]
    edges += [(f"p{i:03d}", f"p{i + 1:03d}") for i in range(60)] + [("hub", f"q{i}") for i in range(60)]
    edges += [(b, a) for a, b in edges[:20]] + edges[:20] + [("x", "x"), (None, "y"), ("z", None)]
    rng.shuffle(edges)
    assert run(spark, edges, bound=bound) == brute(edges)


def test_hub_and_graph_of_twenty_bounds_in_even_partitions(spark, monkeypatch):
    rng, bound = random.Random(3), 500
    edges = [(f"n{rng.randrange(5000):04d}", f"n{rng.randrange(5000):04d}") for _ in range(5000)] + [("a", f"q{i:05d}") for i in range(5000)]
    levels, real = [], C.cut

    def cut(df):
        out = real(df)
        if out.columns == ["node", "root"]:
            sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
            levels.append((sum(sizes), max(sizes, default=0)))
        return out

    monkeypatch.setattr(C, "cut", cut)
    assert run(spark, edges, bound=bound) == brute(edges)
    # after the first level, which keeps the input's partitions, no partition holds much more than its share, the hub's neighbours included
    merging = levels[1 : next(i for i, (n, _) in enumerate(levels) if n <= bound)]
    assert len(merging) > 2 and all(most <= 2 * bound for _, most in merging)


def test_empty(spark):
    assert run(spark, []) == set()


def test_vertices_keep_order_and_round_trip(spark):
    rows = [("a", 5), ("a", -3), ("a", 10), ("ab", 1), ("a/b", 2), ("é", 0), ("z", 2**63 - 1), ("z", -(2**63))]
    df = spark.createDataFrame(rows, "s string, n long").withColumn("k", vertex("s", "n"))
    got = df.orderBy("k").select(vertex_text("k").alias("s"), vertex_number("k").alias("n")).collect()
    assert [tuple(r) for r in got] == sorted(rows, key=lambda r: (r[0].encode(), r[1]))


def test_only_pairs_of_records_link(spark):
    rec = spark.createDataFrame([("s", 1, 0), ("s", 2, 0), ("s", 2, 1), ("t", 1, 0), (None, 3, 0), ("s", None, 0)], "seq string, track_id long, node int")
    pairs = spark.createDataFrame([("s", 2, "s", 1), ("s", 1, "s", 9), ("t", 1, "t", 1), (None, 3, "s", 1), ("s", None, "t", 1)], "seq_a string, track_a long, seq_b string, track_b long")
    got = group_records(rec, pairs).select(vertex_text("node").alias("a"), vertex_number("node").alias("b"), vertex_number("root").alias("c")).collect()
    assert sorted(tuple(r) for r in got) == [("s", 1, 1), ("s", 2, 1)]
