import random

from trackloom.llm.nearest import nearest_in_time, ring_widths

L, R = "lid string, src string, frame long, k0 int", "rid long, src string, frame long, lid int"


def run(spark, left, right, tol, first=3):
    df = nearest_in_time(spark.createDataFrame(left, L), spark.createDataFrame(right, R), left_id="lid", right_id="rid", by=["src"], time="frame", tolerance=tol, first=first)
    got = [tuple(r) for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


def brute(left, right, tol):
    out = set()
    for i, s, t, _ in left:
        c = [(abs(f - t), f, r) for r, q, f, _ in right if q == s and f is not None and t is not None and s is not None and abs(f - t) <= tol]
        if c and i is not None:
            d, _, r = min(c)
            out.add((i, r, d))
    return out


def test_random_rows_match_brute_force(spark):
    rng = random.Random(2)
    left = [(f"l{i}", rng.choice("abc"), rng.randrange(-200, 400), 0) for i in range(150)]
    right = [(i, rng.choice("ab"), rng.randrange(-200, 400), 0) for i in range(60)]
    right += [(i + 500, s, f, 0) for i, s, f, _ in right[:20]] + right[:5]
    left += left[:10] + [("n", "a", None, 0), ("m", None, 3, 0), (None, "a", 3, 0)]
    right += [(900, None, 5, 0), (901, "a", None, 0)]
    for tol, first in ((12, 3), (0, 3), (7, 1), (100, 3)):
        assert run(spark, left, right, tol, first) == brute(left, right, tol)


def test_ties_and_empty(spark):
    assert run(spark, [("x", "a", 10, 0)], [(7, "a", 12, 0), (9, "a", 8, 0), (3, "a", 12, 0)], 12) == {("x", 9, 2)}
    assert run(spark, [("x", "a", 10, 0)], [(7, "a", 10, 0), (3, "a", 10, 0)], 12) == {("x", 3, 0)}
    assert run(spark, [], [(1, "a", 1, 0)], 5) == set() and run(spark, [("x", "a", 1, 0)], [], 5) == set()


def test_rings_double_up_to_the_tolerance():
    assert ring_widths(12, 3) == [3, 6, 12] and ring_widths(0, 3) == [1] and ring_widths(7, 3) == [3, 6, 12]
