import random

from trackloom.operators.intervals import merge_intervals

SCHEMA = "team string, s long, e long, k0 string, b int"


def brute(rows):
    out = set()
    for key in {r[0] for r in rows}:
        covered = sorted({f for k, s, e, *_ in rows if k == key and s is not None and e is not None and s <= e for f in range(s, e + 1)})
        spans = []
        for f in covered:
            if spans and spans[-1][1] == f - 1:
                spans[-1][1] = f
            else:
                spans.append([f, f])
        out |= {(key, "span", a, b) for a, b in spans}
        out |= {(key, "gap", spans[i][1] + 1, spans[i + 1][0] - 1) for i in range(len(spans) - 1)}
    return out


def run(spark, rows, block, **kw):
    df = merge_intervals(spark.createDataFrame(rows, SCHEMA), ["team"], "s", "e", block=block, **kw)
    got = [tuple(r) for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_random_intervals_match_brute_force(spark):
    rng = random.Random(5)
    for block in (3, 4096):
        rows = []
        for _ in range(400):
            s = rng.randrange(-300, 900)
            long_ = rng.random() < 0.03
            rows.append((rng.choice(["a", "b", "c", None]), s, s + rng.randrange(-2, 200 if long_ else 9), "x", 1))
        rows += [("a", None, 5, None, None), ("a", 5, None, None, None), ("d", 9, 3, None, None)]
        assert run(spark, rows + rows[:50], block) == brute(rows)


def test_touching_nested_tied_and_empty(spark):
    assert run(spark, [("a", 0, 4, "", 0), ("a", 5, 9, "", 0), ("a", 1, 2, "", 0), ("a", 11, 11, "", 0)], 4) == {("a", "span", 0, 9), ("a", "gap", 10, 10), ("a", "span", 11, 11)}
    assert run(spark, [], 4) == set()


def test_one_entity_over_many_levels(spark):
    rng = random.Random(6)
    rows = [("a", s * 7, s * 7 + rng.choice([0, 2, 6, 9, 40 if rng.random() < 0.1 else 3]), "", 0) for s in rng.sample(range(600), 300)]
    assert run(spark, rows, 1, fan=8) == brute(rows)
