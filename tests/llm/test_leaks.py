import random

from trackloom.llm import leaks as L
from trackloom.llm.words import words

VOCAB = [f"w{i}" for i in range(400)]


def corpus(seed=1):
    rng = random.Random(seed)
    items = {i: [rng.choice(VOCAB) for _ in range(rng.choice([12, 40, 120]))] for i in range(20)}
    items[90], items[91], items[92] = [], ["lonely", "pair"], ["one", "two", "three", "four", "five", "six"]
    filler = lambda n: [f"f{rng.randrange(5000)}" for _ in range(n)]
    docs, truth = {}, set()
    for d in range(200):
        i = rng.randrange(20)
        w = items[i]
        kind = d % 5
        if kind == 0:
            piece = w
        elif kind == 1:
            a = rng.randrange(max(1, len(w) - 24))
            piece = w[a : a + 24]
        elif kind == 2:
            piece = []
            for k, x in enumerate(w):
                r = (k + d) % 12
                piece += ["changed"] if r == 11 and d % 3 == 0 else [] if r == 11 and d % 3 == 1 else [x, "added"] if r == 11 else [x]
        elif kind == 3:
            piece = w[:10] if len(w) > 20 else w[:6]
        else:
            piece = rng.sample(w, len(w))
        docs[d] = filler(30) + piece + filler(30)
        if kind < 3:
            truth.add((d, i))
    docs[500], docs[501] = filler(5) + ["lonely", "pair"] + filler(5), filler(5) + ["lonely", "x", "y", "pair"]
    truth.add((500, 91))
    docs[502] = filler(3) + items[92]
    truth.add((502, 92))
    return items, docs, truth


def test_planted_passages(spark):
    items, docs, truth = corpus()
    style = lambda k, w: " ".join(w).upper() if k % 4 == 0 else "<p>" + ",&nbsp;".join(w) + "</p>" if k % 4 == 1 else "\n".join(w) if k % 4 == 2 else "** " + " - ".join(w)
    rows = [(d, style(d, w), "s") for d, w in docs.items()] + [(700, None, ""), (701, "", ""), (702, "   ", ""), (None, "x", "")]
    it = spark.createDataFrame([(i, " ".join(w), 0) for i, w in items.items()] + [(98, None, 0)], "item_id long, text string, span int")
    df = spark.createDataFrame(rows + rows[:10], "doc_id long, text string, item_id string")
    got = [(r["doc_id"], r["item_id"]) for r in L.find_leaks(df, it).collect()]
    assert len(got) == len(set(got)) and set(got) == truth
    assert L.find_leaks(df, it.limit(0)).count() == 0 and L.find_leaks(df.limit(0), it).count() == 0


def test_item_blocks_give_the_same(spark, monkeypatch):
    items, docs, truth = corpus(2)
    it = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in docs.items()], "doc_id long, text string")
    monkeypatch.setattr(L, "BLOCK_WORDS", 150)
    assert {(r["doc_id"], r["item_id"]) for r in L.find_leaks(df, it).collect()} == truth


def test_long_text_with_the_passage_at_the_end(spark):
    item = " ".join(f"word{i}" for i in range(30))
    long_ = "filler text " * 60_000 + item
    out = L.find_leaks(spark.createDataFrame([(1, long_)], "doc_id long, text string"), spark.createDataFrame([(5, item)], "item_id long, text string"))
    assert [(r["doc_id"], r["item_id"], r["span"], r["errors"]) for r in out.collect()] == [(1, 5, 30, 0)]


def test_hyphens_do_not_matter(spark):
    item = "A goal-kick, a re-entry and twenty-three wing-backs; a throw-in, then forty-two set-pieces of state-of-the-art make-up."
    forms = [item, item.replace("-", " "), item.replace("-", ""), item.replace("-", "-\n"), item.replace("-", "‑").upper()]
    docs = spark.createDataFrame([(i, f"Before it came this. {t} And after it that.") for i, t in enumerate(forms)], "doc_id long, text string")
    for it in (item, item.replace("-", "‐")):
        out = L.find_leaks(docs, spark.createDataFrame([(1, it)], "item_id long, text string"))
        assert {r["doc_id"] for r in out.collect()} == set(range(len(forms)))


def test_words():
    assert words("Goal-kick, stop-\nwatch’s <b>RE&amp;D</b> &#44; É soft­hyphen [x](http://a.b/c)") == ["goalkick", "stopwatchs", "re", "d", "e", "softhyphen", "x"]
    assert words(None) == words("") == words(" \n") == []


def pairs_in(items, docs):
    built = L.Items.build(list(enumerate(items)))
    coded = [[built.vocabulary.get(w, 0) for w in d] for d in docs]
    return {(d, k) for d, k, s, e, x in L.find_in(built, coded) if L.leaks(s, e, x, len(items[k]))}


def test_exact_passage_inside_loose_text():
    item = [f"i{k}" for k in range(120)]
    loose = [f"x{k}" if k % 4 == 0 else w for k, w in enumerate(item)]
    faulty = [f"x{k}" if k in (2, 5, 8, 11, 14, 17, 30, 50) else w for k, w in enumerate(item[:60])]
    docs = [["f"] * 9 + item[:20] + loose[20:60] + ["f"] * 9, ["f"] * 9 + loose[40:80] + item[80:100] + loose[100:], faulty, loose]
    docs.append(loose[:60] + ["f"] * 9 + item[90:110])  # a clean passage beside a longer loose one
    docs.append(loose[:60] + item[90:110])
    assert pairs_in([item], docs) == {(0, 0), (1, 0), (2, 0), (4, 0), (5, 0)}


def some_passage(item, doc):
    """Whether a stretch of the item is within the error bound of some words of the document, by edit distances."""
    need = min(L.PASSAGE, len(item))
    for a in range(len(item) - need + 1):
        row = [0] * (len(doc) + 1)
        for s, w in enumerate(item[a : a + 2 * L.PASSAGE], 1):
            new = [s]
            for j, x in enumerate(doc, 1):
                new.append(min(row[j - 1] + (x != w), row[j] + 1, new[j - 1] + 1))
            row = new
            if s >= need and min(row) <= round(L.ERRORS * s):
                return True
    return False


def test_verdict_equals_edit_distances():
    rng = random.Random(4)
    items = [[rng.choice(VOCAB) for _ in range(n)] for n in (24, 40, 60, 60)]
    docs = []
    for d in range(80):
        piece, rate = [], rng.choice([0.1, 0.2, 0.3])
        for k, w in enumerate(items[d % 4]):
            r = rng.random() / (rate if k % 40 < 15 else 0.12)
            piece += [f"c{k}"] if r < 0.5 else [] if r < 0.75 else [w, f"a{k}"] if r < 1 else [w]
        docs.append(["f"] * rng.randrange(6) + piece + ["f"] * rng.randrange(6))
    want = {(d, d % 4) for d in range(80) if some_passage(items[d % 4], docs[d])}
    assert 20 < len(want) < 75 and pairs_in(items, docs) == want


def wrong(rng, item, errors, n):
    """The item with some words changed, dropped or followed by another one, never the first or the last."""
    out = list(item)
    for at in sorted(rng.sample(range(1, n - 1), errors), reverse=True):
        kind = rng.randrange(3)
        out[at : at + 1] = [f"c{at}"] if kind == 0 else [] if kind == 1 else [out[at], f"a{at}"]
    return out


def test_recall_by_length_and_errors():
    rng = random.Random(7)
    lost = {}
    for n in [*range(2, 24), 30, 39, 60, 120]:
        for errors in range(round(L.ERRORS * min(n, 39)) + 1):
            if n - 2 < errors:
                continue
            items = [[rng.choice(VOCAB) for _ in range(n)] for _ in range(30)]
            docs = [["f"] * rng.randrange(5) + wrong(rng, w, errors, n) + ["f"] * rng.randrange(5) for w in items]
            got = pairs_in(items, docs)
            want = {(d, d) for d, (x, w) in enumerate(zip(docs, items, strict=True)) if some_passage(w, x)}
            assert len(want) == 30
            lost[n, errors] = len(want - got)
    assert max(lost.values()) == 0, {k: v for k, v in lost.items() if v}


def test_hot_seed_shared_by_many_items(monkeypatch):
    monkeypatch.setattr(L, "HELD", 50)
    start = [f"s{k}" for k in range(20)]
    items = [start + [f"i{k}_{j}" for j in range(20)] for k in range(40)]
    docs = [["f"] * 3 + start + ["f"], start[:12] + items[5][26:40] + ["f"], items[7][15:40]]
    assert pairs_in(items, docs) == {(0, k) for k in range(40)} | {(2, 7)}
