import random

import numpy as np

from trackloom.llm import stuffed as S
from trackloom.llm.stuffed import stuffed_pages

NAMES = ["Alder", "Birch", "Cedar", "Dogwood", "Elm", "Fir"]
PLACES = ["harbour", "market", "station", "valley", "bridge", "quarry", "meadow", "mill"]
VERBS = ["walked", "drove", "cycled", "ran", "hurried", "drifted"]


def sentence(rng):
    return rng.choice([
        f"{rng.choice(NAMES)} {rng.choice(VERBS)} from the {rng.choice(PLACES)} to the old {rng.choice(PLACES)} before the rain came.",
        f"After {rng.randrange(90)} minutes the {rng.choice(PLACES)} was quiet, and nobody at the {rng.choice(PLACES)} knew why.",
        f"It took {rng.randrange(9)}.{rng.randrange(9)} hours to reach the {rng.choice(PLACES)}, because the road by the {rng.choice(PLACES)} had closed."])


def pages():
    rng = random.Random(1)
    text = lambda n: " ".join(sentence(rng) for _ in range(n))
    good = {i: text(12) for i in range(200)}
    good |= {
        300: "Squad\n\n" + "\n".join(f"{i} | A. {rng.choice(NAMES)}{i} | {i}' | {i}.37 km" for i in range(1, 12)) + "\n\n" + text(2),
        301: "\n".join(f"{i}' {sentence(rng)}" for i in range(1, 30, 3)),
        302: text(5) + "\nOh Alder, Alder, we follow you down the road!\nOh Alder, Alder, we follow you down the road!\n" + text(2),
        303: text(6) + "\n\nReferences\n" + "\n".join(f"[{i}] Elm, notes, https://archive.example/{i}" for i in range(1, 6)),
        304: "Match off.", 305: "", 306: "  \n ", 307: None,
        309: "\n\n".join(["Alder", "Birch", "Cedar", "Dogwood", "Elm", "Fir", "Gum", "Hazel", "Ivy", "Juniper", "Larch"]) + "\n\n" + text(2),
        310: "昨日の試合は雨で中止になった。選手は駅から歩いて市場へ行った。橋の近くで新しい工場が建てられている。" + text(1),
        308: text(8) + "\n\ncheap boots | cheap boots | cheap boots",
    }
    bad = {
        400: " / ".join(["cheap river boots", "CHEAP RIVER BOOTS"] * 20),
        401: " ".join(rng.choice(["keeper", "ball", "wing", "recall", "pass", "spell"]) for _ in range(120)),
        402: "\n".join(f"{rng.choice(NAMES)} scarf - http://www.shop{i}.example/scarf/{i}" for i in range(20)),
        403: ", ".join(f"scarf in {rng.choice(NAMES)}ton" for _ in range(40)),
        404: " ".join(f"#buy{n}Scarf #new{n}Boots" for n in NAMES * 3),
        405: " ".join(f"Every cheap {n} scarf here beats any other cheap {n} scarf because this cheap {n} scarf is a real cheap {n} scarf." for n in NAMES),
        407: "\n".join(f"{i}. {rng.choice(NAMES)} scarf - http://www.shop{i}.example/scarf/{i}" for i in range(1, 21)),
        408: "\n".join(f"[{i}] http://www.shop{i}.example/scarf/{i}" for i in range(1, 21)),
        409: "\n\n".join(f"http://www.shop{i}.example/scarf/{i}" for i in range(20)),
        410: "\n".join(f"{i}. cheap river boots, cheap new boots" for i in range(1, 15)),
        411: "便宜 球鞋 / 便宜 新 球鞋 / 球鞋 便宜 / " * 12,
        412: "便宜球鞋便宜新球鞋" * 12,
        406: text(2) + "\n\n" + " | ".join(["best kit sale", "new kit sale"] * 40),
    }
    return good, bad


def test_kinds_of_pages(spark):
    good, bad = pages()
    rows = [(i, t, 0.0) for i, t in (good | bad).items()] + [(None, "x", 0.0), (400, bad[400], 0.0)]
    out = [r["doc_id"] for r in stuffed_pages(spark.createDataFrame(rows, "doc_id long, text string, share double")).collect()]
    assert sorted(out) == sorted(bad)


def test_empty(spark):
    assert stuffed_pages(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_perplexity_decides():
    good, bad = pages()
    raw = [t.encode() if t is not None else None for t in (good | bad).values()]
    p = S.read([S.readable(t) for t in raw], S.Lexicon())
    counts = np.bincount(S.trigrams(p)[S.prose(S.measure(p))[p.sentence]], minlength=S.K**3).astype(float)
    model = S.Model.of(counts)
    flagged = lambda m: {i for i, x in zip(good | bad, S.judge(raw, [""] * len(raw), m, S.Lexicon())[2], strict=True) if x > 0.5}
    assert flagged(model) == set(bad)
    tells_nothing = S.Model({}, np.zeros_like(model.surprise), np.zeros(1), np.ones(1))
    assert flagged(tells_nothing) == set()
    as_usual = S.Model({}, np.full_like(model.surprise, model.mean[0]), model.mean, model.variance)
    assert flagged(as_usual) == set()


def test_languages_have_their_own_prose(spark, monkeypatch):
    monkeypatch.setattr(S, "ENOUGH", 50)
    good, bad = pages()
    rows = [(i, t, lang) for lang in ("EN", "en ", None) for i, t in (good | bad).items()]
    model = S.train(spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("doc_id", "cast(text as binary) text", "coalesce(lower(trim(lang)), '') lang").where("text is not null"))
    assert set(model.langs) == {"", "en"} and (model.mean > 0).all()
    out = stuffed_pages(spark.createDataFrame(rows, "doc_id long, text string, lang string"), lang="lang")
    assert sorted(r["doc_id"] for r in out.select("doc_id").distinct().collect()) == sorted(bad)
