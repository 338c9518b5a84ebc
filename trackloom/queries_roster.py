"""Queries of rosters, keepers' sides, duplicates, association, counterfactual runs and model inputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackloom.functions import pitch as P
from trackloom.operators import ahead as W
from trackloom.operators import metrics as M
from trackloom.operators import profiles as R
from trackloom.operators import rosters as S
from trackloom.plans.book import Book, r6

BOOK = Book()
add = BOOK.add


def _numbers(t):
    return t.read("queue_items").select("queue_id", F.expr("try_cast(trim(gt_number) AS int)").alias("n")).distinct().withColumn("n", F.coalesce("n", F.lit(-1)))


add("number_digits", lambda t: _numbers(t).withColumns({"cls": S.number_class(F.col("n")), "d": S.digits(F.col("n"))}).select("queue_id", "n", "cls", S.class_number(F.col("cls")).alias("back"), "d.tens", "d.units", "d.legible", S.from_digits(F.col("d.tens"), F.col("d.units")).alias("made")), """
WITH q AS (SELECT DISTINCT queue_id, coalesce(TRY_CAST(trim(gt_number) AS INT), -1) AS n FROM queue_items), d AS (SELECT *, CASE WHEN n = -1 THEN 0 WHEN n BETWEEN 1 AND 99 THEN n END AS cls,
  CASE WHEN n = -1 OR n BETWEEN 1 AND 9 THEN 10 WHEN n BETWEEN 10 AND 99 THEN n // 10 END AS tens, CASE WHEN n = -1 THEN 0 WHEN n BETWEEN 1 AND 99 THEN n % 10 END AS units, CASE WHEN n = -1 THEN 0 WHEN n BETWEEN 1 AND 99 THEN 1 END AS legible FROM q)
SELECT queue_id, n, cls, CASE WHEN cls = 0 THEN -1 ELSE cls END AS back, tens, units, legible, CASE WHEN tens = 10 THEN units ELSE tens * 10 + units END AS made FROM d""")
add("roster_decoding", lambda t: t.read("embeddings").select("vec_id", F.posexplode(S.on_roster(F.transform(F.slice(F.col("embedding").cast("array<double>"), 1, 12), lambda v: F.abs(v)), F.array(*(F.lit(i) for i in (2, 3, 7))))).alias("i", "p")).select("vec_id", "i", r6("p").alias("p")), """
WITH e AS (SELECT vec_id, unnest(range(12)) AS i, unnest(embedding[1:12]) AS v FROM embeddings), k AS (SELECT vec_id, i, CASE WHEN i IN (0, 2, 3, 7) THEN abs(CAST(v AS DOUBLE)) ELSE 0 END AS p FROM e)
SELECT vec_id, i, R6(p / sum(p) OVER (PARTITION BY vec_id)) AS p FROM k""")
_PLAYED = "SELECT s_suppkey AS player, s_suppkey % 3 = 0 AS substitute, CASE WHEN s_suppkey % 11 <> 0 THEN CAST(s_suppkey % 97 AS DOUBLE) END AS minutes FROM {s}"
add("halves_played", lambda t: t.spark.sql(_PLAYED, s=t.read("supplier")).withColumn("h", S.halves_played(F.col("substitute"), F.col("minutes"))).select("player", "h.first", "h.second"), f"""
WITH p AS ({_PLAYED.replace('{s}', 'supplier')}), w AS (SELECT *, CASE WHEN substitute THEN greatest(90 - minutes, 0) ELSE 0 END AS b, CASE WHEN substitute THEN 90 ELSE minutes END AS e FROM p)
SELECT player, coalesce(minutes > 0 AND b < 45 AND e > 0, false) AS first, coalesce(minutes > 0 AND b < 90 AND e > 45, false) AS second FROM w""")
_CAND = "SELECT c_custkey AS query, c_nationkey AS player FROM {c}"
_MIN = "SELECT c_custkey AS query, CAST(c_custkey % 100 AS DOUBLE) AS minute FROM {c}"
_WIN = "SELECT n_nationkey AS player, n_nationkey % 7 = 0 AS unused, CAST(n_nationkey % 4 * 20 AS DOUBLE) AS on_from, CAST(90 - n_nationkey % 3 * 25 AS DOUBLE) AS on_to FROM {n} WHERE n_nationkey < 20"
add("off_pitch", lambda t: S.off_pitch(t.spark.sql(_CAND, c=t.read("customer")), t.spark.sql(_MIN, c=t.read("customer")), t.spark.sql(_WIN, n=t.read("nation"))).select("query", "player", "off"), f"""
WITH c AS ({_CAND.replace('{c}', 'customer')}), m AS ({_MIN.replace('{c}', 'customer')}), w AS ({_WIN.replace('{n}', 'nation')})
SELECT query, player, coalesce(unused OR minute + 5 < on_from OR minute - 5 > on_to, false) AS off FROM c LEFT JOIN m USING (query) LEFT JOIN w USING (player)""")
_GROUPS = "SELECT chunk, team, track_id AS grp, CASE WHEN track_id % 4 <> 0 THEN CAST(track_id % 9 AS INT) END AS number, avg(pitch_x) / 105 AS u, max(CASE WHEN role = 'goalkeeper' THEN 1 ELSE 0 END) = 1 AS keeper, CAST(count(*) % 7 AS INT) AS votes FROM {p} GROUP BY chunk, team, track_id"
_SQUAD = "SELECT DISTINCT chunk, team, track_id % 9 AS player, CAST(track_id % 9 AS INT) AS shirt, CASE track_id % 9 WHEN 1 THEN 'G' WHEN 2 THEN 'D' WHEN 3 THEN 'D' WHEN 7 THEN 'F' WHEN 8 THEN 'X' ELSE 'M' END AS position FROM {p}"


def _squad(t):
    return t.spark.sql(_SQUAD, p=t.players), t.spark.sql(_GROUPS, p=t.players)


add("roster_costs", lambda t: S.roster_costs(*_squad(t), ["chunk", "team"]).withColumn("cost", r6("cost")), f"""
WITH g AS ({_GROUPS.replace('{p}', 'pl')}), s AS ({_SQUAD.replace('{p}', 'pl')})
SELECT chunk, team, grp, player, R6(CASE WHEN number IS NOT NULL AND number <> shirt THEN 1e6 WHEN (position = 'G') <> keeper THEN 10.0 + CASE WHEN number IS NULL THEN 0.5 ELSE 0 END
  ELSE CASE WHEN number IS NULL THEN 0.5 ELSE 0 END + 0.25 * abs(u - CASE position WHEN 'G' THEN 0.05 WHEN 'D' THEN 0.30 WHEN 'F' THEN 0.82 ELSE 0.55 END) END) AS cost FROM g JOIN s USING (chunk, team)""", "pl")
add("roster_assignment", lambda t: S.assign_roster(*_squad(t), ["chunk", "team"]))
_DEPTH = """WITH b AS (SELECT chunk, track_id, median(pitch_x - 52.5) AS mx, avg((least(pitch_x, 105 - pitch_x) <= 16.5 AND abs(pitch_y - 34) <= 20.16)::INT) AS pen FROM pl GROUP BY ALL),
r AS (SELECT chunk, track_id, role FROM (SELECT chunk, track_id, role, count(*) AS k FROM pl GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY chunk, track_id ORDER BY k DESC, role) = 1),
a AS (SELECT *, sign(mx) AS half, bool_or(role = 'goalkeeper') OVER (PARTITION BY chunk, sign(mx)) AS has FROM b JOIN r USING (chunk, track_id)),
l AS (SELECT *, NOT has AND half <> 0 AND role = 'player' AND abs(mx) >= 36 AND pen >= 0.9 AS alike FROM a),
z AS (SELECT chunk, track_id, mx, CASE WHEN alike AND row_number() OVER (PARTITION BY chunk, half, alike ORDER BY abs(mx) DESC, track_id) = 1 THEN 'goalkeeper' ELSE role END AS role FROM l)
"""
add("keeper_sides", lambda t: S.keeper_sides(t.players), _DEPTH + "SELECT chunk, track_id, role, CASE WHEN role = 'goalkeeper' THEN CASE WHEN mx < 0 THEN 'left' ELSE 'right' END END AS side FROM z", "pl")
add("sides_by_depth", lambda t: S.sides_by_depth(t.players).withColumn("margin", r6("margin")), """
WITH m AS (SELECT chunk, avg(pitch_x) FILTER (team = 0) AS m0, avg(pitch_x) FILTER (team = 1) AS m1 FROM pl WHERE role = 'player' GROUP BY chunk)
SELECT chunk, CASE WHEN m0 > m1 THEN 1 ELSE 0 END AS left_team, R6(coalesce(abs(m1 - m0), 0)) AS margin FROM m""", "pl")
_PAIR = "SELECT a.chunk, a.track_id AS a, b.track_id AS b, count(*) AS overlap, median(sqrt((b.pitch_x - a.pitch_x) ** 2 + (b.pitch_y - a.pitch_y) ** 2)) AS median_d, bool_and(a.team = b.team) AS same_team FROM pl a JOIN pl b ON a.chunk = b.chunk AND a.frame = b.frame AND a.track_id < b.track_id GROUP BY ALL"


def _twice(t):
    return S.duplicates(R.pair_features(t.players), overlap=3, median_m=40.0)


add("duplicate_tracks", lambda t: _twice(t).withColumn("median_d", r6("median_d")), f"WITH p AS ({_PAIR}) SELECT chunk, a, b, overlap, R6(median_d) AS median_d, same_team FROM p WHERE overlap >= 3 AND median_d <= 40 AND same_team", "pl")
add("absorbed_tracks", lambda t: S.absorbed(t.players, _twice(t)).select("chunk", "frame", "track_id", "pitch_x", "pitch_y"), f"""
WITH RECURSIVE p AS ({_PAIR}), e AS (SELECT chunk, a, b FROM p WHERE overlap >= 3 AND median_d <= 40 AND same_team), d AS (SELECT * FROM e UNION SELECT chunk, b, a FROM e),
w AS (SELECT chunk, a, a AS v FROM d UNION SELECT w.chunk, w.a, d.b FROM w JOIN d ON d.chunk = w.chunk AND d.a = w.v),
k AS (SELECT chunk, track_id, count(*) AS n, avg(conf) AS c FROM pl GROUP BY ALL),
t AS (SELECT w.chunk, w.a, w.v, row_number() OVER (PARTITION BY w.chunk, w.a ORDER BY n DESC, c DESC, w.v) AS r FROM w JOIN k ON k.chunk = w.chunk AND k.track_id = w.v),
j AS (SELECT pl.*, coalesce(t.v, pl.track_id) AS win, k.n, k.c FROM pl JOIN k USING (chunk, track_id) LEFT JOIN t ON t.chunk = pl.chunk AND t.a = pl.track_id AND t.r = 1)
SELECT chunk, frame, win AS track_id, pitch_x, pitch_y FROM j QUALIFY row_number() OVER (PARTITION BY chunk, win, frame ORDER BY n DESC, c DESC, track_id) = 1""", "pl")


def _boxes(t):
    p = t.players.where("image_x IS NOT NULL")
    return p.select("chunk", "frame", F.col("track_id").alias("det"), F.col("image_x").alias("x0"), F.col("image_y").alias("y0"), (F.col("image_x") + 80).alias("x1"), (F.col("image_y") + 160).alias("y1"))


add("associated_boxes", lambda t: S.associate(_boxes(t)))
_SUMMARY = """, n AS (SELECT *, CASE WHEN lag(def_team) OVER (PARTITION BY chunk ORDER BY frame) = def_team THEN 0 ELSE 1 END AS new FROM bf), r AS (SELECT *, sum(new) OVER (PARTITION BY chunk ORDER BY frame) AS run FROM n),
sp AS (SELECT def_team, count(line_m) AS n_usable, CASE WHEN median(line_m) < 33 THEN 'low' WHEN median(line_m) >= 50 THEN 'high' ELSE 'mid' END AS c FROM r GROUP BY chunk, run, def_team HAVING count(line_m) >= 3),
q AS (SELECT def_team, count(*) AS spells, sum(CASE WHEN c = 'low' THEN n_usable ELSE 0 END) AS low, sum(CASE WHEN c = 'mid' THEN n_usable ELSE 0 END) AS mid, sum(CASE WHEN c = 'high' THEN n_usable ELSE 0 END) AS high FROM sp GROUP BY def_team),
f AS (SELECT def_team, count(*) AS frames, count(*) FILTER (usable) AS usable_frames, avg(usable::INT) AS coverage, avg(ball_adv_m) FILTER (usable) - avg(ball_adv_m) FILTER (NOT usable) AS bias_m, avg(line_m) FILTER (usable) AS line_m, avg(vspread_m) FILTER (usable) AS vspread_m, avg(ball_to_block_m) FILTER (usable) AS ball_to_block_m FROM bf GROUP BY def_team)
SELECT f.def_team, frames, usable_frames, R6(coverage) AS coverage, R6(bias_m) AS bias_m, R6(line_m) AS line_m, R6(vspread_m) AS vspread_m, R6(ball_to_block_m) AS ball_to_block_m, spells, R6(low / (low + mid + high)) AS low, R6(mid / (low + mid + high)) AS mid, R6(high / (low + mid + high)) AS high FROM f LEFT JOIN q USING (def_team)"""


def _blocks(t):
    from trackloom.queries_metrics import _BL

    return _BL


def _summary(t):
    b = M.block_frames(t.ball, t.poss, t.pos, t.dirs)
    s = M.block_summary(b, M.block_spells(b, least=3))
    return s.withColumns({c: r6(c) for c in ("coverage", "bias_m", "line_m", "vspread_m", "ball_to_block_m", "low", "mid", "high")})


add("block_summary", _summary, _blocks(None) + _SUMMARY, "poss", "dirs")


def _free(t):
    """Players of the side in possession without the carrier and the keeper, turned so that they attack to the right."""
    p = t.players.where("role = 'player'").join(t.poss.select("chunk", "frame", "team", "carrier"), ["chunk", "frame", "team"]).where("track_id <> carrier").join(t.dirs, ["chunk", "team"])
    return p.select("chunk", "frame", "team", "track_id", P.advance("pitch_x", "dir").alias("pitch_x"), P.across("pitch_y", "dir").alias("pitch_y"))


def _worth(t):
    return W.best_runs(_free(t), lambda x, y: F.exp(-F.sqrt((105.0 - x) ** 2 + (34.0 - y) ** 2) / 18), radius=8.75)


_FREE = """WITH o AS (SELECT pl.chunk, pl.frame, pl.team, track_id, CASE WHEN dir = 1 THEN pitch_x ELSE 105 - pitch_x END AS x, CASE WHEN dir = 1 THEN pitch_y ELSE 68 - pitch_y END AS y
  FROM pl JOIN poss p ON p.chunk = pl.chunk AND p.frame = pl.frame AND p.team = pl.team JOIN dirs d ON d.chunk = pl.chunk AND d.team = pl.team WHERE role = 'player' AND track_id <> carrier),
c AS (SELECT unnest(range(16)) AS i), n AS (SELECT o.*, i, greatest(least(x + 8.75 * (CASE WHEN i < 8 THEN 0.5 ELSE 1 END) * cos(2 * pi() * (i % 8) / 8), 105), 0) AS cx, greatest(least(y + 8.75 * (CASE WHEN i < 8 THEN 0.5 ELSE 1 END) * sin(2 * pi() * (i % 8) / 8), 68), 0) AS cy FROM o CROSS JOIN c),
v AS (SELECT *, exp(-sqrt((105 - x) ** 2 + (34 - y) ** 2) / 18) AS base, exp(-sqrt((105 - cx) ** 2 + (34 - cy) ** 2) / 18) AS worth FROM n),
g AS (SELECT chunk, frame, team, track_id, max(base) AS baseline, greatest(max(worth), max(base)) AS best FROM v GROUP BY ALL)
"""
add("best_runs", lambda t: _worth(t).select("chunk", "frame", "team", "track_id", r6("baseline").alias("baseline"), r6("best").alias("best"), r6("gain").alias("gain")), _FREE + "SELECT chunk, frame, team, track_id, R6(baseline) AS baseline, R6(best) AS best, R6(best - baseline) AS gain FROM g", "poss", "dirs")


def _quality(t):
    mates = t.players.where("role = 'player'").join(t.dirs, ["chunk", "team"]).select("chunk", "frame", "team", "track_id", P.advance("pitch_x", "dir").alias("pitch_x"), P.across("pitch_y", "dir").alias("pitch_y"))
    return W.run_quality(_worth(t), W.actual_runs(_free(t), mates, horizon=75), "team")


add("run_quality", lambda t: _quality(t).select("team", "runs", r6("potential").alias("potential")), _FREE + "SELECT team, count(*) AS runs, R6(avg(best - baseline)) AS potential FROM g GROUP BY team", "poss", "dirs")


def _nodes(t):
    n = t.players.join(t.poss.select("chunk", "frame", F.col("team").alias("att"), "carrier"), ["chunk", "frame"]).join(t.ball, ["chunk", "frame"])
    x, y = W.rescaled(F.col("pitch_x"), F.col("pitch_y"), P.LENGTH, P.WIDTH)
    bx, by = W.rescaled(F.col("x"), F.col("y"), P.LENGTH, P.WIDTH)
    none = F.lit(None).cast("double")
    return n.select("chunk", "frame", "track_id", x.alias("x"), y.alias("y"), none.alias("vx"), none.alias("vy"), none.alias("turn"), (F.col("team") == F.col("att")).alias("teammate"), (F.col("track_id") == F.col("carrier")).alias("actor"), (F.col("role") == "goalkeeper").alias("keeper"), bx.alias("ball_x"), by.alias("ball_y"), F.lit(True).alias("observed"))


_NODE = """WITH n AS (SELECT pl.chunk, pl.frame, track_id, pitch_x / 105 AS x, pitch_y / 68 AS y, (pl.team = p.team)::INT AS mate, (track_id = carrier)::INT AS actor, (role = 'goalkeeper')::INT AS keeper, sqrt(((pitch_x - b.x) * 120 / 105) ** 2 + ((pitch_y - b.y) * 80 / 68) ** 2) / sqrt(120 ** 2 + 80 ** 2) AS far
  FROM pl JOIN poss p ON p.chunk = pl.chunk AND p.frame = pl.frame JOIN ball b ON b.chunk = pl.chunk AND b.frame = pl.frame)
"""
add("node_features", lambda t: W.node_features(_nodes(t)).select("chunk", "frame", "track_id", *(r6(F.get("feat", i)).alias(f"f{i}") for i in range(11)), F.aggregate("mask", F.lit(0.0), lambda a, m: a + m).alias("known")), _NODE + """
SELECT chunk, frame, track_id, R6(x) AS f0, R6(y) AS f1, R6(0.0) AS f2, R6(0.0) AS f3, R6(0.0) AS f4, R6(0.0) AS f5, R6(mate::DOUBLE) AS f6, R6(actor::DOUBLE) AS f7, R6(keeper::DOUBLE) AS f8, R6(far) AS f9, R6(1.0) AS f10, 7.0 AS known FROM n""", "poss", "ball")
add("parsed_frames", lambda t: W.parsed_frames(_nodes(t).groupBy("chunk", "frame").agg(F.to_json(F.array_sort(F.collect_list(F.struct("track_id", F.array("x", "y").alias("location"), "teammate", "keeper")))).alias("doc")).withColumn("key", F.concat_ws("/", "chunk", "frame")), "key", "doc").withColumns({"x": r6("x"), "y": r6("y")}), _NODE + """
SELECT chunk || '/' || frame AS key, CAST(row_number() OVER (PARTITION BY chunk, frame ORDER BY track_id) - 1 AS INT) AS i, R6(x * 120) AS x, R6(y * 80) AS y, mate = 1 AS teammate, false AS actor, keeper = 1 AS keeper FROM n""", "poss", "ball")


def _losses(t):
    share = t.poss.groupBy().agg(*(F.avg((F.col("team") == k).cast("double")).alias(f"s{k}") for k in (0, 1)))
    n = t.poss.groupBy("team").agg(F.count("*").alias("n"))
    return n.join(F.broadcast(share)).select("team", r6(W.per_opponent_possession(F.col("n").cast("double"), F.when(F.col("team") == 0, F.col("s0")).otherwise(F.col("s1")))).alias("rate"))


add("per_opponent_possession", _losses, "WITH s AS (SELECT team, count(*) AS n, count(*) / sum(count(*)) OVER () AS s FROM poss GROUP BY team) SELECT team, R6(n / (1 - s)) AS rate FROM s WHERE s < 1", "poss")

QUERIES, SQL = BOOK.queries, BOOK.sql
