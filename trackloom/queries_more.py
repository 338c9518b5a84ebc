"""Queries of profiles, ledgers, geometry, corpus analytics and fitted models."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackloom.functions import stats as X
from trackloom.operators import corpus as K
from trackloom.operators import geometry as G
from trackloom.operators import learned as L
from trackloom.operators import metrics as M
from trackloom.operators import network as N
from trackloom.operators import possession as O
from trackloom.operators import profiles as R
from trackloom.operators import shape as S
from trackloom.operators import shapes as H
from trackloom.operators import tracks as T
from trackloom.plans.book import Book, r6

BOOK = Book()
add = BOOK.add
_OX = "CASE WHEN dir > 0 THEN pitch_x ELSE 105 - pitch_x END"
_OY = "CASE WHEN dir > 0 THEN pitch_y ELSE 68 - pitch_y END"
_ORI = f"WITH ori AS (SELECT pl.*, {_OX} AS ox, {_OY} AS oy FROM pl JOIN dirs d ON d.chunk = pl.chunk AND d.team = pl.team)"

add("global_ids", lambda t: R.global_ids(t.pos).select("chunk", "frame", "track_id"), "WITH o AS (SELECT chunk, row_number() OVER (ORDER BY chunk) - 1 AS o FROM (SELECT DISTINCT chunk FROM pos)) SELECT pos.chunk, o * 10000000 + frame AS frame, o * 1000000 + track_id AS track_id FROM pos JOIN o USING (chunk)", "pos")
add("align_by_goal", lambda t: R.align_by_goal(t.pos).withColumn("aligned", F.col("aligned").cast("long")), "SELECT chunk, team, row_number() OVER (PARTITION BY chunk ORDER BY m, team) - 1 AS aligned FROM keep", "keep")
_PG = ("mx", "my", "sx", "sy", "final_third", "radial", "minutes")
add("player_geometry", lambda t: R.player_geometry(R.oriented(t.pos, t.dirs), "track_id").select("track_id", "frames", *(r6(c).alias(c) for c in _PG), "trusted"), _ORI + """
, g AS (SELECT track_id, avg(ox) AS mx, avg(oy) AS my, stddev_pop(ox) AS sx, stddev_pop(oy) AS sy, avg((ox >= 70)::INT) AS final_third, count(DISTINCT (chunk, frame)) AS frames FROM ori GROUP BY track_id)
SELECT track_id, frames, R6(mx) AS mx, R6(my) AS my, R6(sx) AS sx, R6(sy) AS sy, R6(final_third) AS final_third, R6(sqrt(sx ** 2 + sy ** 2)) AS radial, R6(frames / 25.0 / 60) AS minutes, frames >= 50 AS trusted FROM g""", "pl", "dirs")


def _match_geometry(t):
    o = R.oriented(t.pos, t.dirs).withColumn("match", F.pmod("chunk", F.lit(3))).withColumn("manager", F.when(F.col("chunk") < 3, "one").when(F.col("chunk") < 5, "two"))
    return o.groupBy("match", "manager", "track_id").agg(F.avg("ox").alias("mx"), F.avg("oy").alias("my"), F.avg((F.col("ox") >= 70).cast("double")).alias("final_third"))


_MG = _ORI + ", mg AS (SELECT chunk % 3 AS match, CASE WHEN chunk < 3 THEN 'one' WHEN chunk < 5 THEN 'two' END AS manager, track_id, avg(ox) AS mx, avg(oy) AS my, avg((ox >= 70)::INT) AS final_third FROM ori GROUP BY ALL)"
add("cross_match", lambda t: R.cross_match(_match_geometry(t), "track_id").withColumns({c: r6(c) for c in ("mx", "my", "final_third")}), _MG + " SELECT track_id, count(DISTINCT match) AS matches, R6(avg(mx)) AS mx, R6(avg(my)) AS my, R6(avg(final_third)) AS final_third FROM mg GROUP BY track_id HAVING count(DISTINCT match) >= 2", "pl", "dirs")
add("era_split", lambda t: R.by_era(_match_geometry(t), "track_id", "one").withColumns({c: r6(c) for c in ("a", "b", "delta")}), _MG + " SELECT track_id, R6(avg(mx) FILTER (manager = 'one')) AS a, R6(avg(mx) FILTER (manager IS DISTINCT FROM 'one')) AS b, R6(avg(mx) FILTER (manager IS DISTINCT FROM 'one') - avg(mx) FILTER (manager = 'one')) AS delta FROM mg GROUP BY track_id", "pl", "dirs")
add("involvement", lambda t: R.involvement(t.stream.select((F.col("chunk") % 40).alias("player"), F.when(F.col("event_type") == "click", "pass").otherwise("touch").alias("kind")), t.spark.range(50).select(F.col("id").alias("player"), (F.col("id") % 2).alias("team"))).withColumn("share", r6("share")), """
WITH g AS (SELECT chunk % 40 AS player, count(*) FILTER (event_type = 'click') AS passes, count(*) AS touches FROM stream GROUP BY 1), r AS (SELECT i AS player, i % 2 AS team FROM range(50) x(i)), j AS (SELECT r.player, r.team, coalesce(passes, 0) AS passes, coalesce(touches, 0) AS touches FROM r LEFT JOIN g USING (player))
SELECT player, team, passes, touches, R6(touches / sum(touches) OVER (PARTITION BY team)) AS share FROM j""", "stream")
_TEN = """WITH c AS (SELECT *, avg(pitch_x) OVER w AS mx FROM pl WINDOW w AS (PARTITION BY chunk, frame, team)), s AS (SELECT chunk, frame, team, max(pitch_y) - min(pitch_y) AS width, max(pitch_x) - min(pitch_x) AS length FROM c GROUP BY ALL HAVING count(*) >= 4),
te AS (SELECT chunk, team, count(*) AS frames, avg(width) AS width, avg(length) AS length FROM s GROUP BY ALL HAVING count(*) >= 20)"""


def _tend(t):
    return R.tendencies(S.frame_shapes(t.pos).select("chunk", "frame", "team", "width", "length"), ["width", "length"])


add("tendencies", lambda t: _tend(t).withColumns({c: r6(c) for c in ("width", "length")}), _TEN + " SELECT chunk, team, frames, R6(width) AS width, R6(length) AS length FROM te", "pl")
add("marginals", lambda t: R.marginals(_tend(t), "width").withColumns({c: r6(c) for c in ("mean", "sd", "low", "high")}), _TEN + " SELECT team, R6(avg(width)) AS mean, R6(stddev_pop(width)) AS sd, R6(quantile_cont(width, 0.1)) AS low, R6(quantile_cont(width, 0.9)) AS high, count(*) AS n FROM te GROUP BY team", "pl")
_FIT = _TEN + """, ob AS (SELECT a.*, b.length AS opp FROM te a JOIN te b ON a.chunk = b.chunk AND b.team = 1 - a.team), lg AS (SELECT opp AS x, 'width' AS tendency, width AS y FROM ob UNION ALL SELECT opp, 'length', length FROM ob),
fl AS (SELECT tendency, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept, count(*) AS n FROM lg GROUP BY tendency), rs AS (SELECT fl.tendency, slope, intercept, n, stddev_pop(y - intercept - slope * x) AS resid FROM lg JOIN fl USING (tendency) GROUP BY ALL)"""


def _fit(t):
    return R.fit_lines(R.opponents(_tend(t), "length", "opp"), "opp", ["width", "length"])


add("opponent_lines", lambda t: _fit(t).select("tendency", "n", *(r6(c).alias(c) for c in ("slope", "intercept", "resid"))), _FIT + " SELECT tendency, n, R6(slope) AS slope, R6(intercept) AS intercept, R6(resid) AS resid FROM rs", "pl")
add("opponent_forecast", lambda t: R.forecast(_fit(t), F.lit(60.0)).withColumns({c: r6(c) for c in ("mean", "low", "high")}), _FIT + " SELECT tendency, R6(intercept + slope * 60) AS mean, R6(intercept + slope * 60 - resid) AS low, R6(intercept + slope * 60 + resid) AS high FROM rs", "pl")
add("pair_share", lambda t: R.pair_share(O.passes(t.poss, t.players).groupBy("chunk", "team").agg(F.count("*").alias("n")), "n").withColumn("share", r6("share")), 'WITH g AS (SELECT chunk, team, count(*) AS n FROM "pass" GROUP BY ALL) SELECT chunk, team, R6(CASE WHEN count(*) OVER w = 2 THEN n / sum(n) OVER w END) AS share FROM g WINDOW w AS (PARTITION BY chunk)', "pass")


def _ledger(t):
    e = t.ball.select((F.col("chunk") * 100000 + F.col("frame")).alias("event_id"), "chunk", (F.col("frame") + 2).alias("frame"))
    return R.ledger(e, t.poss, most_m=9.0)


_LED = """WITH ev AS (SELECT chunk * 100000 + frame AS event_id, chunk, frame + 2 AS frame, frame AS g FROM ball), c AS (SELECT ev.*, p.frame AS at_, p.team, p.carrier, p.dist_m FROM ev LEFT JOIN poss p ON p.chunk = ev.chunk AND p.frame IN (g - 15, g - 10, g - 5, g, g + 5) AND p.dist_m <= 9),
le AS (SELECT event_id, chunk, frame, at_ AS "at", team, carrier FROM c QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY dist_m NULLS LAST, at_) = 1)"""
add("event_ledger", _ledger, _LED + " SELECT * FROM le", "poss")
add("ledger_gate", lambda t: R.gate_counts(_ledger(t).withColumn("half", F.when(F.col("chunk") < 4, "h1").otherwise("h2"))), _LED + " SELECT coalesce(half, 'match') AS half, count(*) AS events, count(team) AS named FROM (SELECT *, CASE WHEN chunk < 4 THEN 'h1' ELSE 'h2' END AS half FROM le) GROUP BY ROLLUP (half)", "poss")
add("vote_attributes", lambda t: R.vote_attributes(t.pos.select("chunk", "frame", "track_id", (F.col("image_x") % 3).cast("long").alias("side")), ["chunk", "track_id"], ["side"]), """
WITH r AS (SELECT chunk, frame, track_id, CAST(image_x % 3 AS BIGINT) AS side FROM pos), c AS (SELECT chunk, track_id, side, count(*) AS n, min(frame) AS f FROM r GROUP BY ALL), b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY chunk, track_id ORDER BY n DESC, f, side) = 1)
SELECT r.chunk, r.frame, r.track_id, b.side FROM r JOIN b ON b.chunk = r.chunk AND b.track_id = r.track_id""", "pos")
add("crop_votes", lambda t: R.crop_votes(t.pos.select("track_id", (F.col("image_y").cast("long") % 20 - 2).alias("number"), "conf"), least_conf=0.6, least=3).withColumn("conf", r6("conf")), """
WITH c AS (SELECT track_id, CAST(image_y AS BIGINT) % 20 - 2 AS number, conf FROM pos), g AS (SELECT track_id, number, count(*) AS votes, avg(conf) AS conf, sum(conf) AS s FROM c WHERE conf >= 0.6 AND number >= 0 GROUP BY ALL HAVING count(*) >= 3)
SELECT track_id, number, votes, R6(conf) AS conf FROM g QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY round(s, 6) DESC, number) = 1""", "pos")
add("roster_maps", lambda t: R.roster_maps(t.read("supplier").select((F.col("s_suppkey") % 30).alias("number"), (F.col("s_nationkey") % 2).cast("string").alias("team"), F.col("s_name").alias("name"))).select("number", F.array_join("teams", ",").alias("teams"), F.array_join("names", ",").alias("names")), """
SELECT s_suppkey % 30 AS number, array_to_string(list_sort(list(DISTINCT CAST(s_nationkey % 2 AS VARCHAR))), ',') AS teams, array_to_string(list_sort(list(DISTINCT s_name)), ',') AS names FROM supplier GROUP BY 1""")
add("pair_features", lambda t: R.pair_features(t.players).withColumn("median_d", r6("median_d")), """
SELECT a.chunk, a.track_id AS a, b.track_id AS b, count(*) AS overlap, R6(median(sqrt((b.pitch_x - a.pitch_x) ** 2 + (b.pitch_y - a.pitch_y) ** 2))) AS median_d, bool_and(a.team = b.team) AS same_team FROM pl a JOIN pl b ON a.chunk = b.chunk AND a.frame = b.frame AND a.track_id < b.track_id GROUP BY ALL HAVING count(*) >= 2""", "pl")
add("penalty_share", lambda t: R.penalty_share(t.players, "team", "role").withColumn("share", r6("share")), "SELECT team, role, R6(avg((least(pitch_x, 105 - pitch_x) <= 16.5 AND abs(pitch_y - 34) <= 20.16)::INT)) AS share FROM pl GROUP BY ALL", "pl")
add("submission", lambda t: R.submission(t.players, t.ball.select("chunk", "frame", (F.col("chunk") * 100000 + F.col("frame")).alias("image_id"))))
add("receiver_top_k", lambda t: R.top_k_rate(R.receiver_candidates(O.passes(t.poss, t.players), t.players), "dist", "cand").withColumn("rate", r6("rate")), """
WITH c AS (SELECT p.chunk, p.frame, p.from_id, l.track_id = p.to_id AS ok, row_number() OVER (PARTITION BY p.chunk, p.frame, p.from_id ORDER BY sqrt((l.pitch_x - x0) ** 2 + (l.pitch_y - y0) ** 2), l.track_id) AS k FROM "pass" p JOIN pl l ON l.chunk = p.chunk AND l.frame = p.frame AND l.team = p.team AND l.track_id <> p.from_id),
r AS (SELECT chunk, frame, from_id, min(k) FILTER (ok) AS r FROM c GROUP BY ALL) SELECT 1 AS k, R6(avg(coalesce(r <= 1, false)::INT)) AS rate FROM r UNION ALL SELECT 3, R6(avg(coalesce(r <= 3, false)::INT)) FROM r""", "pass")
add("evenly_spaced", lambda t: R.evenly_spaced(t.ball.select("chunk", "frame"), ["chunk"], "frame", 20), """
WITH d AS (SELECT chunk, frame, row_number() OVER (PARTITION BY chunk ORDER BY frame) - 1 AS i, count(*) OVER (PARTITION BY chunk) AS n FROM ball) SELECT chunk, frame FROM d WHERE i = 0 OR floor(i * 20 / n) <> floor((i - 1) * 20 / n)""", "ball")
add("text_lines", lambda t: R.lines_of_words(t.ball.select("chunk", "y", "frame"), "chunk", "y", 0.4).groupBy("chunk").agg((F.max("line") + 1).alias("lines")), """
WITH d AS (SELECT chunk, CASE WHEN y - lag(y) OVER (PARTITION BY chunk ORDER BY y) > 0.4 THEN 1 ELSE 0 END AS c FROM ball) SELECT chunk, CAST(sum(c) + 1 AS BIGINT) AS lines FROM d GROUP BY chunk""", "ball")
add("ratings_at", lambda t: R.rating_at(t.read("orders").select("o_orderkey", (F.col("o_custkey") % 25).alias("name"), (F.col("o_orderkey") % 100).alias("day")), t.read("supplier").select(F.col("s_nationkey").cast("long").alias("name"), (F.col("s_suppkey") % 4 * 25).alias("from_day"), (F.col("s_suppkey") % 4 * 25 + 24).alias("to_day"), F.col("s_acctbal").alias("rating"))).select("o_orderkey", "rating"), """
SELECT o_orderkey, s_acctbal AS rating FROM orders JOIN supplier ON s_nationkey = o_custkey % 25 AND o_orderkey % 100 BETWEEN s_suppkey % 4 * 25 AND s_suppkey % 4 * 25 + 24""")
add("cross_validate", lambda t: R.cross_validate(t.read("lineitem").groupBy("l_suppkey").agg(F.avg("l_quantity").alias("q"), F.avg("l_tax").alias("x")), t.read("lineitem").where("l_linenumber < 4").groupBy("l_suppkey").agg(F.avg("l_quantity").alias("q"), F.avg("l_tax").alias("x")), "l_suppkey", ["q", "x"], tolerance=0.03).withColumns({c: r6(c) for c in ("primary", "secondary")}), """
WITH a AS (SELECT l_suppkey, avg(l_quantity) AS q, avg(l_tax) AS x FROM lineitem GROUP BY 1), b AS (SELECT l_suppkey, avg(l_quantity) AS q, avg(l_tax) AS x FROM lineitem WHERE l_linenumber < 4 GROUP BY 1)
SELECT l_suppkey, 'q' AS metric, R6(a.q) AS "primary", R6(b.q) AS secondary, abs(a.q - b.q) > 0.03 * abs(a.q) AS flagged FROM a FULL JOIN b USING (l_suppkey) UNION ALL SELECT l_suppkey, 'x', R6(a.x), R6(b.x), abs(a.x - b.x) > 0.03 * abs(a.x) FROM a FULL JOIN b USING (l_suppkey)""")


def _hs(t):
    return G.frame_homographies(t.pos)


add("frame_homographies", lambda t: _hs(t))
add("calibration_gaps_filled", lambda t: G.projected(t.pos, G.carried(t.pos, G.frame_homographies(t.pos, least=12), most=15)).select("chunk", "frame", "track_id", "pitch_x", "pitch_y"))
add("reprojection_error", lambda t: G.reprojection_error(t.pos, _hs(t)))
add("smoothed_ball", lambda t: G.smoothed(t.ball, "chunk", "frame", "x"))
add("pitch_model_points", lambda t: G.model_points(t.read("nation").select(F.col("n_name").alias("segment"), F.lit(0.0).alias("x0"), F.col("n_nationkey").cast("double").alias("y0"), (F.col("n_nationkey") * 2.5).alias("x1"), F.col("n_nationkey").cast("double").alias("y1")), step=2.0).withColumns({c: r6(c) for c in ("x", "y")}), """
WITH s AS (SELECT n_name AS segment, n_nationkey AS y, n_nationkey * 2.5 AS x1, greatest(CAST(ceil(n_nationkey * 2.5 / 2) AS INT), 1) AS n FROM nation), k AS (SELECT *, unnest(range(0, n + 1)) AS k FROM s) SELECT segment, R6(k / n * x1) AS x, R6(y) AS y FROM k""")

_CH = f"""WITH ch AS (SELECT p.chunk, p.frame, p.team, CASE WHEN dir > 0 THEN b.x ELSE 105 - b.x END AS ax, CASE WHEN dir > 0 THEN b.y ELSE 68 - b.y END AS ay FROM poss p JOIN ball b ON b.chunk = p.chunk AND b.frame = p.frame JOIN dirs d ON d.chunk = p.chunk AND d.team = p.team),
cz AS (SELECT *, CASE WHEN ay < 22.67 THEN 'left' WHEN ay < 45.33 THEN 'centre' ELSE 'right' END AS channel, CASE WHEN ax < 35 THEN 'own' WHEN ax < 70 THEN 'middle' ELSE 'final' END AS zone FROM ch)"""
add("ball_channels", lambda t: K.ball_channels(t.ball, t.poss, t.dirs).groupBy("team", "channel", "zone").agg(F.count("*").alias("n")), _CH + " SELECT team, channel, zone, count(*) AS n FROM cz GROUP BY ALL", "poss", "dirs")
add("progression", lambda t: K.progression(K.ball_channels(t.ball, t.poss, t.dirs), gap=60, step_m=80.0).withColumn("forward_m", r6("forward_m")), _CH + """
, f AS (SELECT *, lead(frame) OVER w AS f1, lead(team) OVER w AS t1, lead(ax) OVER w AS a1, lead(ay) OVER w AS y1 FROM cz WINDOW w AS (PARTITION BY chunk ORDER BY frame)), o AS (SELECT *, coalesce(t1 = team AND f1 - frame <= 60 AND sqrt((a1 - ax) ** 2 + (y1 - ay) ** 2) <= 80, false) AS ok FROM f)
SELECT team, channel, count(*) AS samples, R6(sum(CASE WHEN ok THEN greatest(a1 - ax, 0) ELSE 0 END)) AS forward_m, count(*) FILTER (ok AND ax < 70 AND a1 >= 70) AS entries FROM o GROUP BY ALL""", "poss", "dirs")
add("coverage_profile", lambda t: K.coverage_profile(t.players.where("role = 'player'").select("chunk", "frame"), t.pos.where("pitch_x IS NULL").select("chunk", "frame"), ["chunk", "frame"]), """
WITH a AS (SELECT chunk, frame, count(*) AS observed FROM pl WHERE role = 'player' GROUP BY ALL), b AS (SELECT chunk, frame, count(*) AS estimated FROM pos WHERE pitch_x IS NULL GROUP BY ALL)
SELECT coalesce(a.chunk, b.chunk) AS chunk, coalesce(a.frame, b.frame) AS frame, coalesce(observed, 0) AS observed, coalesce(estimated, 0) AS estimated FROM a FULL JOIN b ON a.chunk = b.chunk AND a.frame = b.frame""", "pl")
add("sight_gaps", lambda t: K.sight_gaps(t.players, t.players.groupBy("chunk", "frame").agg(F.count("*").alias("n")), step=5, least=8), """
WITH g AS (SELECT chunk, track_id, frame + 5 AS f0, lead(frame) OVER (PARTITION BY chunk, track_id ORDER BY frame) - 5 AS f1 FROM pl), n AS (SELECT chunk, frame, count(*) AS n FROM pl GROUP BY ALL)
SELECT g.chunk, track_id, f0, f1 FROM g JOIN n ON n.chunk = g.chunk AND n.frame BETWEEN f0 AND f1 WHERE f1 >= f0 GROUP BY ALL HAVING min(n) >= 8 AND count(*) = (f1 - f0) / 5 + 1""", "pl")
add("second_deepest", lambda t: K.second_deepest(T.advance_of(t.players, t.dirs), "ax").withColumn("line", r6("line")), _ORI + " SELECT chunk, frame, team, R6(max(ox) FILTER (k = 2)) AS line FROM (SELECT *, row_number() OVER (PARTITION BY chunk, frame, team ORDER BY ox) AS k FROM ori) GROUP BY ALL", "pl", "dirs")
add("noise_floor", lambda t: K.noise_floor(t.ball, ["chunk"], "frame", "x").withColumn("noise", r6("noise")), "WITH d AS (SELECT x - (lag(x) OVER w + lead(x) OVER w) / 2 AS d, frame - lag(frame) OVER w = lead(frame) OVER w - frame AS e FROM ball WINDOW w AS (PARTITION BY chunk ORDER BY frame)) SELECT R6(sqrt(avg(d * d) FILTER (e)) / sqrt(1.5)) AS noise FROM d", "ball")
add("regain_labels", lambda t: K.regain_labels(O.turnovers(t.poss, t.ball), t.poss, t.ball, within=60, hole=5), """
WITH c AS (SELECT chunk, frame AS cut, lead(frame) OVER (PARTITION BY chunk ORDER BY frame) AS nxt FROM ball), k AS (SELECT chunk, cut FROM c WHERE nxt IS NULL OR nxt - cut > 5),
j AS (SELECT t.chunk, t.frame, (SELECT min(cut) FROM k WHERE k.chunk = t.chunk AND cut BETWEEN t.frame AND t.frame + 60) AS cut, (SELECT min(p.frame) FROM poss p WHERE p.chunk = t.chunk AND p.team = t.lost_team AND p.frame > t.frame AND p.frame <= t.frame + 60) AS back FROM turn t)
SELECT chunk, frame, CASE WHEN back IS NOT NULL AND (cut IS NULL OR back <= cut) THEN 1 WHEN cut IS NOT NULL THEN NULL ELSE 0 END AS label FROM j""", "turn")
add("poststratified", lambda t: K.poststratified(t.read("orders").select(F.col("o_orderstatus").alias("s"), F.col("o_totalprice").alias("value")), t.spark.createDataFrame([("O", 0.5), ("F", 0.3), ("P", 0.2), ("X", 9.0)], "s string, weight double"), "s").withColumn("mean", r6("mean")), """
SELECT R6(sum(m * w) / sum(w)) AS mean FROM (SELECT o_orderstatus AS s, avg(o_totalprice) AS m FROM orders GROUP BY 1) JOIN (VALUES ('O', 0.5::DOUBLE), ('F', 0.3), ('P', 0.2), ('X', 9.0)) v(s, w) USING (s)""")
add("holding_time", lambda t: K.holding_time(t.poss), """
WITH p AS (SELECT team, lead(frame) OVER w - frame AS d, lead(team) OVER w AS n FROM poss WINDOW w AS (PARTITION BY chunk ORDER BY frame)), s AS (SELECT team, CASE WHEN n = team THEN d ELSE d / 2.0 END AS d FROM p WHERE d IS NOT NULL UNION ALL SELECT n, d / 2.0 FROM p WHERE n <> team)
SELECT team, CAST(sum(d) AS DOUBLE) AS frames FROM s GROUP BY team""", "poss")
add("dominant_share", lambda t: K.dominant_share(t.poss.groupBy("carrier", "chunk").agg(F.count("*").alias("n")), "carrier", "n").withColumns({c: r6(c) for c in ("share", "herfindahl")}), "WITH g AS (SELECT carrier, chunk, count(*) AS n FROM poss GROUP BY ALL), p AS (SELECT carrier, n / sum(n) OVER (PARTITION BY carrier) AS p FROM g) SELECT carrier, R6(max(p)) AS share, R6(sum(p * p)) AS herfindahl FROM p GROUP BY carrier", "poss")
add("territory", lambda t: K.territory(t.players.where("role = 'player' OR chunk < 4").select(F.col("track_id").alias("player"), F.when(F.col("chunk") < 4, 1).otherwise(2).alias("half"), F.col("pitch_x").alias("x"), F.col("pitch_y").alias("y"))).withColumns({c: r6(c) for c in ("mx", "my", "sx", "sy")}), """
WITH a AS (SELECT track_id AS player, CASE WHEN chunk < 4 THEN 1 ELSE 2 END AS half, pitch_x AS x, pitch_y AS y FROM pl WHERE role = 'player' OR chunk < 4), g AS (SELECT player, half, avg(x) AS mx, avg(y) AS my, greatest(stddev_pop(x), 3) AS sx, greatest(stddev_pop(y), 3) AS sy FROM a GROUP BY ALL),
b AS (SELECT DISTINCT g.player, h.half FROM g, (VALUES (1), (2)) h(half))
SELECT b.player, b.half, R6(coalesce(g.mx, 105 - o.mx)) AS mx, R6(coalesce(g.my, 68 - o.my)) AS my, R6(coalesce(g.sx, o.sx)) AS sx, R6(coalesce(g.sy, o.sy)) AS sy FROM b LEFT JOIN g ON g.player = b.player AND g.half = b.half LEFT JOIN g o ON o.player = b.player AND o.half = 3 - b.half""", "pl")
add("anchor_flags", lambda t: K.reachable_anchor_flags(t.ball.select((F.col("chunk") * 100000 + F.col("frame")).alias("event_id"), "chunk", "frame", "x", "y", (F.col("frame") % 14 + 1).alias("player")), t.players.select("chunk", "frame", F.col("track_id").alias("player"), F.col("pitch_x").alias("x"), F.col("pitch_y").alias("y"))), """
WITH c AS (SELECT chunk * 100000 + frame AS event_id, chunk, frame, x, y, frame % 14 + 1 AS player FROM ball)
SELECT event_id, c.player, coalesce(bool_or(a.frame = c.frame OR sqrt((c.x - a.pitch_x) ** 2 + (c.y - a.pitch_y) ** 2) > 9 * abs(a.frame - c.frame) / 25.0 + 2), false) AS excluded FROM c LEFT JOIN pl a ON a.chunk = c.chunk AND a.track_id = c.player AND a.frame BETWEEN c.frame - 125 AND c.frame + 125 GROUP BY ALL""", "ball", "pl")

_PR = "WITH d AS (SELECT l_returnflag, l_tax - l_discount AS d FROM lineitem WHERE l_tax <> l_discount), r AS (SELECT l_returnflag, d, rank() OVER (PARTITION BY l_returnflag ORDER BY abs(d)) + (count(*) OVER (PARTITION BY l_returnflag, abs(d)) - 1) / 2 AS r FROM d), w AS (SELECT l_returnflag, count(*) AS n, sum(CASE WHEN d > 0 THEN r ELSE 0 END) AS w_plus, count(*) FILTER (d > 0) AS helped, count(*) FILTER (d < 0) AS hurt FROM r GROUP BY ALL)"
add("signed_rank", lambda t: X.signed_rank(t.read("lineitem"), ["l_returnflag"], "l_discount", "l_tax").withColumns({c: r6(c) for c in ("w_plus", "z")}), _PR + " SELECT l_returnflag, n, R6(w_plus) AS w_plus, R6((w_plus - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24)) AS z, helped, hurt FROM w")
_HW = "WITH r AS (SELECT o_orderpriority AS b, o_totalprice / 1000 - 200 AS r FROM orders), w AS (SELECT b, count(*) AS n, greatest((quantile_cont(r, 0.95) - quantile_cont(r, 0.05)) / 2, 1) AS width FROM r GROUP BY b HAVING count(*) >= 20)"


def _resid(t):
    return t.read("orders").select(F.col("o_orderpriority").alias("b"), (F.col("o_totalprice") / 1000 - 200).alias("r"))


add("half_widths", lambda t: X.half_widths(_resid(t), "b", "r", floor=1.0).withColumn("width", r6("width")), _HW + " SELECT b, n, R6(width) AS width FROM w")
add("coverage_table", lambda t: X.coverage_table(_resid(t), "b", "r", X.half_widths(_resid(t), "b", "r", floor=1.0), k=0.8).withColumns({c: r6(c) for c in ("radius", "covered")}), _HW + " SELECT b, R6(max(width) * 0.8) AS radius, R6(avg((abs(r) <= width * 0.8)::INT)) AS covered FROM r JOIN w USING (b) GROUP BY b")
add("team_map", lambda t: X.team_map(t.poss.select(F.col("team").alias("pred_team"), (F.col("carrier") % 3).alias("team"))), "WITH m AS (SELECT team AS p, carrier % 3 AS g FROM poss WHERE team IN (0, 1)), c AS (SELECT count(*) FILTER (p + 1 = g) AS identity, count(*) FILTER (2 - p = g) AS flipped FROM m) SELECT identity, flipped, CASE WHEN identity >= flipped THEN 'identity' ELSE 'flipped' END AS mapping FROM c", "poss")
add("first_unskilled", lambda t: X.first_unskilled(t.read("lineitem").withColumn("b", F.floor(F.col("l_quantity") / 10).cast("int")), "b", "l_discount", "l_tax", "l_suppkey"))
_ELO = "SELECT c_mktsegment, R6(avg(1 / (1 + pow(10.0::DOUBLE, (c_nationkey * 10 - c_acctbal / 20 - 60) / 400)))) AS p FROM customer GROUP BY ALL"
add("elo_expected", lambda t: t.read("customer").groupBy("c_mktsegment").agg(r6(F.avg(L.elo_expected(F.col("c_acctbal") / 20, F.col("c_nationkey") * 10.0))).alias("p")), _ELO)
add("phases_by_state", lambda t: M.phases_by_state(M.four_phases(t.poss, window=40), S.frame_shapes(t.pos).select("chunk", "frame", "team", "width"), t.ball.withColumn("state", F.when(F.col("x") < 35, "chasing").when(F.col("x") < 70, "level").otherwise("leading")), "width").withColumn("width", r6("width")), """
WITH p AS (SELECT *, lag(team) OVER (PARTITION BY chunk ORDER BY frame) AS was FROM poss), f AS (SELECT *, last_value(CASE WHEN team <> was THEN frame END IGNORE NULLS) OVER w AS ff, last_value(CASE WHEN team <> was THEN team END IGNORE NULLS) OVER w AS won, last_value(CASE WHEN team <> was THEN was END IGNORE NULLS) OVER w AS lost FROM p WINDOW w AS (PARTITION BY chunk ORDER BY frame)),
fp AS (SELECT chunk, frame, t.team, CASE WHEN frame - ff <= 40 AND t.team = won THEN 'trans_pos' WHEN frame - ff <= 40 AND t.team = lost THEN 'trans_neg' WHEN t.team = f.team THEN 'in_poss' ELSE 'out_poss' END AS phase FROM f, (SELECT unnest([0, 1]) AS team) t),
s AS (SELECT chunk, frame, team, max(pitch_y) - min(pitch_y) AS width FROM pl GROUP BY ALL HAVING count(*) >= 4)
SELECT fp.team, phase, CASE WHEN x < 35 THEN 'chasing' WHEN x < 70 THEN 'level' ELSE 'leading' END AS state, count(*) AS frames, R6(avg(width)) AS width FROM fp JOIN s ON s.chunk = fp.chunk AND s.frame = fp.frame AND s.team = fp.team JOIN ball b ON b.chunk = fp.chunk AND b.frame = fp.frame GROUP BY ALL""", "poss")
add("event_minutes", lambda t: M.event_minutes(t.stream.select(F.col("event_id").alias("match"), F.concat(F.lit('[{"minute": '), (F.col("event_id") % 90).cast("string"), F.lit(', "type": "'), F.col("event_type"), F.lit('", "home": '), (F.col("event_id") % 2 == 0).cast("string"), F.lit("}]")).alias("doc")), "doc", kinds=("purchase", "click")), """
SELECT event_id AS match, CAST(event_id % 90 AS INTEGER) AS minute, event_type AS kind, CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END AS side FROM stream WHERE event_type IN ('purchase', 'click')""", "stream")


def _states(t):
    o = t.read("orders")
    return o.select("o_orderkey", (F.col("o_orderkey") % 91).alias("minute"), (F.col("o_custkey") % 5 - 2).alias("diff"), F.lit(0).alias("men"), (F.col("o_totalprice") / 1000 - 200).alias("elo"), (F.col("o_orderkey") % 2).alias("home"), F.when(F.col("o_custkey") % 5 > 2, 2).when(F.col("o_custkey") % 5 == 2, 1).otherwise(0).alias("result"))


add("win_probability", lambda t: L.outcomes(L.fit_outcomes(_states(t)), _states(t)).groupBy("result").agg(F.count("*").alias("n"), F.avg("p_win").alias("p_win")))
add("receiver_model", lambda t: R.top_k_rate((lambda c: L.scored(L.receiver_model(c, ["dist"]), c))(R.receiver_candidates(O.passes(t.poss, t.players), t.players)), F.desc("score"), "cand"))
add("run_scores", lambda t: (lambda d: L.displacement_scores(L.ridge(d, ["speed", "cos_h", "sin_h"], "dx").transform(d).withColumnRenamed("prediction", "px").withColumn("py", F.lit(0.0)), "px", "py"))(L.run_features(T.build_tracks(t.pos), T.run_targets(T.build_tracks(t.pos), horizon=38, tolerance=5))))
add("style_components", lambda t: L.components(_tend(t).withColumn("k", F.col("chunk") * 2 + F.col("team")), "k", ["width", "length"], 2)[0])
add("shape_prototypes", lambda t: H.shape_prototypes(t.pos, t.dirs, 8))
add("colour_teams", lambda t: L.colour_teams(t.pos.groupBy("chunk", "track_id").agg(F.avg("conf").alias("l"), F.avg("image_x").alias("a"), F.avg("image_y").alias("b"))))

QUERIES, SQL = BOOK.queries, BOOK.sql
