"""Queries of frame cleaning, tracks and match metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackloom.functions import pitch as P
from trackloom.operators import frames as C
from trackloom.operators import metrics as M
from trackloom.operators import possession as O
from trackloom.operators import shape as S
from trackloom.operators import tracks as T
from trackloom.plans.book import Book, r6
from trackloom.plans.ordered import asof

BOOK = Book()
add = BOOK.add


def _xy():
    return [r6("pitch_x").alias("pitch_x"), r6("pitch_y").alias("pitch_y")]


_KEEP = ["chunk", "frame", "track_id"]
_SEEN = "role IN ('player', 'goalkeeper') AND pitch_x IS NOT NULL AND pitch_y IS NOT NULL"

add("clamp_positions", lambda t: C.clamp_positions(t.pos).select(*_KEEP, *_xy()), """
SELECT chunk, frame, track_id, R6(CASE WHEN ok THEN least(greatest(pitch_x, 0), 105) END) AS pitch_x, R6(CASE WHEN ok THEN least(greatest(pitch_y, 0), 68) END) AS pitch_y
FROM (SELECT *, pitch_x BETWEEN -2 AND 107 AND pitch_y BETWEEN -2 AND 70 AS ok FROM pos)""", "pos")
add("plausible_frames", lambda t: C.plausible_frames(t.pos), f"""
WITH c AS (SELECT chunk, frame, CASE WHEN pitch_x BETWEEN -2 AND 107 AND pitch_y BETWEEN -2 AND 70 AND {_SEEN} THEN least(greatest(pitch_x, 0), 105) END AS x, CASE WHEN pitch_x BETWEEN -2 AND 107 AND pitch_y BETWEEN -2 AND 70 AND {_SEEN} THEN least(greatest(pitch_y, 0), 68) END AS y FROM pos)
SELECT chunk, frame, count(x) >= 3 AND coalesce(greatest(max(x) - min(x), max(y) - min(y)) >= 5, false) AS plausible FROM c GROUP BY ALL""", "pos")
add("reject_frames", lambda t: C.reject_frames(t.pos, least=7, span_m=60.0).select(*_KEEP, *_xy()), f"""
WITH w AS (SELECT *, count(*) FILTER ({_SEEN}) OVER f >= 7 AND coalesce(greatest(max(CASE WHEN {_SEEN} THEN pitch_x END) OVER f - min(CASE WHEN {_SEEN} THEN pitch_x END) OVER f, max(CASE WHEN {_SEEN} THEN pitch_y END) OVER f - min(CASE WHEN {_SEEN} THEN pitch_y END) OVER f) >= 60, false) AS ok FROM pos WINDOW f AS (PARTITION BY chunk, frame))
SELECT chunk, frame, track_id, R6(CASE WHEN ok THEN pitch_x END) AS pitch_x, R6(CASE WHEN ok THEN pitch_y END) AS pitch_y FROM w""", "pos")
add("smooth_positions", lambda t: C.smooth_positions(t.pos).select(*_KEEP, *_xy()), """
SELECT chunk, frame, track_id, R6(CASE WHEN role IN ('player', 'goalkeeper') AND pitch_x IS NOT NULL THEN median(CASE WHEN role IN ('player', 'goalkeeper') THEN pitch_x END) OVER w ELSE pitch_x END) AS pitch_x,
  R6(CASE WHEN role IN ('player', 'goalkeeper') AND pitch_y IS NOT NULL THEN median(CASE WHEN role IN ('player', 'goalkeeper') THEN pitch_y END) OVER w ELSE pitch_y END) AS pitch_y
FROM pos WINDOW w AS (PARTITION BY chunk, track_id ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)""", "pos")
add("actors", lambda t: C.flag_actor(t.pos, t.ball, most_m=8.0).where("is_actor").select(*_KEEP), "SELECT chunk, frame, carrier AS track_id FROM poss WHERE dist_m <= 8", "poss")
add("keepers", lambda t: C.flag_keeper(t.pos).where("is_keeper").select(*_KEEP), """
WITH m AS (SELECT chunk, frame, team, avg(pitch_x) AS m FROM pl GROUP BY ALL), lo AS (SELECT chunk, frame, team AS low FROM m QUALIFY row_number() OVER (PARTITION BY chunk, frame ORDER BY m, team) = 1),
g AS (SELECT pl.*, abs(pitch_x - CASE WHEN team = low THEN 0 ELSE 105 END) AS off, (role = 'goalkeeper')::INT AS gk FROM pl JOIN lo USING (chunk, frame)),
k AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY chunk, frame, team ORDER BY gk DESC, off, track_id) = 1)
SELECT chunk, frame, track_id FROM k WHERE gk = 1 OR off <= 16.5""", "pl")
_SIG = f"""
WITH g AS (SELECT chunk, frame, count(*) FILTER (role IN ('player', 'goalkeeper')) AS n_det, count(*) FILTER ({_SEEN}) AS n_pitch, max(image_x) FILTER (role IN ('player', 'goalkeeper')) - min(image_x) FILTER (role IN ('player', 'goalkeeper')) AS x_spread,
  max(image_y) FILTER (role IN ('player', 'goalkeeper')) - min(image_y) FILTER (role IN ('player', 'goalkeeper')) AS y_spread, arg_min(calib_error_m, track_id) AS calib_error_m FROM pos GROUP BY chunk, frame),
s AS (SELECT *, CASE WHEN n_det >= 8 AND x_spread >= 1000 THEN 'live_wide' WHEN n_det <= 4 THEN 'close_up' ELSE 'replay_or_other' END AS shot_type FROM g WHERE n_det > 0),
e AS (SELECT chunk, min(frame) AS a, max(frame) AS z FROM s GROUP BY chunk), q AS (SELECT chunk, unnest(range(a, z + 1, 5)) AS frame FROM e),
gr AS (SELECT q.chunk, q.frame, coalesce(n_det, 0) AS n_det, coalesce(shot_type, 'graphic') AS shot_type FROM q LEFT JOIN s USING (chunk, frame))
"""
add("frame_signals", lambda t: C.frame_signals(t.pos).withColumn("calib_error_m", r6("calib_error_m")), _SIG + "SELECT chunk, frame, n_det, n_pitch, x_spread, y_spread, R6(calib_error_m) AS calib_error_m, calib_error_m <= 2 AS calibrated, n_pitch >= 6 AS ge6, shot_type FROM s", "pos")
add("shot_grid", lambda t: C.on_grid(C.frame_signals(t.pos), 5), _SIG + "SELECT * FROM gr", "pos")
add("shot_shares", lambda t: C.class_shares(C.on_grid(C.frame_signals(t.pos), 5)).select("shot_type", r6("share").alias("share")), _SIG + """
SELECT t AS shot_type, R6((SELECT count(*) FROM gr WHERE shot_type = t) / (SELECT count(*) FROM gr)) AS share FROM (SELECT unnest(['live_wide', 'close_up', 'replay_or_other', 'graphic']) AS t)""", "pos")
add("wide_score", lambda t: C.wide_score(t.pos).select("chunk", "frame", r6("score").alias("score")), "SELECT chunk, frame, R6(CASE WHEN count(*) >= 10 THEN count(*) * stddev_pop(image_x) / 1920 ELSE 0 END) AS score FROM pos WHERE role IN ('player', 'goalkeeper') GROUP BY ALL", "pos")
add("best_wide_frame", lambda t: C.wide_score(t.pos).groupBy("chunk").agg(F.max(F.struct("score", "frame")).alias("b")).select("chunk", "b.frame", r6("b.score").alias("score")), """
WITH s AS (SELECT chunk, frame, CASE WHEN count(*) >= 10 THEN count(*) * stddev_pop(image_x) / 1920 ELSE 0 END AS score FROM pos WHERE role IN ('player', 'goalkeeper') GROUP BY ALL)
SELECT chunk, frame, R6(score) AS score FROM s QUALIFY row_number() OVER (PARTITION BY chunk ORDER BY score DESC, frame DESC) = 1""", "pos")
_TEAM = ", ".join(f"CASE WHEN accepted THEN n_team{t} END AS n_team{t}, " + ", ".join(f"R6(CASE WHEN accepted THEN team{t}_{c} END) AS team{t}_{c}" for c in ("cx", "cy", "length", "width")) for t in (0, 1))
_TAGG = ", ".join(f"count(*) FILTER (s AND team = {t}) AS n_team{t}, avg(pitch_x) FILTER (s AND team = {t}) AS team{t}_cx, avg(pitch_y) FILTER (s AND team = {t}) AS team{t}_cy, max(pitch_x) FILTER (s AND team = {t}) - min(pitch_x) FILTER (s AND team = {t}) AS team{t}_length, max(pitch_y) FILTER (s AND team = {t}) - min(pitch_y) FILTER (s AND team = {t}) AS team{t}_width" for t in (0, 1))
_TC = ["mean_calib_error_m", "time_s", "ball_x", "ball_y", *(f"team{t}_{c}" for t in (0, 1) for c in ("cx", "cy", "length", "width"))]
add("tactical_frames", lambda t: C.tactical_frames(t.pos).withColumns({c: r6(c) for c in _TC}), f"""
WITH p AS (SELECT *, {_SEEN} AS s FROM pos), g AS (SELECT chunk, frame, count(*) FILTER (s) AS n_onpitch, avg(calib_error_m) AS mean_calib_error_m, count(*) FILTER (s) >= 10 AS accepted, {_TAGG},
  max(pitch_x) FILTER (role = 'ball' AND pitch_x IS NOT NULL AND pitch_y IS NOT NULL) AS ball_x, max(pitch_y) FILTER (role = 'ball' AND pitch_x IS NOT NULL AND pitch_y IS NOT NULL) AS ball_y FROM p GROUP BY chunk, frame)
SELECT chunk, frame, n_onpitch, R6(mean_calib_error_m) AS mean_calib_error_m, accepted, R6(frame / 25.0) AS time_s, {_TEAM}, R6(CASE WHEN accepted THEN ball_x END) AS ball_x, R6(CASE WHEN accepted THEN ball_y END) AS ball_y FROM g""", "pos")
add("freeze_frames", lambda t: C.exploded(C.orient(C.freeze_frames(t.pos), S.attacking_team(t.pos.withColumn("is_actor", F.lit(False))))).select("chunk", "frame", "track_id", "team", r6("x").alias("x"), r6("y").alias("y"), "keeper"), """
WITH a AS (SELECT chunk, frame, team AS att FROM (SELECT chunk, frame, team, avg(pitch_x) AS m FROM pl GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY chunk, frame ORDER BY m DESC, team) = 1),
p AS (SELECT pl.*, pitch_x * 120 / 105 AS x, pitch_y * 80 / 68 AS y, att FROM pl JOIN a USING (chunk, frame) QUALIFY count(*) OVER (PARTITION BY chunk, frame) >= 10),
m AS (SELECT *, avg(CASE WHEN team = att THEN x END) OVER (PARTITION BY chunk, frame) AS mean FROM p)
SELECT chunk, frame, track_id, team, R6(CASE WHEN mean < 60 THEN 120 - x ELSE x END) AS x, R6(CASE WHEN mean < 60 THEN 80 - y ELSE y END) AS y, role = 'goalkeeper' AS keeper FROM m""", "pl")
add("camera_segments", lambda t: C.camera_segments(t.pos, least=0.5), """
WITH s AS (SELECT chunk, frame, list(DISTINCT track_id) AS ids FROM pos GROUP BY ALL), l AS (SELECT *, lag(ids) OVER (PARTITION BY chunk ORDER BY frame) AS was FROM s),
c AS (SELECT chunk, frame, CASE WHEN was IS NULL THEN 0 WHEN len(list_intersect(ids, was)) / len(list_distinct(list_concat(ids, was))) < 0.5 THEN 1 ELSE 0 END AS cut FROM l)
SELECT chunk, frame, CAST(sum(cut) OVER (PARTITION BY chunk ORDER BY frame) AS BIGINT) AS segment FROM c""", "pos")
add("geometry_yield", lambda t: C.geometry_yield(t.pos).withColumn("share", r6("share")), f"WITH g AS (SELECT chunk, frame, count(*) FILTER ({_SEEN}) >= 6 AS ok FROM pos GROUP BY ALL) SELECT chunk, R6(avg(ok::INT)) AS share FROM g GROUP BY chunk", "pos")
add("strongest_peaks", lambda t: C.strongest_peaks(t.stream.select("chunk", "event_type", "frame", F.col("value").alias("conf")), ["chunk", "event_type"], gap=7200))
_LIVE = """
WITH l AS (SELECT chunk, frame, dist_m <= 9 AS is_live FROM poss), a AS (SELECT *, CASE WHEN lag(is_live) OVER w = is_live THEN 0 ELSE 1 END AS n FROM l WINDOW w AS (PARTITION BY chunk ORDER BY frame)),
b AS (SELECT *, sum(n) OVER (PARTITION BY chunk ORDER BY frame) AS r FROM a), s AS (SELECT chunk, min(frame) AS a, max(frame) AS z FROM b WHERE is_live GROUP BY chunk, r),
m AS (SELECT *, CASE WHEN a - lag(z) OVER (PARTITION BY chunk ORDER BY a) <= 15 THEN 0 ELSE 1 END AS n FROM s), q AS (SELECT *, sum(n) OVER (PARTITION BY chunk ORDER BY a) AS q FROM m),
seg AS (SELECT chunk, min(a) - 2 AS f0, max(z) + 2 AS f1 FROM q GROUP BY chunk, q)
"""


def _segments(t):
    return C.live_segments(t.poss.select("chunk", "frame", (F.col("dist_m") <= 9).alias("is_live")), merge=15, pad=2)


add("live_segments", _segments, _LIVE + "SELECT * FROM seg", "poss")
add("in_live_segments", lambda t: C.in_segments(t.ball.select("chunk", "frame"), _segments(t)), _LIVE + "SELECT chunk, frame FROM ball WHERE EXISTS (SELECT 1 FROM seg WHERE seg.chunk = ball.chunk AND frame BETWEEN f0 AND f1)", "poss")
add("camera_jobs", lambda t: C.camera_jobs(t.ball.select("chunk", "frame", (F.col("x") / 10).alias("drift"), (F.col("y") > 67).alias("is_cut")), period=50, drift=10.0))

_TRACK = """
WITH n AS (SELECT *, count(*) OVER (PARTITION BY chunk, track_id) AS n, row_number() OVER w AS i FROM pl WINDOW w AS (PARTITION BY chunk, track_id ORDER BY frame)),
s AS (SELECT *, {x} AS x_s, {y} AS y_s, (frame - lag(frame) OVER w) / 25.0 AS a, (lead(frame) OVER w - frame) / 25.0 AS b FROM n WINDOW w AS (PARTITION BY chunk, track_id ORDER BY frame)),
v AS (SELECT *, CASE WHEN a IS NULL OR a * 25 > 15 THEN NULL WHEN b IS NULL THEN (x_s - lag(x_s) OVER w) / a ELSE (a * a * lead(x_s) OVER w + (b * b - a * a) * x_s - b * b * lag(x_s) OVER w) / (a * b * (a + b)) END AS ux,
  CASE WHEN a IS NULL OR a * 25 > 15 THEN NULL WHEN b IS NULL THEN (y_s - lag(y_s) OVER w) / a ELSE (a * a * lead(y_s) OVER w + (b * b - a * a) * y_s - b * b * lag(y_s) OVER w) / (a * b * (a + b)) END AS uy FROM s WINDOW w AS (PARTITION BY chunk, track_id ORDER BY frame)),
tr AS (SELECT * EXCLUDE (n, i, a, b, ux, uy), ux * CASE WHEN sqrt(ux * ux + uy * uy) > 10 THEN 10 / sqrt(ux * ux + uy * uy) ELSE 1 END AS vx, uy * CASE WHEN sqrt(ux * ux + uy * uy) > 10 THEN 10 / sqrt(ux * ux + uy * uy) ELSE 1 END AS vy FROM v),
trk AS (SELECT *, sqrt(vx * vx + vy * vy) AS speed FROM tr)
"""


def _fit(c: str) -> str:
    at = lambda k: f"{'lead' if k > 0 else 'lag'}({c}, {abs(k)}) OVER w" if k else c
    fit = lambda ws, ks: "(" + " + ".join(f"{w} * {at(k)}" for w, k in zip(ws, ks)) + ") / 35"
    e0, e1, m = T._EDGE0, T._EDGE1, T._MID
    return f"CASE WHEN n < 5 THEN {c} WHEN i = 1 THEN {fit(e0, range(5))} WHEN i = 2 THEN {fit(e1, range(-1, 4))} WHEN i = n THEN {fit(e0[::-1], range(-4, 1))} WHEN i = n - 1 THEN {fit(e1[::-1], range(-3, 2))} ELSE {fit(m, range(-2, 3))} END"


_TRACK = _TRACK.replace("{x}", _fit("pitch_x")).replace("{y}", _fit("pitch_y"))


def _tracks(t):
    return T.build_tracks(t.pos)


_TV = ["x_s", "y_s", "vx", "vy", "speed"]
add("build_tracks", lambda t: _tracks(t).select(*_KEEP, *(r6(c).alias(c) for c in _TV)), _TRACK + "SELECT chunk, frame, track_id, " + ", ".join(f"R6({c}) AS {c}" for c in _TV) + " FROM trk", "pl")
add("run_targets", lambda t: T.run_targets(_tracks(t), horizon=38, tolerance=5).select(*_KEEP, r6("dx").alias("dx"), r6("dy").alias("dy")), _TRACK + """
SELECT a.chunk, a.frame, a.track_id, R6(b.x_s - a.x_s) AS dx, R6(b.y_s - a.y_s) AS dy FROM trk a JOIN trk b ON a.chunk = b.chunk AND a.track_id = b.track_id AND abs(b.frame - a.frame - 38) <= 5
QUALIFY row_number() OVER (PARTITION BY a.chunk, a.track_id, a.frame ORDER BY abs(b.frame - a.frame - 38), b.frame) = 1""", "pl")
add("physical_profile", lambda t: T.physical_profile(_tracks(t)).select("team", *(r6(c).alias(c) for c in ("walk", "jog", "run", "sprint", "p99", "mean_speed"))), _TRACK + """
SELECT team, R6(avg((speed < 2)::INT)) AS walk, R6(avg((speed >= 2 AND speed < 4)::INT)) AS jog, R6(avg((speed >= 4 AND speed < 7)::INT)) AS run, R6(avg((speed >= 7)::INT)) AS sprint, R6(quantile_cont(speed, 0.99)) AS p99, R6(avg(speed)) AS mean_speed FROM trk WHERE speed IS NOT NULL GROUP BY team""", "pl")
add("synchrony", lambda t: T.synchrony(_tracks(t)).select("team", r6("synchrony").alias("synchrony")), _TRACK + """
, m AS (SELECT chunk, frame, team, sqrt(avg(vx / speed) ** 2 + avg(vy / speed) ** 2) AS r FROM trk WHERE speed > 0.5 GROUP BY ALL HAVING count(*) >= 3), c AS (SELECT chunk, team, avg(r) AS r FROM m GROUP BY ALL)
SELECT team, R6(avg(r)) AS synchrony FROM c GROUP BY team""", "pl")
add("link_ball", lambda t: T.link_ball(t.ball.withColumn("conf", F.lit(1.0)), fps=25.0))
add("fill_gaps", lambda t: T.fill_gaps(t.ball, step=5, max_gap=8).select("chunk", "frame", r6("x").alias("x"), r6("y").alias("y"), "observed"), """
WITH l AS (SELECT *, lead(frame) OVER w AS f1, lead(x) OVER w AS x1, lead(y) OVER w AS y1 FROM ball WINDOW w AS (PARTITION BY chunk ORDER BY frame)), n AS (SELECT *, (f1 - frame) // 5 AS n FROM l),
k AS (SELECT *, unnest(range(0, CASE WHEN n > 1 AND n <= 8 THEN n ELSE 1 END)) AS k FROM n)
SELECT chunk, frame + k * 5 AS frame, R6(CASE WHEN k = 0 THEN x ELSE x + k / n * (x1 - x) END) AS x, R6(CASE WHEN k = 0 THEN y ELSE y + k / n * (y1 - y) END) AS y, k = 0 AS observed FROM k""", "ball")
add("receivers", lambda t: T.receivers(C.flag_actor(t.pos, t.ball, most_m=12.0)), """
SELECT chunk, frame, team, carrier AS passer, f1, c1 AS receiver FROM (SELECT *, lead(frame) OVER w AS f1, lead(team) OVER w AS t1, lead(carrier) OVER w AS c1 FROM poss WINDOW w AS (PARTITION BY chunk ORDER BY frame)) WHERE t1 = team AND c1 <> carrier AND f1 - frame <= 75""", "poss")

_D = "CASE WHEN {d} > 0 THEN {x} ELSE 105 - {x} END"
ax = lambda x, d="dir": _D.format(x=x, d=d)
_PH = f"""
WITH h AS (SELECT p.chunk, p.frame, p.team, {ax('b.x')} AS ax FROM poss p JOIN ball b ON b.chunk = p.chunk AND b.frame = p.frame JOIN dirs d ON d.chunk = p.chunk AND d.team = p.team),
li AS (SELECT pl.chunk, pl.frame, pl.team, quantile_cont({ax('pitch_x')}, 0.2) AS line FROM pl JOIN dirs d ON d.chunk = pl.chunk AND d.team = pl.team WHERE role = 'player' GROUP BY ALL HAVING count(*) >= 3),
ph AS (SELECT chunk, frame, team, CASE WHEN ax <= 35 THEN 'build_up' WHEN ax <= 70 THEN 'progression' ELSE 'final_third' END AS phase, true AS in_possession FROM h
  UNION ALL SELECT h.chunk, h.frame, li.team, CASE WHEN line >= 61 THEN 'high_press' WHEN line >= 44 THEN 'mid_block' ELSE 'low_block' END, false FROM h JOIN li ON li.chunk = h.chunk AND li.frame = h.frame AND li.team = 1 - h.team)
"""
add("ball_phases", lambda t: M.ball_phases(t.ball, t.poss, t.pos, t.dirs), _PH + "SELECT * FROM ph", "poss", "dirs")
add("ball_phase_shares", lambda t: M.ball_phases(t.ball, t.poss, t.pos, t.dirs).groupBy("team", "in_possession", "phase").agg(F.count("*").alias("frames")), _PH + "SELECT team, in_possession, phase, count(*) AS frames FROM ph GROUP BY ALL", "poss", "dirs")
_FOUR = """
WITH p AS (SELECT *, lag(team) OVER (PARTITION BY chunk ORDER BY frame) AS was FROM poss), f AS (SELECT *, last_value(CASE WHEN team <> was THEN frame END IGNORE NULLS) OVER w AS ff, last_value(CASE WHEN team <> was THEN team END IGNORE NULLS) OVER w AS won, last_value(CASE WHEN team <> was THEN was END IGNORE NULLS) OVER w AS lost FROM p WINDOW w AS (PARTITION BY chunk ORDER BY frame)),
fp AS (SELECT chunk, frame, t.team, CASE WHEN frame - ff <= 40 AND t.team = won THEN 'trans_pos' WHEN frame - ff <= 40 AND t.team = lost THEN 'trans_neg' WHEN t.team = f.team THEN 'in_poss' ELSE 'out_poss' END AS phase FROM f, (SELECT unnest([0, 1]) AS team) t)
"""
add("four_phases", lambda t: M.four_phases(t.poss, window=40), _FOUR + "SELECT * FROM fp", "poss")
add("phase_profile", lambda t: M.by_phase(M.four_phases(t.poss, window=40), S.frame_shapes(t.pos).drop("area"), ["width", "length", "compactness"], "phase").select("team", "phase", "frames", *(r6(c).alias(c) for c in ("width", "length", "compactness"))), _FOUR + """
, c AS (SELECT *, avg(pitch_x) OVER w AS mx, avg(pitch_y) OVER w AS my FROM pl WINDOW w AS (PARTITION BY chunk, frame, team)),
s AS (SELECT chunk, frame, team, max(pitch_y) - min(pitch_y) AS width, max(pitch_x) - min(pitch_x) AS length, avg(sqrt((pitch_x - mx) ** 2 + (pitch_y - my) ** 2)) AS compactness FROM c GROUP BY ALL HAVING count(*) >= 4)
SELECT fp.team, phase, count(*) AS frames, R6(avg(width)) AS width, R6(avg(length)) AS length, R6(avg(compactness)) AS compactness FROM fp JOIN s ON s.chunk = fp.chunk AND s.frame = fp.frame AND s.team = fp.team GROUP BY ALL""", "poss")
add("pressing", lambda t: M.pressing(t.ball, t.poss, _tracks(t)).select("team", r6("pressing_intensity").alias("pressing_intensity"), "press_frames"), _TRACK + """
, d AS (SELECT trk.*, b.x - x_s AS dx, b.y - y_s AS dy FROM poss p JOIN ball b ON b.chunk = p.chunk AND b.frame = p.frame JOIN trk ON trk.chunk = p.chunk AND trk.frame = p.frame WHERE trk.team <> p.team AND trk.team >= 0),
e AS (SELECT *, sqrt(dx * dx + dy * dy) AS dist FROM d), f AS (SELECT *, 0.7 + coalesce(1.5 - 0.5 * ((vx * dx + vy * dy) / nullif(speed * dist, 0)), 1) * greatest(0, dist - 1) / 7 AS t FROM e),
g AS (SELECT chunk, frame, team, 1 - exp(sum(ln(1 - least(1 / (1 + exp(-3 * (1.5 - t))), 1 - 1e-12)))) AS p FROM f GROUP BY ALL) SELECT team, R6(avg(p)) AS pressing_intensity, count(*) AS press_frames FROM g GROUP BY team""", "poss")
add("line_gap", lambda t: M.line_gap(t.ball, t.poss, t.players, t.dirs).withColumn("diff", r6("diff")), f"""
SELECT p.chunk, p.frame, p.team, R6({ax('b.x')} - quantile_cont({ax('o.pitch_x')}, 0.8)) AS diff FROM poss p JOIN ball b ON b.chunk = p.chunk AND b.frame = p.frame JOIN dirs d ON d.chunk = p.chunk AND d.team = p.team
JOIN pl o ON o.chunk = p.chunk AND o.frame = p.frame AND o.team = 1 - p.team GROUP BY p.chunk, p.frame, p.team, b.x, dir HAVING count(*) >= 3""", "poss", "dirs")
add("line_breaks", lambda t: M.line_breaks(M.line_gap(t.ball, t.poss, t.players, t.dirs)))
add("overload", lambda t: M.overload(t.ball, t.poss, t.players, radius=20.0).select("team", r6("mean_overload").alias("mean_overload"), r6("overload_share").alias("overload_share"), "frames"), """
WITH f AS (SELECT p.chunk, p.frame, p.team, count(*) FILTER (n AND l.team = p.team) - count(*) FILTER (n AND l.team = 1 - p.team) AS o FROM poss p JOIN ball b ON b.chunk = p.chunk AND b.frame = p.frame
  JOIN (SELECT *, true AS one FROM pl) l ON l.chunk = p.chunk AND l.frame = p.frame, LATERAL (SELECT sqrt((l.pitch_x - b.x) ** 2 + (l.pitch_y - b.y) ** 2) <= 20 AS n) GROUP BY ALL)
SELECT team, R6(avg(o)) AS mean_overload, R6(avg((o >= 1)::INT)) AS overload_share, count(*) AS frames FROM f GROUP BY team""", "poss")
add("verticality", lambda t: M.verticality(t.ball, t.poss, t.dirs, least=3).withColumn("verticality", r6("verticality")), f"""
WITH a AS (SELECT p.*, b.x, b.y, CASE WHEN lag(p.team) OVER (PARTITION BY p.chunk ORDER BY p.frame) = p.team THEN 0 ELSE 1 END AS new FROM poss p JOIN ball b ON b.chunk = p.chunk AND b.frame = p.frame),
r AS (SELECT *, sum(new) OVER (PARTITION BY chunk ORDER BY frame) AS run FROM a), x AS (SELECT r.*, {ax('x')} AS ax FROM r JOIN dirs d ON d.chunk = r.chunk AND d.team = r.team),
s AS (SELECT *, sqrt((ax - lag(ax) OVER w) ** 2 + (y - lag(y) OVER w) ** 2) AS step FROM x WINDOW w AS (PARTITION BY chunk, run ORDER BY frame)),
g AS (SELECT chunk, run, team, arg_max(ax, frame) - arg_min(ax, frame) AS fwd, sum(step) AS path FROM s GROUP BY ALL HAVING count(*) >= 3)
SELECT team, R6(sum(greatest(fwd, 0)) / sum(path)) AS verticality, count(*) AS spells FROM g GROUP BY team""", "poss", "dirs")
_LANES = [f"{a}_{b}" for a in M.LANES for b in M.THIRDS]
add("lane_occupation", lambda t: M.lane_occupation(t.players, t.dirs).select("team", *(r6(c).alias(c) for c in ("halfspace_share", "wing_share", "centre_share", "final_third_share", *_LANES))), f"""
WITH p AS (SELECT pl.team, greatest(least(CAST(floor((CASE WHEN dir > 0 THEN pitch_y ELSE 68 - pitch_y END) / 13.6) AS INT), 4), 0) AS l, greatest(least(CAST(floor(({ax('pitch_x')}) / 105 * 3) AS INT), 2), 0) AS t FROM pl JOIN dirs d ON d.chunk = pl.chunk AND d.team = pl.team)
SELECT team, R6(avg((l IN (1, 3))::INT)) AS halfspace_share, R6(avg((l IN (0, 4))::INT)) AS wing_share, R6(avg((l = 2)::INT)) AS centre_share, R6(avg((t = 2)::INT)) AS final_third_share, """ + ", ".join(f"R6(avg((l = {i} AND t = {j})::INT)) AS {a}_{b}" for i, a in enumerate(M.LANES) for j, b in enumerate(M.THIRDS)) + " FROM p GROUP BY team", "pl", "dirs")
_V = lambda x, y: f"exp(-sqrt((105 - {x}) ** 2 + (34 - {y}) ** 2) / 18)"
add("threat_created", lambda t: M.threat_created(t.ball, t.poss, t.dirs).withColumn("xt_created", r6("xt_created")), f"""
WITH v AS (SELECT b.chunk, b.frame, p.team, {_V(ax('b.x'), 'b.y')} AS v FROM ball b LEFT JOIN poss p ON p.chunk = b.chunk AND p.frame = b.frame LEFT JOIN dirs d ON d.chunk = p.chunk AND d.team = p.team),
g AS (SELECT team, v - lag(v) OVER w AS d, lag(team) OVER w AS was FROM v WINDOW w AS (PARTITION BY chunk ORDER BY frame)) SELECT team, R6(sum(d)) AS xt_created, count(*) AS n_moves FROM g WHERE was = team AND d > 0 GROUP BY team""", "poss", "dirs")
_CELLS = _TRACK + """
, q AS (SELECT chunk, frame, team, pitch_x + coalesce(vx, 0) * 0.5 AS px, pitch_y + coalesce(vy, 0) * 0.5 AS py FROM trk WHERE team IN (0, 1) AND chunk = 3 QUALIFY count(*) FILTER (team = 0) OVER (PARTITION BY chunk, frame) >= 3 AND count(*) FILTER (team = 1) OVER (PARTITION BY chunk, frame) >= 3),
gr AS (SELECT i * (105.0::DOUBLE / 20) AS gx, j * (68.0::DOUBLE / 13) AS gy FROM range(21) a(i), range(14) b(j)),
c0 AS (SELECT chunk, frame, gx, gy, sum(CASE WHEN team = 0 THEN e ELSE 0 END) AS a, sum(CASE WHEN team = 1 THEN e ELSE 0 END) AS b FROM (SELECT *, exp(-((gx - px) ** 2 + (gy - py) ** 2) / 162) AS e FROM q, gr) GROUP BY ALL),
ce AS (SELECT chunk, frame, gx, gy, a / (a + b + 1e-9) AS control FROM c0), z AS (SELECT ce.*, coalesce(dir, 1) AS dir FROM ce LEFT JOIN dirs d ON d.chunk = ce.chunk AND d.team = 0)
"""


_CELLS = _CELLS.replace(" AND chunk = 3", "")
add("space_control", lambda t: M.space_control(M.control_cells(_tracks(t)), t.dirs).select("team", r6("space_control").alias("space_control"), r6("attacking_control").alias("attacking_control")), _CELLS + """
, m AS (SELECT *, CASE WHEN dir > 0 THEN gx > 70 ELSE gx < 35 END AS mine FROM z), f AS (SELECT chunk, frame, avg(control) AS s, avg(control) FILTER (mine) AS a0, avg(1 - control) FILTER (NOT mine) AS a1 FROM m GROUP BY ALL)
SELECT 0 AS team, R6(avg(s)) AS space_control, R6(avg(a0)) AS attacking_control FROM f UNION ALL SELECT 1, R6(avg(1 - s)), R6(avg(a1)) FROM f""", "pl", "dirs")
add("controlled_threat", lambda t: M.controlled_threat(M.control_cells(_tracks(t)), t.dirs).select("team", r6("controlled_threat").alias("controlled_threat"), r6("threat_share").alias("threat_share"), "frames"), _CELLS + f"""
, f AS (SELECT chunk, frame, sum(control * {_V(ax('gx'), 'gy')}) AS t0, sum((1 - control) * {_V('(105 - ' + ax('gx') + ')', 'gy')}) AS t1 FROM z GROUP BY ALL)
SELECT 0 AS team, R6(avg(t0)) AS controlled_threat, R6(avg(t0 / (t0 + t1 + 1e-9))) AS threat_share, count(*) AS frames FROM f UNION ALL SELECT 1, R6(avg(t1)), R6(avg(t1 / (t0 + t1 + 1e-9))), count(*) FROM f""", "pl", "dirs")
_SP = """
WITH g AS (SELECT *, frame - lag(frame) OVER w AS gap_frames, sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2) AS d FROM ball WINDOW w AS (PARTITION BY chunk ORDER BY frame)),
sp AS (SELECT chunk, frame, CASE WHEN least(x, 105 - x) <= 3 AND least(y, 68 - y) <= 3 THEN 'corner' WHEN least(y, 68 - y) <= 1.5 THEN 'throw_in' WHEN least(x, 105 - x) <= 5.5 AND abs(y - 34) <= 9.16 THEN 'goal_kick' ELSE 'free_kick' END AS type, x, y, gap_frames FROM g WHERE gap_frames > 5 AND d * 25 / gap_frames <= 200)
"""
add("set_pieces", lambda t: M.set_pieces(t.ball, gap=5, settle=200.0), _SP + "SELECT * FROM sp", "ball")
add("set_piece_summary", lambda t: M.set_piece_summary(M.set_pieces(t.ball, gap=5, settle=200.0)), _SP + """
SELECT count(*) AS total, count(*) FILTER (type <> 'free_kick') AS reliable, count(*) FILTER (type = 'free_kick') AS candidate, count(*) FILTER (type = 'corner') AS corner, count(*) FILTER (type = 'throw_in') AS throw_in, count(*) FILTER (type = 'goal_kick') AS goal_kick, count(*) FILTER (type = 'free_kick') AS free_kick FROM sp""", "ball")
_AT = f"""
WITH a0 AS (SELECT *, CASE WHEN lag(team) OVER (PARTITION BY chunk ORDER BY frame) = team THEN 0 ELSE 1 END AS new FROM poss), r AS (SELECT *, sum(new) OVER (PARTITION BY chunk ORDER BY frame) AS run FROM a0),
s AS (SELECT chunk, run, team, min(frame) AS f0, max(frame) AS f1 FROM r GROUP BY ALL),
j AS (SELECT s.chunk, s.team, f0, f1, (SELECT count(*) FROM pass p WHERE p.chunk = s.chunk AND p.team = s.team AND p.frame BETWEEN f0 AND f1) AS n_passes, dir FROM s LEFT JOIN dirs d ON d.chunk = s.chunk AND d.team = s.team),
b AS (SELECT j.chunk, f0, arg_min({ax('x')}, frame) AS start_ac, min(frame) FILTER ({ax('x')} >= 70) AS at_ FROM j JOIN ball ON ball.chunk = j.chunk AND frame BETWEEN f0 AND f1 GROUP BY ALL),
k AS (SELECT j.chunk, team, j.f0, f1, n_passes, start_ac, (at_ - j.f0) / 25.0 AS entry_s FROM j LEFT JOIN b ON b.chunk = j.chunk AND b.f0 = j.f0),
att AS (SELECT *, CASE WHEN start_ac >= 70 THEN 'high_start' WHEN entry_s IS NOT NULL THEN CASE WHEN n_passes >= 6 OR entry_s > 15 THEN 'sustained_build_up' WHEN n_passes <= 2 THEN 'direct' ELSE 'fast_transition' END
  WHEN start_ac IS NOT NULL OR n_passes > 0 THEN CASE WHEN n_passes >= 6 THEN 'sustained' ELSE 'fast' END END AS label FROM k)
"""


def _attacks(t):
    return M.attacks(O.spells(t.poss), O.passes(t.poss, t.players), t.ball, t.dirs)


add("attacks", lambda t: _attacks(t).withColumns({c: r6(c) for c in ("start_ac", "entry_s")}), _AT + "SELECT chunk, team, f0, f1, n_passes, R6(start_ac) AS start_ac, R6(entry_s) AS entry_s, label FROM att", "pass", "dirs")
_MIX = ("high_start", "sustained_build_up", "direct", "fast_transition", "sustained", "fast")
add("attack_mix", lambda t: M.attack_mix(_attacks(t)).select("team", "n_attack", *(r6(c).alias(c) for c in _MIX)), _AT + "SELECT team, count(label) AS n_attack, " + ", ".join(f"R6(count(*) FILTER (label = '{c}') / count(label)) AS {c}" for c in _MIX) + " FROM att GROUP BY team", "pass", "dirs")
_BL = f"""
WITH o AS (SELECT pl.chunk, pl.frame, pl.team, {ax('pitch_x')} AS ax FROM pl JOIN dirs d ON d.chunk = pl.chunk AND d.team = pl.team WHERE role = 'player'),
rk AS (SELECT *, row_number() OVER (PARTITION BY chunk, frame, team ORDER BY ax) AS k, count(*) OVER (PARTITION BY chunk, frame, team) AS n FROM o),
g AS (SELECT chunk, frame, team, avg(ax) FILTER (k <= 4) - 5.62 * (4 - least(max(n), 4)) AS line_m, CASE WHEN max(n) >= 3 THEN stddev_pop(ax) END AS vspread_m FROM rk GROUP BY ALL),
h AS (SELECT p.chunk, p.frame, 1 - p.team AS def_team, {ax('b.x')} AS ball_adv_m FROM poss p JOIN ball b ON b.chunk = p.chunk AND b.frame = p.frame JOIN dirs d ON d.chunk = p.chunk AND d.team = 1 - p.team),
bf AS (SELECT h.chunk, h.frame, def_team, line_m, vspread_m, ball_adv_m, ball_adv_m - line_m AS ball_to_block_m, line_m IS NOT NULL AS usable FROM h LEFT JOIN g ON g.chunk = h.chunk AND g.frame = h.frame AND g.team = def_team)
"""
_BC = ("line_m", "vspread_m", "ball_adv_m", "ball_to_block_m")
add("block_frames", lambda t: M.block_frames(t.ball, t.poss, t.pos, t.dirs).withColumns({c: r6(c) for c in _BC}), _BL + "SELECT chunk, frame, def_team, " + ", ".join(f"R6({c}) AS {c}" for c in _BC) + ", usable FROM bf", "poss", "dirs")
add("block_spells", lambda t: M.block_spells(M.block_frames(t.ball, t.poss, t.pos, t.dirs), least=3).withColumn("median_line_m", r6("median_line_m")), _BL + """
, n AS (SELECT *, CASE WHEN lag(def_team) OVER (PARTITION BY chunk ORDER BY frame) = def_team THEN 0 ELSE 1 END AS new FROM bf), r AS (SELECT *, sum(new) OVER (PARTITION BY chunk ORDER BY frame) AS run FROM n)
SELECT chunk, def_team, min(frame) AS f0, max(frame) AS f1, count(*) AS n_frames, count(line_m) AS n_usable, R6(median(line_m)) AS median_line_m, CASE WHEN median(line_m) < 33 THEN 'low' WHEN median(line_m) >= 50 THEN 'high' ELSE 'mid' END AS block_class FROM r GROUP BY chunk, run, def_team HAVING count(line_m) >= 3""", "poss", "dirs")

_PTS = "SELECT chunk % 25 AS match, CASE WHEN frame % 86400 < 43200 THEN 'h1' ELSE 'h2' END AS half, CAST(frame % 43200 AS DOUBLE) / 8 AS t_s, event_id FROM {s}"
_GOALS = "SELECT chunk % 25 AS match, CASE WHEN frame % 86400 < 43200 THEN 'h1' ELSE 'h2' END AS half, CAST(frame % 43200 AS DOUBLE) / 8 AS t_s, CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END AS ours FROM {s} WHERE event_type IN ('purchase', 'view') AND value > 120"


def _goals(t):
    return t.spark.sql(_GOALS, s=t.stream)


def _points(t):
    return t.spark.sql(_PTS, s=t.stream)


_GS = f"WITH goals AS ({_GOALS.format(s='stream')}), points AS ({_PTS.format(s='stream')}) "
add("score_states", lambda t: M.score_states(_points(t), _goals(t)), _GS + """
, c AS (SELECT *, (SELECT count(*) FROM goals g WHERE g.match = p.match AND g.ours = 1 AND (g.half < p.half OR g.half = p.half AND g.t_s <= p.t_s)) AS gf, (SELECT count(*) FROM goals g WHERE g.match = p.match AND g.ours = 0 AND (g.half < p.half OR g.half = p.half AND g.t_s <= p.t_s)) AS ga FROM points p)
SELECT *, CASE WHEN gf = ga THEN 'level' WHEN gf > ga THEN 'leading' ELSE 'chasing' END AS state, gf || '-' || ga AS scoreline, t_s > 2700 AS stoppage FROM c""", "stream")
add("score_segments", lambda t: M.score_segments(_goals(t), _points(t).groupBy("match", "half").agg(F.max("t_s").alias("t_end"))), _GS + """
, e AS (SELECT match, half, max(t_s) AS t_end FROM points GROUP BY ALL), b AS (SELECT match, half, 0.0::DOUBLE AS t0_s, t_end FROM e UNION ALL SELECT match, half, t_s, t_end FROM goals JOIN e USING (match, half))
SELECT match, half, t0_s, coalesce(lead(t0_s) OVER (PARTITION BY match, half ORDER BY t0_s), t_end) AS t1_s FROM b""", "stream")
add("chunk_offsets", lambda t: M.chunk_offsets(t.ball.groupBy("chunk").agg((F.max("frame") / 25.0).alias("duration_s")).withColumn("half", F.when(F.col("chunk") < 4, "h1").otherwise("h2"))).withColumns({c: r6(c) for c in ("duration_s", "offset_s")}), """
WITH c AS (SELECT chunk, max(frame) / 25.0 AS duration_s, CASE WHEN chunk < 4 THEN 'h1' ELSE 'h2' END AS half FROM ball GROUP BY chunk)
SELECT chunk, R6(duration_s) AS duration_s, half, R6(coalesce(sum(duration_s) OVER (PARTITION BY half ORDER BY chunk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS offset_s FROM c""", "ball")
add("snapshots", lambda t: M.snapshots(_goals(t), _points(t).select("match").distinct()), _GS + """
, m AS (SELECT DISTINCT match FROM points), g AS (SELECT match, unnest(range(0, 91)) AS minute FROM m),
d AS (SELECT g.match, minute, coalesce((SELECT sum(CASE WHEN ours = 1 THEN 1 ELSE -1 END) FROM goals q WHERE q.match = g.match AND floor(q.t_s / 60) < g.minute), 0) AS diff FROM g)
SELECT match, CAST(minute AS INT) AS minute, 'home' AS perspective, CAST(diff AS BIGINT) AS diff FROM d UNION ALL SELECT match, CAST(minute AS INT), 'away', CAST(-diff AS BIGINT) FROM d""", "stream")
add("asof_backward", lambda t: asof(t.stream.where("event_type = 'purchase'").select("chunk", "frame", "event_id"), t.stream.where("event_type = 'click'").groupBy("chunk", "frame").agg(F.max("event_id").alias("click")), ["chunk"], "frame", tolerance=86400, take=["click"]), """
WITH r AS (SELECT chunk, frame, max(event_id) AS click FROM stream WHERE event_type = 'click' GROUP BY ALL), l AS (SELECT chunk, frame, event_id FROM stream WHERE event_type = 'purchase')
SELECT l.chunk, l.frame, l.event_id, r.frame AS r_frame, r.click FROM l LEFT JOIN r ON r.chunk = l.chunk AND r.frame <= l.frame AND l.frame - r.frame <= 86400 QUALIFY row_number() OVER (PARTITION BY l.event_id ORDER BY r.frame DESC NULLS LAST) = 1""", "stream")
add("asof_nearest", lambda t: asof(t.stream.where("event_type = 'purchase'").select("chunk", "frame", "event_id"), t.stream.where("event_type = 'click'").groupBy("chunk", "frame").agg(F.max("event_id").alias("click")), ["chunk"], "frame", direction="nearest", tolerance=7200, take=["click"]), """
WITH r AS (SELECT chunk, frame, max(event_id) AS click FROM stream WHERE event_type = 'click' GROUP BY ALL), l AS (SELECT chunk, frame, event_id FROM stream WHERE event_type = 'purchase')
SELECT l.chunk, l.frame, l.event_id, r.frame AS r_frame, r.click FROM l LEFT JOIN r ON r.chunk = l.chunk AND abs(r.frame - l.frame) <= 7200 QUALIFY row_number() OVER (PARTITION BY l.event_id ORDER BY abs(r.frame - l.frame) NULLS LAST, r.frame) = 1""", "stream")

QUERIES, SQL = BOOK.queries, BOOK.sql
