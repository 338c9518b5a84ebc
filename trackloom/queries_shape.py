"""Queries of shape, possession and transition operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackloom.functions import pitch as P
from trackloom.operators import possession as O
from trackloom.operators import shape as S
from trackloom.plans.book import Book, r6

BOOK = Book()
add = BOOK.add

add("attack_directions", lambda t: t.dirs.withColumn("dir", F.col("dir").cast("int")), "SELECT chunk, team, dir FROM dirs", "dirs")
add("directions_from_ball", lambda t: S.directions_from_ball(t.pos, t.ball, 12.0), """
WITH m AS (SELECT p.chunk, p.team, avg(b.x) AS m FROM poss p JOIN ball b ON p.chunk = b.chunk AND p.frame = b.frame GROUP BY p.chunk, p.team)
SELECT chunk, team, CASE WHEN row_number() OVER (PARTITION BY chunk ORDER BY m DESC, team) = 1 THEN 1 ELSE -1 END AS dir FROM m QUALIFY count(*) OVER (PARTITION BY chunk) = 2""", "poss")
add("complete_directions", lambda t: S.complete_directions(t.dirs.where("team = 0"), t.players), "SELECT chunk, team, CASE WHEN team = 0 THEN dir ELSE -(SELECT dir FROM dirs d WHERE d.chunk = dirs.chunk AND d.team = 0) END AS dir FROM dirs", "dirs")

_SHAPE = """
WITH c AS (SELECT *, avg(pitch_x) OVER w AS mx, avg(pitch_y) OVER w AS my FROM pl WINDOW w AS (PARTITION BY chunk, frame, team)),
j AS (SELECT c.*, CASE WHEN dir > 0 THEN pitch_x ELSE 105 - pitch_x END AS ax FROM c LEFT JOIN dirs ON dirs.chunk = c.chunk AND dirs.team = c.team),
s AS (SELECT chunk, frame, team, count(*) AS n, avg(pitch_x) AS cx, avg(pitch_y) AS cy, max(pitch_y) - min(pitch_y) AS width, max(pitch_x) - min(pitch_x) AS length,
  stddev_pop(pitch_x) AS sd_x, stddev_pop(pitch_y) AS sd_y, avg(sqrt((pitch_x - mx) ** 2 + (pitch_y - my) ** 2)) AS compactness,
  count(*) FILTER (pitch_y >= 0 AND pitch_y < 13.6) / count(*) FILTER (pitch_y BETWEEN 0 AND 68) AS lane0, count(*) FILTER (pitch_y BETWEEN 0 AND 68 AND floor(pitch_y / 13.6) = 1) / count(*) FILTER (pitch_y BETWEEN 0 AND 68) AS lane1,
  count(*) FILTER (pitch_y BETWEEN 0 AND 68 AND floor(pitch_y / 13.6) = 2) / count(*) FILTER (pitch_y BETWEEN 0 AND 68) AS lane2, count(*) FILTER (pitch_y BETWEEN 0 AND 68 AND floor(pitch_y / 13.6) = 3) / count(*) FILTER (pitch_y BETWEEN 0 AND 68) AS lane3,
  count(*) FILTER (pitch_y BETWEEN 0 AND 68 AND floor(pitch_y / 13.6) >= 4) / count(*) FILTER (pitch_y BETWEEN 0 AND 68) AS lane4,
  avg(ax) FILTER (role = 'player') AS advance, quantile_cont(ax, 0.2) FILTER (role = 'player') AS line, avg((ax > 70)::DOUBLE) FILTER (role = 'player') AS high
  FROM j GROUP BY chunk, frame, team HAVING count(*) >= 4)
"""
_COLS = ["cx", "cy", "width", "length", "sd_x", "sd_y", "compactness", "lane0", "lane1", "lane2", "lane3", "lane4", "advance", "line", "high"]
add("frame_shapes", lambda t: S.frame_shapes(t.pos, t.dirs).select("chunk", "frame", "team", "n", *(r6(c).alias(c) for c in _COLS)),
    _SHAPE + "SELECT chunk, frame, team, n, " + ", ".join(f"R6({c}) AS {c}" for c in _COLS) + " FROM s", "pl", "dirs")
add("hull_area", lambda t: S.frame_shapes(t.pos).select("chunk", "frame", "team", r6("area").alias("area")), """
WITH q AS (SELECT DISTINCT chunk, frame, team, CAST(round(pitch_x * 100) AS BIGINT) AS x, CAST(round(pitch_y * 100) AS BIGINT) AS y FROM pl),
ok AS (SELECT chunk, frame, team FROM pl GROUP BY ALL HAVING count(*) >= 4),
e AS (SELECT a.chunk, a.frame, a.team, a.x * b.y - a.y * b.x AS cr FROM q a JOIN q b ON a.chunk = b.chunk AND a.frame = b.frame AND a.team = b.team AND (a.x, a.y) <> (b.x, b.y)
  JOIN q c ON a.chunk = c.chunk AND a.frame = c.frame AND a.team = c.team
  GROUP BY a.chunk, a.frame, a.team, a.x, a.y, b.x, b.y HAVING bool_and((b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) > 0
    OR ((b.x - a.x) * (c.y - a.y) = (b.y - a.y) * (c.x - a.x) AND (c.x - a.x) * (c.x - b.x) + (c.y - a.y) * (c.y - b.y) <= 0)))
SELECT chunk, frame, team, R6(sum(cr) / 20000.0) AS area FROM e JOIN ok USING (chunk, frame, team) GROUP BY chunk, frame, team""", "pl")
add("team_fingerprint", lambda t: S.fingerprint(S.frame_shapes(t.pos, t.dirs).drop("area"), "team").select("team", "frames", r6("players").alias("players"), *(r6(c).alias(c) for c in _COLS)),
    _SHAPE + "SELECT team, count(*) AS frames, R6(avg(n)) AS players, " + ", ".join(f"R6(avg({c})) AS {c}" for c in _COLS) + " FROM s GROUP BY team", "pl", "dirs")
add("chunk_fingerprint", lambda t: S.fingerprint(S.frame_shapes(t.pos, t.dirs).select("chunk", "frame", "team", "n", "width", "length", "advance"), "chunk", "team").select("chunk", "team", "frames", r6("players").alias("players"), *(r6(c).alias(c) for c in ("width", "length", "advance"))),
    _SHAPE + "SELECT chunk, team, count(*) AS frames, R6(avg(n)) AS players, R6(avg(width)) AS width, R6(avg(length)) AS length, R6(avg(advance)) AS advance FROM s GROUP BY chunk, team", "pl", "dirs")
add("style_indices", lambda t: S.style_indices(S.fingerprint(S.frame_shapes(t.pos).select("chunk", "frame", "team", "n", *(f"lane{i}" for i in range(5))), "team")).select("team", *(r6(c).alias(c) for c in ("wing", "half_space", "bias"))),
    _SHAPE + "SELECT team, R6(avg(lane0) + avg(lane4)) AS wing, R6(avg(lane1) + avg(lane3)) AS half_space, R6(avg(lane0) + avg(lane1) - avg(lane3) - avg(lane4)) AS bias FROM s GROUP BY team", "pl", "dirs")
add("passing_connectivity", lambda t: S.near_mate(t.pos).select("team", r6("connectivity").alias("connectivity")), """
WITH p AS (SELECT * FROM pl QUALIFY count(*) OVER (PARTITION BY chunk, frame, team) >= 4),
d AS (SELECT a.chunk, a.frame, a.team, a.track_id, min(sqrt((a.pitch_x - b.pitch_x) ** 2 + (a.pitch_y - b.pitch_y) ** 2)) AS d FROM p a JOIN p b ON a.chunk = b.chunk AND a.frame = b.frame AND a.team = b.team AND a.track_id <> b.track_id GROUP BY ALL),
f AS (SELECT chunk, frame, team, avg(d) AS d FROM d GROUP BY ALL) SELECT team, R6(avg(d)) AS connectivity FROM f GROUP BY team""", "pl")
add("keeper_metrics", lambda t: S.keeper_metrics(t.pos, t.dirs).select("team", r6("gk_advance").alias("gk_advance"), r6("gk_lateral").alias("gk_lateral")),
    "SELECT pl.team, R6(median(CASE WHEN dir > 0 THEN pitch_x ELSE 105 - pitch_x END)) AS gk_advance, R6(stddev_samp(pitch_y)) AS gk_lateral FROM pl JOIN dirs ON pl.chunk = dirs.chunk AND pl.team = dirs.team WHERE role = 'goalkeeper' GROUP BY pl.team", "pl", "dirs")
add("marginal_distance", lambda t: S.marginal_distance(t.pos).select(r6("distance").alias("distance")), """
WITH v AS (SELECT team, 'x' AS axis, pitch_x AS v FROM pl UNION ALL SELECT team, 'y', pitch_y FROM pl), c AS (SELECT axis, v, count(*) FILTER (team = 0) AS n0, count(*) FILTER (team = 1) AS n1 FROM v GROUP BY ALL),
g AS (SELECT abs(sum(n0) OVER w / sum(n0) OVER t - sum(n1) OVER w / sum(n1) OVER t) AS g, lead(v) OVER w - v AS d FROM c WINDOW w AS (PARTITION BY axis ORDER BY v), t AS (PARTITION BY axis))
SELECT R6(sum(g * d)) AS distance FROM g""", "pl")
add("attacking_team", lambda t: S.attacking_team(t.pos.withColumn("is_actor", F.col("track_id") == 5)), """
WITH m AS (SELECT chunk, frame, team, avg(pitch_x) AS m, bool_or(track_id = 5) AS has FROM pl GROUP BY ALL)
SELECT chunk, frame, team FROM m QUALIFY row_number() OVER (PARTITION BY chunk, frame ORDER BY has DESC, m DESC, team) = 1""", "pl")

add("possession", lambda t: t.poss.withColumn("dist_m", r6("dist_m")), "SELECT chunk, frame, carrier, team, R6(dist_m) AS dist_m FROM poss", "poss")
add("possession_debounced", lambda t: O.drop_short_runs(t.poss, 3).select("chunk", "frame", "carrier", "team"), """
WITH a AS (SELECT *, CASE WHEN lag(team) OVER (PARTITION BY chunk ORDER BY frame) = team THEN 0 ELSE 1 END AS new FROM poss), b AS (SELECT *, sum(new) OVER (PARTITION BY chunk ORDER BY frame) AS run FROM a)
SELECT chunk, frame, carrier, team FROM b QUALIFY count(*) OVER (PARTITION BY chunk, run) >= 3""", "poss")
add("possession_smooth", lambda t: O.smooth_possession(t.ball, t.players, radius_m=12.0))
add("passes", lambda t: O.passes(t.poss, t.players).select("chunk", "frame", "f_to", "team", "from_id", "to_id", r6("length_m").alias("length_m")), "SELECT chunk, frame, f_to, team, from_id, to_id, R6(length_m) AS length_m FROM pass", "pass")
add("pass_edges", lambda t: O.pass_edges(O.passes(t.poss, t.players)), "SELECT team, from_id, to_id, count(*) AS weight FROM pass GROUP BY ALL", "pass")
add("pass_nodes", lambda t: O.pass_nodes(O.passes(t.poss, t.players), t.players).select("team", "track_id", "touches", r6("x").alias("x"), r6("y").alias("y")), """
WITH e AS (SELECT team, from_id AS track_id FROM pass UNION ALL SELECT team, to_id FROM pass), n AS (SELECT team, track_id, count(*) AS touches FROM e GROUP BY ALL)
SELECT n.team, n.track_id, touches, R6(avg(pitch_x)) AS x, R6(avg(pitch_y)) AS y FROM n JOIN pl ON pl.team = n.team AND pl.track_id = n.track_id GROUP BY ALL""", "pass")
add("turnovers", lambda t: O.turnovers(t.poss, t.ball), "SELECT * FROM turn", "turn")
add("possession_spells", lambda t: O.spells(t.poss, max_gap=50), """
WITH a AS (SELECT *, CASE WHEN lag(team) OVER w = team AND frame - lag(frame) OVER w <= 50 THEN 0 ELSE 1 END AS new FROM poss WINDOW w AS (PARTITION BY chunk ORDER BY frame)),
b AS (SELECT *, sum(new) OVER (PARTITION BY chunk ORDER BY frame) AS run FROM a) SELECT chunk, team, min(frame) AS f0, max(frame) AS f1, count(*) AS samples FROM b GROUP BY chunk, run, team""", "poss")
_TRANS = """
WITH s AS (SELECT t.chunk, t.frame AS f0, t.lost_team, t.won_team, t.x AS tx, t.y AS ty, b.frame, b.x, b.y FROM turn t LEFT JOIN ball b ON b.chunk = t.chunk AND b.frame > t.frame AND b.frame <= t.frame + 125),
pr AS (SELECT s.chunk, f0, min(s.frame) AS pressed FROM s JOIN pl ON pl.chunk = s.chunk AND pl.frame = s.frame AND pl.team = lost_team AND sqrt((pitch_x - x) ** 2 + (pitch_y - y) ** 2) <= 5 GROUP BY ALL),
la AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY chunk, f0 ORDER BY frame DESC NULLS LAST) = 1),
tt AS (SELECT la.chunk, la.f0 AS frame, lost_team, won_team, pressed - la.f0 AS recovery,
  exp(-sqrt((105 - CASE WHEN dir > 0 THEN x ELSE 105 - x END) ** 2 + (34 - y) ** 2) / 18) - exp(-sqrt((105 - CASE WHEN dir > 0 THEN tx ELSE 105 - tx END) ** 2 + (34 - ty) ** 2) / 18) AS gain,
  CASE WHEN dir > 0 THEN tx ELSE 105 - tx END > 70 AS high
  FROM la LEFT JOIN pr ON pr.chunk = la.chunk AND pr.f0 = la.f0 LEFT JOIN dirs ON dirs.chunk = la.chunk AND dirs.team = won_team)
"""


def _table(t):
    return O.transition_table(O.turnovers(t.poss, t.ball), t.ball, t.players, t.dirs)


add("transition_table", lambda t: _table(t).withColumn("gain", r6("gain")), _TRANS + "SELECT chunk, frame, lost_team, won_team, recovery, R6(gain) AS gain, high FROM tt", "turn", "dirs")
add("transition_metrics", lambda t: O.transition_metrics(_table(t)).select("team", "won", "lost", *(r6(c).alias(c) for c in ("counterpress_rate", "mean_recovery", "counter_threat")), "high_regains"), _TRANS + """
, w AS (SELECT won_team AS team, count(*) AS won, avg(gain) AS counter_threat, count(*) FILTER (high) AS high_regains FROM tt GROUP BY ALL),
l AS (SELECT lost_team AS team, count(*) AS lost, count(recovery) / count(*) AS counterpress_rate, avg(recovery) AS mean_recovery FROM tt GROUP BY ALL)
SELECT team, won, lost, R6(counterpress_rate) AS counterpress_rate, R6(mean_recovery) AS mean_recovery, R6(counter_threat) AS counter_threat, high_regains FROM w JOIN l USING (team)""", "turn", "dirs")
add("regain_curve", lambda t: O.regain_curve(O.turnovers(t.poss, t.ball), t.poss).select("team", "losses", *(r6(f"regain_{w}s").alias(f"regain_{w}s") for w in (3, 4, 5, 6, 8))), """
WITH b AS (SELECT t.chunk, t.frame, t.lost_team, min(p.frame) AS back FROM turn t LEFT JOIN poss p ON p.chunk = t.chunk AND p.team = t.lost_team AND p.frame > t.frame AND p.frame <= t.frame + 200 GROUP BY ALL)
SELECT lost_team AS team, count(*) AS losses, """ + ", ".join(f"R6(avg(CASE WHEN back - frame <= {w * 25} THEN 1.0::DOUBLE ELSE 0 END)) AS regain_{w}s" for w in (3, 4, 5, 6, 8)) + " FROM b GROUP BY lost_team", "turn")
add("ppda", lambda t: O.ppda(t.poss, O.passes(t.poss, t.players), t.players, t.dirs).withColumn("ppda", r6("ppda")), """
WITH a AS (SELECT 1 - p.team AS team, count(*) AS passes_allowed FROM pass p JOIN dirs d ON d.chunk = p.chunk AND d.team = p.team WHERE CASE WHEN dir > 0 THEN x0 ELSE 105 - x0 END <= 63 GROUP BY ALL),
c AS (SELECT o.chunk, o.frame, o.team, l.pitch_x AS cx, l.pitch_y AS cy FROM poss o JOIN pl l ON l.chunk = o.chunk AND l.frame = o.frame AND l.track_id = o.carrier JOIN dirs d ON d.chunk = o.chunk AND d.team = o.team WHERE CASE WHEN dir > 0 THEN l.pitch_x ELSE 105 - l.pitch_x END <= 63),
r AS (SELECT 1 - c.team AS team, count(*) AS pressures FROM c WHERE EXISTS (SELECT 1 FROM pl WHERE pl.chunk = c.chunk AND pl.frame = c.frame AND pl.team <> c.team AND sqrt((pitch_x - cx) ** 2 + (pitch_y - cy) ** 2) <= 3) GROUP BY ALL)
SELECT team, coalesce(passes_allowed, 0) AS passes_allowed, coalesce(pressures, 0) AS pressures, R6(passes_allowed / pressures) AS ppda FROM a FULL JOIN r USING (team)""", "pass", "dirs")
add("carrier_filled", lambda t: O.carrier_filled(t.poss, t.ball), "SELECT b.chunk, b.frame, last_value(p.team IGNORE NULLS) OVER (PARTITION BY b.chunk ORDER BY b.frame) AS team FROM ball b LEFT JOIN poss p ON p.chunk = b.chunk AND p.frame = b.frame", "poss")
add("final_third_share", lambda t: t.players.join(t.dirs, ["chunk", "team"]).groupBy("team").agg(r6(F.avg((P.third(P.advance("pitch_x", "dir")) == 2).cast("double"))).alias("share")),
    "SELECT pl.team, R6(avg(CASE WHEN CASE WHEN dir > 0 THEN pitch_x ELSE 105 - pitch_x END >= 70 THEN 1.0::DOUBLE ELSE 0 END)) AS share FROM pl JOIN dirs ON pl.chunk = dirs.chunk AND pl.team = dirs.team GROUP BY pl.team", "pl", "dirs")

QUERIES, SQL = BOOK.queries, BOOK.sql
