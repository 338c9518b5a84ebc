"""Queries of claims, map distances, reconstructed lines and pressing after losses."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackloom.operators import metrics as M
from trackloom.operators import possession as O
from trackloom.operators import profiles as R
from trackloom.operators import reports as Q
from trackloom.operators import shape as S
from trackloom.operators import tracks as T
from trackloom.plans.book import Book, r6
from trackloom.plans.joins import against

BOOK = Book()
add = BOOK.add


def _claims(t):
    p = t.read("part")
    return p.select(F.col("p_partkey").alias("id"), F.array(F.col("p_type"), F.col("p_brand")).alias("tags"), F.when(F.col("p_partkey") % 4 < 3, "confirmed").otherwise("open").alias("status"), F.lit("m").alias("unit"), (F.col("p_size") * 1.0).alias("value"), F.array((F.col("p_partkey") + 1)).alias("links"), F.col("p_name").alias("statement"), F.array(F.concat(F.lit("f"), (F.col("p_partkey") % 50).cast("string"), F.lit("#x"))).alias("evidence"))


_CL = "WITH c AS (SELECT p_partkey AS id, p_type AS t1, p_brand AS t2, p_partkey % 4 < 3 AS ok, p_size * 1.0::DOUBLE AS v, p_name AS s, list_distinct(list_filter(regexp_split_to_array(lower(p_name), '[\\s.,():\\-]+'), lambda w: length(w) > 3)) AS w FROM part)"
add("claims_with_tag", lambda t: Q.claims_with(_claims(t), "ECONOMY", "confirmed").select("id"), _CL + " SELECT id FROM c WHERE ok AND (t1 = 'ECONOMY' OR t2 = 'ECONOMY')")
add("dead_evidence", lambda t: Q.dead_evidence(_claims(t), t.spark.range(40).select(F.concat(F.lit("f"), F.col("id").cast("string")).alias("path"))), _CL + " SELECT id, 'f' || (id % 50) AS path FROM c WHERE id % 50 >= 40")
add("contradictions", lambda t: Q.contradictions(_claims(t).withColumn("tags", F.array(F.concat_ws("/", F.element_at("tags", 1), F.element_at("tags", 2), (F.col("id") % 7).cast("string")))), ratio=0.9, overlap=0.6), _CL + """
, j AS (SELECT a.id AS a, b.id AS b, abs(a.v - b.v) > 0.9 * greatest(abs(a.v), abs(b.v)) AS n, len(list_intersect(a.w, b.w)) / nullif(len(list_distinct(list_concat(a.w, b.w))), 0) AS jac FROM c a JOIN c b ON a.ok AND b.ok AND a.id < b.id AND a.t1 = b.t1 AND a.t2 = b.t2 AND a.id % 7 = b.id % 7 AND b.id <> a.id + 1)
SELECT a, b, CASE WHEN n THEN 'number' ELSE 'statement' END AS reason FROM j WHERE n OR jac > 0.6""")
add("all_contradictions", lambda t: Q.contradictions(_claims(t), ratio=0.9, overlap=0.6), _CL + """
, j AS (SELECT a.id AS a, b.id AS b, abs(a.v - b.v) > 0.9 * greatest(abs(a.v), abs(b.v)) AS n, len(list_intersect(a.w, b.w)) / nullif(len(list_distinct(list_concat(a.w, b.w))), 0) AS jac FROM c a JOIN c b ON a.ok AND b.ok AND a.id < b.id AND (a.t1 = b.t1 OR a.t2 = b.t2) AND b.id <> a.id + 1)
SELECT a, b, CASE WHEN n THEN 'number' ELSE 'statement' END AS reason FROM j WHERE n OR jac > 0.6""")
add("marked_numbers", lambda t: t.read("documents").select("doc_id", Q.marked(F.col("text"), [("pct", 12.5), ("m", 7.7), ("count", 40.0)]).alias("text")))
add("map_distance", lambda t: Q.map_distance(*(t.players.where(f"team = {k}").groupBy(F.floor(F.col("pitch_x") / 15).alias("cell")).agg(F.count("*").alias("n")) for k in (0, 1)), ["cell"], "n").withColumn("distance", r6("distance")), """
WITH g AS (SELECT team, floor(pitch_x / 15) AS cell, count(*) AS n FROM pl GROUP BY ALL) SELECT R6(avg(abs(a.n - b.n))) AS distance FROM g a JOIN g b ON a.cell = b.cell AND a.team = 0 AND b.team = 1""", "pl")


def _dist(t):
    """Chunk sides by the difference of their mean shapes; there are two to a chunk."""
    f = R.tendencies(S.frame_shapes(t.pos).select("chunk", "frame", "team", "width", "length"), ["width", "length"]).select((F.col("chunk") * 2 + F.col("team")).alias("id"), F.col("team").alias("label"), "width", "length")
    a, b = (f.select(F.col("id").alias(s), F.col("width").alias(f"w{s}"), F.col("length").alias(f"l{s}")) for s in ("a", "b"))
    return against(b, a, F.col("a") != F.col("b")).select("a", "b", F.round(F.abs(F.col("wa") - F.col("wb")) + F.abs(F.col("la") - F.col("lb")), 9).alias("d")), f.select("id", "label")


add("nearest_label_accuracy", lambda t: Q.nearest_label_accuracy(*_dist(t)).withColumn("accuracy", r6("accuracy")), """
WITH s AS (SELECT chunk, frame, team, max(pitch_y) - min(pitch_y) AS width, max(pitch_x) - min(pitch_x) AS length FROM pl GROUP BY ALL HAVING count(*) >= 4), v AS (SELECT chunk * 2 + team AS id, team AS label, avg(width) AS w, avg(length) AS l FROM s GROUP BY ALL HAVING count(*) >= 20),
d AS (SELECT a.label AS la, b.label AS lb, row_number() OVER (PARTITION BY a.id ORDER BY round(abs(a.w - b.w) + abs(a.l - b.l), 9), b.id) AS k FROM v a JOIN v b ON a.id <> b.id) SELECT count(*) AS n, R6(avg((la = lb)::INT)) AS accuracy FROM d WHERE k = 1""", "pl")
add("press_after_loss", lambda t: Q.press_after_loss(O.turnovers(t.poss, t.ball), t.ball, t.players, t.poss, t.dirs, window=60), """
WITH l AS (SELECT t.* FROM turn t JOIN dirs d ON d.chunk = t.chunk AND d.team = t.lost_team WHERE CASE WHEN dir > 0 THEN t.x ELSE 105 - t.x END >= 35)
SELECT chunk, frame, lost_team, EXISTS (SELECT 1 FROM ball b JOIN pl p ON p.chunk = b.chunk AND p.frame = b.frame WHERE b.chunk = l.chunk AND b.frame > l.frame AND b.frame <= l.frame + 60 AND p.team = l.lost_team AND sqrt((p.pitch_x - b.x) ** 2 + (p.pitch_y - b.y) ** 2) <= 4.57) AS pressed,
  EXISTS (SELECT 1 FROM poss p WHERE p.chunk = l.chunk AND p.team = l.lost_team AND p.frame > l.frame AND p.frame <= l.frame + 60) AS regained FROM l""", "turn", "dirs")
add("press_rates", lambda t: Q.press_after_loss(O.turnovers(t.poss, t.ball), t.ball, t.players, t.poss, t.dirs, window=60).groupBy(F.col("lost_team").alias("team")).agg(F.count("*").alias("losses"), r6(F.avg(F.col("pressed").cast("double"))).alias("pressed"), r6(F.avg(F.col("regained").cast("double"))).alias("regained")), """
WITH l AS (SELECT t.* FROM turn t JOIN dirs d ON d.chunk = t.chunk AND d.team = t.lost_team WHERE CASE WHEN dir > 0 THEN t.x ELSE 105 - t.x END >= 35),
e AS (SELECT lost_team, EXISTS (SELECT 1 FROM ball b JOIN pl p ON p.chunk = b.chunk AND p.frame = b.frame WHERE b.chunk = l.chunk AND b.frame > l.frame AND b.frame <= l.frame + 60 AND p.team = l.lost_team AND sqrt((p.pitch_x - b.x) ** 2 + (p.pitch_y - b.y) ** 2) <= 4.57) AS p,
  EXISTS (SELECT 1 FROM poss p WHERE p.chunk = l.chunk AND p.team = l.lost_team AND p.frame > l.frame AND p.frame <= l.frame + 60) AS r FROM l)
SELECT lost_team AS team, count(*) AS losses, R6(avg(p::INT)) AS pressed, R6(avg(r::INT)) AS regained FROM e GROUP BY lost_team""", "turn", "dirs")


def _slots(t):
    return t.pos.select("chunk", "track_id", (F.col("track_id") % 9).alias("slot")).distinct()


_RC = "WITH rc AS (SELECT chunk, team, track_id % 9 AS slot, avg(pitch_x) AS cx, avg(pitch_y) AS cy FROM pl GROUP BY ALL)"
add("role_centres", lambda t: Q.role_centres(t.players, _slots(t)).withColumns({c: r6(c) for c in ("cx", "cy")}), _RC + " SELECT chunk, team, slot, R6(cx) AS cx, R6(cy) AS cy FROM rc", "pl")
add("relabelled_roles", lambda t: Q.relabelled(t.players, Q.role_centres(t.players, _slots(t))), _RC + """
, m AS (SELECT chunk, team, track_id, avg(pitch_x) AS mx, avg(pitch_y) AS my FROM pl GROUP BY ALL)
SELECT m.chunk, track_id, slot FROM m JOIN rc ON rc.chunk = m.chunk AND rc.team = m.team QUALIFY row_number() OVER (PARTITION BY m.chunk, track_id ORDER BY sqrt((cx - mx) ** 2 + (cy - my) ** 2), slot) = 1""", "pl")
add("reconstructed_line", lambda t: Q.reconstructed_line(t.pos, t.dirs, t.pos.where("role = 'player'").select("chunk", "track_id").distinct()).withColumn("line", r6("line")), """
WITH t AS (SELECT pl.chunk, pl.frame, track_id, pl.team, CASE WHEN dir > 0 THEN pitch_x ELSE 105 - pitch_x END AS ax FROM pl JOIN dirs d ON d.chunk = pl.chunk AND d.team = pl.team WHERE role = 'player'), k AS (SELECT DISTINCT chunk, track_id, team FROM t),
g AS (SELECT f.chunk, f.frame, k.track_id, k.team, t.ax FROM (SELECT DISTINCT chunk, frame FROM pos) f JOIN k ON k.chunk = f.chunk LEFT JOIN t ON t.chunk = f.chunk AND t.frame = f.frame AND t.track_id = k.track_id),
b AS (SELECT *, last_value(CASE WHEN ax IS NOT NULL THEN frame END IGNORE NULLS) OVER p AS f0, last_value(ax IGNORE NULLS) OVER p AS a0, first_value(CASE WHEN ax IS NOT NULL THEN frame END IGNORE NULLS) OVER n AS f1, first_value(ax IGNORE NULLS) OVER n AS a1 FROM g
  WINDOW p AS (PARTITION BY chunk, track_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), n AS (PARTITION BY chunk, track_id ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT chunk, frame, team, R6(quantile_cont(coalesce(ax, a0 + (a1 - a0) * ((frame - f0) / nullif(f1 - f0, 0)), a0, a1), 0.2)) AS line FROM b GROUP BY ALL""", "pl", "dirs")
add("counts_after_loss", lambda t: Q.offsets_counts(O.turnovers(t.poss, t.ball), t.players.groupBy("chunk", "frame").agg(F.count("*").alias("n"))), """
WITH c AS (SELECT chunk, frame, count(*) AS n FROM pl GROUP BY ALL), a AS (SELECT chunk, frame AS f0, s AS second, frame + s * 25 AS at FROM turn, (SELECT unnest([0, 1, 2]) AS s))
SELECT a.chunk, a.f0 AS frame, second, n FROM a LEFT JOIN c ON c.chunk = a.chunk AND abs(c.frame - a.at) <= 12 QUALIFY row_number() OVER (PARTITION BY a.chunk, a.f0, second ORDER BY abs(c.frame - a.at) NULLS LAST, c.frame) = 1""", "turn")
add("association_accuracy", lambda t: (lambda p: Q.association_accuracy(p, p.groupBy("gt").agg(F.sum("n").alias("n")), p.groupBy("pred").agg(F.sum("n").alias("n"))))(t.poss.groupBy(F.col("carrier").alias("gt"), (F.col("carrier") % 5 + F.col("chunk")).alias("pred")).agg(F.count("*").alias("n"))).withColumn("assa", r6("assa")), """
WITH p AS (SELECT carrier AS gt, carrier % 5 + chunk AS pred, count(*) AS n FROM poss GROUP BY ALL), j AS (SELECT n, sum(n) OVER (PARTITION BY gt) AS a, sum(n) OVER (PARTITION BY pred) AS b FROM p) SELECT R6(sum(n * n / (a + b - n)) / sum(n)) AS assa FROM j""", "poss")
add("window_counts", lambda t: Q.frame_windows(t.pos, 100).groupBy("chunk", "window").agg(F.count("*").alias("n")), "SELECT chunk, CAST(floor(frame / 100.0) AS BIGINT) AS window, count(*) AS n FROM pos GROUP BY ALL", "pos")
add("facets", lambda t: Q.facets({"link": S.near_mate(t.pos).select("team", r6("connectivity").alias("mate")), "sync": T.synchrony(T.build_tracks(t.pos)).select("team", r6("synchrony").alias("s")), "lanes": M.lane_occupation(t.players, t.dirs).select("team", r6("wing_share").alias("wing"))}))
add("spell_counts", lambda t: Q.spell_counts(t.poss), "WITH a AS (SELECT team, CASE WHEN lag(team) OVER (PARTITION BY chunk ORDER BY frame) = team THEN 0 ELSE 1 END AS n FROM poss) SELECT team, CAST(sum(n) AS BIGINT) AS spells FROM a GROUP BY team", "poss")

QUERIES, SQL = BOOK.queries, BOOK.sql
