"""Queries of association, identity and vote operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackloom.functions import vectors as V
from trackloom.operators import association as A
from trackloom.operators.intervals import merge_intervals
from trackloom.plans.book import Book, r6
from trackloom.plans.joins import against

BOOK = Book()
add = BOOK.add


def _frags(t):
    f = t.read("fragments").where("start_frame IS NOT NULL AND end_frame >= start_frame AND role IS NOT NULL")
    at = lambda c, i: F.expr(f"try_element_at({c}, {i})")
    f = f.select(F.concat("match_id", F.lit("/"), "chunk").alias("seq"), "track_id", "start_frame", "end_frame", "role", "team", at("start_xy", 1).alias("sx"), at("start_xy", 2).alias("sy"), at("end_xy", 1).alias("ex"), at("end_xy", 2).alias("ey"))
    return f.where(" AND ".join(f"{c} IS NOT NULL AND NOT isnan({c}) AND abs({c}) < 1000" for c in ("sx", "sy", "ex", "ey"))).distinct()


_FR = """WITH fr AS (SELECT DISTINCT match_id || '/' || chunk AS seq, track_id, start_frame, end_frame, role, team, start_xy[1] AS sx, start_xy[2] AS sy, end_xy[1] AS ex, end_xy[2] AS ey FROM fragments
  WHERE start_frame IS NOT NULL AND end_frame >= start_frame AND role IS NOT NULL AND isfinite(start_xy[1]) AND isfinite(start_xy[2]) AND isfinite(end_xy[1]) AND isfinite(end_xy[2]) AND abs(start_xy[1]) < 1000 AND abs(start_xy[2]) < 1000 AND abs(end_xy[1]) < 1000 AND abs(end_xy[2]) < 1000),
mp AS (SELECT a.seq, a.track_id AS a, b.track_id AS b, b.start_frame - a.end_frame AS gap FROM fr a JOIN fr b ON a.seq = b.seq AND a.role = b.role AND a.team = b.team AND a.track_id <> b.track_id AND b.start_frame > a.end_frame AND b.start_frame <= a.end_frame + 100
  WHERE sqrt((a.ex - b.sx) ** 2 + (a.ey - b.sy) ** 2) <= 9 * (b.start_frame - a.end_frame) / 25 + 2)
"""
add("fragments", lambda t: A.fragments(t.pos).withColumns({c: r6(c) for c in ("sx", "sy", "ex", "ey")}), """
WITH p AS (SELECT * FROM pos WHERE role <> 'ball' AND pitch_x IS NOT NULL AND pitch_y IS NOT NULL),
g AS (SELECT chunk, track_id, min(frame) AS start_frame, max(frame) AS end_frame, arg_min(pitch_x, frame) AS sx, arg_min(pitch_y, frame) AS sy, arg_max(pitch_x, frame) AS ex, arg_max(pitch_y, frame) AS ey, count(*) AS n FROM p GROUP BY ALL),
r AS (SELECT chunk, track_id, role FROM (SELECT chunk, track_id, role, count(*) AS k FROM p GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY chunk, track_id ORDER BY k DESC, role) = 1),
m AS (SELECT chunk, track_id, team FROM (SELECT chunk, track_id, team, count(*) AS k FROM p GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY chunk, track_id ORDER BY k DESC, team) = 1)
SELECT g.chunk, g.track_id, start_frame, end_frame, R6(sx) AS sx, R6(sy) AS sy, R6(ex) AS ex, R6(ey) AS ey, role, team, n FROM g JOIN r USING (chunk, track_id) JOIN m USING (chunk, track_id)""", "pos")
add("mergeable_fragments", lambda t: A.mergeable(_frags(t)), _FR + "SELECT * FROM mp")


def _vecs(t):
    return t.read("embeddings").select(F.col("vec_id").alias("track_id"), F.col("embedding").cast("array<double>").alias("vec"), "label")


def _sims(t):
    n = t.read("embeddings").count()
    p = A.mergeable(_frags(t)).withColumns({"ka": F.col("a") % n, "kb": F.col("b") % n})
    v = lambda s: _vecs(t).select(F.col("track_id").alias(f"k{s}"), F.col("vec").alias(f"v{s}"))
    return p.join(v("a"), "ka").join(v("b"), "kb").select("seq", "a", "b", V.cosine("va", "vb").alias("cosine"))


add("pair_cosines", lambda t: _sims(t).withColumn("cosine", r6("cosine")), _FR + """
SELECT seq, a, b, R6(list_cosine_similarity(CAST(x.embedding AS DOUBLE[]), CAST(y.embedding AS DOUBLE[]))) AS cosine FROM mp JOIN embeddings x ON x.vec_id = a % (SELECT count(*) FROM embeddings) JOIN embeddings y ON y.vec_id = b % (SELECT count(*) FROM embeddings)""")
add("greedy_merge", lambda t: A.greedy_merge(_frags(t), _sims(t), threshold=0.1))


def _mixed(t):
    """Tracks of fifty vectors each, those of a label together in time and alike."""
    like = F.concat("vec", F.array(*(F.when(F.col("label") == k, 3.0).otherwise(0.0) for k in range(10))))
    return _vecs(t).select(F.floor(F.col("track_id") / 50).cast("long").alias("track_id"), (F.col("label") * 1000 + F.col("track_id")).cast("long").alias("frame"), like.alias("vec"))


add("split_tracks", lambda t: A.split_tracks(_mixed(t)))
add("apply_splits", lambda t: A.apply_splits(t.pos.select("chunk", "track_id", "frame"), t.spark.sql("SELECT id AS track_id, p AS part, CASE p WHEN 0 THEN -1000000 ELSE 700 * p + 1 END AS lo, CASE p WHEN 2 THEN 1000000 ELSE 700 * (p + 1) END AS hi FROM range(1, 9), LATERAL explode(array(0L, 1L, 2L)) AS e(p)")), """
SELECT chunk, track_id, frame, CAST(CASE WHEN track_id > 8 THEN 0 WHEN frame <= 700 THEN 0 WHEN frame <= 1400 THEN 1 ELSE 2 END AS BIGINT) AS part FROM pos""", "pos")
_GT = """WITH gt AS (SELECT chunk, frame, track_id % 5 AS gt, pitch_x, pitch_y FROM pl WHERE team = 1), d AS (SELECT p.chunk, p.frame, p.track_id, g.gt, sqrt((p.pitch_x - g.pitch_x) ** 2 + (p.pitch_y - g.pitch_y) ** 2) AS d FROM pl p JOIN gt g ON g.chunk = p.chunk AND g.frame = p.frame),
near AS (SELECT chunk, frame, track_id, gt FROM d WHERE d <= 15 QUALIFY row_number() OVER (PARTITION BY chunk, frame, track_id ORDER BY d, gt) = 1)
"""


def _near(t):
    return A.nearest_truth(t.players.select("chunk", "frame", "track_id", "pitch_x", "pitch_y"), t.players.where("team = 1").select("chunk", "frame", (F.col("track_id") % 5).alias("gt"), "pitch_x", "pitch_y"), tol=15.0)


add("nearest_truth", _near, _GT + "SELECT * FROM near", "pl")
add("fragment_truth", lambda t: A.modal(_near(t), ["chunk", "track_id"], "gt"), _GT + "SELECT chunk, track_id, gt FROM (SELECT chunk, track_id, gt, count(*) AS n FROM near GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY chunk, track_id ORDER BY n DESC, gt) = 1", "pl")
add("tracklet_purity", lambda t: A.purity(_near(t)).withColumn("purity", r6("purity")), _GT + """
, c AS (SELECT chunk, track_id, gt, count(*) AS n FROM near GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY chunk, track_id ORDER BY n DESC, gt) AS k, sum(n) OVER (PARTITION BY chunk, track_id) AS total FROM c),
t AS (SELECT chunk, track_id, max(total) AS total, max(n) FILTER (k = 1) AS a, coalesce(max(n) FILTER (k = 2), 0) AS b FROM r GROUP BY ALL HAVING max(total) >= 5)
SELECT count(*) AS tracklets, R6(sum(a) / sum(total)) AS purity, count(*) FILTER (b >= 10 AND b >= 0.2 * total) AS contaminated FROM t""", "pl")
add("merge_precision", lambda t: A.merge_precision(_near(t).select((F.col("track_id") % 7).alias("grp"), "gt")).withColumn("precision", r6("precision")), _GT + """
, g AS (SELECT track_id % 7 AS grp, gt, count(*) AS n FROM near GROUP BY ALL), t AS (SELECT grp, sum(n) AS n, sum(n * (n - 1) / 2) AS good FROM g GROUP BY grp)
SELECT CAST(sum(n * (n - 1) / 2) AS BIGINT) AS pairs, CAST(sum(good) AS BIGINT) AS correct, R6(sum(good) / sum(n * (n - 1) / 2)) AS precision FROM t""", "pl")
add("fragments_per_truth", lambda t: _near(t).groupBy("chunk", "gt").agg(F.count_distinct("track_id").alias("k")).groupBy("chunk").agg(r6(F.avg("k")).alias("fragments")), _GT + "SELECT chunk, R6(avg(k)) AS fragments FROM (SELECT chunk, gt, count(DISTINCT track_id) AS k FROM near GROUP BY ALL) GROUP BY chunk", "pl")
add("digit_confusion", lambda t: A.digit_confusion(t.read("lineitem").select(F.col("l_suppkey").cast("string").alias("truth"), (F.col("l_suppkey") + F.expr("CASE WHEN l_linenumber % 3 = 0 THEN 1 ELSE 0 END")).cast("string").alias("reading"))).withColumn("p", r6("p")), """
WITH s AS (SELECT CAST(l_suppkey AS VARCHAR) AS t, CAST(l_suppkey + CASE WHEN l_linenumber % 3 = 0 THEN 1 ELSE 0 END AS VARCHAR) AS r FROM lineitem), z AS (SELECT t, r, unnest(range(1, length(t) + 1)) AS i FROM s WHERE length(t) = length(r)),
c AS (SELECT t[i] AS a, r[i] AS b, count(*) AS n FROM z GROUP BY ALL), g AS (SELECT CAST(a AS VARCHAR) AS a, CAST(b AS VARCHAR) AS b FROM range(10) x(a), range(10) y(b)), j AS (SELECT g.a, g.b, coalesce(n, 0) + 1.0::DOUBLE AS n FROM g LEFT JOIN c ON c.a = g.a AND c.b = g.b)
SELECT a AS true_digit, b AS read_digit, R6(n / sum(n) OVER (PARTITION BY a)) AS p FROM j""")
_GAL = """WITH s AS (SELECT q.vec_id AS query, g.label AS identity, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(g.embedding AS DOUBLE[])) AS c FROM embeddings q JOIN embeddings g ON q.vec_id <> g.vec_id WHERE q.vec_id % 100 = 0),
gal AS (SELECT query, identity, avg(c) AS similarity FROM (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query, identity ORDER BY c DESC) <= 5) GROUP BY ALL)
"""


def _gallery(t):
    q = _vecs(t).where("track_id % 100 = 0").select(F.col("track_id").alias("query"), F.col("vec").alias("qv"))
    s = against(q, _vecs(t), F.col("track_id") != F.col("query")).select("query", F.col("label").alias("identity"), V.cosine("qv", "vec").alias("c"))
    top = s.groupBy("query", "identity").agg(F.slice(F.sort_array(F.collect_list("c"), asc=False), 1, 5).alias("t"))
    return top.select("query", "identity", (V.total("t") / F.size("t")).alias("similarity"))


add("gallery_similarity", lambda t: _gallery(t).withColumn("similarity", r6("similarity")), _GAL + "SELECT query, identity, R6(similarity) AS similarity FROM gal")
add("choose_identity", lambda t: A.choose(_gallery(t), margin=0.02, least=0.1), _GAL + """
, r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, identity) AS k FROM gal)
SELECT a.query, a.identity FROM r a JOIN r b ON a.query = b.query AND a.k = 1 AND b.k = 2 WHERE a.similarity >= 0.1 AND a.similarity - b.similarity >= 0.02""")
add("identity_posterior", lambda t: A.posterior(_gallery(t)).withColumn("p", r6("p")), _GAL + "SELECT query, identity, R6(exp(10 * similarity) / sum(exp(10 * similarity)) OVER (PARTITION BY query)) AS p FROM gal")
add("exclusion_groups", lambda t: A.exclusion_groups(t.pos.where("role <> 'player'").select("chunk", "frame", "track_id")).withColumn("members", F.array_join(F.col("members").cast("array<string>"), ",")), """
WITH s AS (SELECT DISTINCT chunk, m FROM (SELECT chunk, frame, list_sort(list(DISTINCT track_id)) AS m FROM pos WHERE role <> 'player' GROUP BY ALL))
SELECT chunk, array_to_string(m, ',') AS members FROM s WHERE NOT EXISTS (SELECT 1 FROM s o WHERE o.chunk = s.chunk AND len(o.m) > len(s.m) AND list_has_all(o.m, s.m))""", "pos")
add("assign_roster", lambda t: A.assign(t.players.groupBy("chunk", F.col("track_id").alias("a")).agg(F.avg("pitch_x").alias("m")).select("chunk", "a", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(30).cast("long"))).alias("b"), "m").select("chunk", "a", "b", F.abs(F.col("m") - (45 + F.col("b"))).alias("cost")), ["chunk"]))
add("resolve_names", lambda t: A.resolve_names(t.read("queue_items").where("length(trim(gt_number)) > 0").select("seq", "track_id", F.expr("try_cast(trim(gt_number) AS int)").alias("name"))), """
SELECT seq, track_id, min(CAST(trim(gt_number) AS INT)) AS name, count(*) AS n FROM queue_items WHERE length(trim(gt_number)) > 0 GROUP BY ALL HAVING count(DISTINCT CAST(trim(gt_number) AS INT)) = 1""")
add("propagate_numbers", lambda t: A.propagate(t.read("queue_items").select(F.concat("seq", F.lit("#"), (F.col("track_id") % 40).cast("string")).alias("grp"), "track_id", F.expr("try_cast(trim(gt_number) AS int)").alias("number")).distinct()), """
WITH v AS (SELECT DISTINCT seq || '#' || (track_id % 40) AS grp, track_id, TRY_CAST(trim(gt_number) AS INT) AS number FROM queue_items), g AS (SELECT grp, min(number) AS number FROM v WHERE number IS NOT NULL GROUP BY grp HAVING count(DISTINCT number) = 1)
SELECT v.grp, v.track_id, g.number FROM v JOIN g USING (grp) WHERE v.number IS NULL""")
add("vote_means", lambda t: A.element_means(_vecs(t), ["label"], "vec").select("label", F.posexplode("mean").alias("i", "m")).select("label", "i", r6("m").alias("m")), """
WITH e AS (SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings) SELECT label, CAST(i AS INT) AS i, R6(avg(v)) AS m FROM e GROUP BY ALL""")
add("vote_decisions", lambda t: A.element_means(_vecs(t), ["label"], "vec").select("label", A.decide(F.col("mean"), least=0.03).alias("choice")), """
WITH e AS (SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings), m AS (SELECT label, i, avg(v) AS m FROM e GROUP BY ALL), b AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY label ORDER BY m DESC, i) = 1)
SELECT label, CASE WHEN i = (SELECT max(i) FROM m) OR b.m < 0.03 THEN -1 ELSE i END AS choice FROM b""")
add("dirichlet_fusion", lambda t: _vecs(t).withColumn("alpha", V.softplus("vec")).withColumn("u", V.uncertainty("alpha")).groupBy("label").agg(F.count("*").alias("n"), r6(F.avg("u")).alias("u"), r6(F.sum(V.total("alpha"))).alias("mass")), """
WITH e AS (SELECT vec_id, label, unnest(CAST(embedding AS DOUBLE[])) AS v FROM embeddings), a AS (SELECT vec_id, label, sum(ln(1 + exp(v)) + 1) AS s, count(*) AS k FROM e GROUP BY ALL)
SELECT label, count(*) AS n, R6(avg(k / s)) AS u, R6(sum(s)) AS mass FROM a GROUP BY label""")
add("covered_length", lambda t: merge_intervals(t.read("reappearances"), ["match_id", "chunk"], "t0", "t1").where("kind = 'span'").groupBy("match_id", "chunk").agg(F.sum(F.col("f1") - F.col("f0") + 1).alias("covered")), """
WITH i AS (SELECT DISTINCT match_id, chunk, t0 AS s, t1 AS e FROM reappearances WHERE t0 <= t1), m AS (SELECT *, max(e) OVER (PARTITION BY match_id, chunk ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM i),
g AS (SELECT *, sum(CASE WHEN far IS NULL OR s > far + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY match_id, chunk ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM m), p AS (SELECT match_id, chunk, k, max(e) - min(s) + 1 AS n FROM g GROUP BY ALL)
SELECT match_id, chunk, CAST(sum(n) AS BIGINT) AS covered FROM p GROUP BY ALL""")


def _boxes(t, shift):
    p = t.pos.where(f"team = {shift}").select("chunk", "frame", F.col("track_id").alias("i"), (F.col("image_x") - 60).alias("x0"), (F.col("image_y") - 120).alias("y0"), (F.col("image_x") + 60).alias("x1"), (F.col("image_y") + 120).alias("y1"))
    return p


add("iou_pairs", lambda t: A.iou_pairs(_boxes(t, 0), _boxes(t, 1), grow=0.5).withColumn("iou", r6("iou")), """
WITH b AS (SELECT chunk, frame, team, track_id AS i, image_x - 90 AS x0, image_y - 180 AS y0, image_x + 90 AS x1, image_y + 180 AS y1 FROM pos),
j AS (SELECT a.chunk, a.frame, a.i AS ia, b.i AS ib, (least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS n FROM b a JOIN b ON a.chunk = b.chunk AND a.frame = b.frame AND a.team = 0 AND b.team = 1 AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1)
SELECT chunk, frame, ia, ib, R6(n / (2.0::DOUBLE * 180 * 360 - n)) AS iou FROM j""", "pos")
add("detection_scores", lambda t: A.detection_scores(t.ball, t.pos.where("role = 'ball' AND pitch_x IS NOT NULL").select("chunk", "frame", F.col("pitch_x").alias("x"), F.col("pitch_y").alias("y")), tol=30.0), """
WITH g AS (SELECT chunk, frame, x, y FROM ball), d AS (SELECT chunk, frame, pitch_x AS x, pitch_y AS y FROM pos WHERE role = 'ball' AND pitch_x IS NOT NULL),
j AS (SELECT g.x AS gx, d.x AS dx, coalesce(sqrt((g.x - d.x) ** 2 + (g.y - d.y) ** 2) <= 30, false) AS near FROM g FULL JOIN d ON g.chunk = d.chunk AND g.frame = d.frame)
SELECT count(*) FILTER (near) AS hits, count(*) FILTER (gx IS NOT NULL AND NOT near) AS missed, count(*) FILTER (dx IS NOT NULL AND NOT near) AS false_alarms FROM j""", "ball", "pos")

QUERIES, SQL = BOOK.queries, BOOK.sql
