"""Queries of networks, imputation, statistics, text audits and facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackloom.functions import stats as X
from trackloom.functions import text as W
from trackloom.operators import imputation as I
from trackloom.operators import network as N
from trackloom.operators import possession as O
from trackloom.operators import shape as S
from trackloom.operators import tracks as T
from trackloom.plans.book import Book, r6
from trackloom.plans.joins import against

BOOK = Book()
add = BOOK.add


def _edges(t):
    return O.pass_edges(O.passes(t.poss, t.players, max_gap=60)).select("team", F.col("from_id").alias("src"), F.col("to_id").alias("dst"), "weight")


_PASS60 = """WITH n0 AS (SELECT *, lead(frame) OVER w AS f_to, lead(team) OVER w AS t_to, lead(carrier) OVER w AS c_to FROM poss WINDOW w AS (PARTITION BY chunk ORDER BY frame)),
ed AS (SELECT team, carrier AS src, c_to AS dst, count(*) AS w FROM n0 WHERE t_to = team AND c_to <> carrier AND f_to - frame <= 60 GROUP BY ALL)
"""
_NC = ("density", "reciprocity", "asymmetry", "top3", "centralization")
add("network_metrics", lambda t: N.edge_stats(_edges(t)).select("team", "nodes", "edges", "passes", *(r6(c).alias(c) for c in _NC)), _PASS60 + """
, b AS (SELECT team, least(src, dst) AS a, greatest(src, dst) AS b, count(*) AS k, sum(w) AS s, sum(CASE WHEN src < dst THEN w ELSE -w END) AS d FROM ed GROUP BY ALL), p AS (SELECT team, avg((k = 2)::INT) AS reciprocity, sum(abs(d)) / sum(s) AS asymmetry FROM b GROUP BY team),
r AS (SELECT team, count(*) AS edges, CAST(sum(w) AS BIGINT) AS passes, sum(w) FILTER (k <= 3) / sum(w) AS top3 FROM (SELECT *, row_number() OVER (PARTITION BY team ORDER BY w DESC, src, dst) AS k FROM ed) GROUP BY team),
s AS (SELECT team, v, sum(w) AS s FROM (SELECT team, src AS v, w FROM ed UNION ALL SELECT team, dst, w FROM ed) GROUP BY ALL), n AS (SELECT team, count(*) AS nodes, (max(s) - avg(s)) / sum(s) AS centralization FROM s GROUP BY team)
SELECT team, nodes, edges, passes, R6(edges / (nodes * (nodes - 1))) AS density, R6(reciprocity) AS reciprocity, R6(asymmetry) AS asymmetry, R6(top3) AS top3, R6(centralization) AS centralization FROM r JOIN p USING (team) JOIN n USING (team)""", "poss")
add("two_paths", lambda t: N.two_paths(_edges(t)), _PASS60 + """
SELECT a.team, CAST(sum(CASE WHEN b.dst = a.src THEN a.w * b.w ELSE 0 END) AS BIGINT) AS aba, CAST(sum(CASE WHEN b.dst <> a.src THEN a.w * b.w ELSE 0 END) AS BIGINT) AS abc FROM ed a JOIN ed b ON a.team = b.team AND a.dst = b.src GROUP BY a.team""", "poss")
add("edge_gini", lambda t: X.gini(_edges(t), ["team"], "weight").withColumn("gini", r6("gini")), _PASS60 + """
, r AS (SELECT team, w, row_number() OVER (PARTITION BY team ORDER BY w) AS k, count(*) OVER (PARTITION BY team) AS n FROM ed) SELECT team, R6(sum((2 * k - n - 1) * w) / (max(n) * sum(w))) AS gini FROM r GROUP BY team""", "poss")
add("betweenness", lambda t: N.centrality(_edges(t)))


def _seq(t):
    return N.per_second(t.ball, fps=5).join(t.poss.select("chunk", "frame", "team"), ["chunk", "frame"], "left")


_SEQ = """WITH b0 AS (SELECT *, CAST(floor(frame / 5.0 + 0.5) AS BIGINT) AS t FROM ball), sq AS (SELECT chunk, t, frame, x, y FROM b0 QUALIFY row_number() OVER (PARTITION BY chunk, t ORDER BY abs(frame - t * 5), frame) = 1),
sp AS (SELECT sq.*, p.team FROM sq LEFT JOIN poss p ON p.chunk = sq.chunk AND p.frame = sq.frame), st0 AS (SELECT *, CASE WHEN lag(team) OVER w = team AND t - lag(t) OVER w <= 3 THEN 0 ELSE 1 END AS new FROM sp WHERE team IS NOT NULL WINDOW w AS (PARTITION BY chunk ORDER BY t)),
st AS (SELECT chunk, t, frame, x, y, team, CAST(sum(new) OVER (PARTITION BY chunk ORDER BY t) AS BIGINT) AS string FROM st0),
ce AS (SELECT *, CAST(greatest(least(floor(x / 105 * 4), 3), 0) * 3 + greatest(least(floor(y / 68 * 3), 2), 0) AS BIGINT) AS "start" FROM st), wi AS (SELECT team, "start", lead("start", 2) OVER (PARTITION BY chunk, string ORDER BY t) AS "end" FROM ce),
wn AS (SELECT * FROM wi WHERE "end" IS NOT NULL)
"""


def _windows(t):
    return N.windows(N.strings(_seq(t), gap=3), length=3, nx=4, ny=3)


add("per_second", lambda t: N.per_second(t.ball, fps=5), _SEQ + "SELECT * FROM sq", "poss")
add("possession_strings", lambda t: N.strings(_seq(t), gap=3), _SEQ + "SELECT * FROM st", "poss")
add("cell_windows", lambda t: _windows(t).groupBy("team", "start", "end").agg(F.count("*").alias("n")), _SEQ + 'SELECT team, "start", "end", count(*) AS n FROM wn GROUP BY ALL', "poss")
add("entropy_map", lambda t: N.entropy_map(_windows(t), least=3).withColumn("entropy", r6("entropy")), _SEQ + """
, c AS (SELECT team, "start", "end", count(*) AS k FROM wn GROUP BY ALL), n AS (SELECT *, sum(k) OVER (PARTITION BY team, "start") AS n FROM c)
SELECT team, "start", CAST(n AS BIGINT) AS n, R6(-sum(k / n * log2(k / n))) AS entropy FROM n WHERE n >= 3 GROUP BY team, "start", n""", "poss")
add("occupancy_distance", lambda t: X.js_distance(*(_windows(t).where(f"team = {k}").groupBy("start").agg(F.count("*").alias("n")) for k in (0, 1)), "start", "n").withColumn("js", r6("js")), _SEQ + """
, a AS (SELECT "start", count(*) / (SELECT count(*) FROM wn WHERE team = 0) AS p FROM wn WHERE team = 0 GROUP BY 1), b AS (SELECT "start", count(*) / (SELECT count(*) FROM wn WHERE team = 1) AS q FROM wn WHERE team = 1 GROUP BY 1),
j AS (SELECT coalesce(p, 0) AS p, coalesce(q, 0) AS q FROM a FULL JOIN b ON a."start" = b."start")
SELECT R6(sqrt(sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2)) AS js FROM j""", "poss")
_TM = """WITH tm AS (SELECT pl.chunk, pl.team, track_id, avg(CASE WHEN dir > 0 THEN pitch_x ELSE 105 - pitch_x END) AS mx, avg(CASE WHEN dir > 0 THEN pitch_y ELSE 68 - pitch_y END) AS my, avg((role = 'goalkeeper')::INT) > 0.5 AS keeper, count(*) AS n
  FROM pl JOIN dirs d ON d.chunk = pl.chunk AND d.team = pl.team GROUP BY ALL HAVING count(*) >= 30)
"""
add("track_means", lambda t: N.track_means(t.pos, t.dirs).withColumns({c: r6(c) for c in ("mx", "my")}), _TM + "SELECT chunk, team, track_id, R6(mx) AS mx, R6(my) AS my, keeper, n FROM tm", "pl", "dirs")
add("formations", lambda t: N.formations(N.track_means(t.pos, t.dirs)))
add("modal_formation", lambda t: N.modal_formation(N.formations(N.track_means(t.pos, t.dirs))))
add("sliced_embedding", lambda t: N.sliced_embedding(t.pos, t.dirs).select("chunk", "team", F.posexplode("emb").alias("i", "v")).groupBy("chunk", "team", "i").agg(F.count("*").alias("n"), F.avg("v").alias("v")).withColumn("v", r6("v")), f"""
WITH p AS (SELECT pl.chunk, pl.frame, pl.team, CASE WHEN dir > 0 THEN pitch_x ELSE 105 - pitch_x END AS x, CASE WHEN dir > 0 THEN pitch_y ELSE 68 - pitch_y END AS y FROM pl JOIN dirs d ON d.chunk = pl.chunk AND d.team = pl.team),
c AS (SELECT chunk, frame, team, x - avg(x) OVER w AS x, y - avg(y) OVER w AS y FROM p WINDOW w AS (PARTITION BY chunk, frame, team)),
q AS (SELECT chunk, frame, team, k, quantile_cont(x * cos(pi() * k / 24) + y * sin(pi() * k / 24), {[(i + 0.5) / 12 for i in range(12)]}) AS l FROM c, range(24) r(k) GROUP BY chunk, frame, team, k HAVING count(*) >= 4)
SELECT chunk, team, CAST(k * 12 + j AS INT) AS i, count(*) AS n, R6(avg(l[j + 1])) AS v FROM q, range(12) s(j) GROUP BY chunk, team, k, j""", "pl", "dirs")

_LINES = """WITH o AS (SELECT pl.chunk, pl.frame, pl.team, CASE WHEN dir > 0 THEN pitch_x ELSE 105 - pitch_x END AS ax FROM pl JOIN dirs d ON d.chunk = pl.chunk AND d.team = pl.team WHERE role = 'player'),
li AS (SELECT chunk, frame, team, count(*) AS n, avg(ax) FILTER (k <= 4) AS line FROM (SELECT *, row_number() OVER (PARTITION BY chunk, frame, team ORDER BY ax) AS k FROM o) GROUP BY ALL)
"""


def _lines(t):
    g = T.advance_of(t.players.where("role = 'player'"), t.dirs).groupBy("chunk", "frame", "team").agg(F.count("*").alias("n"), F.slice(F.array_sort(F.collect_list("ax")), 1, 4).alias("d"))
    return g.select("chunk", "frame", "team", "n", (F.expr("aggregate(d, 0D, (a, v) -> a + v)") / F.size("d")).alias("line"))


add("line_estimates", lambda t: _lines(t).withColumn("line", r6("line")), _LINES + "SELECT chunk, frame, team, n, R6(line) AS line FROM li", "pl", "dirs")
add("debias_slope", lambda t: I.debias_slope(_lines(t), "n", "line", cap=6.0).withColumn("slope", r6("slope")), _LINES + "SELECT R6(regr_slope(line, least(n, 6))) AS slope FROM li", "pl", "dirs")


def _roles(t):
    return t.pos.select("chunk", "track_id", (F.col("track_id") % 9).alias("slot")).distinct()


_OFF = """WITH p AS (SELECT *, track_id % 9 AS slot, count(*) OVER w AS n, sum(pitch_x) OVER w AS sx, sum(pitch_y) OVER w AS sy FROM pl WINDOW w AS (PARTITION BY chunk, frame, team)),
of AS (SELECT team, slot, avg(pitch_x - (sx - pitch_x) / (n - 1)) AS dx, avg(pitch_y - (sy - pitch_y) / (n - 1)) AS dy, count(*) AS n FROM p WHERE n > 1 GROUP BY ALL)
"""
add("role_offsets", lambda t: I.role_offsets(t.pos, _roles(t)).withColumns({"dx": r6("dx"), "dy": r6("dy")}), _OFF + "SELECT team, slot, R6(dx) AS dx, R6(dy) AS dy, n FROM of", "pl")
add("impute_roles", lambda t: I.impute_roles(t.pos, _roles(t), I.role_offsets(t.pos, _roles(t))).withColumns({"x": r6("x"), "y": r6("y")}), _OFF + """
, ce AS (SELECT chunk, frame, team, avg(pitch_x) AS cx, avg(pitch_y) AS cy FROM pl GROUP BY ALL), sl AS (SELECT DISTINCT chunk, team, track_id % 9 AS slot FROM pos WHERE team >= 0),
se AS (SELECT DISTINCT chunk, frame, team, track_id % 9 AS slot FROM pl)
SELECT ce.chunk, ce.frame, ce.team, sl.slot, R6(least(greatest(cx + dx, 0), 105)) AS x, R6(least(greatest(cy + dy, 0), 68)) AS y FROM ce JOIN sl ON sl.chunk = ce.chunk AND sl.team = ce.team JOIN of ON of.team = ce.team AND of.slot = sl.slot
WHERE NOT EXISTS (SELECT 1 FROM se WHERE se.chunk = ce.chunk AND se.frame = ce.frame AND se.team = ce.team AND se.slot = sl.slot)""", "pl")


def _hidden(t):
    return t.players.select("chunk", "track_id", "frame", "pitch_x", (F.abs(F.col("pitch_x") - 52) < 25).alias("visible"))


def _base(t):
    return I.baselines(I.between_sightings(_hidden(t), ["chunk", "track_id"], "frame", "pitch_x", "visible"), "frame", "pitch_x", "visible")


_HID = """WITH h AS (SELECT chunk, track_id, frame, pitch_x, abs(pitch_x - 52) < 25 AS visible FROM pl),
b AS (SELECT *, last_value(CASE WHEN visible THEN frame END IGNORE NULLS) OVER w AS t_last, last_value(CASE WHEN visible THEN pitch_x END IGNORE NULLS) OVER w AS v_last, first_value(CASE WHEN visible THEN frame END IGNORE NULLS) OVER v AS t_next, first_value(CASE WHEN visible THEN pitch_x END IGNORE NULLS) OVER v AS v_next FROM h
  WINDOW w AS (PARTITION BY chunk, track_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), v AS (PARTITION BY chunk, track_id ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
e AS (SELECT chunk, track_id, frame, frame - t_last AS tsls, abs(pitch_x - v_last) AS hold_err, abs(pitch_x - CASE WHEN t_next IS NULL THEN v_last ELSE v_last + (v_next - v_last) * ((frame - t_last) / (t_next - t_last)) END) AS line_err FROM b WHERE NOT visible AND v_last IS NOT NULL)
"""
add("hidden_baselines", lambda t: _base(t).select("chunk", "track_id", "frame", "tsls", r6("hold_err").alias("hold_err"), r6("line_err").alias("line_err")), _HID + "SELECT chunk, track_id, frame, tsls, R6(hold_err) AS hold_err, R6(line_err) AS line_err FROM e", "pl")
add("horizon_stats", lambda t: I.horizon_stats(_base(t).withColumn("bucket", I.horizon(F.col("tsls"), (5, 10, 20, 40))), "hold_err", "bucket").select("bucket", "n", *(r6(c).alias(c) for c in ("rmse", "p50", "p90"))), _HID + """
, k AS (SELECT *, CASE WHEN tsls <= 5 THEN 0 WHEN tsls <= 10 THEN 1 WHEN tsls <= 20 THEN 2 WHEN tsls <= 40 THEN 3 ELSE 4 END AS bucket FROM e)
SELECT bucket, count(*) AS n, R6(sqrt(avg(hold_err * hold_err))) AS rmse, R6(median(hold_err)) AS p50, R6(quantile_cont(hold_err, 0.9)) AS p90 FROM k GROUP BY bucket""", "pl")
add("k_step_velocity", lambda t: I.k_step_velocity(_hidden(t), ["chunk", "track_id"], "frame", "pitch_x", k=2, fps=25.0).select("chunk", "track_id", "frame", r6("v").alias("v")), """
WITH d AS (SELECT chunk, track_id, frame, (pitch_x - lag(pitch_x, 2) OVER w) * 25 / (frame - lag(frame, 2) OVER w) AS v FROM pl WINDOW w AS (PARTITION BY chunk, track_id ORDER BY frame)) SELECT chunk, track_id, frame, R6(CASE WHEN v > 12 THEN 12 WHEN v < -12 THEN -12 ELSE v END) AS v FROM d""", "pl")
add("best_tau", lambda t: I.best_tau(_base(t).select(F.col("v_last").alias("base"), ((F.col("v_next") - F.col("v_last")) / 4).alias("v0"), (F.col("tsls") / 25).alias("seconds"), F.col("pitch_x").alias("truth")), [0.1, 0.5, 1.0, 2.0, 4.0]).withColumns({"tau": r6("tau"), "rmse": r6("rmse")}), _HID + """
, s AS (SELECT v_last AS base, coalesce((v_next - v_last) / 4, 0) AS v0, (frame - t_last) / 25.0 AS s, pitch_x FROM b WHERE NOT visible AND v_last IS NOT NULL), g AS (SELECT tau, sqrt(avg((pitch_x - (base + v0 * tau * (1 - exp(-s / tau)))) ** 2)) AS rmse FROM s, (SELECT unnest([0.1, 0.5, 1.0, 2.0, 4.0])::DOUBLE AS tau) GROUP BY tau)
SELECT R6(tau) AS tau, R6(rmse) AS rmse FROM g ORDER BY g.rmse LIMIT 1""", "pl")
add("smooth_camera", lambda t: I.smooth_camera(t.ball).withColumn("cam", r6("cam")), "SELECT chunk, frame, R6(avg(x) OVER (PARTITION BY chunk ORDER BY frame ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING)) AS cam FROM ball", "ball")
add("visibility_runs", lambda t: I.visibility_runs(_hidden(t).where("visible"), ["chunk", "track_id"], "frame", 5), """
WITH g AS (SELECT chunk, track_id, frame, frame - 5 * row_number() OVER (PARTITION BY chunk, track_id ORDER BY frame) AS g FROM pl WHERE abs(pitch_x - 52) < 25) SELECT chunk, track_id, min(frame) AS f0, max(frame) AS f1, count(*) AS n FROM g GROUP BY chunk, track_id, g""", "pl")
add("emit_policy", lambda t: _base(t).groupBy(I.emit_policy(F.col("hold_err"), F.col("line_err"), F.lit(20.0), F.lit(False)).alias("policy")).agg(F.count("*").alias("n")), _HID + "SELECT CASE WHEN hold_err <= 20 THEN 'model' WHEN line_err <= 20 THEN 'anchor' ELSE 'abstain' END AS policy, count(*) AS n FROM e GROUP BY 1", "pl")
add("attack_signs", lambda t: I.attack_signs(t.players, ["chunk", "team"], "track_id", "pitch_x"), """
WITH m AS (SELECT chunk, team, track_id, avg(pitch_x) AS m FROM pl GROUP BY ALL) SELECT chunk, team, CASE WHEN m < 52.5 THEN 1 ELSE -1 END AS sign FROM m QUALIFY row_number() OVER (PARTITION BY chunk, team ORDER BY abs(m - 52.5) DESC, track_id DESC) = 1""", "pl")


def _orders(t):
    return t.read("orders").select("o_orderkey", "o_orderstatus", (F.col("o_totalprice") / 600000).alias("p"), (F.col("o_orderpriority") == "1-URGENT").alias("y"), "o_custkey", "o_totalprice")


_OR = "WITH o AS (SELECT o_orderkey, o_orderstatus, o_totalprice / 600000 AS p, o_orderpriority = '1-URGENT' AS y, o_custkey, o_totalprice FROM orders)"
add("roc_auc", lambda t: X.roc_auc(_orders(t), ["o_orderstatus"], "p", "y").withColumn("auc", r6("auc")), _OR + """
, r AS (SELECT o_orderstatus, y, rank() OVER (PARTITION BY o_orderstatus ORDER BY p) + (count(*) OVER (PARTITION BY o_orderstatus, p) - 1) / 2 AS r FROM o), s AS (SELECT o_orderstatus, sum(r) FILTER (y) AS s, count(*) FILTER (y) AS a, count(*) FILTER (NOT y) AS b FROM r GROUP BY ALL)
SELECT o_orderstatus, R6((s - a * (a + 1) / 2) / (a * b)) AS auc FROM s""")
add("spearman", lambda t: X.spearman(t.read("lineitem"), ["l_returnflag"], "l_quantity", "l_discount").withColumn("rho", r6("rho")), """
WITH r AS (SELECT l_returnflag, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2 AS a, rank() OVER (PARTITION BY l_returnflag ORDER BY l_discount) + (count(*) OVER (PARTITION BY l_returnflag, l_discount) - 1) / 2 AS b FROM lineitem)
SELECT l_returnflag, count(*) AS n, R6(corr(a, b)) AS rho FROM r GROUP BY ALL""")
_REL = _OR + ", rl AS (SELECT CAST(greatest(least(floor(p * 10), 9), 0) AS INT) AS bin, count(*) AS n, avg(p) AS mean_p, avg(y::INT) AS frac FROM o GROUP BY 1)"
add("reliability", lambda t: X.reliability(_orders(t), "p", "y").withColumns({c: r6(c) for c in ("mean_p", "frac")}), _REL + "SELECT bin, n, R6(mean_p) AS mean_p, R6(frac) AS frac FROM rl")
add("calibration_error", lambda t: X.calibration_error(X.reliability(_orders(t), "p", "y")).withColumn("ece", r6("ece")), _REL + "SELECT R6(sum(n * abs(mean_p - frac)) / sum(n)) AS ece FROM rl")
add("ranked_probability", lambda t: t.read("lineitem").select("l_returnflag", (F.col("l_discount") * 5).alias("a"), (F.col("l_tax") * 5).alias("b"), (1 - F.col("l_discount") * 5 - F.col("l_tax") * 5).alias("c"), F.pmod("l_suppkey", F.lit(3)).alias("k")).groupBy("l_returnflag").agg(r6(F.avg(X.rps(["a", "b", "c"], "k"))).alias("rps")), """
SELECT l_returnflag, R6(avg(((l_discount * 5 - (l_suppkey % 3 <= 0)::INT) ** 2 + (l_discount * 5 + l_tax * 5 - (l_suppkey % 3 <= 1)::INT) ** 2) / 2)) AS rps FROM lineitem GROUP BY ALL""")
add("wilson", lambda t: _orders(t).groupBy("o_orderstatus").agg(F.count(F.when(F.col("y"), 1)).alias("k"), F.count("*").alias("n")).select("o_orderstatus", *(r6(c).alias(a) for c, a in zip(X.wilson(F.col("k"), F.col("n")), ("low", "high")))), _OR + """
, c AS (SELECT o_orderstatus, count(*) FILTER (y) / count(*) AS p, count(*)::DOUBLE AS n FROM o GROUP BY ALL) SELECT o_orderstatus, R6((p + 3.8416::DOUBLE / (2 * n) - 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n)) AS low, R6((p + 3.8416::DOUBLE / (2 * n) + 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n)) AS high FROM c""")
add("conformal_radius", lambda t: X.conformal_radius(_orders(t), ["o_orderstatus"], "p").withColumn("k", r6("k")), _OR + """
, r AS (SELECT o_orderstatus, p, row_number() OVER (PARTITION BY o_orderstatus ORDER BY p) AS r, count(*) OVER (PARTITION BY o_orderstatus) AS n FROM o) SELECT o_orderstatus, R6(min(p) FILTER (r = ceil((n + 1) * 0.9::DOUBLE))) AS k FROM r GROUP BY ALL""")
add("risk_coverage", lambda t: X.risk_coverage(_orders(t).withColumn("err", F.abs(F.col("p") - F.col("y").cast("double"))), ["o_orderstatus"], "err", "p", "o_orderkey").withColumns({c: r6(c) for c in ("aurc", "augrc")}), _OR + """
, d AS (SELECT o_orderstatus, sum(abs(p - y::INT)) OVER w AS s, count(*) OVER w AS k, count(*) OVER (PARTITION BY o_orderstatus) AS n FROM o WINDOW w AS (PARTITION BY o_orderstatus ORDER BY p, o_orderkey ROWS UNBOUNDED PRECEDING)) SELECT o_orderstatus, R6(avg(s / k)) AS aurc, R6(avg(s / n)) AS augrc FROM d GROUP BY ALL""")
_FRN = _OR + ", fn AS (SELECT o_orderstatus, count(*) OVER w AS k, p AS threshold, count(*) OVER w / count(*) OVER (PARTITION BY o_orderstatus) AS coverage, sum(y::INT) OVER w / count(*) OVER w AS precision FROM o WINDOW w AS (PARTITION BY o_orderstatus ORDER BY p DESC, o_orderkey ROWS UNBOUNDED PRECEDING))"


def _frontier(t):
    return X.frontier(_orders(t), ["o_orderstatus"], "p", "y", "o_orderkey")


add("frontier", lambda t: _frontier(t).withColumns({c: r6(c) for c in ("threshold", "coverage", "precision")}), _FRN + "SELECT o_orderstatus, k, R6(threshold) AS threshold, R6(coverage) AS coverage, R6(precision) AS precision FROM fn")
add("coverage_at", lambda t: X.coverage_at(_frontier(t), ["o_orderstatus"], 0.25).withColumn("coverage", r6("coverage")), _FRN + "SELECT o_orderstatus, R6(coalesce(max(coverage) FILTER (precision >= 0.25), 0)) AS coverage FROM fn GROUP BY o_orderstatus")
add("mean_without_self", lambda t: X.mean_without_self(t.read("supplier"), ["s_nationkey"], "s_acctbal", "rest").select("s_suppkey", r6("rest").alias("rest")), "SELECT s_suppkey, R6((sum(s_acctbal) OVER w - s_acctbal) / nullif(count(*) OVER w - 1, 0)) AS rest FROM supplier WINDOW w AS (PARTITION BY s_nationkey)")
add("line_without_group", lambda t: X.line_without_group(t.read("customer").withColumn("x", F.col("c_nationkey").cast("double") * 3 + F.col("c_custkey") % 7), "c_mktsegment", "x", "c_acctbal").withColumns({c: r6(c) for c in ("slope", "intercept")}), """
SELECT s.c_mktsegment, R6(regr_slope(c.c_acctbal, c.c_nationkey * 3 + c.c_custkey % 7)) AS slope, R6(regr_intercept(c.c_acctbal, c.c_nationkey * 3 + c.c_custkey % 7)) AS intercept FROM (SELECT DISTINCT c_mktsegment FROM customer) s JOIN customer c ON c.c_mktsegment <> s.c_mktsegment GROUP BY ALL""")
add("one_way", lambda t: X.one_way(t.read("customer"), "c_nationkey", "c_acctbal").select("groups", "n", r6("f").alias("f")), """
WITH g AS (SELECT c_nationkey, count(*) AS n, avg(c_acctbal) AS m, var_pop(c_acctbal) AS v FROM customer GROUP BY 1), t AS (SELECT count(*) AS groups, sum(n) AS n, sum(n * m) / sum(n) AS mean, sum(n * v) AS w FROM g)
SELECT groups, CAST(t.n AS BIGINT) AS n, R6((SELECT sum(g.n * (m - mean) ** 2) FROM g) / (groups - 1) / (w / (t.n - groups))) AS f FROM t""")
add("spread", lambda t: X.spread(t.read("customer"), ["c_mktsegment"], "c_acctbal").select("c_mktsegment", *(r6(c).alias(c) for c in ("mean", "sd", "cv", "low", "high")), "n"), "SELECT c_mktsegment, R6(avg(c_acctbal)) AS mean, R6(stddev_samp(c_acctbal)) AS sd, R6(stddev_samp(c_acctbal) / avg(c_acctbal)) AS cv, R6(min(c_acctbal)) AS low, R6(max(c_acctbal)) AS high, count(*) AS n FROM customer GROUP BY ALL")
add("block_bootstrap", lambda t: X.block_bootstrap(_orders(t), "o_custkey", "p"))
add("discordant", lambda t: X.discordant(_orders(t).withColumn("big", F.col("p") > 0.4), "y", "big"), _OR + "SELECT count(*) FILTER (NOT y AND p > 0.4) AS helped, count(*) FILTER (y AND p <= 0.4) AS hurt, count(*) FILTER (y AND p > 0.4) AS both, count(*) FILTER (NOT y AND p <= 0.4) AS neither FROM o")
add("score_slices", lambda t: t.spark.sql("SELECT coalesce(o_orderstatus, 'all') AS status, coalesce(o_orderpriority, 'all') AS priority, count(*) AS n, round(avg(CASE WHEN o_totalprice > 200000 THEN 1.0D ELSE 0 END) + 1e-9, 6) AS rate FROM {o} GROUP BY GROUPING SETS ((), (o_orderstatus), (o_orderpriority), (o_orderstatus, o_orderpriority))", o=t.read("orders")), """
SELECT coalesce(o_orderstatus, 'all') AS status, coalesce(o_orderpriority, 'all') AS priority, count(*) AS n, R6(avg(CASE WHEN o_totalprice > 200000 THEN 1.0::DOUBLE ELSE 0 END)) AS rate FROM orders GROUP BY GROUPING SETS ((), (o_orderstatus), (o_orderpriority), (o_orderstatus, o_orderpriority))""")

_PIV = "SELECT l_returnflag, CAST(sum(CASE WHEN l_linestatus = 'F' THEN l_linenumber ELSE 0 END) AS BIGINT) AS f, CAST(sum(CASE WHEN l_linestatus = 'O' THEN l_linenumber ELSE 0 END) AS BIGINT) AS o FROM lineitem GROUP BY ALL"
add("pivot", lambda t: t.read("lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(F.sum("l_linenumber")).na.fill(0).select("l_returnflag", F.col("F").alias("f"), F.col("O").alias("o")), _PIV)
add("unpivot", lambda t: t.read("supplier").select("s_suppkey", F.expr("stack(2, 'nation', cast(s_nationkey as double), 'balance', s_acctbal) AS (field, value)")), "SELECT s_suppkey, 'nation' AS field, CAST(s_nationkey AS DOUBLE) AS value FROM supplier UNION ALL SELECT s_suppkey, 'balance', s_acctbal FROM supplier")


def _facts(t):
    p = O.passes(t.poss, t.players)
    s = S.fingerprint(S.frame_shapes(t.pos).select("chunk", "frame", "team", "n", "width", "length"), "chunk", "team")
    k = p.groupBy("chunk", "team").agg(F.count("*").alias("passes"), F.avg("length_m").alias("mean_pass_m"))
    j = s.join(k, ["chunk", "team"], "left")
    return j.groupBy("chunk").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.concat(F.lit("team"), F.col("team").cast("string")), F.struct("frames", F.coalesce("passes", F.lit(0)).alias("passes"), F.round("width", 3).alias("width"), F.round("mean_pass_m", 3).alias("mean_pass_m"))))))).alias("doc"))


add("fact_documents", _facts)
add("flatten_facts", lambda t: W.flatten_json(t.read("events").select("event_id", "props"), "event_id", "props").withColumn("value", r6("value")), "SELECT event_id, 'k' AS label, R6(CAST(json_extract(props, '$.k') AS DOUBLE)) AS value FROM events WHERE json_extract(props, '$.k') IS NOT NULL")
add("numbers_in_text", lambda t: W.numbers(t.read("documents"), "doc_id", "text"))


def _audit(t):
    facts = t.spark.createDataFrame([("pct", 12.5, "share"), ("m", 7.7, "line"), ("s", 3.2, "recovery"), ("count", 40.0, "passes")], "kind string, fact double, label string").withColumn("one", F.lit(1))
    found = W.numbers(t.read("documents"), "doc_id", "text").withColumn("one", F.lit(1))
    return W.check_numbers(found, facts, "doc_id", ["one"])


add("audited_numbers", lambda t: W.audit(_audit(t), "doc_id"))
add("gate_tiers", lambda t: t.read("part").select("p_partkey", W.gate(F.col("p_size") * 2.0, F.col("p_retailprice") / 20, F.when(F.col("p_partkey") % 5 == 0, None).otherwise(F.col("p_partkey") % 11 / 100)).alias("tier")), """
SELECT p_partkey, CASE WHEN p_size * 2.0 >= 40 AND p_retailprice / 20 >= 50 THEN 'absolute' WHEN p_partkey % 5 <> 0 AND (p_partkey % 11)::DOUBLE / 100 <= 0.05 THEN 'comparative' ELSE 'abstain' END AS tier FROM part""")
add("search_text", lambda t: t.read("documents").where(F.col("text").ilike("%calibration error%") & F.col("lang").isin("en", "EN")).select("doc_id"), "SELECT doc_id FROM documents WHERE text ILIKE '%calibration error%' AND lang IN ('en', 'EN')")
add("name_match", lambda t: against(t.read("region").select("r_name"), t.read("nation"), W.name_match(F.col("n_name"), F.concat(F.lit("x "), F.col("r_name"), F.lit(" nation_1")))).select("n_name", "r_name"), "SELECT n_name, r_name FROM nation, region WHERE contains('x ' || lower(r_name) || ' nation_1', lower(n_name)) OR starts_with(lower(n_name), 'nation_1') OR starts_with(lower(r_name), lower(n_name)) OR starts_with(lower(n_name), lower(r_name))")
add("registry", lambda t: t.read("frame_states").groupBy("match_id").agg(F.count_distinct("chunk").alias("chunks"), F.count("frame").alias("frames"), F.max("frame").alias("last_frame")), "SELECT match_id, count(DISTINCT chunk) AS chunks, count(frame) AS frames, max(frame) AS last_frame FROM frame_states GROUP BY match_id")
add("not_yet_done", lambda t: t.read("frame_states").select("match_id", "chunk").distinct().join(t.read("ball_clicks").select("match_id", "chunk").distinct(), ["match_id", "chunk"], "left_anti"), "SELECT DISTINCT match_id, chunk FROM frame_states f WHERE NOT EXISTS (SELECT 1 FROM ball_clicks b WHERE b.match_id = f.match_id AND b.chunk = f.chunk)")
add("latest_delivery", lambda t: t.read("carrier_labels").groupBy("label_id").agg(F.max("loaded_at").alias("loaded_at"), F.count("*").alias("deliveries")).select("label_id", "deliveries"), "SELECT label_id, count(*) AS deliveries FROM carrier_labels GROUP BY label_id")

QUERIES, SQL = BOOK.queries, BOOK.sql
