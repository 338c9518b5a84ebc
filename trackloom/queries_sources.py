"""Queries of the registry, text and calibration inputs and of oriented rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackloom.functions import pitch as P
from trackloom.operators import association as A
from trackloom.operators import frames as C
from trackloom.operators import geometry as G
from trackloom.operators import possession as O
from trackloom.operators import profiles as R
from trackloom.plans.book import Book, r6
from trackloom.sources import io

BOOK = Book()
add = BOOK.add


def _registry(t):
    m = t.read("frame_states").where("match_id IS NOT NULL").groupBy("match_id").agg(F.count("*").alias("n"))
    return m.select("match_id", F.col("n").alias("ord"), F.right("match_id", F.lit(1)).alias("manager"))


def _last(t):
    r = _registry(t)
    return io.get_match(r, r.agg(F.max("match_id")).first()[0])


_REG = "WITH r AS (SELECT match_id, count(*) AS ord, right(match_id, 1) AS manager FROM frame_states WHERE match_id IS NOT NULL GROUP BY match_id)"
add("manager_matches", lambda t: io.by_manager(_registry(t), "3"), f"{_REG} SELECT * FROM r WHERE manager = '3'")
add("one_match", _last, f"{_REG} SELECT * FROM r WHERE match_id = (SELECT max(match_id) FROM r)")
_HOMOGRAPHY = [0.05, 0.004, 2.0, 0.001, 0.06, 1.0, 0.00001, 0.00002, 1.0]
_PX, _PY = ("({0} * image_x + {1} * image_y + {2}) / ({3} * image_x + {4} * image_y + {5})".format(*_HOMOGRAPHY[a : a + 3], *_HOMOGRAPHY[6:]) for a in (0, 3))


def _gated(t):
    x, y = P.project(_HOMOGRAPHY, "image_x", "image_y")
    return t.pos.select("chunk", "frame", "track_id", x.alias("x"), y.alias("y")).where("x BETWEEN -2 AND 107 AND y BETWEEN -2 AND 70")


add("gated_points", lambda t: _gated(t).withColumns({"x": r6("x"), "y": r6("y")}), f"WITH p AS (SELECT chunk, frame, track_id, {_PX} AS x, {_PY} AS y FROM pos) SELECT chunk, frame, track_id, R6(x) AS x, R6(y) AS y FROM p WHERE x BETWEEN -2 AND 107 AND y BETWEEN -2 AND 70", "pos")


def _known(t):
    return t.pos.where("frame % 40 = 0").select("chunk", "frame").distinct().withColumn("h", F.array(F.col("frame").cast("double"), *(F.lit(v) for v in _HOMOGRAPHY[1:])))


add("carried_calibration", lambda t: G.carried(t.pos, _known(t), most=15).select("chunk", "frame", r6(F.get("h", 0)).alias("h0"), r6(F.get("h", 1)).alias("h1")), """
WITH f AS (SELECT DISTINCT chunk, frame FROM pos), k AS (SELECT chunk, frame AS at FROM f WHERE frame % 40 = 0),
j AS (SELECT f.chunk, f.frame, max(p.at) AS p, min(n.at) AS n FROM f LEFT JOIN k p ON p.chunk = f.chunk AND p.at <= f.frame LEFT JOIN k n ON n.chunk = f.chunk AND n.at >= f.frame GROUP BY ALL),
h AS (SELECT *, coalesce(frame - p <= 15, false) AS a, coalesce(n - frame <= 15, false) AS b FROM j)
SELECT chunk, frame, R6(CASE WHEN a AND b THEN frame WHEN a THEN p ELSE n END::DOUBLE) AS h0, R6(0.004) AS h1 FROM h WHERE a OR b""", "pos")


def _fixed(t):
    return t.pos.select("chunk", "frame").distinct().withColumn("h", F.array(*(F.lit(v) for v in _HOMOGRAPHY)))


_PROJ = f"WITH p AS (SELECT chunk, frame, track_id, pitch_x, pitch_y, {_PX} AS x, {_PY} AS y FROM pos), i AS (SELECT *, x BETWEEN -2 AND 107 AND y BETWEEN -2 AND 70 AS inside FROM p)"
add("projected_missing", lambda t: G.projected(t.pos, _fixed(t)).select("chunk", "frame", "track_id", r6("pitch_x").alias("x"), r6("pitch_y").alias("y")), _PROJ + "SELECT chunk, frame, track_id, R6(coalesce(pitch_x, CASE WHEN inside THEN x END)) AS x, R6(coalesce(pitch_y, CASE WHEN inside THEN y END)) AS y FROM i", "pos")
add("projected_anew", lambda t: G.projected(t.pos, _fixed(t), only_missing=False).select("chunk", "frame", "track_id", r6("pitch_x").alias("x"), r6("pitch_y").alias("y")), _PROJ + "SELECT chunk, frame, track_id, R6(coalesce(CASE WHEN inside THEN x END, pitch_x)) AS x, R6(coalesce(CASE WHEN inside THEN y END, pitch_y)) AS y FROM i", "pos")
add("projection_error", lambda t: G.reprojection_error(t.pos, _fixed(t)).withColumn("error_m", r6("error_m")), _PROJ + "SELECT chunk, frame, R6(avg(CASE WHEN inside THEN sqrt((x - pitch_x) ** 2 + (y - pitch_y) ** 2) ELSE 0 END)) AS error_m FROM i WHERE pitch_x IS NOT NULL AND pitch_y IS NOT NULL GROUP BY ALL", "pos")
add("parsed_percentages", lambda t: io.parse_percentages(t.read("nation").groupBy("n_regionkey").agg(F.concat_ws("\n", F.collect_list(F.concat(F.translate("n_name", "0123456789_", "ABCDEFGHIJ "), F.lit("  "), F.format_string("%.1f", F.col("n_nationkey") * 1.5), F.lit("%  "), (F.col("n_nationkey") % 100).cast("string"), F.lit("% x")))).alias("doc")), "doc"), "SELECT translate(n_name, '0123456789_', 'ABCDEFGHIJ ') AS label, n_nationkey * 1.5::DOUBLE AS home, (n_nationkey % 100)::DOUBLE AS away FROM nation")
add("parsed_numbers", lambda t: t.read("customer").withColumn("s", F.format_number("c_acctbal", 2)).select("c_custkey", r6(io.number("s")).alias("v")), "SELECT c_custkey, R6(round(c_acctbal, 2)::DOUBLE) AS v FROM customer")
_TURN = """WITH p AS (SELECT chunk, frame, track_id, team, pitch_x * 120 / 105 AS x, pitch_y * 80 / 68 AS y, role = 'goalkeeper' AS keeper, count(*) OVER (PARTITION BY chunk, frame) AS n FROM pl),
a AS (SELECT p.*, s.team AS att FROM p JOIN poss s ON s.chunk = p.chunk AND s.frame = p.frame WHERE n >= 10), m AS (SELECT *, avg(x) FILTER (team = att) OVER (PARTITION BY chunk, frame) AS mean FROM a)
SELECT chunk, frame, track_id, team, R6(CASE WHEN mean < 60 THEN 120 - x ELSE x END) AS x, R6(CASE WHEN mean < 60 THEN 80 - y ELSE y END) AS y, keeper FROM m"""
add("oriented_nodes", lambda t: C.exploded(C.orient(C.freeze_frames(t.pos), t.poss)).withColumns({"x": r6("x"), "y": r6("y")}), _TURN, "poss")
add("oriented_rows", lambda t: R.oriented(t.pos, t.dirs).select("chunk", "frame", "track_id", r6("ox").alias("x"), r6("oy").alias("y")), "SELECT pl.chunk, pl.frame, track_id, R6(CASE WHEN dir > 0 THEN pitch_x ELSE 105 - pitch_x END) AS x, R6(CASE WHEN dir > 0 THEN pitch_y ELSE 68 - pitch_y END) AS y FROM pl JOIN dirs d ON d.chunk = pl.chunk AND d.team = pl.team", "pl", "dirs")
add("carrier_stream", lambda t: O.first_of_frame(O.assign_possession(t.ball, t.players, radius_m=12.0)).select("chunk", "frame", "carrier", "team"), "SELECT chunk, frame, carrier, team FROM poss WHERE team >= 0", "poss")
add("modal_third", lambda t: A.modal(t.players.withColumn("third", F.floor(F.col("pitch_x") / 35.001).cast("long")), ["team", "track_id"], "third"), "SELECT team, track_id, third FROM (SELECT team, track_id, CAST(floor(pitch_x / 35.001) AS BIGINT) AS third, count(*) AS k FROM pl GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY team, track_id ORDER BY k DESC, third) = 1", "pl")

QUERIES, SQL = BOOK.queries, BOOK.sql
