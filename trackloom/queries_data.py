"""Queries over the tracking tables that use the core operators."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.operators.grid import regular_grid
from trackloom.operators.implausible import Field, implausible
from trackloom.operators.intervals import merge_intervals


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _grid(spark: SparkSession, sf: str, only_missing: bool) -> dict[str, DataFrame]:
    at = lambda i: F.expr(f"try_element_at(ball_pitch, {i})")
    ball = table(spark, sf, "frame_states").select("match_id", "chunk", F.lit(-1).cast("long").alias("tid"), "frame", at(1).alias("x"), at(2).alias("y"))
    ghosts = table(spark, sf, "ghosts").select("match_id", "chunk", "tid", "frame", "tsls")
    starts = table(spark, sf, "fragments").select("match_id", "chunk", F.lit(-1).cast("long").alias("tid"), "start_frame", F.col("n").cast("double").alias("n"), F.lit(1.0).alias("one"))
    keys = ["match_id", "chunk", "tid"]
    made = {
        "ball": lambda: regular_grid(ball, keys, "frame", ["x", "y"], 25, only_missing=only_missing),
        "tsls": lambda: regular_grid(ghosts, keys, "frame", ["tsls"], 50, only_missing=only_missing),
        "starts": lambda: regular_grid(starts, keys, "start_frame", ["one"], 250, only_missing=only_missing),
    }
    # the rounds of one series leave executors idle that the others can use
    with ThreadPoolExecutor(len(made)) as pool:
        return dict(zip(made, pool.map(lambda f: f(), made.values()), strict=True))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    parts = [g.where("state <> 'observed'").select(F.lit(s).alias("series"), "match_id", "chunk", "tid", "period") for s, g in _grid(spark, sf, True).items()]
    return parts[0].union(parts[1]).union(parts[2])


def p4_grid(spark: SparkSession, sf: str) -> DataFrame:
    """Every period of the three series with its state and values."""
    parts = [g.select(F.lit(n).alias("series"), "match_id", "chunk", "tid", "period", "state", F.array(*g.columns[5:]).alias("value")) for n, g in _grid(spark, sf, False).items()]
    return parts[0].union(parts[1]).union(parts[2])


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    f = table(spark, sf, "fragments").where("role is not null").withColumn("entity", F.concat("role", F.lit(":"), F.col("team").cast("string")))
    e = table(spark, sf, "reappearances").withColumn("entity", F.col("slot").cast("string"))
    keys = ["match_id", "chunk", "entity"]
    a = merge_intervals(f, keys, "start_frame", "end_frame").withColumn("series", F.lit("fragment"))
    b = merge_intervals(e, keys, "t0", "t1").withColumn("series", F.lit("event"))
    return a.unionByName(b).select("series", "kind", "match_id", "chunk", "entity", "f0", "f1")


_OUT = "({x} < -10 or {x} > 115 or {y} < -10 or {y} > 78)"
_BALL = _OUT.format(x="try_element_at(ball_pitch, 1)", y="try_element_at(ball_pitch, 2)")
_START = _OUT.format(x="try_element_at(start_xy, 1)", y="try_element_at(start_xy, 2)")
_RUN_X, _RUN_Y = (f"(try_element_at(end_xy, {i}) - try_element_at(start_xy, {i}))" for i in (1, 2))
_RUSH = f"(end_frame > start_frame and not isnan({_RUN_X}) and not isnan({_RUN_Y}) and hypot({_RUN_X}, {_RUN_Y}) * 25 > 15 * (end_frame - start_frame))"
FRAME_FIELDS = [
    Field("ball_pitch", "try_element_at(ball_pitch, 1)", "try_element_at(ball_pitch, 2)", wrong=_BALL, possible=f"not {_BALL}", jump=(20.0, 12.0)),
    Field("calib_err", "CASE WHEN calib_err > -1.7E308D AND calib_err < 1.7E308D THEN calib_err END", wrong="calib_err < 0", mad=12.0),
]
START_FIELD = Field("start_xy", "try_element_at(start_xy, 1)", "try_element_at(start_xy, 2)", wrong=f"({_START} or coalesce({_RUSH}, false))", min_run=5)


def judged(spark: SparkSession, sf: str, flagged: bool) -> DataFrame:
    keys = ["match_id", "chunk"]
    a = implausible(table(spark, sf, "frame_states").where("frame is not null"), keys, "frame", "frame", FRAME_FIELDS, flagged=flagged)
    b = implausible(table(spark, sf, "fragments"), keys, "start_frame", "track_id", [START_FIELD], flagged=flagged)
    return a.withColumn("tab", F.lit("frame_states")).unionByName(b.withColumn("tab", F.lit("fragments")))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return judged(spark, sf, True).where("impossible or frozen or odd").select("tab", "field", "match_id", "chunk", "row_key")


P3_SQL = """
WITH f AS (
  SELECT match_id, chunk, frame, any_value(ball_pitch[1]) AS x, any_value(ball_pitch[2]) AS y, any_value(calib_err) AS c FROM frame_states WHERE frame IS NOT NULL GROUP BY ALL),
b0 AS (SELECT match_id, chunk, frame AS k, x, y, (x < -10 OR x > 115 OR y < -10 OR y > 78) AS bad FROM f WHERE x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)),
b1 AS (SELECT *, row_number() OVER w AS i, lag(x) OVER w IS DISTINCT FROM x OR lag(y) OVER w IS DISTINCT FROM y AS new,
  lag(x, 1) OVER w AS x1, lag(y, 1) OVER w AS y1, lead(x, 1) OVER w AS u1, lead(y, 1) OVER w AS v1, lead(x, 2) OVER w AS u2, lead(y, 2) OVER w AS v2, lead(x, 3) OVER w AS u3, lead(y, 3) OVER w AS v3
  FROM b0 WINDOW w AS (PARTITION BY match_id, chunk ORDER BY k)),
st AS (SELECT match_id, chunk, median(d) AS u FROM (SELECT match_id, chunk, sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2) AS d FROM b0 WHERE NOT bad WINDOW w AS (PARTITION BY match_id, chunk ORDER BY k)) GROUP BY ALL),
b2 AS (SELECT *, sum(new::INT) OVER (PARTITION BY match_id, chunk ORDER BY k) AS run FROM b1),
b3 AS (SELECT *, count(*) OVER (PARTITION BY match_id, chunk, run) AS len FROM b2),
z AS (SELECT b3.*, u FROM b3 JOIN st USING (match_id, chunk) WHERE isfinite(x1) AND isfinite(y1)),
q AS (
  SELECT match_id, chunk, i, 1 AS n FROM z WHERE isfinite(u1) AND isfinite(v1) AND sqrt((u1-x1)**2+(v1-y1)**2) <= 12*u
    AND sqrt((x-x1)**2+(y-y1)**2) > 20*u AND sqrt((x-u1)**2+(y-v1)**2) > 20*u
  UNION ALL SELECT match_id, chunk, i, 2 FROM z WHERE isfinite(u2) AND isfinite(v2) AND sqrt((u2-x1)**2+(v2-y1)**2) <= 12*u
    AND sqrt((x-x1)**2+(y-y1)**2) > 20*u AND sqrt((x-u2)**2+(y-v2)**2) > 20*u AND sqrt((u1-x1)**2+(v1-y1)**2) > 20*u AND sqrt((u1-u2)**2+(v1-v2)**2) > 20*u
  UNION ALL SELECT match_id, chunk, i, 3 FROM z WHERE isfinite(u3) AND isfinite(v3) AND sqrt((u3-x1)**2+(v3-y1)**2) <= 12*u
    AND sqrt((x-x1)**2+(y-y1)**2) > 20*u AND sqrt((x-u3)**2+(y-v3)**2) > 20*u AND sqrt((u1-x1)**2+(v1-y1)**2) > 20*u AND sqrt((u1-u3)**2+(v1-v3)**2) > 20*u
    AND sqrt((u2-x1)**2+(v2-y1)**2) > 20*u AND sqrt((u2-u3)**2+(v2-v3)**2) > 20*u),
odd AS (SELECT match_id, chunk, i + unnest(range(n)) AS i FROM q),
c0 AS (SELECT match_id, chunk, frame AS k, c FROM f WHERE c IS NOT NULL AND isfinite(c)),
c1 AS (SELECT *, lag(c) OVER (PARTITION BY match_id, chunk ORDER BY k) IS DISTINCT FROM c AS new FROM c0),
c2 AS (SELECT *, sum(new::INT) OVER (PARTITION BY match_id, chunk ORDER BY k) AS run FROM c1),
c3 AS (SELECT *, count(*) OVER (PARTITION BY match_id, chunk, run) AS len, median(c) OVER (PARTITION BY match_id, chunk) AS med FROM c2),
c4 AS (SELECT *, median(abs(c - med)) OVER (PARTITION BY match_id, chunk) AS mad FROM c3),
g0 AS (SELECT DISTINCT match_id, chunk, track_id AS k, start_frame AS s, end_frame AS e, start_xy[1] AS x, start_xy[2] AS y, end_xy[1] AS ex, end_xy[2] AS ey FROM fragments),
g1 AS (SELECT * FROM g0 WHERE x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)),
g2 AS (SELECT *, lag(x) OVER w IS DISTINCT FROM x OR lag(y) OVER w IS DISTINCT FROM y AS new FROM g1 WHERE s IS NOT NULL WINDOW w AS (PARTITION BY match_id, chunk ORDER BY s, k)),
g3 AS (SELECT *, sum(new::INT) OVER (PARTITION BY match_id, chunk ORDER BY s, k) AS run FROM g2),
g4 AS (SELECT *, count(*) OVER (PARTITION BY match_id, chunk, run) AS len FROM g3)
SELECT 'frame_states' AS tab, 'ball_pitch' AS field, match_id, chunk, k AS row_key FROM b3 WHERE bad OR len >= 8
UNION SELECT 'frame_states', 'ball_pitch', match_id, chunk, k FROM b3 JOIN odd USING (match_id, chunk, i)
UNION SELECT 'frame_states', 'calib_err', match_id, chunk, k FROM c4 WHERE c < 0 OR len >= 8 OR abs(c - med) > 12 * mad
UNION SELECT 'fragments', 'start_xy', match_id, chunk, k FROM g4 WHERE len >= 5
UNION SELECT 'fragments', 'start_xy', match_id, chunk, k FROM g1 WHERE x < -10 OR x > 115 OR y < -10 OR y > 78
UNION SELECT 'fragments', 'start_xy', match_id, chunk, k FROM g1 WHERE e > s AND isfinite(x) AND isfinite(y) AND isfinite(ex) AND isfinite(ey) AND sqrt((ex - x)**2 + (ey - y)**2) * 25 > 15 * (e - s)
"""

P4_SQL = """
WITH r AS (
  SELECT 'ball' AS series, match_id, chunk, CAST(-1 AS BIGINT) AS tid, CAST(floor(frame / 25.0) AS BIGINT) AS period FROM frame_states
  WHERE frame IS NOT NULL AND ball_pitch[1] IS NOT NULL AND ball_pitch[2] IS NOT NULL AND NOT isnan(ball_pitch[1]) AND NOT isnan(ball_pitch[2])
  UNION SELECT 'tsls', match_id, chunk, tid, CAST(floor(frame / 50.0) AS BIGINT) FROM ghosts WHERE frame IS NOT NULL AND tsls IS NOT NULL AND NOT isnan(tsls)
  UNION SELECT 'starts', match_id, chunk, CAST(-1 AS BIGINT), CAST(floor(start_frame / 250.0) AS BIGINT) FROM fragments WHERE start_frame IS NOT NULL),
n AS (SELECT *, lead(period) OVER (PARTITION BY series, match_id, chunk, tid ORDER BY period) AS nxt FROM r)
SELECT series, match_id, chunk, tid, unnest(range(period + 1, nxt)) AS period FROM n WHERE nxt > period + 1
"""

P5_SQL = """
WITH i AS (
  SELECT 'fragment' AS series, match_id, chunk, role || ':' || team AS entity, start_frame AS s, end_frame AS e FROM fragments WHERE role IS NOT NULL AND start_frame <= end_frame
  UNION SELECT 'event', match_id, chunk, CAST(slot AS VARCHAR), t0, t1 FROM reappearances WHERE t0 <= t1),
m AS (SELECT *, max(e) OVER (PARTITION BY series, match_id, chunk, entity ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM i),
g AS (SELECT *, sum(CASE WHEN far IS NULL OR s > far + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY series, match_id, chunk, entity ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM m),
p AS (SELECT series, match_id, chunk, entity, min(s) AS f0, max(e) AS f1 FROM g GROUP BY series, match_id, chunk, entity, k),
q AS (SELECT *, lead(f0) OVER (PARTITION BY series, match_id, chunk, entity ORDER BY f0) AS nxt FROM p)
SELECT series, 'span' AS kind, match_id, chunk, entity, f0, f1 FROM q
UNION ALL SELECT series, 'gap', match_id, chunk, entity, f1 + 1, nxt - 1 FROM q WHERE nxt IS NOT NULL
"""

QUERIES = {"p3_found": p3_found, "p4_found": p4_found, "p4_grid": p4_grid, "p5_found": p5_found}
SQL = {"p3_found": P3_SQL, "p4_found": P4_SQL, "p5_found": P5_SQL}
