"""Position, ball and possession relations derived from the star-schema tables, in SQL that Spark and other engines read alike."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

POS = """SELECT chunk, frame, track_id, role, CASE WHEN role IN ('ball', 'referee') THEN -1 ELSE CAST(track_id % 2 AS INT) END AS team,
  CASE WHEN hidden THEN NULL ELSE px END AS pitch_x, CASE WHEN hidden THEN NULL ELSE py END AS pitch_y, image_x, image_y, conf, calib_error_m
FROM (
  SELECT CAST(f % 8 AS BIGINT) AS chunk, CAST((f - f % 8) / 8 * 5 AS BIGINT) AS frame, track_id,
    CASE WHEN track_id = 28 THEN 'ball' WHEN track_id = 21 THEN 'referee' WHEN track_id IN (1, 8) THEN 'goalkeeper' ELSE 'player' END AS role,
    CAST((l_partkey * 7919 + l_suppkey * 31) % 10701 AS DOUBLE) / 100 - 1 AS px, CAST((l_partkey * 104729 + l_suppkey * 17) % 7001 AS DOUBLE) / 100 - 1 AS py,
    CAST((l_partkey * 12289) % 1920 AS DOUBLE) AS image_x, CAST((l_suppkey * 24593) % 1080 AS DOUBLE) AS image_y,
    0.5 + l_tax * 5 AS conf, l_discount * 20 AS calib_error_m, l_linenumber % 5 = 0 AND l_quantity > 40 AS hidden
  FROM (
    SELECT *, CAST((l_orderkey - l_orderkey % 4) / 4 AS BIGINT) AS f, CAST((l_orderkey % 4) * 7 + l_linenumber AS BIGINT) AS track_id,
      row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax) AS k
    FROM {lineitem}) a
  WHERE k = 1) b"""

BALL = """SELECT CAST(f % 8 AS BIGINT) AS chunk, CAST((f - f % 8) / 8 * 5 AS BIGINT) AS frame,
  CAST(CAST(floor(min(o_totalprice) * 100) AS BIGINT) % 10501 AS DOUBLE) / 100 AS x, CAST(CAST(floor(max(o_totalprice) * 100) AS BIGINT) % 6801 AS DOUBLE) / 100 AS y
FROM (SELECT *, CAST((o_orderkey - o_orderkey % 4) / 4 AS BIGINT) AS f FROM {orders}) a WHERE o_orderpriority <> '1-URGENT' AND o_orderstatus <> 'P'
GROUP BY CAST(f % 8 AS BIGINT), CAST((f - f % 8) / 8 * 5 AS BIGINT)"""

STREAM = """SELECT user_id AS chunk, CAST(floor(epoch_s) AS BIGINT) AS frame, event_id, event_type, value, props,
  CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'purchase' THEN 0 WHEN 'signup' THEN 1 ELSE -1 END AS team FROM (SELECT *, {epoch} AS epoch_s FROM {events}) a"""

#: Relations an oracle may name; each may use those before it.
RADIUS = 12.0
CTES = {
    "pos": POS.replace("{lineitem}", "lineitem"),
    "ball": BALL.replace("{orders}", "orders"),
    "stream": STREAM.replace("{events}", "events").replace("{epoch}", "epoch(ts)"),
    "pl": "SELECT * FROM pos WHERE role IN ('player', 'goalkeeper') AND pitch_x IS NOT NULL AND pitch_y IS NOT NULL",
    "poss": f"""SELECT chunk, frame, carrier, team, dist_m FROM (
      SELECT b.chunk, b.frame, p.track_id AS carrier, p.team, sqrt((p.pitch_x - b.x) ** 2 + (p.pitch_y - b.y) ** 2) AS dist_m,
        row_number() OVER (PARTITION BY b.chunk, b.frame ORDER BY sqrt((p.pitch_x - b.x) ** 2 + (p.pitch_y - b.y) ** 2), p.track_id) AS k
      FROM ball b JOIN pl p ON p.chunk = b.chunk AND p.frame = b.frame) WHERE k = 1 AND dist_m <= {RADIUS}""",
    "keep": "SELECT chunk, team, median(pitch_x) AS m, count(*) AS n FROM pl WHERE role = 'goalkeeper' GROUP BY chunk, team",
    "dirs": """SELECT a.chunk, a.team, CASE WHEN b.team IS NULL OR (a.m < 52.5) <> (b.m < 52.5) OR a.n > b.n OR (a.n = b.n AND a.team < b.team)
      THEN CASE WHEN a.m < 52.5 THEN 1 ELSE -1 END ELSE CASE WHEN a.m < 52.5 THEN -1 ELSE 1 END END AS dir
      FROM keep a LEFT JOIN keep b ON a.chunk = b.chunk AND a.team <> b.team""",
    "turn": """SELECT q.chunk, q.frame, q.lost_team, q.won_team, b.x, b.y FROM (
      SELECT chunk, frame, lag(team) OVER (PARTITION BY chunk ORDER BY frame) AS lost_team, team AS won_team FROM poss) q
      JOIN ball b ON b.chunk = q.chunk AND b.frame = q.frame WHERE lost_team <> won_team""",
    "pass": """SELECT n.chunk, n.frame, n.f_to, n.team, n.carrier AS from_id, n.c_to AS to_id, a.pitch_x AS x0, a.pitch_y AS y0, b.pitch_x AS x1, b.pitch_y AS y1,
      sqrt((b.pitch_x - a.pitch_x) ** 2 + (b.pitch_y - a.pitch_y) ** 2) AS length_m
      FROM (SELECT *, lead(frame) OVER w AS f_to, lead(team) OVER w AS t_to, lead(carrier) OVER w AS c_to FROM poss WINDOW w AS (PARTITION BY chunk ORDER BY frame)) n
      JOIN pl a ON a.chunk = n.chunk AND a.frame = n.frame AND a.track_id = n.carrier JOIN pl b ON b.chunk = n.chunk AND b.frame = n.f_to AND b.track_id = n.c_to
      WHERE t_to = n.team AND c_to <> n.carrier AND f_to - n.frame <= 22""",
}
_NEEDS = {"pl": ["pos"], "poss": ["pl", "ball"], "keep": ["pl"], "dirs": ["keep"], "turn": ["poss"], "pass": ["poss"]}


def oracle(sql: str, *names: str) -> str:
    """SQL with the named relations, and what they need, before it as common table expressions."""
    want: set[str] = set()

    def add(n: str) -> None:
        for m in _NEEDS.get(n, []):
            add(m)
        want.add(n)

    for n in names:
        add(n)
    ctes = ",\n".join(f'"{n}" AS ({CTES[n]})' for n in CTES if n in want)
    sql = sql.strip()
    if sql.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes}, {sql[15:]}"
    return f"WITH {ctes}, {sql[5:]}" if sql.upper().startswith("WITH ") else f"WITH {ctes}\n{sql}"


class Tables:
    """The relations of one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def pos(self) -> DataFrame:
        return self.spark.sql(POS, lineitem=self.read("lineitem"))

    @cached_property
    def ball(self) -> DataFrame:
        return self.spark.sql(BALL, orders=self.read("orders"))

    @cached_property
    def stream(self) -> DataFrame:
        return self.spark.sql(STREAM.replace("{epoch}", "(datediff(CAST(ts AS DATE), DATE'1970-01-01') * 86400L + hour(ts) * 3600 + minute(ts) * 60 + second(ts))"), events=self.read("events"))

    @cached_property
    def players(self) -> DataFrame:
        return self.pos.where("role IN ('player', 'goalkeeper') AND pitch_x IS NOT NULL AND pitch_y IS NOT NULL")

    @cached_property
    def poss(self) -> DataFrame:
        from trackloom.operators.possession import assign_possession

        return assign_possession(self.ball, self.players, radius_m=RADIUS)

    @cached_property
    def dirs(self) -> DataFrame:
        from trackloom.operators.shape import attack_directions

        return attack_directions(self.pos)
