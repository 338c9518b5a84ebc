"""Readers and writers of the formats the pipeline exchanges."""

from __future__ import annotations

import json
import re

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POSITIONS = "chunk string, frame long, track_id long, role string, team int, pitch_x double, pitch_y double, image_x double, image_y double, conf double, calib_error_m double, is_actor boolean, is_keeper boolean"
REGISTRY = "ord int, match_id string, teams array<string>, aligned string, ball_dir string, roster string, competition string, home_team string, away_team string, manager string, date date"


def read_positions(spark: SparkSession, path: str) -> DataFrame:
    """Positions with every optional column, NaN turned into null at the scan."""
    df = spark.read.parquet(path)
    have = set(df.columns)
    cols = []
    for f in spark.createDataFrame([], POSITIONS).schema.fields:
        c = F.col(f.name).cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)
        cols.append((F.when(~F.isnan(c), c) if f.dataType.typeName() == "double" else c).alias(f.name))
    return df.select(*cols)


def empty_positions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], POSITIONS)


def write_positions(df: DataFrame, path: str) -> None:
    """Parquet partitioned by chunk, so that scans of one chunk prune the others."""
    df.repartition("chunk").write.mode("overwrite").partitionBy("chunk").parquet(path)


def read_registry(spark: SparkSession, text: str) -> DataFrame:
    """One row per match of a YAML registry, in its order; dates become dates, missing keys null."""
    data = yaml.safe_load(text) or {}
    rows = []
    for i, (k, v) in enumerate((data.get("matches") or data).items()):
        get = v.get
        rows.append((i, str(k), [str(x) for x in get("teams") or []], get("aligned"), get("ball_dir"), get("roster"), get("competition"), get("home_team"), get("away_team"), get("manager"), str(get("date")) if get("date") else None))
    raw = spark.createDataFrame(rows, REGISTRY.replace("date date", "date string"))
    return raw.withColumn("date", F.col("date").try_cast("date"))


def get_match(registry: DataFrame, match_id: str) -> DataFrame:
    """The match's row; an unknown id raises KeyError with the known ones."""
    row = registry.where(F.col("match_id") == match_id)
    if row.isEmpty():
        raise KeyError(f"{match_id}: known are {', '.join(sorted(r[0] for r in registry.select('match_id').limit(1000).collect()))}")
    return row


def by_manager(registry: DataFrame, manager: str) -> DataFrame:
    return registry.where(F.col("manager") == manager).orderBy("ord")


def read_clicks(spark: SparkSession, path: str) -> DataFrame:
    """Ball clicks from CSV (frame, x, y, visible); coordinates of invisible ones are null."""
    df = spark.read.schema("frame long, x double, y double, visible int").option("header", True).csv(path)
    return df.withColumns({c: F.when(F.col("visible") == 1, F.col(c)) for c in ("x", "y")})


def read_wide(spark: SparkSession, path: str, *, skip: int = 3, length: float = 105.0, width: float = 68.0) -> DataFrame:
    """Long rows (period, frame, time_s, slot, x, y) in metres of a wide CSV: period, frame, time, then an x and a y column per player in shares of the pitch.

    Banner rows before the first numeric period are skipped; blanks are null.
    """
    raw = spark.read.option("header", False).csv(path)
    names = raw.columns
    raw = raw.where(F.col(names[0]).rlike(r"^\s*\d+\s*$")) if skip else raw
    num = lambda c: F.col(c).try_cast("double")
    pairs = [F.struct(F.lit(i).alias("slot"), (num(names[3 + 2 * i]) * length).alias("x"), (num(names[4 + 2 * i]) * width).alias("y")) for i in range((len(names) - 3) // 2)]
    return raw.select(num(names[0]).cast("int").alias("period"), num(names[1]).cast("long").alias("frame"), num(names[2]).alias("time_s"), F.explode(F.array(*pairs)).alias("p")).select("period", "frame", "time_s", "p.*")


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """(image_id, track_id, role, team, jersey, x, y) of nested JSON annotations of people."""
    schema = "annotations array<struct<image_id:string,track_id:long,attributes:struct<role:string,team:string,jersey:string>,bbox_pitch:struct<x_bottom_middle:double,y_bottom_middle:double>>>"
    df = spark.read.schema(schema).option("multiLine", True).json(path)
    a = df.select(F.explode("annotations").alias("a"))
    return a.select("a.image_id", "a.track_id", "a.attributes.role", "a.attributes.team", "a.attributes.jersey", F.col("a.bbox_pitch.x_bottom_middle").alias("x"), F.col("a.bbox_pitch.y_bottom_middle").alias("y")).where("role IN ('player', 'goalkeeper')")


def number(c: str):
    """A number with thousands separators; anything else is null."""
    return F.regexp_replace(F.col(c), ",", "").try_cast("double")


def parse_percentages(df: DataFrame, text: str) -> DataFrame:
    """(label, home, away) of lines 'Label 12.5% 30%'."""
    line = df.select(F.explode(F.split(text, "\n")).alias("line"))
    pattern = r"^\s*([A-Za-z][A-Za-z \-]*?)\s+(\d+(?:\.\d+)?)\s*%\s+(\d+(?:\.\d+)?)\s*%"
    part = lambda i: F.regexp_extract("line", pattern, i)
    return line.where(F.col("line").rlike(pattern)).select(part(1).alias("label"), part(2).cast("double").alias("home"), part(3).cast("double").alias("away"))


def write_document(df: DataFrame, path: str) -> None:
    """JSON lines, non-finite numbers as null."""
    clean = [F.when(~F.isnan(f.name) & (F.abs(f.name) < float("inf")), F.col(f.name)).alias(f.name) if f.dataType.typeName() in ("double", "float") else F.col(f.name) for f in df.schema.fields]
    df.select(*clean).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def read_documents(spark: SparkSession, path: str) -> list[dict]:
    """Few small documents, as the report layer wants them."""
    return [json.loads(r[0]) for r in spark.read.text(path).toLocalIterator()]


def survivor_fields(name: str) -> tuple[int, int, int] | None:
    """(track, frame, index) of an image file name such as 't12_f340_2.png'."""
    m = re.match(r"t(\d+)_f(\d+)_(\d+)\.\w+$", name)
    return tuple(map(int, m.groups())) if m else None
