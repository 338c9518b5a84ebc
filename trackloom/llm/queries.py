"""Queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.llm.components import group_records, vertex_number, vertex_text
from trackloom.llm.leaks import find_leaks
from trackloom.llm.nearest import nearest_in_time
from trackloom.llm.stuffed import stuffed_pages
from trackloom.llm.tokens import encode_texts


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    tracks = table(spark, sf, "fragments").select(F.concat("match_id", F.lit("/"), "chunk").alias("seq"), "track_id")
    records = tracks.union(table(spark, sf, "queue_items").select("seq", "track_id"))
    groups = group_records(records, table(spark, sf, "relink_pairs").where("verdict = 'same'"))
    return groups.select(
        vertex_text("node").alias("seq"), vertex_number("node").alias("track_id"),
        vertex_text("root").alias("group_seq"), vertex_number("root").alias("group_track_id"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    near = nearest_in_time(table(spark, sf, "carrier_labels"), table(spark, sf, "ball_clicks"), left_id="label_id", right_id="click_id", by=["match_id", "chunk"], time="frame", tolerance=12)
    return near.select("label_id", "click_id")


def p6_ids(spark: SparkSession, sf: str) -> DataFrame:
    return encode_texts(table(spark, sf, "documents"))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return find_leaks(table(spark, sf, "documents"), table(spark, sf, "bench_items")).select("doc_id", "item_id")


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return stuffed_pages(table(spark, sf, "documents"), lang="lang").select("doc_id").distinct()


QUERIES = {"p1_found": p1_found, "p2_found": p2_found, "p6_ids": p6_ids, "p7_found": p7_found, "p8_found": p8_found}
