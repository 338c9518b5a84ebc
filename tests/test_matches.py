"""Matches whose chunks have equal names do not touch each other, whatever the type of the chunk."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from tests.test_queries import FOLDER, rows
from trackloom import queries_identity, queries_metrics, queries_more, queries_roster, queries_shape, queries_stats
from trackloom.plans.matches import keyed, split
from trackloom.sources.adapters import Tables

pytestmark = pytest.mark.skipif(not os.path.exists(FOLDER), reason="no test tables")
MAKES = {k: m for q in (queries_shape, queries_metrics, queries_identity, queries_stats, queries_more, queries_roster) for k, m in q.BOOK.makes.items()}
NAMES = [
    "frame_shapes", "possession", "possession_debounced", "possession_smooth", "passes", "turnovers", "possession_spells", "ball_phases", "build_tracks", "link_ball", "smooth_positions",
    "actors", "reject_frames", "camera_segments", "set_pieces", "attacks", "block_spells", "line_gap", "formations", "frame_homographies", "per_second", "keeper_sides", "best_runs", "associated_boxes"]


class Some(Tables):
    """Two chunks of the test tables as one match or as two that differ, under one chunk column."""

    def __init__(self, spark, matches, key):
        super().__init__(spark, FOLDER)
        whole = Tables(spark, FOLDER)

        def made(df, x):
            parts = [df.where(f"chunk = {0 if m == 'a' else 3}").withColumns({"chunk": F.lit(5).cast("long"), "match_id": F.lit(m)}) for m in matches]
            out = parts[0]
            for p in parts[1:]:
                out = out.unionByName(p)
            return keyed(out) if key else out.drop("match_id")

        self.__dict__["pos"], self.__dict__["ball"] = made(whole.pos, "pitch_x"), made(whole.ball, "x")


@pytest.mark.parametrize("name", NAMES)
def test_two_matches_are_the_union_of_both(spark, name):
    both = split(MAKES[name](Some(spark, "ab", True)))
    assert both.schema["chunk"].dataType.simpleString() == "string"
    for m in "ab":
        got = both.where(F.col("match_id") == m).drop("match_id", "chunk").toPandas()
        assert rows(got) == rows(MAKES[name](Some(spark, m, False)).drop("chunk").toPandas())


def test_keys_split_again(spark):
    df = spark.createDataFrame([("m/1", "c/2", 1), ("m", "x\x1fy", 2), (None, "c", 3), ("m", None, 4)], "match_id string, chunk string, v int")
    assert sorted(tuple(r) for r in split(keyed(df)).collect()) == [("m", "x\x1fy", 2), ("m/1", "c/2", 1)]
