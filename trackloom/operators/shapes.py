"""Prototypes of team shapes: k-means over sliced embeddings that are made anew in every pass from the packed places."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.functions import pitch as P
from trackloom.plans.cut import cut

ROWS = 1024
_PACKED = "n int, draws binary, places binary"


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (draw, places) as one row for each number of places: compressed x of all rows, then y."""
    for b in batches:
        size = b.column(1).value_lengths().to_numpy()
        first = np.cumsum(size) - size
        flat = b.column(1).flatten()
        xy = [flat.field(i).to_numpy() for i in range(2)]
        draw, out = b.column(0).to_numpy(), []
        for n in np.unique(size):
            at = np.flatnonzero(size == n)
            places = np.stack([v[first[at][:, None] + np.arange(n)] for v in xy])
            out.append((int(n), draw[at].tobytes(), pa.compress(places.tobytes(), "zstd", asbytes=True)))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], ["n", "draws", "places"])


def weights(n: int, quantiles: int) -> np.ndarray:
    """What each of n sorted values counts for in each interpolated quantile."""
    at = (np.arange(quantiles) + 0.5) / quantiles * (n - 1)
    low = np.minimum(np.floor(at).astype(int), max(n - 2, 0))
    w, part = np.zeros((quantiles, n)), at - low
    w[np.arange(quantiles), low] = 1 - part
    w[np.arange(quantiles), np.minimum(low + 1, n - 1)] += part
    return w


def _sorted(batches: Iterator[pa.RecordBatch], directions: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(n, draws, sorted projections of the centred places by row and direction) of at most ROWS rows at a time."""
    a = np.pi * np.arange(directions) / directions
    turn = np.stack([np.cos(a), np.sin(a)])
    for b in batches:
        for r in b.to_pylist():
            n, draws = r["n"], np.frombuffer(r["draws"], np.int64)
            xy = np.frombuffer(pa.decompress(r["places"], 16 * n * len(draws), "zstd", asbytes=True)).reshape(2, len(draws), n)
            for i in range(0, len(draws), ROWS):
                x, y = (v - v.mean(axis=1, keepdims=True) for v in xy[:, i : i + ROWS])
                s = x[:, None, :] * turn[0][:, None] + y[:, None, :] * turn[1][:, None]
                s.sort(axis=2)
                yield n, draws[i : i + ROWS], s


def _uniform(draws: np.ndarray, seed: int) -> np.ndarray:
    h = (draws.view(np.uint64) ^ np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((h ^ (h >> np.uint64(29))) >> np.uint64(11)).astype(np.float64) / 2.0**53 + 2.0**-54


def _draw(centres: np.ndarray | None, directions: int, quantiles: int, seed: int):
    """The row of a task that comes first if each waits in inverse proportion to its squared distance to the nearest centre."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = (np.inf, None)
        for n, draws, s in _sorted(batches, directions):
            e = (s @ weights(n, quantiles).T).reshape(len(s), -1)
            d = np.ones(len(s))
            if centres is not None:
                own = (e * e).sum(axis=1)
                d = (own[:, None] - 2 * e @ centres.T + (centres * centres).sum(axis=1)).min(axis=1)
                d[d < 1e-9 * own + 1e-12] = 0.0
            with np.errstate(divide="ignore"):
                wait = -np.log(_uniform(draws, seed)) / d
            i = int(np.argmin(wait))
            best = min(best, (float(wait[i]), e[i]), key=lambda b: b[0])
        if best[1] is not None:
            yield pa.RecordBatch.from_arrays([pa.array([best[0]]), pa.array([best[1].tolist()], pa.list_(pa.float64()))], ["wait", "e"])

    return run


def _sums(centres: np.ndarray, directions: int, quantiles: int):
    """Rows of a task and sums of their embeddings by nearest centre."""
    k, half = len(centres), (centres * centres).sum(axis=1) / 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total, scorers, sums = np.zeros(k, np.int64), np.zeros((k, directions, quantiles)), {}, {}
        for n, _, s in _sorted(batches, directions):
            if n not in scorers:
                # embeddings are linear in the sorted projections, so neither distances nor sums need them
                scorers[n] = (centres.reshape(k, directions, quantiles) @ weights(n, quantiles)).reshape(k, -1).T.copy()
                sums[n] = np.zeros((k, directions * n))
            flat = s.reshape(len(s), -1)
            near = np.argmax(flat @ scorers[n] - half, axis=1)
            one = (near == np.arange(k)[:, None]).astype(np.float64)
            sums[n] += one @ flat
            count += np.bincount(near, minlength=k)
        for n, v in sums.items():
            total += v.reshape(k, directions, n) @ weights(n, quantiles).T
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k)), pa.array(count), pa.array(total.reshape(k, -1).tolist(), pa.list_(pa.float64()))], ["cluster", "n", "total"])

    return run


def shape_prototypes(pos: DataFrame, dirs: DataFrame, k: int, *, directions: int = 24, quantiles: int = 12, least: int = 4, rounds: int = 20, tolerance: float = 1e-4, seed: int = 1) -> DataFrame:
    """(cluster, centre, weight): k-means of the sliced embeddings of all teams and frames, with the share of each centre.

    An embedding is many times as large as the places it comes from, so the places are kept, packed, and every pass
    makes the embeddings again.  First centres are drawn by squared distance from all rows (k-means++).
    """
    p = pos.where("role IN ('player', 'goalkeeper') AND pitch_x IS NOT NULL AND pitch_y IS NOT NULL").join(dirs, ["chunk", "team"])
    place = F.struct(P.advance("pitch_x", "dir").cast("double").alias("x"), P.across("pitch_y", "dir").cast("double").alias("y"))
    g = p.groupBy("chunk", "frame", "team").agg(F.collect_list(place).alias("l")).where(F.size("l") >= least)
    packed = cut(g.select(F.xxhash64("chunk", "frame", "team").alias("draw"), "l").mapInArrow(_pack, _PACKED))
    spark, centres = pos.sparkSession, None
    for step in range(k):
        rows = [r for r in packed.mapInArrow(_draw(centres, directions, quantiles, 1000 * seed + step), "wait double, e array<double>").collect() if np.isfinite(r["wait"])]
        if not rows:
            break
        e = np.array(min(rows, key=lambda r: (r["wait"], r["e"]))["e"])[None]
        centres = e if centres is None else np.concatenate([centres, e])
    schema = "cluster int, centre array<double>, weight double"
    if centres is None:
        return spark.createDataFrame([], schema)
    for i in range(rounds + 1):
        count, total = np.zeros(len(centres)), np.zeros_like(centres)
        for r in packed.mapInArrow(_sums(centres, directions, quantiles), "cluster long, n long, total array<double>").toLocalIterator():
            count[r["cluster"]] += r["n"]
            total[r["cluster"]] += r["total"]
        was, centres = centres, np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centres)
        if np.sqrt(((centres - was) ** 2).sum(axis=1)).max() <= tolerance:
            break
    return spark.createDataFrame([(j, c.tolist(), float(n / count.sum())) for j, (c, n) in enumerate(zip(centres, count, strict=True)) if n], schema)
