"""Irregular readings onto a regular grid, gaps filled by low-rank factorisation.

The matrix has one row per source and one column per period.  It is stored as one row per (source, segment of ``SEG``
periods), so a long source spreads over many rows.  Alternating least squares solves each source's factors from sums over
its segments and each period's factors from sums over the sources, so neither side is ever whole in one task: sums of a
segment are made per partition first, segments that many sources share are spread by a salt.  Observed cells keep their
value; a missing cell is filled if its source and its period have enough other readings, else marked 'unsupported'.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackloom.plans.cut import cut
from trackloom.plans.joins import BROADCAST_ROWS, null_safe_join

SEG = 64
#: Segments whose factors may be broadcast, of a few KB each.
FEW = 5000
#: Partitions a segment's sources are spread over, and segments whose sums a task holds at a time.
SALT, HELD = 16, 2000


def _dense(batch: pa.RecordBatch, channels: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Observed flags and values, each rows x SEG."""
    lists = batch.column("cells")
    n = batch.num_rows
    ends = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    flat = lists.flatten()
    row = np.repeat(np.arange(n), np.diff(ends))
    slot = flat.field("slot").to_numpy(zero_copy_only=False)
    seen = np.zeros((n, SEG), bool)
    seen[row, slot] = True
    vals = []
    for c in range(channels):
        v = np.full((n, SEG), np.nan)
        v[row, slot] = flat.field(f"v{c}").to_numpy(zero_copy_only=False)
        vals.append(v)
    return seen, vals


def _lists(batch: pa.RecordBatch, name: str, width: int) -> np.ndarray:
    """A list column as rows x width; NaN where it is null."""
    col, out = batch.column(name), np.full((batch.num_rows, width), np.nan)
    out[~np.asarray(col.is_null())] = col.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    return out


def _as_lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))


def _centred(batch: pa.RecordBatch, channels: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Usable cells and their values in units of the source's deviation from its mean, zeros elsewhere, per channel."""
    mean, size = _lists(batch, "mean", channels), _lists(batch, "size", channels)
    out = []
    for c, v in enumerate(_dense(batch, channels)[1]):
        use = np.isfinite(v)
        out.append((use, np.where(use, (np.where(use, v, 0) - mean[:, c : c + 1]) / size[:, c : c + 1], 0)))
    return out


def start(seg: np.ndarray, channels: int, rank: int) -> np.ndarray:
    """Period factors before the first round, the same for a period wherever it is computed: rows x channels x SEG x rank."""
    at = (seg[:, None].astype(np.uint64) * np.uint64(SEG) + np.arange(SEG, dtype=np.uint64))[:, None, :, None]
    k = np.arange(1, channels * rank + 1, dtype=np.uint64).reshape(channels, 1, rank)
    h = (at * np.uint64(0x9E3779B97F4A7C15)) ^ (k * np.uint64(0xBF58476D1CE4E5B9))
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0x94D049BB133111EB)
    return (h >> np.uint64(11)).astype(float) / 2.0**52 - 1


def _source_sums(channels: int, rank: int, first: bool):
    """Each row's share of its source's equations: per channel the products and values of a constant and ``rank`` factors."""
    r = rank + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            n = b.num_rows
            v = start(b.column("seg").to_numpy(), channels, rank) if first else np.nan_to_num(_lists(b, "v", channels * SEG * rank)).reshape(n, channels, SEG, rank)
            out = np.zeros((n, channels, r * r + r))
            for c, (use, y) in enumerate(_centred(b, channels)):
                f = np.concatenate([np.ones((n, SEG, 1)), v[:, c]], axis=2) * use[:, :, None]
                out[:, c, : r * r] = (f.transpose(0, 2, 1) @ f).reshape(n, -1)
                out[:, c, r * r :] = (y[:, None, :] @ f)[:, 0]
            keys = [b.column(i) for i in range(b.num_columns) if b.schema.names[i].startswith("k")]
            names = [x for x in b.schema.names if x.startswith("k")]
            flat = out.reshape(n, -1)
            yield pa.RecordBatch.from_arrays([*keys, *(pa.array(flat[:, i]) for i in range(flat.shape[1]))], [*names, *(f"s{i}" for i in range(flat.shape[1]))])

    return run


def _solve(sums: np.ndarray, rank: int, ridge: float) -> np.ndarray:
    """... x (rank^2 + rank) sums to ... x rank factors."""
    a = sums[..., : rank * rank].reshape(*sums.shape[:-1], rank, rank) + ridge * np.eye(rank)
    return np.linalg.solve(a, sums[..., rank * rank :, None])[..., 0]


def _period_sums(channels: int, rank: int):
    """Sums of the equations of each segment's periods over the rows of a partition, with the number of sources that read each period."""
    w = rank * rank + rank + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), _as_lists(np.stack([x.ravel() for x in held.values()]))], ["seg", "sums"])

        for b in batches:
            if not b.num_rows:
                continue
            u = np.nan_to_num(_lists(b, "u", channels * (rank + 1))).reshape(-1, channels, rank + 1)
            segs, which = np.unique(b.column("seg").to_numpy(), return_inverse=True)
            cells = _centred(b, channels)
            for i, seg in enumerate(segs.tolist()):
                mine = np.flatnonzero(which == i)
                total = held.setdefault(seg, np.zeros((channels, SEG, w)))
                for c, (use, y) in enumerate(cells):
                    f = u[mine, c, 1:]
                    seen = use[mine].T.astype(float)
                    total[c, :, : rank * rank] += seen @ (f[:, :, None] * f[:, None, :]).reshape(len(mine), -1)
                    total[c, :, rank * rank : -1] += (y[mine] - u[mine, c, :1] * use[mine]).T @ f
                    total[c, :, -1] += seen.sum(1)
            if len(held) >= HELD:
                yield out()
                held.clear()
        if held:
            yield out()

    return run


def _period_factors(channels: int, rank: int, ridge: float):
    """Factors and numbers of sources of one segment's periods, from the sums of the partitions."""

    def run(table: pa.Table) -> pa.Table:
        col = table.column("sums").combine_chunks()
        total = col.flatten().to_numpy().reshape(len(col), -1).sum(0).reshape(channels, SEG, -1)
        v = _solve(total[..., :-1], rank, ridge)
        return pa.table({"seg": table.column("seg")[:1], "v": _as_lists(v.reshape(1, -1)), "sources": _as_lists(total[..., -1].reshape(1, -1))})

    return run


def factorise(rows: DataFrame, about: DataFrame, ks: Sequence[str], channels: int, *, rank: int, rounds: int, ridge: float) -> tuple[DataFrame, DataFrame]:
    """(``about``, u) and (seg, v, sources): constant and factors of sources, factors of periods; to be broadcast only if counted few, from rows of keys, seg, cells, mean and size."""
    r = rank + 1
    w = r * r + r
    keys = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in ks)
    names = [f"s{i}" for i in range(channels * w)]
    few = lambda c, most: (lambda d: F.broadcast(d)) if rows.select(*c).distinct().limit(most + 1).count() <= most else (lambda d: d)
    by_source, by_seg = few(ks, BROADCAST_ROWS), few(["seg"], FEW)
    v = None

    def solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                sums = np.stack([b.column(x).to_numpy() for x in names], axis=1).reshape(-1, channels, w)
                yield pa.RecordBatch.from_arrays([*(b.column(k) for k in ks), _as_lists(_solve(sums, r, ridge).reshape(b.num_rows, -1))], [*ks, "u"])

    for i in range(rounds):
        held = rows if v is None else null_safe_join(rows, by_seg(v.select("seg", "v")), ["seg"])
        cells = held.select(*ks, "seg", "cells", "mean", "size", *([] if v is None else ["v"]))
        sums = cells.mapInArrow(_source_sums(channels, rank, v is None), f"{keys}, " + ", ".join(f"{x} double" for x in names))
        u = cut(sums.groupBy(*ks).agg(*(F.sum(x).alias(x) for x in names)).mapInArrow(solved, f"{keys}, u array<double>"))
        part = null_safe_join(rows, by_source(u), ks).select("seg", "cells", "mean", "size", "u").mapInArrow(_period_sums(channels, rank), "seg long, sums array<double>")
        v = cut(part.groupBy("seg").applyInArrow(_period_factors(channels, rank, ridge), "seg long, v array<double>, sources array<double>"))
    return by_source(null_safe_join(about, u, ks)), by_seg(v)


def _emit(names: list[str], channels: int, rank: int, need: int, only_missing: bool, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            seen, vals = _dense(b, channels)
            slots = np.arange(SEG)
            inside = (slots >= b.column("from_slot").to_numpy()[:, None]) & (slots <= b.column("to_slot").to_numpy()[:, None])
            row, slot = np.nonzero(inside & ~seen if only_missing else inside)
            u = _lists(b, "u", channels * (rank + 1)).reshape(-1, channels, rank + 1)
            v = _lists(b, "v", channels * SEG * rank).reshape(-1, channels, SEG, rank)
            others = np.nan_to_num(_lists(b, "sources", channels * SEG)).reshape(-1, channels, SEG)
            mean, size, read = (_lists(b, x, channels) for x in ("mean", "size", "read"))
            fill = mean[:, :, None] + size[:, :, None] * (u[..., :1] + (v @ u[..., 1:, None])[..., 0])
            ok = ((np.nan_to_num(read)[:, :, None] >= need) & (others >= need) & np.isfinite(fill)).all(axis=1)
            state = np.where(seen, 0, np.where(ok, 1, 2))
            st = pa.array(np.array(["observed", "filled", "unsupported"], dtype=object)[state[row, slot]], pa.string())
            period = b.column("seg").to_numpy()[row] * SEG + slot
            missing = state[row, slot] == 2
            cols = [b.column(k).take(pa.array(row)) for k in names] + [pa.array(period), st]
            cols += [pa.array(np.where(seen, x, fill[:, c])[row, slot], mask=missing) for c, x in enumerate(vals)]
            yield pa.RecordBatch.from_arrays(cols, schema=schema)

    return run


def _whole_holes(segs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds has_prev, next_seg by windows over blocks of segments, then over one row per block."""
    inner = Window.partitionBy(*keys, "blk").orderBy("seg")
    over = Window.partitionBy(*keys).orderBy("blk")
    segs = segs.withColumn("blk", F.expr("(seg - pmod(seg, 4096L)) div 4096L"))
    segs = segs.withColumn("p", F.lag("seg").over(inner)).withColumn("q", F.lead("seg").over(inner))
    ends = segs.groupBy(*keys, "blk").agg(F.min("seg").alias("a"), F.max("seg").alias("z"))
    ends = ends.withColumn("pz", F.lag("z").over(over)).withColumn("na", F.lead("a").over(over))
    both = null_safe_join(segs, ends.drop("a", "z"), [*keys, "blk"], "left")
    return both.withColumn("has_prev", F.coalesce("p", "pz").isNotNull()).withColumn("next_seg", F.coalesce("q", "na")).drop("p", "q", "pz", "na", "blk")


def regular_grid(df: DataFrame, keys: Sequence[str], time: str, values: Sequence[str], width: int, *, rank: int = 2, rounds: int = 4, ridge: float = 0.05, only_missing: bool = False) -> DataFrame:
    """(keys, period, state, values): every period between the first and the last one with a reading.

    Rows whose time is null or whose first value is null or NaN are no readings; infinite values are readings
    but teach the factors nothing.  A period's value is the mean of its readings, repeated rows included; state is
    'observed', 'filled' (the source has 2 x rank finite readings and as many sources read the period) or
    'unsupported' (then the values are null).  An empty input gives no rows.
    Key columns may be null; other columns may clash and are not read.
    """
    ks, vs = [f"k{i}" for i in range(len(keys))], [f"v{i}" for i in range(len(values))]
    r = df.select(*(F.col(k).alias(a) for k, a in zip(keys, ks, strict=True)), F.expr(f"({time} - pmod({time}, {width}L)) div {width}L").alias("period"), *(F.col(v).cast("double").alias(a) for v, a in zip(values, vs, strict=True)))
    r = r.where(" and ".join(["period is not null", *(f"{v} is not null and not isnan({v})" for v in vs)]))
    cells = r.groupBy(*ks, "period").agg(*(F.avg(v).alias(v) for v in vs))
    cells = cells.withColumn("seg", F.expr(f"(period - pmod(period, {SEG}L)) div {SEG}L")).withColumn("slot", F.expr(f"cast(pmod(period, {SEG}L) as int)"))
    fine = {v: F.when(F.abs(v) < float("inf"), F.col(v)) for v in vs}
    moments = [f(fine[v]).alias(f"{n}{v}") for v in vs for n, f in (("n", F.count), ("a", F.sum), ("q", lambda c: F.sum(c * c)))]
    segs = cells.groupBy(*ks, "seg").agg(F.collect_list(F.struct("slot", *vs)).alias("cells"), F.min("slot").alias("lo"), F.max("slot").alias("hi"), *moments)
    segs = cut(_whole_holes(segs, ks))
    total = lambda n, v: F.sum(f"{n}{v}")
    means = [F.coalesce(F.try_divide(total("a", v), total("n", v)), F.lit(0.0)) for v in vs]
    # a source that never varies has no deviation to divide by
    sizes = [F.greatest(F.sqrt(F.greatest(F.coalesce(F.try_divide(total("q", v), total("n", v)), F.lit(0.0)) - m * m, F.lit(0.0))), F.abs(m) * 1e-9, F.lit(1e-9)) for v, m in zip(vs, means, strict=True)]
    about = cut(segs.groupBy(*ks).agg(F.array(*means).alias("mean"), F.array(*sizes).alias("size"), F.array(*(total("n", v).cast("double") for v in vs)).alias("read")))
    rows = cut(null_safe_join(segs.select(*ks, "seg", "cells"), about, ks).withColumn("salt", F.pmod(F.xxhash64(*ks), F.lit(SALT))).repartition("seg", "salt").drop("salt", "read"))
    sources, periods = factorise(rows, about, ks, len(vs), rank=rank, rounds=rounds, ridge=ridge)
    own = segs.select(*ks, "seg", "cells", F.when(F.col("has_prev"), 0).otherwise(F.col("lo")).alias("from_slot"), F.when(F.col("next_seg").isNotNull(), SEG - 1).otherwise(F.col("hi")).alias("to_slot"))
    hole = segs.where("next_seg > seg + 1").select(*ks, "next_seg", F.explode(F.expr("sequence(seg + 1, next_seg - 1, 4096L)")).alias("s"))
    none = F.array().cast(segs.schema["cells"].dataType)
    hole = hole.select(*ks, F.explode(F.expr("sequence(s, least(s + 4095, next_seg - 1))")).alias("seg"), none.alias("cells"), F.lit(0).alias("from_slot"), F.lit(SEG - 1).alias("to_slot"))
    kinds = {f.name: f.dataType for f in segs.schema.fields}
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructType

    arrow = pa.schema([(k, to_arrow_type(kinds[k])) for k in ks] + [("period", pa.int64()), ("state", pa.string())] + [(v, pa.float64()) for v in vs])
    schema = StructType()
    for k in ks:
        schema = schema.add(k, kinds[k])
    schema = schema.add("period", "long").add("state", "string")
    for x in vs:
        schema = schema.add(x, "double")
    every = null_safe_join(null_safe_join(own.union(hole), sources, ks, "left"), periods, ["seg"], "left")
    out = every.mapInArrow(_emit(ks, len(vs), rank, 2 * rank, only_missing, arrow), schema)
    return out.select(*(F.col(a).alias(k) for k, a in zip(keys, ks, strict=True)), "period", "state", *(F.col(a).alias(v) for v, a in zip(values, vs, strict=True)))
