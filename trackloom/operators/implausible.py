"""Spikes, frozen values and impossible readings, judged against each source's own normal behaviour.

Each reading gets features of level, difference (steps, distance to the local median and to the readings around
runs of one to three), season (distance to the mean of its phase in the source) and run length.  An isolation
forest per source and field, grown on the central half of all its readings, scores every reading.  Readings that
score more than ``MARGIN`` of the way from the ``QUANTILE`` of those central readings to 1 are the source's
candidates; of these, jumps and far-off levels are reported if an exact test in units of the source's usual
movement or median absolute deviation confirms them.  Physical limits and frozen runs are explicit rules.

A source of at most ``block`` rows is one group.  Larger sources are numbered in order and cut into blocks with
a halo on either side that decides every feature and rule exactly; medians come from ``exact_median``, season
means from one aggregation, and the forest from counts that blocks add up, in ``ROUNDS`` passes over the
features.  Both ways share features, forest and threshold, so they agree.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackloom.functions import iforest
from trackloom.functions.quantile import exact_median
from trackloom.plans.cut import cut
from trackloom.plans.joins import join_checked, null_safe_join

BLOCK, HALO = 8192, 12
#: Readings whose scores are this part of the way from this quantile of the source's central readings to 1 are candidates.
QUANTILE, MARGIN = 0.98, 0.25
SEASON, PHASES = 1500, 12
#: Season means are sums of whole multiples of this, so that their order does not matter.
GRAIN = 1e-6
#: Passes over the features of large sources: middles, levels, spreads, central half, six levels of the trees, threshold.
ROUNDS = 8


@dataclass(frozen=True)
class Field:
    """x, y, wrong: SQL expressions; a reading is missing where x (or y) is null or NaN, impossible where wrong is true.

    jump: (usual movements a spike is away, usual movements its surroundings may be apart); mad: median absolute
    deviations that are too far; either may be None.  possible: SQL, readings that count for the usual movement.
    """

    name: str
    x: str
    y: str | None = None
    wrong: str = "false"
    possible: str = "true"
    min_run: int = 8
    jump: tuple[float, float] | None = None
    mad: float | None = None


def _steps(x: np.ndarray, y: np.ndarray, gap: int) -> np.ndarray:
    """Distance of each reading to the one ``gap`` before; NaN at the start."""
    out = np.full(len(x), np.nan)
    out[gap:] = np.hypot(x[gap:] - x[:-gap], y[gap:] - y[:-gap]) if len(x) > gap else out[gap:]
    return out


def run_lengths(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Length of the run of equal readings around each reading."""
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
    run = np.cumsum(new) - 1
    return np.bincount(run)[run]


def spike_runs(x: np.ndarray, y: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """For runs of 1, 2, 3: least distance of a member to both neighbours, and the neighbours' distance, by the run's first reading."""
    with np.errstate(invalid="ignore"):
        return [(k, *_spikes(x, y, k)) for k in (1, 2, 3)]


def _spikes(x: np.ndarray, y: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    n = len(x)
    m, g = np.full(n, np.nan), np.full(n, np.nan)
    if n >= k + 2:
        bx, by, ax, ay = x[: n - k - 1], y[: n - k - 1], x[k + 1 :], y[k + 1 :]
        g[1 : n - k] = np.hypot(ax - bx, ay - by)
        least = np.full(n - k - 1, np.inf)
        for j in range(k):
            rx, ry = x[1 + j : n - k + j], y[1 + j : n - k + j]
            least = np.minimum(least, np.minimum(np.hypot(rx - bx, ry - by), np.hypot(rx - ax, ry - ay)))
        m[1 : n - k] = least
    return m, g


def usual_steps(x: np.ndarray, y: np.ndarray, possible: np.ndarray) -> np.ndarray:
    """Distance of each possible reading to the possible one before; NaN elsewhere."""
    out = np.full(len(x), np.nan)
    at = np.flatnonzero(possible)
    out[at[1:]] = np.hypot(np.diff(x[at]), np.diff(y[at]))
    return out


def phase(t: np.ndarray) -> np.ndarray:
    return (t % SEASON) * PHASES // SEASON


def season_mean(v: np.ndarray, t: np.ndarray, good: np.ndarray) -> np.ndarray:
    """Mean of the source's possible, finite readings of the same phase; NaN where there is none."""
    p, good = phase(t), good & (np.abs(v) < 1e6)
    total = np.bincount(p[good], np.rint(v[good] / GRAIN), minlength=PHASES)
    count = np.bincount(p[good], minlength=PHASES)
    with np.errstate(invalid="ignore", divide="ignore"):
        return (total * GRAIN / count)[p]


def features(x: np.ndarray, y: np.ndarray, mx: np.ndarray, my: np.ndarray, spikes: list, halo: int, flat: bool) -> np.ndarray:
    """Level, difference, season and run-length features of each reading, all finite; mx, my are the season means."""
    x, y = (np.clip(np.nan_to_num(v, nan=0.0, posinf=1e6, neginf=-1e6), -1e6, 1e6) for v in (x, y))
    n = len(x)
    before = np.nan_to_num(_steps(x, y, 1))
    after = np.append(before[1:], 0.0)
    ends = lambda v: np.concatenate([np.repeat(v[:1], 4), v, np.repeat(v[-1:], 4)])
    mid = lambda v: np.partition(np.lib.stride_tricks.sliding_window_view(ends(v), 9), 4, axis=1)[:, 4]
    local = np.hypot(x - mid(x), y - mid(y)) if not flat else np.abs(x - mid(x))
    season = np.nan_to_num(np.hypot(x - mx, y - my) if not flat else np.abs(x - mx))
    away = np.zeros(n)
    for k, m, _ in spikes:
        m = np.nan_to_num(m, nan=0.0, posinf=1e6)
        for j in range(k):
            away[j:] = np.maximum(away[j:], m[: n - j])
    run = np.minimum(run_lengths(x, y), halo) if n else np.zeros(0)
    cols = [x, *([] if flat else [y]), before, after, local, season, away, run]
    return np.stack([np.asarray(c, np.float32) for c in cols], axis=1)


def _order(v: np.ndarray) -> np.ndarray:
    """Unsigned numbers in the order of float32 values."""
    b = (v.astype(np.float32) + np.float32(0)).view(np.uint32)
    return np.where(b >> 31, ~b, b | np.uint32(2**31))


def _value(key: np.ndarray) -> np.ndarray:
    key = np.asarray(key).astype(np.uint32)
    return np.where(key >> 31, key & np.uint32(2**31 - 1), ~key).astype(np.uint32).view(np.float32)


def _coarse(v: np.ndarray) -> np.ndarray:
    """The upper half of ``_order``: values to 1 in 128."""
    return (_order(v) >> 16).astype(np.uint16)


def _tally(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(key.astype(np.int64).ravel(), return_counts=True)


def _at(key: np.ndarray, count: np.ndarray, rank: int) -> tuple[int, int]:
    """Key of the value with this rank (from 0), and how many values have smaller keys."""
    upto = np.cumsum(count)
    i = int(np.searchsorted(upto, rank, side="right"))
    return int(key[i]), int(upto[i] - count[i])


class Model:
    """Usual sizes of features, forest, and the score from which a reading is a candidate, of one source and field.

    Everything is taken from all readings: in memory by ``fit``, or in ``ROUNDS`` rounds of ``ask``, which gives counts
    of a part of the readings, and ``tell``, which takes the counts of all parts together.  Medians are the lower
    ones, those of sizes and spreads to 1 in 128.
    """

    def __init__(self, width: int):
        self.round, self.width = 0, width

    @staticmethod
    def fit(feat: np.ndarray) -> tuple[Model, np.ndarray]:
        """The model and the scores of the readings it is taken from."""
        own, n = Model(feat.shape[1]), len(feat)
        rank = (n - 1) // 2
        own._middle(n, np.partition(feat, rank, axis=0)[rank])
        x = own._sized(feat)
        off = np.abs(x - own.center)
        own.spread = own._rough(np.partition(off, rank, axis=0)[rank])
        far = _coarse(own._far(off))
        own._central(np.partition(far, rank)[rank])
        part = x[far <= own.limit]
        grower = iforest.Grower(part.min(axis=0), part.max(axis=0), len(part))
        code = grower.code(part)
        while not grower.done:
            grower.split(grower.count(code))
        own.forest = grower.forest()
        s = iforest.score(own.forest, x)
        mid = s[far <= own.limit]
        rank = own._rank(len(mid))
        own._threshold(int(own._fixed(np.partition(mid, rank)[rank])))
        return own, s

    def ask(self, feat: np.ndarray) -> tuple[np.ndarray, ...]:
        """Keys and counts of a part of the readings, for the central half also least and greatest features by key."""
        column = np.arange(self.width, dtype=np.int64)
        if self.round == 0:
            return _tally(_coarse(feat) + (column << 32))
        if self.round == 1:
            key = _order(feat[:, : self.levels])
            key = key + (column[: self.levels] << 32)
            return _tally(key[key >> 16 == self.bucket + (column[: self.levels] << 16)])
        x = self._sized(feat)
        off = np.abs(x - self.center)
        if self.round == 2:
            return _tally(_coarse(off) + (column << 32))
        far = _coarse(self._far(off))
        if self.round == 3:
            by = np.argsort(far, kind="stable")
            key, first = np.unique(far[by], return_index=True)
            return key.astype(np.int64), np.diff(np.append(first, len(by))), np.minimum.reduceat(x[by], first), np.maximum.reduceat(x[by], first)
        x = x[far <= self.limit]
        if self.round < ROUNDS - 1:
            count = np.zeros(0, np.int64) if self.grower.done or not len(x) else self.grower.count(self.grower.code(x))
            key = np.flatnonzero(count)
            return key, count[key]
        return _tally(self._fixed(iforest.score(self.forest, x)))

    @staticmethod
    def add(parts: Sequence[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
        """Answers of several parts together."""
        if len(parts) == 1:
            return parts[0]
        key = np.concatenate([p[0] for p in parts])
        by = np.argsort(key, kind="stable")
        key, first = np.unique(key[by], return_index=True)
        merged = [f.reduceat(np.concatenate([p[i] for p in parts])[by], first) if len(first) else parts[0][i] for i, f in enumerate((np.add, np.minimum, np.maximum)[: len(parts[0]) - 1], 1)]
        return (key, *merged)

    def tell(self, key: np.ndarray, count: np.ndarray, *ends: np.ndarray) -> None:
        """Answers of all readings."""
        of = lambda c: (key >> 32) == c
        if self.round == 0:
            self.n = int(count[of(0)].sum())
            found = [_at(key[of(c)] & 0xFFFF, count[of(c)], (self.n - 1) // 2) for c in range(self.width)]
            self.bucket, self.below = np.array(found).T[:, : self.levels]
            self.middle = _value(np.array([k for k, _ in found]) << 16)
        elif self.round == 1:
            exact = [_at(key[of(c)] & 0xFFFFFFFF, count[of(c)], (self.n - 1) // 2 - self.below[c])[0] for c in range(self.levels)]
            self._middle(self.n, np.concatenate([_value(np.array(exact)), self.middle[self.levels :]]))
        elif self.round == 2:
            self.spread = _value(np.array([_at(key[of(c)] & 0xFFFF, count[of(c)], (self.n - 1) // 2)[0] for c in range(self.width)]) << 16)
        elif self.round == 3:
            self._central(_at(key, count, (self.n - 1) // 2)[0])
            inside = key <= self.limit
            self.grower = iforest.Grower(ends[0][inside].min(axis=0), ends[1][inside].max(axis=0), int(count[inside].sum()))
        elif self.round < ROUNDS - 1:
            if not self.grower.done:
                whole = np.zeros(self.grower.places, np.int64)
                whole[key] = count
                self.grower.split(whole)
            if self.round == ROUNDS - 2:
                self.forest = self.grower.forest()
                del self.grower
        else:
            self._threshold(_at(key, count, self._rank(int(count.sum())))[0])
        self.round += 1

    def score(self, feat: np.ndarray) -> np.ndarray:
        return iforest.score(self.forest, self._sized(feat))

    @property
    def levels(self) -> int:
        return self.width - 6

    def _rough(self, v: np.ndarray) -> np.ndarray:
        return _value(_order(v) & np.uint32(0xFFFF0000))

    def _middle(self, n: int, middle: np.ndarray) -> None:
        middle = np.concatenate([middle[: self.levels], self._rough(middle[self.levels :])])
        self.n, self.usual = n, np.maximum(middle[-6:-1], np.float32(1e-9))
        self.center = self._sized(middle[None])[0]

    def _sized(self, feat: np.ndarray) -> np.ndarray:
        """Steps and distances as logarithms in units of their usual sizes."""
        x = feat.astype(np.float32)
        x[:, -6:-1] = np.log1p(x[:, -6:-1] / self.usual)
        return x

    def _far(self, off: np.ndarray) -> np.ndarray:
        """Distance from the medians in median absolute deviations of the worst feature."""
        return (off / np.maximum(self.spread, np.float32(1e-9))).max(axis=1)

    def _central(self, limit: int) -> None:
        self.limit = np.uint16(limit)

    @staticmethod
    def _rank(n: int) -> int:
        return max(0, int(np.ceil(QUANTILE * n)) - 1)

    @staticmethod
    def _fixed(score: np.ndarray) -> np.ndarray:
        return np.floor(score * 2**20).astype(np.int64)

    def _threshold(self, usually: int) -> None:
        self.least = usually / 2**20 + MARGIN * (1 - usually / 2**20)


def _number(col: pa.ChunkedArray, what=np.float64) -> np.ndarray:
    if what is bool:
        return np.asarray(col.fill_null(False).to_numpy(), bool)
    return col.to_numpy().astype(what, copy=False)


def _judge(field: Field, x, y, t, possible, halo: int) -> tuple[np.ndarray, ...]:
    """Score, frozen, odd of the readings of a whole source in order."""
    n = len(x)
    if not n:
        return np.zeros(0), np.zeros(0, bool), np.zeros(0, bool)
    flat = field.y is None
    spikes = spike_runs(x, y)
    feat = features(x, y, season_mean(x, t, possible), season_mean(y, t, possible), spikes, halo, flat)
    model, s = Model.fit(feat)
    candidate = s > model.least
    odd = np.zeros(n, bool)
    with np.errstate(invalid="ignore"):
        if field.jump and candidate.any():
            step = usual_steps(x, y, possible)
            step = step[~np.isnan(step)]
            if len(step):
                usual = np.median(step)
                for k, m, g in spikes:
                    at = np.flatnonzero((m > field.jump[0] * usual) & (g <= field.jump[1] * usual))
                    for j in range(k):
                        odd[at + j] = True
        if field.mad is not None and candidate.any():
            off = np.abs(x - np.median(x))
            odd |= off > field.mad * np.median(off)
    return s, run_lengths(x, y) >= field.min_run, odd & candidate


_OUT = "field string, row_key long, score double, impossible boolean, frozen boolean, odd boolean"


def _small(fields: Sequence[Field], names: list[str], types: list[pa.DataType], halo: int, flagged: bool):
    schema = pa.schema(list(zip(names, types, strict=True)) + [("field", pa.string()), ("row_key", pa.int64()), ("score", pa.float64()), ("impossible", pa.bool_()), ("frozen", pa.bool_()), ("odd", pa.bool_())])

    def run(table: pa.Table) -> pa.Table:
        rk = _number(table.column("rk"), np.int64)
        by = np.argsort(rk, kind="stable")
        first = np.flatnonzero(np.append(True, np.diff(rk[by]) != 0))
        # a record is the least order and the greatest of each other column of its copies
        one = (lambda v, f: f.reduceat(v[by], first)) if len(first) < len(rk) else (lambda v, f: v[by])
        rk = rk[by[first]]
        there = one(~_nulls(table.column("o")), np.logical_or)
        o = one(np.where(_nulls(table.column("o")), np.iinfo(np.int64).max, _number(table.column("o").fill_null(0), np.int64)), np.minimum)
        order = np.lexsort((rk, o))
        parts = []
        for i, f in enumerate(fields):
            x = one(_number(table.column(f"x{i}")), np.fmax)
            y = one(_number(table.column(f"y{i}")), np.fmax) if f.y else np.zeros(len(x))
            wrong, possible = (one(_number(table.column(f"{c}{i}"), bool), np.logical_or) for c in "wp")
            read = ~(np.isnan(x) | np.isnan(y))
            at = order[(read & there)[order]]
            s, frozen, odd = _judge(f, x[at], y[at], o[at], possible[at], halo)
            loose = np.flatnonzero(read & ~there & wrong)
            at = np.concatenate([at, loose])
            none = np.zeros(len(loose), bool)
            s, frozen, odd = np.concatenate([s, np.ones(len(loose))]), np.concatenate([frozen, none]), np.concatenate([odd, none])
            keep = np.flatnonzero(wrong[at] | frozen | odd) if flagged else np.arange(len(at))
            key = [pa.repeat(table.column(k)[0], len(keep)) for k in names]
            parts.append(pa.Table.from_arrays([*key, pa.repeat(f.name, len(keep)), pa.array(rk[at[keep]]), pa.array(s[keep]), pa.array(wrong[at[keep]]), pa.array(frozen[keep]), pa.array(odd[keep])], schema=schema))
        return pa.concat_tables(parts)

    return run


def _nulls(col: pa.ChunkedArray) -> np.ndarray:
    return np.asarray(col.is_null().to_numpy(), bool)


def _measure(fields: Sequence[Field], block: int, halo: int):
    """Features, undecided spikes and first answers of one block of a large source; rows around it are dropped."""
    by = {f.name: f for f in fields}
    schema = pa.schema([("source", pa.int64()), ("field", pa.string()), ("v", pa.list_(pa.float64())), ("part", pa.binary()), ("feat", pa.binary()), ("rest", pa.binary())])

    def run(table: pa.Table) -> pa.Table:
        table = table.take(pa.array(np.unique(_number(table.column("n"), np.int64), return_index=True)[1]))
        f, blk = by[table.column("field")[0].as_py()], table.column("blk")[0].as_py()
        n, x, y = _number(table.column("n"), np.int64), _number(table.column("x")), _number(table.column("y"))
        own = np.flatnonzero(n // block == blk)
        wrong, possible = _number(table.column("w"), bool), _number(table.column("p"), bool)
        step = usual_steps(x, y, possible)[own]
        frozen = (run_lengths(x, y) >= f.min_run)[own]
        # the last possible reading before a long impossible stretch lies apart from the others
        apart = int(np.flatnonzero(np.append(True, np.diff(n) > 1))[-1]) if len(own) and n[0] < blk * block else 0
        x, y, own, wrong = x[apart:], y[apart:], own - apart, wrong[apart:]
        spikes = spike_runs(x, y)
        feat = features(x, y, _number(table.column("mx"))[apart:], _number(table.column("my"))[apart:], spikes, halo, f.y is None)[own]
        at, ms, gs = [], [], []
        if f.jump:
            for k, m, g in spikes:
                with np.errstate(invalid="ignore"):
                    a = np.flatnonzero(g * f.jump[0] < m * f.jump[1])
                for j in range(k):
                    at, ms, gs = [*at, a + j], [*ms, m[a]], [*gs, g[a]]
        at, ms, gs = (np.concatenate(v) if v else np.zeros(0) for v in (at, ms, gs))
        order = np.argsort(at, kind="stable")
        at, ms, gs = at[order].astype(np.int64), ms[order], gs[order]
        inside = np.isin(at, own)
        at, ms, gs = at[inside] - (own[0] if len(own) else 0), ms[inside], gs[inside]
        level = x[own]
        v = level if f.mad is not None else step[~np.isnan(step)] if f.jump else np.zeros(0)
        rest = pickle.dumps((_number(table.column("rk"), np.int64)[apart:][own], wrong[own], frozen, level, at, ms, gs))
        one = [table.column("source")[:1].combine_chunks(), pa.array([f.name]), pa.array([v], pa.list_(pa.float64()))]
        row = pa.Table.from_arrays([*one, *(pa.array([b], pa.binary()) for b in (pickle.dumps(Model(feat.shape[1]).ask(feat)), feat.tobytes(), rest))], schema=schema)
        # a halo reaching past the last reading makes a block without rows of its own
        return row.slice(0, min(len(own), 1))

    return run


def _ask(models: Broadcast):
    """Answers of a task's blocks to the round of their source's model, added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        had: dict = {}
        for batch in batches:
            for source, field, feat in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (source, field) not in had:
                    had[source, field] = pickle.loads(models.value[source, field]), None
                model, answer = had[source, field]
                new = model.ask(np.frombuffer(feat, np.float32).reshape(-1, model.width))
                had[source, field] = model, new if answer is None else Model.add([answer, new])
        for (source, field), (_, answer) in had.items():
            yield pa.RecordBatch.from_arrays([pa.array([source], pa.int64()), pa.array([field]), pa.array([pickle.dumps(answer)], pa.binary())], ["source", "field", "part"])

    return run


def _tell(fields: Sequence[Field], models: Broadcast | None):
    by = {f.name: f for f in fields}

    def run(table: pa.Table) -> pa.Table:
        source, field = table.column("source")[0].as_py(), table.column("field")[0].as_py()
        model = pickle.loads(models.value[source, field]) if models else Model(7 if by[field].y is None else 8)
        model.tell(*Model.add([pickle.loads(p.as_py()) for p in table.column("part")]))
        return pa.table({"source": pa.array([source], pa.int64()), "field": pa.array([field]), "part": pa.array([pickle.dumps(model)], pa.binary())})

    return run


def _settle(fields: Sequence[Field], models: Broadcast, flagged: bool):
    """Readings of blocks with their scores and the exact tests; models: (model, usual movement or median, deviation)."""
    by = {f.name: f for f in fields}
    names = ["source", "field", "row_key", "score", "impossible", "frozen", "odd"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source, field, feat, rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                f, (model, mid, mad) = by[field], models.value[source, field]
                model = pickle.loads(model)
                rk, wrong, frozen, level, at, m, g = pickle.loads(rest)
                s = model.score(np.frombuffer(feat, np.float32).reshape(-1, model.width))
                odd = np.zeros(len(rk), bool)
                if f.jump and mid is not None:
                    odd[at[(m > f.jump[0] * mid) & (g <= f.jump[1] * mid)]] = True
                if f.mad is not None and mad is not None:
                    odd |= np.abs(level - mid) > f.mad * mad
                odd &= s > model.least
                keep = np.flatnonzero(wrong | frozen | odd) if flagged else np.arange(len(rk))
                yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(source, pa.int64()), len(keep)), pa.repeat(field, len(keep)), *(pa.array(v[keep]) for v in (rk, s, wrong, frozen, odd))], names)

    return run


def _large(rows: DataFrame, fields: Sequence[Field], block: int, halo: int, flagged: bool) -> DataFrame:
    """The same judgement for sources of more than a block, which are numbered in ``source``."""
    one = rows.groupBy("source", "rk").agg(F.min("o").alias("o"), *(F.max(c).alias(c) for c in rows.columns if c not in ("source", "o", "rk")))
    one = cut(one)
    parts = []
    for i, f in enumerate(fields):
        p = one.select("source", F.lit(f.name).alias("field"), "o", "rk", F.col(f"x{i}").alias("x"), (F.col(f"y{i}") if f.y else F.lit(0.0)).alias("y"), F.col(f"w{i}").alias("w"), F.col(f"p{i}").alias("p"))
        parts.append(p.where("x is not null and y is not null"))
    long = parts[0]
    for p in parts[1:]:
        long = long.unionByName(p)
    loose = long.where("o is null and w").select("source", "field", F.col("rk").alias("row_key"), F.lit(1.0).alias("score"), F.col("w").alias("impossible"), F.lit(False).alias("frozen"), F.lit(False).alias("odd"))
    gk = ["source", "field"]
    long = long.where("o is not null").withColumn("c", F.expr(f"(o - pmod(o, {block}L)) div {block}L")).withColumn("ph", F.expr(f"pmod(o, {SEASON}L) * {PHASES}L div {SEASON}L"))
    mean = lambda c: F.try_divide(F.sum(F.when(F.col("p") & (F.abs(c) < 1e6), F.rint(F.col(c) / GRAIN).cast("long"))).cast("double") * GRAIN, F.count(F.when(F.col("p") & (F.abs(c) < 1e6), 1)))
    seasons = cut(long.groupBy(*gk, "ph").agg(mean("x").alias("mx"), mean("y").alias("my")))
    counts = long.groupBy(*gk, "c").agg(F.count("*").alias("k"))
    counts = counts.withColumn("base", F.sum("k").over(Window.partitionBy(*gk).orderBy("c")) - F.col("k")).drop("k")
    place = F.row_number().over(Window.partitionBy(*gk, "c").orderBy("o", "rk")) - 1 + F.col("base")
    long = join_checked(null_safe_join(long, counts, [*gk, "c"]).withColumn("n", place), seasons, [*gk, "ph"], "left")
    inb = F.expr(f"pmod(n, {block}L)")
    own = F.expr(f"n div {block}L")
    near = F.when(inb < halo, F.array(own, own - 1)).when(inb >= block - halo, F.array(own, own + 1)).otherwise(F.array(own))
    long = cut(long.withColumn("own", own).drop("c", "ph"))
    # the last possible reading of the blocks before goes into each block too, so the usual movement needs no halo
    cols = [c for c in long.columns if c not in (*gk, "own")]
    last = long.groupBy(*gk, "own").agg(F.max(F.when(F.col("p"), F.struct("n", *(c for c in cols if c != "n")))).alias("l"))
    before = F.last("l", ignorenulls=True).over(Window.partitionBy(*gk).orderBy("own").rowsBetween(Window.unboundedPreceding, -1))
    last = last.select(*gk, F.col("own").alias("blk"), before.alias("l")).where("l is not null").select(*gk, "blk", "l.*")
    long = long.withColumn("blk", F.explode(near)).drop("own").unionByName(last)
    m = cut(long.groupBy(*gk, "blk").applyInArrow(_measure(fields, block, halo), "source long, field string, v array<double>, part binary, feat binary, rest binary"))
    context = m.sparkSession.sparkContext
    models, answers = None, m.select(*gk, "part")
    for _ in range(ROUNDS):
        told = answers.groupBy(*gk).applyInArrow(_tell(fields, models), "source long, field string, part binary").collect()
        models = context.broadcast({(r["source"], r["field"]): bytes(r["part"]) for r in told})
        answers = m.select(*gk, "feat").mapInArrow(_ask(models), "source long, field string, part binary")
    jump = [f.name for f in fields if f.jump]
    mad = [f.name for f in fields if f.mad is not None]
    mid = cut(exact_median(m.where(F.col("field").isin(jump + mad)).select(*gk, F.explode("v").alias("v")), gk, "v", "mid").drop("n"))
    usual = {(r["source"], r["field"]): r["mid"] for r in mid.collect()}
    spread = {}
    if mad:
        deviations = join_checked(m.where(F.col("field").isin(mad)).select(*gk, F.explode("v").alias("v")), mid, gk).withColumn("v", F.abs(F.col("v") - F.col("mid")))
        spread = {(r["source"], r["field"]): r["mad"] for r in exact_median(deviations, gk, "v", "mad").collect()}
    known = context.broadcast({k: (v, usual.get(k), spread.get(k)) for k, v in models.value.items()})
    out = m.select(*gk, "feat", "rest").mapInArrow(_settle(fields, known, flagged), "source long, field string, row_key long, score double, impossible boolean, frozen boolean, odd boolean")
    return out.unionByName(loose)


def _near(rows: DataFrame, big: DataFrame, ks: Sequence[str], most: int = 1000) -> DataFrame:
    """Rows whose key columns each hold a value of some large source: a filter the scan can prune by, if the sources are few."""
    few = big.select(*ks).limit(most + 1).collect()
    if len(few) > most or any(v is None for r in few for v in r):
        return rows
    for i, k in enumerate(ks):
        rows = rows.where(F.col(k).isin(sorted({r[i] for r in few})))
    return rows


def implausible(df: DataFrame, keys: Sequence[str], order: str, row_key: str, fields: Sequence[Field], *, block: int = BLOCK, flagged: bool = False) -> DataFrame:
    """(keys, field, row_key, score, impossible, frozen, odd) of every reading, or only of the flagged ones.

    Rows without row_key are ignored; rows without order are judged by the physical limits only and appear only if they
    break one.  A record is its row_key: repeated rows count once, with the least order and the greatest of each other
    column if they differ.  Missing readings (null, NaN) are skipped.  Ties of
    order go by row_key.  Keys may be null.  Empty inputs give no rows.  Other columns are not read.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    ks = [f"k{i}" for i in range(len(keys))]
    cols = [F.col(k).alias(a) for k, a in zip(keys, ks, strict=True)] + [F.expr(order).cast("long").alias("o"), F.expr(row_key).cast("long").alias("rk")]
    for i, f in enumerate(fields):
        x, y = F.expr(f.x).cast("double"), F.expr(f.y or "0.0D").cast("double")
        read = x.isNotNull() & y.isNotNull() & ~F.isnan(x) & ~F.isnan(y)
        cols.append(F.when(read, x).alias(f"x{i}"))
        cols += [F.when(read, y).alias(f"y{i}")] * (f.y is not None)
        cols += [(read & F.coalesce(F.expr(f.wrong), F.lit(False))).alias(f"w{i}"), (read & F.coalesce(F.expr(f.possible), F.lit(True))).alias(f"p{i}")]
    rows = df.select(*cols).where("rk is not null")
    big = cut(rows.groupBy(*ks).agg(F.count("*").alias("size")).where(F.col("size") > block).withColumn("source", F.monotonically_increasing_id()))
    types = [to_arrow_type(rows.schema[k].dataType) for k in ks]
    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in ks)
    if big.isEmpty():
        small, large = rows, None
    else:
        mark = big.select(*ks, "source")
        small = join_checked(rows, mark, ks, "left").where("source is null").drop("source")
        large = join_checked(_near(rows, big, ks), mark, ks).drop(*ks)
    halo = max([HALO, *(f.min_run for f in fields)])
    out = small.groupBy(*ks).applyInArrow(_small(fields, ks, types, halo, flagged), f"{kinds}, {_OUT}")
    if large is not None:
        more = join_checked(_large(large, fields, max(block, 2 * halo), halo, flagged), mark, ["source"])
        out = out.unionByName(more.select(*out.columns))
    return out.select(*(F.col(a).alias(k) for k, a in zip(keys, ks, strict=True)), "field", "row_key", "score", "impossible", "frozen", "odd")
