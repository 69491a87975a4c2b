"""Replicates of resampled rows, added up where the rows lie.

A row's weight in every replicate follows from its key (``functions/resampling.py``), so each task adds up its own rows for all
replicates at once and only sums travel. Three kinds of figures are built on that: functions of sums, quantiles, and any aggregate that
can be added to and merged.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.resampling import weights
from plumbline.operators.skew import checked_broadcast
from plumbline.session import settle

#: Weights worked out at a time, and bytes of sums a task holds before it hands them on.
CELLS, HELD_BYTES = 1 << 21, 64 << 20
#: Partial results meet in so many places first, then in one.
MEETINGS = (64, 1)
#: Units of a set whose quantiles one task finds, and pivots that narrow a larger set's values.
ORDERED, PIVOTS = 200_000, 255


def kinds_of(df: DataFrame, columns: list[str]) -> list[str]:
    types = {f.name: f.dataType.simpleString() for f in df.schema}
    return [f"`{c}` {types[c]}" for c in columns]


def sets_in(batch: pa.RecordBatch, by: list[str]) -> Iterator[tuple[pa.RecordBatch | None, tuple, np.ndarray]]:
    """(one row with the set's columns, their values, places of its rows) for every set in the batch."""
    if not by:
        yield None, (), np.arange(batch.num_rows)
        return
    code = np.zeros(batch.num_rows, np.int64)
    for c in by:
        found = batch.column(c).dictionary_encode(null_encoding="encode")
        code = np.unique(code * (len(found.dictionary) + 1) + found.indices.to_numpy(zero_copy_only=False), return_inverse=True)[1]
    order = np.argsort(code, kind="stable")
    for rows in np.split(order, np.flatnonzero(np.diff(code[order])) + 1):
        if len(rows):
            one = batch.select(by).slice(int(rows[0]), 1)
            yield one, tuple(one.to_pylist()[0].values()), rows


def replicate_sums(rows: DataFrame, by: list[str], sums: list[str], resamples: int) -> DataFrame:
    """(by..., __r, sums..., n): weighted sums of every replicate and, as replicate -1, the plain ones. ``rows`` has by..., __k and sums.

    A sum is NULL where none of its values is set.
    """
    replicates = np.arange(-1, resamples)

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}

        def handed() -> Iterator[pa.RecordBatch]:
            for one, total, seen in held.values():
                lead = [pa.concat_arrays([one.column(c)] * len(replicates)) for c in by]
                values = [pa.array(total[:, i]) if seen[i] else pa.nulls(len(replicates), pa.float64()) for i in range(len(sums))]
                yield pa.RecordBatch.from_arrays([*lead, pa.array(replicates, pa.int32()), *values, pa.array(total[:, -1])], names=[*by, "__r", *sums, "n"])

        for batch in batches:
            columns = [batch.column(c) for c in sums]
            valid = np.array([c.is_valid().to_numpy(zero_copy_only=False) for c in columns]).reshape(len(sums), -1)
            values = np.column_stack([*(c.fill_null(0.0).to_numpy(zero_copy_only=False) for c in columns), np.ones(batch.num_rows)])
            keys = batch.column("__k").to_numpy()
            for one, name, places in sets_in(batch, by):
                if name not in held:
                    held[name] = [one, np.zeros((len(replicates), len(sums) + 1)), np.zeros(len(sums), bool)]
                held[name][2] |= valid[:, places].any(axis=1)
                for at in range(0, len(places), step := max(1, CELLS // len(replicates))):
                    part = places[at:at + step]
                    held[name][1] += weights(keys[part], replicates).T.astype(float) @ values[part]
            if len(held) * len(replicates) * (len(sums) + 1) * 8 > HELD_BYTES:
                yield from handed()
                held = {}
        yield from handed()

    schema = ", ".join([*kinds_of(rows, by), "__r int", *[f"`{c}` double" for c in sums], "n double"])
    return rows.select(*by, "__k", *sums).mapInArrow(add, schema).groupBy(*by, "__r").agg(*[F.sum(c).alias(c) for c in [*sums, "n"]])


# -- states that are added to and merged ------------------------------------------------------------------------------------------


def tree_merge(parts: DataFrame, by: list[str], merge: Callable[[Any, Any], Any], load: Callable = pickle.loads, dump: Callable = pickle.dumps) -> DataFrame:
    """(by..., state): states of (by..., part, state) merged in steps, one held at a time."""
    schema = ", ".join([*kinds_of(parts, by), "part int, state binary"])
    names = [*by, "part", "state"]

    def fold(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, first, state = None, None, None
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.select([*by, "part"]).slice(i, 1)
                name = tuple(one.to_pylist()[0].values())
                more = load(batch.column("state")[i].as_py())
                if name == now:
                    state = merge(state, more)
                    continue
                if first is not None:
                    yield pa.RecordBatch.from_arrays([*first.columns, pa.array([dump(state)], pa.binary())], names=names)
                now, first, state = name, one, more
        if first is not None:
            yield pa.RecordBatch.from_arrays([*first.columns, pa.array([dump(state)], pa.binary())], names=names)

    for width in MEETINGS:
        met = parts.withColumn("part", F.pmod("part", F.lit(width)).cast("int")).select(*names)
        parts = met.repartition(*by, "part").sortWithinPartitions(*by, "part").mapInArrow(fold, schema)
    return parts.drop("part")


def partial_states(rows: DataFrame, by: list[str], columns: list[str], resamples: int, start: Callable[[tuple], Any], add: Callable[[Any, dict, np.ndarray], Any]) -> DataFrame:
    """(by..., part, state): each task's state per set, pickled. ``add(state, values by column, weights)`` takes some rows of a set."""
    replicates = np.arange(-1, resamples)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() if TaskContext.get() else 0
        held: dict[tuple, list] = {}
        for batch in batches:
            keys = batch.column("__k").to_numpy()
            for one, name, places in sets_in(batch, by):
                if name not in held:
                    held[name] = [one, start(name)]
                for at in range(0, len(places), step := max(1, CELLS // len(replicates))):
                    some = places[at:at + step]
                    values = {c: batch.column(c).take(pa.array(some)).to_numpy(zero_copy_only=False) for c in columns}
                    held[name][1] = add(held[name][1], values, weights(keys[some], replicates))
        for one, state in held.values():
            yield pa.RecordBatch.from_arrays([*(one.columns if one is not None else []), pa.array([part], pa.int32()), pa.array([pickle.dumps(state)], pa.binary())],
                                             names=[*by, "part", "state"])

    return rows.select(*by, "__k", *columns).mapInArrow(run, ", ".join([*kinds_of(rows, by), "part int, state binary"]))


class Aggregate:
    """A statistic of weighted rows that can be worked out in parts; subclass it and name the ``columns`` it reads.

    Weights are (rows, replicates) counts, and ``finish`` gives one number for each replicate, NaN where it has none. A state should stay
    small however many rows are added: it is what travels.
    """

    columns: list[str] = []

    def init(self, replicates: int) -> Any:
        raise TypeError("an aggregate needs a first state")

    def add(self, state: Any, values: dict[str, np.ndarray], counts: np.ndarray) -> Any:
        raise TypeError("an aggregate has to take rows")

    def merge(self, one: Any, other: Any) -> Any:
        raise TypeError("an aggregate has to merge states")

    def finish(self, state: Any) -> np.ndarray:
        raise TypeError("an aggregate has to give figures")


def _figure_rows(states: DataFrame, by: list[str], resamples: int, finish: Callable[[Any], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """(by..., __r, __s, n) from merged states; ``finish`` gives figures and numbers of units drawn."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                figures, drawn = finish(pickle.loads(batch.column("state")[i].as_py()))
                lead = [pa.concat_arrays([batch.column(c).slice(i, 1)] * (resamples + 1)) for c in by]
                yield pa.RecordBatch.from_arrays(
                    [*lead, pa.array(np.arange(-1, resamples), pa.int32()), pa.array(np.asarray(figures, float), from_pandas=True), pa.array(np.asarray(drawn, float))],
                    names=[*by, "__r", "__s", "n"])

    return states.mapInArrow(run, ", ".join([*kinds_of(states, by), "__r int, __s double, n double"]))


def replicate_figures(rows: DataFrame, by: list[str], aggregate: Aggregate, resamples: int) -> DataFrame:
    """(by..., __r, __s, n) of a user's aggregate. ``rows`` has by..., __k and the aggregate's columns."""

    def start(_: tuple) -> tuple:
        return np.zeros(resamples + 1, np.int64), aggregate.init(resamples + 1)

    def add(state: tuple, values: dict, counts: np.ndarray) -> tuple:
        return state[0] + counts.sum(axis=0, dtype=np.int64), aggregate.add(state[1], values, counts)

    def merge(one: tuple, other: tuple) -> tuple:
        return one[0] + other[0], aggregate.merge(one[1], other[1])

    parts = partial_states(rows, by, aggregate.columns, resamples, start, add)
    return _figure_rows(tree_merge(parts, by, merge), by, resamples, lambda state: (aggregate.finish(state[1]), state[0]))


# -- quantiles ---------------------------------------------------------------------------------------------------------------------


def _at_ranks(values: np.ndarray, keys: np.ndarray, known: list[tuple[float, np.ndarray]], below: np.ndarray, total: np.ndarray | None, prob: float, replicates: np.ndarray) -> np.ndarray:
    """Each replicate's quantile, interpolated between neighbours in rank. ``known`` are values whose weights are added up already."""
    order = np.argsort(values, kind="stable")
    values, keys = values[order], keys[order]
    step = max(1, CELLS // len(replicates))
    chunks = [(values[a:a + step], keys[a:a + step]) for a in range(0, len(values), step)]
    if total is None:
        total = below + sum((weights(k, replicates).sum(axis=0, dtype=np.int64) for _, k in chunks), np.zeros(len(replicates), np.int64))
    at = prob * (total - 1)
    ranks = np.array([np.floor(at), np.ceil(at)])
    found = np.full(ranks.shape, np.nan)
    known = sorted(known, key=lambda x: x[0])
    runs: list[tuple[np.ndarray, np.ndarray | None, np.ndarray | None]] = []
    for v, k in chunks:  # known values stand between the chunks' ones
        while known and (not len(v) or known[0][0] <= v[-1]):
            cut = int(np.searchsorted(v, known[0][0]))
            runs += [(v[:cut], k[:cut], None), (np.array([known[0][0]]), None, known[0][1])]
            v, k, known = v[cut:], k[cut:], known[1:]
        runs.append((v, k, None))
    runs += [(np.array([x]), None, w) for x, w in known]
    reached = below.astype(np.int64)
    for v, k, w in runs:
        if not len(v):
            continue
        counts = w[None, :] if k is None else weights(k, replicates)
        sums = reached + np.cumsum(counts, axis=0, dtype=np.int64)
        for side in range(2):
            place = (sums <= ranks[side]).sum(axis=0)
            here = np.isnan(found[side]) & (place < len(v)) & (total > 0)
            found[side, here] = v[place[here]]
        reached = sums[-1]
    return found[0] + (found[1] - found[0]) * (at - np.floor(at))


def _narrowed(rows: DataFrame, by: list[str], hot: DataFrame, prob: float, resamples: int, ordered: int, pivots: int) -> dict[tuple, dict]:
    """For every set of ``hot``: the values among which its replicates' quantiles lie, at most about ``ordered`` where narrowing gets that far.

    Each round takes pivots at even ranks of what is left, adds up all replicates' weights on and between them, and keeps the span that holds a
    wanted rank. ``hot`` has at most rows / ``ordered`` sets, and a set's span is one row of numbers.
    """
    state: dict[tuple, dict] = {}
    spans = {tuple(r): None for r in hot.select(*by).collect()} if by else {(): None}
    crowd = rows.join(checked_broadcast(hot.select(*by)), by, "left_semi") if by else rows
    left = spans
    while left:
        inside = crowd.where(_within(by, left))
        points = [i / (pivots + 1) for i in range(1, pivots + 1)]
        told = inside.groupBy(*by).agg(F.percentile_approx("__v", points, 10_000).alias("p"), F.count(F.lit(1)).alias("n")).collect()
        knots = {tuple(r[c] for c in by): np.unique(r["p"]) for r in told if r["p"]}
        sizes = {tuple(r[c] for c in by): r["n"] for r in told}

        def start(name: tuple) -> dict:
            return {"name": name, "w": np.zeros((2 * len(knots[name]) + 1, resamples + 1), np.int64)}

        def add(one: dict, values: dict, counts: np.ndarray) -> dict:
            at, v = knots[one["name"]], values["__v"]
            code = 2 * np.searchsorted(at, v)
            code += (at[np.minimum(code // 2, len(at) - 1)] == v)
            order = np.argsort(code, kind="stable")
            first = np.flatnonzero(np.append(True, np.diff(code[order]) != 0))
            one["w"][code[order][first]] += np.add.reduceat(counts[order], first, axis=0, dtype=np.int64)
            return one

        def merge(one: dict, other: dict) -> dict:
            return {**one, "w": one["w"] + other["w"]}

        merged = tree_merge(partial_states(inside, by, ["__v"], resamples, start, add), by, merge)
        following = {}
        for row in merged.toLocalIterator():
            name = tuple(row[c] for c in by)
            counts, at = pickle.loads(bytes(row["state"]))["w"], knots[name]
            before = state.get(name, {"below": np.zeros(resamples + 1, np.int64), "total": counts.sum(axis=0), "span": ((-float("inf"), False), (float("inf"), False))})
            sums = before["below"] + np.cumsum(counts, axis=0)
            place = prob * (before["total"] - 1)
            some = before["total"] > 0
            low = int((sums[:, some] <= np.floor(place[some])).sum(axis=0).min())
            high = int((sums[:, some] <= np.ceil(place[some])).sum(axis=0).max())
            known = [(float(at[c // 2]), counts[c]) for c in range(low, high + 1) if c % 2]
            state[name] = {"below": before["below"] + counts[:low].sum(axis=0), "total": before["total"], "known": known, "span": (_edge(at, low, -1, before["span"]), _edge(at, high, 1, before["span"]))}
            rest = int(sum(counts[c, 0] for c in range(low, high + 1) if not c % 2))  # replicate -1 counts rows
            if ordered < rest <= sizes[name] // 2:
                following[name] = state[name]
        left = following
    return state


def _edge(at: np.ndarray, code: int, side: int, before: tuple) -> tuple[float, bool]:
    """The bound of a span that begins (side -1) or ends (side 1) with ``code``, and whether it belongs to it; beyond all pivots, that of the span ``before``."""
    if code % 2:
        return float(at[code // 2]), True
    place = code // 2 - (side < 0)
    return (float(at[place]), False) if 0 <= place < len(at) else before[side > 0]


def _within(by: list[str], states: dict[tuple, dict | None], but_known: bool = False) -> Column:
    """Rows between their set's bounds; with ``but_known`` without those whose weights are added up already."""
    test = F.lit(False)
    for name, found in states.items():
        here = F.lit(True)
        for c, x in zip(by, name, strict=True):
            here &= F.col(c).eqNullSafe(F.lit(x))
        if found:
            (low, with_low), (high, with_high) = found["span"]
            here &= ((F.col("__v") >= low) if with_low else (F.col("__v") > low)) & ((F.col("__v") <= high) if with_high else (F.col("__v") < high))
            if but_known and found["known"]:
                here &= ~F.col("__v").isin([v for v, _ in found["known"]])
        test |= here
    return test


def replicate_quantiles(rows: DataFrame, by: list[str], prob: float, resamples: int, ordered: int = ORDERED, pivots: int = PIVOTS) -> DataFrame:
    """(by..., __r, __s, n): the exact quantile of every replicate of every set. ``rows`` has by..., __k and __v, NULL values left out.

    A set of more than ``ordered`` units is narrowed first; what is left of it, about six times the root of its size for values that
    don't repeat, is ordered in one task. Sets themselves are spread over the tasks.
    """
    rows = rows.where(F.col("__v").isNotNull())
    sizes = settle(rows.groupBy(*by).agg(F.count(F.lit(1)).alias("__size")))
    hot = sizes.where(F.col("__size") > ordered)
    states = _narrowed(settle(rows), by, hot, prob, resamples, ordered, pivots) if hot.limit(1).count() else {}
    replicates = np.arange(-1, resamples)
    packed = rows.sparkSession.sparkContext.broadcast(states)
    cool = rows.join(checked_broadcast(hot.select(*by)), by, "left_anti") if states and by else rows.where(F.lit(not states))
    # a set whose span holds pivots only has no row left, so it brings one that counts nowhere
    left = rows.where(_within(by, states, but_known=True)) if states else rows.limit(0)
    keep = hot.select(*by, F.lit(None).cast("bigint").alias("__k"), F.lit(None).cast("double").alias("__v"))
    every = cool.unionByName(left).unionByName(keep) if states else cool

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, first, held = None, None, []

        def done() -> pa.RecordBatch:
            keys, values = (np.concatenate(x) for x in zip(*held, strict=True))
            found = packed.value.get(now, {"below": np.zeros(len(replicates), np.int64), "total": None, "known": []})
            total = found["total"]
            if total is None:
                total = sum((weights(keys[a:a + 1024], replicates).sum(axis=0, dtype=np.int64) for a in range(0, len(keys), 1024)), np.zeros(len(replicates), np.int64))
            figures = _at_ranks(values, keys, found["known"], found["below"], total, prob, replicates)
            lead = [pa.concat_arrays([first.column(c)] * len(replicates)) for c in by]
            return pa.RecordBatch.from_arrays([*lead, pa.array(replicates, pa.int32()), pa.array(figures, from_pandas=True), pa.array(total.astype(float))], names=[*by, "__r", "__s", "n"])

        for batch in batches:
            for one, name, places in sorted(sets_in(batch, by), key=lambda s: s[2][0]):
                if name != now:
                    if held:
                        yield done()
                    now, first, held = name, one, []
                some = batch.take(pa.array(places))
                some = some.filter(some.column("__k").is_valid())
                held.append((some.column("__k").to_numpy(zero_copy_only=False).astype(np.int64), some.column("__v").to_numpy(zero_copy_only=False).astype(float)))
        if held:
            yield done()

    schema = ", ".join([*kinds_of(rows, by), "__r int, __s double, n double"])
    placed = every.repartition(*by).sortWithinPartitions(*by) if by else every.repartition(1)
    return placed.select(*by, "__k", "__v").mapInArrow(run, schema)
