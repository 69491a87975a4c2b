"""Queries scored against a gallery of group vectors.

The reference figure needs every query against every gallery vector, but only a few
numbers of each query's row: its own group's score, the sum, and the best k. Those
are computed per batch by one matrix product, so no pair becomes a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.vectors import NORM_FLOOR, vector_mean

#: Groups and bytes of a gallery that goes to every task.
GALLERY_ROWS, GALLERY_BYTES = 8_192, 16 << 20
#: Bytes of queries that stand in one task, gallery rows that pass them at a time, and scores worked out at a time.
QUERY_BYTES, PASSING, CELLS = 32 << 20, 1_024, 4_000_000


def _unit_rows(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.sqrt((m * m).sum(axis=1, keepdims=True)), NORM_FLOOR)


def _scores(q: np.ndarray, g: np.ndarray, metric: str) -> np.ndarray:
    """Similarity (cosine) or minus distance (euclidean): the larger the nearer."""
    if metric == "cosine":
        return _unit_rows(q) @ _unit_rows(g).T
    out = np.empty((len(q), len(g)))
    step = max(1, 4_000_000 // max(1, g.size))
    for at in range(0, len(q), step):
        out[at : at + step] = -np.sqrt(((q[at : at + step, None, :] - g[None, :, :]) ** 2).sum(axis=2))
    return out


def _reduce(scores: np.ndarray, own: np.ndarray, names: np.ndarray, k: int) -> dict[str, list]:
    """Per row: own score (NaN without one), sum, count, and the k best groups; equal scores by name."""
    k = min(k, scores.shape[1])
    order = np.argsort(-scores, axis=1, kind="stable")[:, :k]
    place = {name: i for i, name in enumerate(names)}
    at = np.array([place.get(o, -1) for o in own])
    mine = np.where(at >= 0, scores[np.arange(len(own)), np.maximum(at, 0)], np.nan)
    return {
        "own": [None if np.isnan(x) else float(x) for x in mine],
        "total": scores.sum(axis=1).tolist(),
        "groups": [scores.shape[1]] * len(own),
        "top": [
            [{"s": float(scores[r, c]), "g": str(names[c])} for c in order[r]] for r in range(len(own))
        ],
    }


OUT = "own double, total double, groups bigint, top array<struct<s:double,g:string>>"


def score_against(
    queries: DataFrame, gallery: DataFrame, key: list[str], group: str, vector: str, k: int,
    metric: str = "cosine", gallery_group: str | None = None, gallery_vector: str = "mean",
    gallery_rows: int = GALLERY_ROWS,
) -> DataFrame:
    """(key..., group, own, total, groups, top) per query.

    ``own`` is the score with the query's own group, ``total`` the sum over all
    groups, ``top`` the k best as (s, g), best first, equal scores by group name.
    Euclidean scores are minus distances.

    A gallery of at most ``gallery_rows`` groups and GALLERY_BYTES goes to every task and
    the queries are streamed past it where they lie. A larger one passes the queries
    by, which stand in blocks.
    """
    g = gallery.select(F.col(gallery_group or group).cast("string").alias("g"), F.col(gallery_vector).cast("array<double>").alias("v"))
    q = queries.select(*key, F.col(group).cast("string").alias("__group"), F.col(vector).cast("array<double>").alias("__v"))
    types = {f.name: f.dataType.simpleString() for f in q.schema}
    schema = ", ".join([*[f"{c} {types[c]}" for c in key], "__group string", OUT])

    first = g.limit(1).collect()
    if not first:
        raise ValueError("an empty gallery")
    d = len(first[0]["v"])
    most = max(1, min(gallery_rows, GALLERY_BYTES // (8 * max(1, d))))
    few = g.limit(most + 1).collect()
    if len(few) <= most:
        few.sort(key=lambda r: r["g"])
        packed = queries.sparkSession.sparkContext.broadcast(
            (np.array([r["g"] for r in few]), np.array([r["v"] for r in few], dtype=float).reshape(len(few), d))
        )

        def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, matrix = packed.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                v = batch.column("__v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, d)
                found = _reduce(_scores(v, matrix, metric), np.array(batch.column("__group").to_pylist(), dtype=object), names, k)
                top = pa.array(found["top"], pa.list_(pa.struct([("s", pa.float64()), ("g", pa.string())])))
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c) for c in key], batch.column("__group"), pa.array(found["own"], pa.float64()),
                     pa.array(found["total"], pa.float64()), pa.array(found["groups"], pa.int64()), top],
                    names=[*key, "__group", "own", "total", "groups", "top"],
                )

        scored = q.mapInArrow(stream, schema)
    else:
        scored = _passed_by(q, g, key, d, metric, k, schema)
    return scored.withColumnRenamed("__group", group)


class _Standing:
    """What queries know of the gallery rows that have passed them: own score, sum, number and the k best, equal scores by name."""

    def __init__(self, rows: list[pa.RecordBatch], key: list[str], d: int, metric: str, k: int):
        self.table = pa.Table.from_batches(rows).combine_chunks()
        self.vectors = self.table.column("__v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
        self.groups = np.array(self.table.column("__group").to_pylist(), dtype=object)
        n = len(self.groups)
        self.key, self.d, self.metric, self.k, self.passed = key, d, metric, k, 0
        self.own, self.total = np.full(n, np.nan), np.zeros(n)
        self.best, self.names = np.zeros((n, 0)), np.zeros((n, 0), dtype=object)

    def see(self, vectors: pa.Array, names: list[str]) -> None:
        """Gallery rows in the order of their names, after all that came before."""
        matrix = vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, self.d)
        labels = np.array(names, dtype=object)
        place = {name: i for i, name in enumerate(names)}
        self.passed += len(names)
        step = max(1, CELLS // max(1, len(names)))
        found, told = [], []
        for at in range(0, len(self.groups), step):
            part = slice(at, at + step)
            scores = _scores(self.vectors[part], matrix, self.metric)
            self.total[part] += scores.sum(axis=1)
            mine = np.array([place.get(o, -1) for o in self.groups[part]])
            here = np.flatnonzero(mine >= 0)
            self.own[at + here] = scores[here, mine[here]]
            near = np.argsort(-scores, axis=1, kind="stable")[:, :self.k]
            both = np.hstack([self.best[part], np.take_along_axis(scores, near, axis=1)])
            who = np.hstack([self.names[part], labels[near]])
            order = np.argsort(-both, axis=1, kind="stable")[:, :self.k]
            found.append(np.take_along_axis(both, order, axis=1))
            told.append(np.take_along_axis(who, order, axis=1))
        self.best, self.names = np.concatenate(found), np.concatenate(told)

    def rows(self) -> pa.RecordBatch:
        top = [[{"s": s, "g": g} for s, g in zip(a, b, strict=True)] for a, b in zip(self.best.tolist(), self.names.tolist(), strict=True)]
        n = len(self.groups)
        return pa.RecordBatch.from_arrays(
            [*[self.table.column(c).combine_chunks() for c in [*self.key, "__group"]], pa.array(self.own, from_pandas=True), pa.array(self.total), pa.array([self.passed] * n, pa.int64()),
             pa.array(top, pa.list_(pa.struct([("s", pa.float64()), ("g", pa.string())])))], names=[*self.key, "__group", "own", "total", "groups", "top"])


def _passed_by(q: DataFrame, g: DataFrame, key: list[str], d: int, metric: str, k: int, schema: str) -> DataFrame:
    """Scores against a gallery of any size: each block of queries stands in one task, and the gallery's rows, a copy for each block, pass it in order.

    A query travels once, whatever the gallery's size; a task holds one block of QUERY_BYTES and one batch of the gallery.
    """
    blocks = max(1, -(-q.count() * 8 * d // QUERY_BYTES))
    block = F.pmod(F.xxhash64(*key, "__group"), F.lit(blocks)).cast("int").alias("__block")
    standing = q.select(block, F.lit(None).cast("string").alias("__g"), *key, "__group", "__v")
    passing = g.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("__block"), F.col("g").alias("__g"), F.col("v").alias("__v"))
    met = standing.unionByName(passing, allowMissingColumns=True).repartition("__block").sortWithinPartitions("__block", F.asc_nulls_first("__g"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, waiting, state = None, [], None

        def done() -> Iterator[pa.RecordBatch]:
            if waiting or state is not None:
                yield (state or _Standing(waiting, key, d, metric, k)).rows()

        for batch in batches:
            number = batch.column("__block").to_numpy()
            asks = batch.column("__g").is_null().to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero((number[1:] != number[:-1]) | (asks[1:] != asks[:-1])) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if number[a] != now:
                    yield from done()
                    now, waiting, state = number[a], [], None
                part = batch.slice(a, b - a)
                if asks[a]:
                    waiting.append(part)
                elif waiting or state is not None:
                    state = state or _Standing(waiting, key, d, metric, k)
                    waiting = []
                    for at in range(0, part.num_rows, PASSING):
                        some = part.slice(at, PASSING)
                        state.see(some.column("__v"), some.column("__g").to_pylist())
        yield from done()

    return met.mapInArrow(run, schema)


def top_k(scored: DataFrame, key: list[str]) -> DataFrame:
    """One row per query and place: (key, rank from 1, gallery group, score)."""
    rows = scored.select(*key, F.posexplode("top").alias("p", "t"))
    return rows.select(*key, (F.col("p") + 1).alias("rank"), F.col("t.g").alias("gallery_group"), F.col("t.s").alias("score"))


def retrieval_hits(scored: DataFrame, key: list[str], group: str, k: int) -> DataFrame:
    """(key, group, hit1, hitk, groups) per query; a query of a group the gallery lacks stops the job."""
    names = F.transform("top", lambda t: t["g"])
    known = F.when(F.col("own").isNotNull(), True).otherwise(
        F.raise_error(F.concat(F.lit("query group not in the gallery: "), F.col(group))).cast("boolean")
    )
    return scored.where(known).select(
        *key, group,
        (F.element_at(names, 1) == F.col(group)).alias("hit1"),
        F.array_contains(F.slice(names, 1, k), F.col(group)).alias("hitk"),
        "groups",
    )


def retrieval_score(hits: DataFrame, k: int, by: list[str] | None = None) -> DataFrame:
    """Top-1, top-k, chance and lift over all queries of each set."""
    return hits.groupBy(*(by or [])).agg(
        F.avg(F.col("hit1").cast("double")).alias("top1"),
        F.avg(F.col("hitk").cast("double")).alias("topk"),
        F.least(F.lit(k), F.max("groups")).cast("int").alias("k"),
        F.count(F.lit(1)).alias("queries"),
        F.max("groups").alias("groups"),
        (F.lit(1.0) / F.max("groups")).alias("chance"),
        (F.avg(F.col("hit1").cast("double")) * F.max("groups")).alias("lift"),
    )


def per_group_accuracy(hits: DataFrame, group: str) -> DataFrame:
    return hits.groupBy(group).agg(F.count(F.lit(1)).alias("queries"), F.avg(F.col("hit1").cast("double")).alias("top1"))


def group_distance(
    side: DataFrame, reference: DataFrame, by: list[str], group: str, vector: str, k: int = 1, d: int | None = None,
    gallery_rows: int = GALLERY_ROWS,
) -> DataFrame:
    """(by..., group, own, wrong, gap, nearest_is_right, candidates) of each set's group means.

    ``own`` is the distance of the group's mean to its own reference mean, ``wrong``
    the mean distance to all others (NULL if there are none). A group without a
    reference stops the job.
    """
    means = vector_mean(side, [*by, group], vector, d=d)
    gallery = vector_mean(reference, [group], vector, d=d)
    scored = score_against(
        means.withColumn("__id", F.col(group)), gallery, [*by, "__id"], group, "mean", k, "euclidean", gallery_rows=gallery_rows
    )
    own = -F.coalesce(F.col("own"), F.raise_error(F.concat(F.lit("no reference for group "), F.col(group))).cast("double"))
    wrong = F.when(F.col("groups") > 1, (-F.col("total") - own) / (F.col("groups") - 1))
    return scored.select(
        *by, group, own.alias("own"), wrong.alias("wrong"), (wrong - own).alias("gap"),
        (F.element_at("top", 1)["g"] == F.col(group)).alias("nearest_is_right"),
        F.col("groups").alias("candidates"),
    )


def own_wrong_gap(distances: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Mean distances, gap and share nearest over groups."""
    return distances.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("groups"), F.avg("own").alias("own"), F.avg("wrong").alias("wrong"), F.avg("gap").alias("gap"),
        F.avg(F.col("nearest_is_right").cast("double")).alias("nearest"),
    )


def three_set_score(distances: DataFrame, set_: str = "set") -> DataFrame:
    """One row from distances of the sets ``generated``, ``real`` and ``floor``.

    position = (generated - real) / (floor - real), NULL unless the floor lies
    beyond real. identity = generated gap / real gap, NULL unless the real gap is
    positive.
    """
    def mean(name: str, column: str) -> Column:
        return F.avg(F.when(F.col(set_) == name, F.col(column)))

    figures = distances.agg(
        mean("generated", "own").alias("generated"), mean("real", "own").alias("real"), mean("floor", "own").alias("floor"),
        mean("generated", "gap").alias("gap_generated"), mean("real", "gap").alias("gap_real"),
        F.max("candidates").alias("candidates"),
    )
    span = F.col("floor") - F.col("real")
    return figures.select(
        "generated", "real", "floor",
        F.when(span > 0, (F.col("generated") - F.col("real")) / span).alias("position"),
        F.when(F.col("gap_real") > 0, F.col("gap_generated") / F.col("gap_real")).alias("identity"),
        (F.lit(1.0) / F.col("candidates")).alias("chance"), "candidates",
    )


def withheld(samples: DataFrame, reference: DataFrame, group: str) -> tuple[DataFrame, DataFrame]:
    """(samples whose group the reference holds, one row: scored and withheld counts)."""
    from plumbline.operators.joins import exclusion_counts, keep_known

    counts = exclusion_counts(samples, reference, [group]).select(
        F.col("excluded").alias("scored"), F.col("kept").alias("withheld")
    )
    return keep_known(samples, reference, [group]), counts


def damages(df: DataFrame, vector: str) -> DataFrame:
    """Each row once per damage: untouched, softened, coarse, blurred, tilted.

    All are deterministic; the sets share one read of ``df``.
    """
    v = F.col(vector).cast("array<double>")
    size = F.size(v)
    kinds = {
        "untouched": v,
        "softened": F.transform(v, lambda x: x * 0.7),
        "coarse": F.transform(v, lambda x: F.round(x * 8) / 8),
        "blurred": F.transform(v, lambda x, i: (
            x + F.coalesce(F.get(v, i - 1), F.lit(0.0)) + F.when(i + 1 < size, F.coalesce(F.get(v, i + 1), F.lit(0.0))).otherwise(0.0)
        ) / 3),
        "tilted": F.transform(v, lambda x, i: x + i * F.lit(0.004)),
    }
    rows = F.array(*[F.struct(F.lit(n).alias("damage"), c.alias("v")) for n, c in kinds.items()])
    rest = [c for c in df.columns if c != vector]
    return df.select(*rest, F.explode(rows).alias("d")).select(*rest, "d.damage", F.col("d.v").alias(vector))


def retrieval_sensitivity(
    queries: DataFrame, gallery: DataFrame, key: str, group: str, vector: str, k: int = 5
) -> DataFrame:
    """(damage, top1, topk, kept): accuracy under each damage and the share of the untouched one kept."""
    scored = score_against(damages(queries, vector), gallery, ["damage", key], group, vector, k)
    table = retrieval_score(retrieval_hits(scored, ["damage", key], group, k), k, ["damage"])
    # One row per damage: the window holds a handful of rows.
    base = F.max(F.when(F.col("damage") == "untouched", F.col("top1"))).over(Window.partitionBy())
    share = F.when(base > 0, F.col("top1") / base).otherwise(0.0)
    return table.select("damage", "top1", "topk", share.alias("kept"))


def page_vectors(refs: DataFrame, by: list[str], vector: str, d: int | None = None) -> DataFrame:
    """A page as one unit vector per group: the mean of its records' unit vectors, scaled to one."""
    from plumbline.functions.vectors import unit

    units = refs.select(*by, unit(F.col(vector).cast("array<double>")).alias("__u"))
    return vector_mean(units, by, "__u", "page", d).withColumn("page", unit(F.col("page"))).drop("n")


