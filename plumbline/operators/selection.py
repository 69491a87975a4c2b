"""Best-of-K selection replayed over a table of draws.

A draw: request, attempt (from 1), score, overrun, support, width_ratio, doubled.
An attempt that produced nothing has a NULL score. NULL support or ratio means not
measured, which no gate rejects.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline import fixed
from plumbline.functions.numbers import in_band
from plumbline.functions.text import coverage, doubled_word, error_rate, is_blank, overrun
from plumbline.operators.skew import checked_broadcast, top_per_group

MAX_ATTEMPTS = fixed.CANDIDATES + fixed.EXTRA_DRAWS


def predicted_size(refs: DataFrame, by: list[str], size: str, text: str, targets: DataFrame, target: str) -> DataFrame:
    """``predicted`` size of each target from the references of its group.

    The mean size per character of the references with text, times the target's
    characters; NULL for a blank target or a group without texts.
    """
    rate = refs.groupBy(*by).agg(F.avg(F.when(F.length(text) > 0, F.col(size) / F.length(text))).alias("__rate"))
    joined = targets.join(checked_broadcast(rate), by, "left")
    return joined.withColumn(
        "predicted", F.when(~is_blank(F.col(target)), F.col("__rate") * F.length(target))
    ).drop("__rate")


def score_draws(draws: DataFrame, requests: DataFrame, request: str, text: str, predicted: str | None = None) -> DataFrame:
    """Draws (request, attempt, reading, size, ...) with what the gates ask: score, overrun, doubled, width_ratio.

    ``requests`` holds each request's text and, if known, its predicted size. A draw
    without a reading produced nothing and has no score.
    """
    wanted = [text, *([predicted] if predicted else [])]
    joined = draws.join(requests.select(request, *[F.col(c).alias(f"__{c}") for c in wanted]), request)
    reading, target = F.coalesce("reading", F.lit("")), F.col(f"__{text}")
    made = F.col("reading").isNotNull()
    ratio = F.col("size") / F.nullif(F.col(f"__{predicted}"), F.lit(0.0)) if predicted else F.lit(None).cast("double")
    return joined.withColumns({
        "score": F.when(made, error_rate(reading, target)),
        "overrun": F.when(made, overrun(reading, target)),
        "doubled": F.when(made, doubled_word(reading, target)),
        "width_ratio": F.when(made, ratio),
    }).drop(*[f"__{c}" for c in wanted])


def omitted() -> Column:
    return F.coalesce(F.col("support") > fixed.OMISSION_SUPPORT, F.lit(False))


def acceptable() -> Column:
    """Reads well, ends where it should, leaves nothing out, is as wide as expected, repeats nothing."""
    return (
        (F.col("score") <= fixed.ACCEPT_SCORE)
        & (F.col("overrun") <= fixed.ACCEPT_OVERRUN)
        & ~omitted()
        & in_band(F.col("width_ratio"))
        & F.col("doubled").isNull()
    )


def badness() -> Column:
    """Orders draws none of which is acceptable; the least is kept, of equals the first."""
    return F.struct(
        (F.col("score") > fixed.ACCEPT_SCORE).alias("smear"),
        omitted().alias("omitted"),
        F.col("doubled").isNotNull().alias("doubled"),
        F.col("score").alias("score"),
        F.col("attempt").alias("attempt"),
    )


def draws_used(
    draws: DataFrame, request: str, mode: str = "readable",
    candidates: int = fixed.CANDIDATES, extra: int = fixed.EXTRA_DRAWS,
) -> DataFrame:
    """The draws a run would have made before stopping, with ``ok``.

    ``readable`` stops at the first acceptable draw. ``hand`` makes all candidates.
    Either goes on to ``extra`` more only while none is acceptable.
    """
    marked = draws.where(F.col("attempt") <= candidates + extra).withColumn(
        "ok", F.coalesce(acceptable(), F.lit(False))
    )
    first = F.min(F.when(F.col("ok"), F.col("attempt"))).over(Window.partitionBy(request))
    last = first if mode == "readable" else F.greatest(first, F.lit(candidates))
    # A request has at most candidates + extra rows here, so its window is small.
    stop = F.coalesce(last, F.lit(candidates + extra)).alias("__stop")
    return marked.select("*", stop).where(F.col("attempt") <= F.col("__stop")).drop("__stop")


def choose_readable(used: DataFrame, request: str) -> DataFrame:
    """The first acceptable draw of each request, else its least bad one; one aggregate, no sort."""
    rest = [c for c in used.columns if c != request]
    made = used.where(F.col("score").isNotNull())
    row = F.struct(*rest)
    picked = made.groupBy(request).agg(
        F.min_by(row, F.when(F.col("ok"), F.col("attempt"))).alias("__first"),
        F.min_by(row, badness()).alias("__least"),
    )
    return picked.select(request, F.coalesce("__first", "__least").alias("r")).select(request, "r.*")


def choose_closest(used: DataFrame, request: str, similarity: str) -> DataFrame:
    """The acceptable draw most similar to the page, else the first acceptable, else the least bad one.

    A draw without a similarity is never the most similar. ``moved`` marks requests where that is not the first acceptable draw.
    """
    rest = [c for c in used.columns if c != request]
    made = used.where(F.col("score").isNotNull())
    row = F.struct(*rest)
    nearness = F.struct((-F.col(similarity)).alias("s"), F.col("attempt").alias("a"))
    picked = made.groupBy(request).agg(
        F.min(F.when(F.col("ok"), F.col("attempt"))).alias("__first"),
        F.min_by(row, F.when(F.col("ok") & F.col(similarity).isNotNull(), nearness)).alias("__near"),
        F.min_by(row, F.when(F.col("ok"), F.col("attempt"))).alias("__early"),
        F.min_by(row, badness()).alias("__least"),
    )
    chosen = picked.select(request, "__first", F.coalesce("__near", "__early", "__least").alias("r"))
    return chosen.select(request, "r.*", F.coalesce(F.col("r.attempt") != F.col("__first"), F.lit(False)).alias("moved"))


def rejections(used: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Faults found among draws that read well; a draw may count under several."""
    well = F.col("score") <= fixed.ACCEPT_SCORE
    counts = [
        F.count_if(well & (F.col("overrun") > fixed.ACCEPT_OVERRUN)).alias("rejected_for_overrun"),
        F.count_if(well & omitted()).alias("rejected_for_omission"),
        F.count_if(well & ~in_band(F.col("width_ratio"))).alias("rejected_for_width"),
        F.count_if(well & F.col("doubled").isNotNull()).alias("rejected_for_doubling"),
    ]
    return used.groupBy(*by).agg(*counts) if by else used.agg(*counts)


def selection_log(used: DataFrame, request: str) -> DataFrame:
    """One row: what the selection cost and what it rejected."""
    per_request = used.groupBy(request).agg(
        F.count(F.lit(1)).alias("used"),
        F.count("score").alias("made"),
        F.max("ok").alias("any_ok"),
        F.count_if(F.col("score").isNull()).alias("empty"),
    )
    totals = per_request.agg(
        F.count(F.lit(1)).alias("requests"),
        F.sum("used").alias("draws"),
        (F.sum("used") / F.count(F.lit(1))).alias("draws_per_request"),
        F.count_if(F.col("used") == 1).alias("first_draw_accepted"),
        F.count_if((F.col("made") > 0) & ~F.col("any_ok")).alias("none_accepted"),
        F.count_if(F.col("made") == 0).alias("no_output"),
    )
    names = [f.name for f in totals.schema]
    faults = rejections(used)
    both = totals.unionByName(faults, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in [*names, *faults.columns]])


def empty_log(used: DataFrame, request: str) -> DataFrame:
    """One row: requests that needed another draw, empty draws spent, requests with nothing at all."""
    per_request = used.groupBy(request).agg(
        F.count("score").alias("made"), F.count_if(F.col("score").isNull()).alias("empty")
    )
    return per_request.agg(
        F.count_if((F.col("made") > 0) & (F.col("empty") > 0)).alias("retried"),
        F.sum("empty").alias("extra_draws"),
        F.count_if(F.col("made") == 0).alias("failed"),
    )


def no_output(requests: DataFrame, used: DataFrame, request: str) -> DataFrame:
    """Requests none of whose draws produced anything."""
    return requests.join(used.where(F.col("score").isNotNull()).select(request), request, "left_anti")


def truncation_rate(chosen: DataFrame, truncated: str, text: str) -> DataFrame:
    """One row: outputs, truncated ones, their share, and the longest text affected."""
    hit = F.col(truncated)
    return chosen.agg(
        F.count(F.lit(1)).alias("generated"),
        F.count_if(hit).alias("truncated"),
        F.coalesce(F.avg(F.when(hit, 1.0).otherwise(0.0)), F.lit(0.0)).alias("rate"),
        F.max_by(F.when(hit, F.col(text)), F.when(hit, F.struct(F.length(text), F.col(text)))).alias("longest"),
    )


def style_order(
    refs: DataFrame, request: list[str], ord_: str, size: str, text: str | None = None, target: str | None = None,
    by: str = "width", low: float = fixed.STYLE_RANGE[0], high: float = fixed.STYLE_RANGE[1], keep: int | None = None,
) -> DataFrame:
    """References of each request best-suited first, as ``rank`` from 1.

    Inside the size range first: nearest its middle, or, by letters, covering most of
    the target's characters. Outside it: nearest the range. Without texts letters
    cannot be told and width decides. All references are ranked, or the first ``keep``.
    """
    if by not in fixed.ORDERINGS:
        raise ValueError(f"ordering must be one of {fixed.ORDERINGS}, not {by!r}")
    width = F.col(size)
    outside = ~width.between(low, high)
    middle = F.abs(width - (low + high) / 2)
    distance = F.least(F.abs(width - low), F.abs(width - high))
    lead = -coverage(F.col(target), F.col(text)) if by == "letters" and text and target else middle
    order = [
        outside,
        F.when(outside, distance).otherwise(lead),
        F.when(outside, F.lit(0.0)).otherwise(middle if by == "letters" else F.lit(0.0)),
        F.col(ord_),
    ]
    if keep:
        return top_per_group(refs, request, order, keep, "rank")
    return refs.withColumn("rank", F.row_number().over(Window.partitionBy(*request).orderBy(*order)))


def style_cycle(attempts: DataFrame, ranked: DataFrame, request: str) -> DataFrame:
    """Each attempt with the reference it uses: the ranked references in turn, over and over."""
    counts = ranked.groupBy(request).agg(F.max("rank").alias("__n"))
    turn = attempts.join(counts, request).withColumn("rank", F.pmod(F.col("attempt") - 1, F.col("__n")) + 1)
    return turn.drop("__n").join(ranked, [request, "rank"])
