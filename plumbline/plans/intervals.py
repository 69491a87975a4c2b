"""Bootstrap intervals on the sample tables; the SQL twins make the same draws."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from plumbline import fixed
from plumbline.functions import numbers
from plumbline.functions.resampling import sql_weights
from plumbline.operators import intervals, moments, rates, skew
from plumbline.operators.resample import Aggregate
from plumbline.plans import measures
from plumbline.plans.registry import h, query, r6

SEED = fixed.SEED


def sql_boot(units: str, stat: str, resamples: int, key: str, by: str = "", tag: str = "boot") -> str:
    """CTEs of a bootstrap: units, their counts, replicates and, as ``<tag>_z``, the point and its ends. ``stat`` weighs units by w."""
    lead, group = (f"{by}, ", f"GROUP BY {by}") if by else ("", "")
    part = f"PARTITION BY {by}" if by else ""
    keyed = f"(SELECT *, {h(key)} AS unit_hash FROM {tag}_u)"
    return f"""
{tag}_u AS ({units}),
{tag}_d AS (SELECT * FROM ({sql_weights(keyed, 'unit_hash', resamples)})),
{tag}_r AS (SELECT {lead}r, {stat} AS stat, sum(w) AS drawn FROM {tag}_d GROUP BY {lead}r),
{tag}_f AS (SELECT * REPLACE (CASE WHEN drawn > 0 THEN stat ELSE max(stat) FILTER (r < 0) OVER ({part}) END AS stat) FROM {tag}_r),
{tag}_z AS (SELECT {lead}max(stat) FILTER (r < 0) AS value, (max(drawn) FILTER (r < 0))::BIGINT AS n,
             CASE WHEN count(stat) FILTER (r >= 0) = {resamples} THEN quantile_cont(stat, 0.025) FILTER (r >= 0) END AS low,
             CASE WHEN count(stat) FILTER (r >= 0) = {resamples} THEN quantile_cont(stat, 0.975) FILTER (r >= 0) END AS high FROM {tag}_f {group})
"""


INTERVAL = "round(value, 6) AS value, round(low, 6) AS low, round(high, 6) AS high, n"


def shown(df, *more):
    return df.select(*more, *[r6(c).alias(c) for c in ("value", "low", "high")], "n")


def customer_totals(read):
    return read("orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("total"), F.count(F.lit(1)).alias("orders"))


CUSTOMER_TOTALS = "SELECT o_custkey, sum(o_totalprice) AS total, count(*) AS orders FROM orders GROUP BY 1"


@query("bootstrap", "WITH " + sql_boot(CUSTOMER_TOTALS, "sum(w * total) / sum(w * orders)", 200, "o_custkey") + f"SELECT {INTERVAL} FROM boot_z")
def bootstrap(read):
    found = intervals.bootstrap(
        customer_totals(read), ["o_custkey"], ["total", "orders"], lambda t: t("total") / t("orders"), resamples=200
    )
    return shown(found)


@query("rate_interval", measures.SQL_COSINES + ", " + sql_boot("SELECT vec_id, hit1 FROM hits", "sum(w * hit1::INT) / sum(w)", 2000, "vec_id") + f"SELECT {INTERVAL} FROM boot_z")
def rate_interval(read):
    return shown(intervals.rate_interval(measures.hits(read), ["vec_id"], "hit1"))


TERMS = measures.SQL_READINGS + ", t AS (SELECT p_partkey, levenshtein(reading, target) AS errors, length(target) AS length FROM r), "


@query("ratio_interval", TERMS + sql_boot("SELECT * FROM t", "sum(w * errors) / sum(w * length)", 500, "p_partkey") + f"SELECT {INTERVAL} FROM boot_z")
def ratio_interval(read):
    terms = rates.error_terms(measures.readings(read), "reading", "target")
    return shown(intervals.ratio_interval(terms, ["p_partkey"], "errors", "length", resamples=500))


@query("group_interval", measures.SQL_THREE + ", " + sql_boot("SELECT set, label, own, gap, nearest_is_right FROM w", "sum(w * gap) / sum(w)", 2000, "label", "set")
       + f"SELECT set, {INTERVAL} FROM boot_z")
def group_interval(read):
    found = intervals.mean_interval(measures.three_distances(read), ["label"], "gap", by=["set"])
    return shown(found, "set")


GAPS = """SELECT g.label, g.gap AS made, r.gap AS truth FROM w g JOIN w r ON g.label = r.label AND g.set = 'generated' AND r.set = 'real'"""


def gaps(read):
    distances = measures.three_distances(read)
    return distances.groupBy("label").agg(
        F.max(F.when(F.col("set") == "generated", F.col("gap"))).alias("made"),
        F.max(F.when(F.col("set") == "real", F.col("gap"))).alias("truth"),
        F.max(F.when(F.col("set") == "floor", F.col("gap"))).alias("lowest"),
    )


@query("paired_ratio_interval", measures.SQL_THREE + ", " + sql_boot(GAPS, "CASE WHEN sum(w * truth) > 0 THEN sum(w * made) / sum(w * truth) END", 2000, "label")
       + f"SELECT {INTERVAL} FROM boot_z")
def paired_ratio_interval(read):
    return shown(intervals.paired_ratio_interval(gaps(read), ["label"], "made", "truth"))


CUSTOMER_GAPS = """
SELECT o_custkey, sum(o_totalprice) FILTER (o_orderpriority LIKE '1%') AS first, sum(o_totalprice) FILTER (o_orderpriority LIKE '2%') AS second,
       sum(o_totalprice) AS base FROM orders GROUP BY 1"""


@query("paired_diff_interval", "WITH " + sql_boot(
    f"SELECT o_custkey, coalesce(first, 0) AS first, coalesce(second, 0) AS second, base FROM ({CUSTOMER_GAPS})",
    "sum(w * first) / sum(w * base) - sum(w * second) / sum(w * base)", 200, "o_custkey") + f"""
SELECT {INTERVAL}, CASE WHEN n < 10 THEN 'too few groups to judge' WHEN low > 0 THEN 'higher, and the difference is real'
       WHEN high < 0 THEN 'lower, and the difference is real' ELSE 'no difference that survives resampling' END AS verdict FROM boot_z""")
def paired_diff_interval(read):
    price, priority = F.col("o_totalprice"), F.substring("o_orderpriority", 1, 1)
    units = read("orders").groupBy("o_custkey").agg(
        F.sum(F.when(priority == "1", price).otherwise(0.0)).alias("first"),
        F.sum(F.when(priority == "2", price).otherwise(0.0)).alias("second"), F.sum(price).alias("base"),
    )
    found = intervals.paired_diff_interval(units, ["o_custkey"], "first", "second", "base", resamples=200)
    return shown(found, "verdict")


@query("relative_change_interval", """WITH ends AS (SELECT user_id, arg_min_null(value, struct_pack(t := ts, e := event_id)) AS first,
       arg_max_null(value, struct_pack(t := ts, e := event_id)) AS last FROM events GROUP BY 1),
ch AS (SELECT user_id, CASE WHEN first <> 0 THEN (last - first) / first END AS change FROM ends), """ + sql_boot(
    "SELECT user_id, change FROM ch WHERE change IS NOT NULL", "sum(w * change) / sum(w)", 1000, "user_id") + f"""
SELECT {INTERVAL}, CASE WHEN value <= -0.03 AND high < 0 THEN 'run' ELSE 'close' END AS decision, (SELECT count(*) FROM ch WHERE change IS NULL) AS undefined FROM boot_z""")
def relative_change_interval(read):
    found = intervals.relative_change_interval(read("events"), "user_id", F.struct("ts", "event_id"), "value", resamples=1000)
    return shown(found, "decision", "undefined")


@query("frechet_interval")
def frechet_interval(read):
    return moments.frechet_interval(measures.two_halves(read), "side", "v", "vec_id", resamples=50)


@query("bootstrap_weights", "WITH " + sql_boot("SELECT l_orderkey, l_linenumber, l_quantity, l_discount FROM lineitem", "sum(w * l_discount) / sum(w * l_quantity)", 50,
                                                "l_orderkey, l_linenumber") + f"SELECT {INTERVAL} FROM boot_z")
def bootstrap_weights(read):
    # Every line item is a unit of its own.
    rows = read("lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")
    found = intervals.bootstrap(
        rows, ["l_orderkey", "l_linenumber"], ["l_quantity", "l_discount"], lambda t: t("l_discount") / t("l_quantity"), resamples=50
    )
    return shown(found)


ORDER_MEDIAN = f"""WITH u AS (SELECT o_orderkey, o_orderpriority, o_totalprice AS v, {h('o_orderkey')} AS unit_hash FROM orders),
d AS (SELECT * FROM ({sql_weights('u', 'unit_hash', 100)}) WHERE w > 0),
c AS (SELECT o_orderpriority, r, v, sum(w) OVER (PARTITION BY o_orderpriority, r ORDER BY v, o_orderkey ROWS UNBOUNDED PRECEDING) AS upto, w,
      sum(w) OVER (PARTITION BY o_orderpriority, r) AS total FROM d),
f AS (SELECT o_orderpriority, r, any_value(total) AS drawn, min(v) FILTER (upto > floor((total - 1) / 2)) AS a, min(v) FILTER (upto > ceil((total - 1) / 2)) AS b FROM c GROUP BY 1, 2),
s AS (SELECT o_orderpriority, r, drawn, (a + b) / 2 AS stat FROM f)
SELECT o_orderpriority, round(max(stat) FILTER (r < 0), 6) AS value, round(quantile_cont(stat, 0.025) FILTER (r >= 0), 6) AS low,
       round(quantile_cont(stat, 0.975) FILTER (r >= 0), 6) AS high, (max(drawn) FILTER (r < 0))::BIGINT AS n FROM s GROUP BY 1"""


@query("median_interval", ORDER_MEDIAN)
def median_interval(read):
    found = intervals.bootstrap_quantile(read("orders"), ["o_orderkey"], "o_totalprice", 0.5, ["o_orderpriority"], resamples=100)
    return shown(found, "o_orderpriority")


class Evenness(Aggregate):
    """Entropy of the shares that categories have: not a function of a fixed number of sums."""

    columns = ["category"]

    def init(self, replicates):
        return {}

    def add(self, state, values, counts):
        names = values["category"]
        for name in set(names.tolist()):
            state[name] = state.get(name, 0) + counts[names == name].sum(axis=0, dtype=np.int64)
        return state

    def merge(self, one, other):
        return {name: one.get(name, 0) + other.get(name, 0) for name in one.keys() | other.keys()}

    def finish(self, state):
        counts = np.array(list(state.values()), float)
        total = counts.sum(axis=0)
        shares = np.divide(counts, total, out=np.zeros_like(counts), where=total > 0)
        return np.where(total > 0, -(shares * np.log(np.where(shares > 0, shares, 1.0))).sum(axis=0), np.nan)


@query("statistic_interval", "WITH " + sql_boot("SELECT p_partkey, p_brand, p_type AS category FROM part", "sum(w)", 200, "p_partkey", "p_brand", "c")
       .split("c_r AS")[0].rstrip().rstrip(",") + """,
c AS (SELECT p_brand, r, category, sum(w) AS w FROM c_d GROUP BY 1, 2, 3),
t AS (SELECT p_brand, r, sum(w) AS drawn FROM c GROUP BY 1, 2),
e AS (SELECT p_brand, r, any_value(drawn) AS drawn, -sum(CASE WHEN w > 0 THEN w / drawn * ln(w / drawn) ELSE 0 END) AS stat FROM c JOIN t USING (p_brand, r) GROUP BY 1, 2),
s AS (SELECT p_brand, r, drawn, CASE WHEN drawn > 0 THEN stat ELSE max(stat) FILTER (r < 0) OVER (PARTITION BY p_brand) END AS stat FROM e)
SELECT p_brand, round(max(stat) FILTER (r < 0), 6) AS value, round(quantile_cont(stat, 0.025) FILTER (r >= 0), 6) AS low,
       round(quantile_cont(stat, 0.975) FILTER (r >= 0), 6) AS high, (max(drawn) FILTER (r < 0))::BIGINT AS n FROM s GROUP BY 1""")
def statistic_interval(read):
    rows = read("part").withColumn("category", F.col("p_type"))
    return shown(intervals.bootstrap_aggregate(rows, ["p_partkey"], Evenness(), ["p_brand"], resamples=200), "p_brand")


@query("blind_interval", measures.SQL_BLIND + ", " + sql_boot("SELECT judge, avg(hit::INT) AS share FROM hits GROUP BY 1", "sum(w * share) / sum(w)", 500, "judge")
       + f"SELECT {INTERVAL} FROM boot_z")
def blind_interval(read):
    per_judge = rates.blind_score(measures.answers(read), measures.trial_key(read))[1]
    return shown(intervals.mean_interval(per_judge, ["judge"], "accuracy", resamples=500))


@query("separates", """
WITH n AS (SELECT c_nationkey, quantile_cont(c_acctbal, 0.4) AS low, quantile_cont(c_acctbal, 0.6) AS high FROM customer GROUP BY 1)
SELECT a.c_nationkey, a.high < b.low OR b.high < a.low AS separate, round((a.high - a.low) / 2, 6) AS half_width
FROM n a JOIN n b ON b.c_nationkey = (a.c_nationkey + 1) % 25""")
def separates(read):
    q = skew.exact_quantiles(read("customer"), ["c_nationkey"], F.col("c_acctbal"), [0.4, 0.6])
    a = q.select("c_nationkey", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))
    b = a.select(F.pmod(F.col("c_nationkey") - 1, F.lit(25)).alias("c_nationkey"), F.col("low").alias("low2"), F.col("high").alias("high2"))
    apart = numbers.separates(F.col("low"), F.col("high"), F.col("low2"), F.col("high2"))
    return a.join(b, "c_nationkey").select(
        "c_nationkey", apart.alias("separate"), r6(numbers.half_width(F.col("low"), F.col("high"))).alias("half_width")
    )


def brand_interval(read, reading):
    terms = rates.error_terms(measures.readings(read), reading, "target").withColumnRenamed("p_brand", "name")
    return intervals.ratio_interval(terms, ["p_partkey"], "errors", "length", by=["name"], resamples=200)


def sql_brand(reading, tag):
    units = f"SELECT p_partkey, p_brand AS name, levenshtein({reading}, target) AS errors, length(target) AS length FROM r"
    return sql_boot(units, "sum(w * errors) / sum(w * length)", 200, "p_partkey", "name", tag)


@query("compare_runs", measures.SQL_READINGS + ", " + sql_brand("reading", "a") + ", " + sql_brand("second", "b") + """
SELECT a_z.name, round(a_z.value, 6) AS first_value, round(b_z.value, 6) AS second_value,
       CASE WHEN a_z.high < b_z.low OR b_z.high < a_z.low THEN 'SEPARATE' ELSE 'overlap' END AS verdict FROM a_z JOIN b_z USING (name)""")
def compare_runs(read):
    table = intervals.compare_runs(brand_interval(read, "reading"), brand_interval(read, "second"))
    return table.select("name", r6("first_value").alias("first_value"), r6("second_value").alias("second_value"), "verdict")
