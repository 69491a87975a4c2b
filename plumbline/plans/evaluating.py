"""A whole measurement on the sample tables: embeddings are outputs, part names what they say."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline import evaluation
from plumbline.plans import measures
from plumbline.plans.intervals import INTERVAL, sql_boot
from plumbline.plans.registry import query, r6
from plumbline.session import fresh_path

RESAMPLES = 200


def run_tables(read):
    """requests, draws, truths, gallery and floor of one run; every eleventh request has no output."""
    said = measures.readings(read).select((F.col("p_partkey") - 1).alias("request"), "target", "reading", "second")
    asked = measures.query_rows(read).withColumnRenamed("vec_id", "request").join(said, "request")
    length = F.length("target").cast("double")
    requests = asked.select("request", F.col("label").alias("writer_id"), F.col("target").alias("text"), (length * 10).alias("predicted"))
    vector = F.transform("v", lambda x: x * 0.7 + 0.05)
    draws = asked.select(
        "request", F.lit(1).alias("attempt"), F.when(F.col("request") % 11 != 0, F.col("second")).alias("reading"), (length * 9).alias("size"),
        ((F.col("request") % 7) * 2.5).alias("support"), vector.alias("vector"), vector[0].alias("first"), vector[1].alias("second_entry"),
    )
    truths = asked.select(
        "request", F.col("reading").alias("real_reading"), (length * 10).alias("real_size"), ((F.col("request") % 5) * 3.0).alias("real_support"),
        F.col("v").alias("real_vector"), F.col("v")[0].alias("real_first"), F.col("v")[1].alias("real_second_entry"),
    )
    gallery = measures.gallery_rows(read).select(F.col("label").alias("writer_id"), F.col("v").alias("vector"))
    floor = measures.query_rows(read).select(F.col("label").alias("writer_id"), F.reverse("v").alias("vector"))
    return requests, draws, truths, gallery, floor


def measured(read, names):
    requests, draws, truths, gallery, floor = run_tables(read)
    path = fresh_path(requests.sparkSession, "runs")
    results = evaluation.measure(requests, draws, truths, gallery, path, "one", floor=floor, features=["first", "second_entry"], names=names,
                                 resamples=RESAMPLES, fid_resamples=20, fid_minimum=2)
    return path, results


SQL_RUN = measures.SQL_READINGS.strip() + f""", {measures.SQL_SIDES}, {measures.SQL_MEANS},
q AS (SELECT vec_id, label, v, list_transform(v, lambda x: x * 0.7 + 0.05::DOUBLE) AS g, target, reading, second FROM s JOIN r ON p_partkey = vec_id + 1 WHERE fold = 1),
a AS (SELECT * FROM q WHERE vec_id % 11 <> 0),
c AS (SELECT vec_id, label, gallery.g AS g, list_dot_product(a.g, mean) / (sqrt(list_dot_product(a.g, a.g)) * sqrt(list_dot_product(mean, mean))) AS sim FROM a, gallery),
k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, g) AS rank FROM c),
hits AS (SELECT vec_id, label, bool_or(g = label AND rank = 1) AS hit1, bool_or(g = label AND rank <= 5) AS hitk FROM k WHERE label IN (SELECT g FROM gallery) GROUP BY 1, 2),
d AS (SELECT 'generated' AS set, label, g AS v FROM a UNION ALL SELECT 'real', label, v FROM a UNION ALL SELECT 'floor', label, list_reverse(v) FROM s WHERE fold = 1),
dm AS (SELECT set, label, list(m ORDER BY i) AS mean FROM (SELECT set, label, i, avg(v[i]) AS m FROM d, range(1, 65) t(i) GROUP BY 1, 2, 3) GROUP BY 1, 2),
x AS (SELECT set, label, g, list_distance(dm.mean, gallery.mean) AS dist FROM dm, gallery),
w AS (SELECT set, label, max(dist) FILTER (g = label) AS own, (sum(dist) - max(dist) FILTER (g = label)) / (count(*) - 1) - max(dist) FILTER (g = label) AS gap FROM x GROUP BY 1, 2),
pairs AS (SELECT m.label, m.gap AS made, t.gap AS truth FROM w m JOIN w t ON m.label = t.label AND m.set = 'generated' AND t.set = 'real')
"""

RATIO, MEAN = "sum(w * e) / sum(w * n)", "sum(w * y) / sum(w)"
SQL_FIGURES = {
    "top1": ("SELECT vec_id AS id, hit1::INT AS y FROM hits", MEAN), "topk": ("SELECT vec_id AS id, hitk::INT AS y FROM hits", MEAN),
    "distance": ("SELECT label AS id, own AS y FROM w WHERE set = 'generated'", MEAN), "distance_real": ("SELECT label AS id, own AS y FROM w WHERE set = 'real'", MEAN),
    "distance_floor": ("SELECT label AS id, own AS y FROM w WHERE set = 'floor'", MEAN),
    "identity": ("SELECT label AS id, made, truth FROM pairs", "CASE WHEN sum(w * truth) > 0 THEN sum(w * made) / sum(w * truth) END"),
    "cer": ("SELECT vec_id AS id, levenshtein(second, target) AS e, length(target) AS n FROM a", RATIO),
    "cer_real": ("SELECT vec_id AS id, levenshtein(reading, target) AS e, length(target) AS n FROM a", RATIO),
    "missing": ("SELECT vec_id AS id, (vec_id % 7 * 2.5 > 10)::INT AS y FROM a", MEAN), "missing_real": ("SELECT vec_id AS id, (vec_id % 5 * 3.0 > 10)::INT AS y FROM a", MEAN),
}


@query("measurement", SQL_RUN + "".join(f", {sql_boot(units, stat, RESAMPLES, 'id', tag=name)}" for name, (units, stat) in SQL_FIGURES.items())
       + " UNION ALL ".join(f"SELECT '{name}' AS name, {INTERVAL} FROM {name}_z" for name in SQL_FIGURES))
def measurement(read):
    _, results = measured(read, list(SQL_FIGURES))
    return results.select("name", *[r6(c).alias(c) for c in ("value", "low", "high")], "n")


@query("measurement_counts", SQL_RUN + """
SELECT 'requests' AS name, count(*) AS n FROM q UNION ALL SELECT 'answered', count(*) FROM a
UNION ALL SELECT 'retrieval_scored', count(*) FROM a WHERE label IN (SELECT g FROM gallery)
UNION ALL SELECT 'retrieval_withheld', count(*) FROM a WHERE label NOT IN (SELECT g FROM gallery)
UNION ALL SELECT 'writers_not_in_gallery', count(DISTINCT label) FROM q WHERE label NOT IN (SELECT g FROM gallery)""")
def measurement_counts(read):
    path, results = measured(read, [])
    return evaluation.counts(results.sparkSession, path, "one")


@query("measurement_spread")
def measurement_spread(read):
    _, results = measured(read, ["fid", "detectable"])
    return results.select("name", "value", "low", "high", "n", "error")
