"""Tone, marks and peaks on the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import marks, skew, tone
from plumbline.plans.registry import query, r6


@query("contrast_stretch", """
WITH q AS (SELECT event_type, quantile_cont(value, 0.02) AS dark, quantile_cont(value, 0.85) AS light FROM events GROUP BY 1)
SELECT event_id, round(CASE WHEN light - dark < 1.0 THEN value
  ELSE floor(greatest(0.0, least(255.0, (value - dark) / (light - dark) * 255.0::DOUBLE))) END, 6) AS stretched
FROM events JOIN q USING (event_type)""")
def contrast_stretch(read):
    rows = read("events").select("event_id", "event_type", "value")
    return tone.contrast_stretch(rows, "event_type", "value").select("event_id", r6("stretched").alias("stretched"))




@query("tone_curve", f"""
SELECT event_type, array_to_string(list_transform(quantile_cont(value, [{', '.join(str(i / 20) for i in range(21))}]),
       lambda x: printf('%.6f', x)), ',') AS knots FROM events GROUP BY 1""")
def tone_curve(read):
    curve = tone.tone_curve(read("events"), "event_type", "value")
    text = F.array_join(F.transform("knots", lambda x: F.format_string("%.6f", x)), ",")
    return curve.select("event_type", text.alias("knots"))


@query("quantile_match", f"""
WITH ks AS (SELECT event_type, quantile_cont(value, [{', '.join(str(i / 20) for i in range(21))}]) AS q FROM events GROUP BY 1),
goal AS (SELECT quantile_cont(value, [{', '.join(str(i / 20) for i in range(21))}]) AS q FROM events WHERE event_type = 'purchase'),
src AS (SELECT event_type, list_concat([0.0::DOUBLE], list_transform(q, lambda x, i: list_max(q[1:i]) + (i - 1) * 1e-6::DOUBLE)) AS x FROM ks),
e AS (SELECT event_id, value, x, list_concat([0.0::DOUBLE], goal.q) AS y,
             len(list_filter(x, lambda k: k <= value)) AS i FROM events JOIN src USING (event_type), goal)
SELECT event_id, round(CASE WHEN i >= 22 THEN y[22] WHEN i = 0 THEN 0.0
  ELSE y[i] + (y[i + 1] - y[i]) * (value - x[i]) / (x[i + 1] - x[i]) END, 6) AS matched FROM e""")
def quantile_match(read):
    rows = read("events").select("event_id", "event_type", "value")
    goal = tone.tone_curve(rows.where("event_type = 'purchase'"), "event_type", "value")
    return tone.quantile_match(rows, "event_type", "value", goal).select("event_id", r6("matched").alias("matched"))


REACH = 3_600_000_000


def spots(read):
    rows = read("events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    return rows.select("user_id", "event_id", "at", "event_type")


@query("attach_nearest", f"""
WITH m AS (SELECT user_id, event_id, epoch_us(ts) AS at FROM events WHERE event_type <> 'purchase'),
a AS (SELECT user_id, event_id AS anchor, epoch_us(ts) AS at FROM events WHERE event_type = 'purchase'),
p AS (SELECT m.user_id, m.event_id, anchor, abs(a.at - m.at) AS gap FROM m JOIN a USING (user_id) WHERE abs(a.at - m.at) <= {REACH}
      QUALIFY row_number() OVER (PARTITION BY m.event_id ORDER BY abs(a.at - m.at), anchor) = 1)
SELECT m.user_id, m.event_id, anchor, gap FROM m LEFT JOIN p USING (user_id, event_id)""")
def attach_nearest(read):
    rows = spots(read)
    made = rows.where("event_type <> 'purchase'").select("user_id", "event_id", "at")
    posts = rows.where("event_type = 'purchase'").select("user_id", "event_id", "at")
    return marks.attach_nearest(made, posts, ["user_id"], "event_id", "at", REACH).select("user_id", "event_id", "anchor", "gap")


@query("attach_nearest_boxes", """
WITH b AS (SELECT event_id, event_type, user_id % 10 AS page, epoch(ts)::DOUBLE / 3600 AS x0, value AS y0,
                  epoch(ts)::DOUBLE / 3600 + 2 AS x1, value + 1 + user_id % 3 AS y1 FROM events),
m AS (SELECT * FROM b WHERE event_type <> 'purchase'), a AS (SELECT * FROM b WHERE event_type = 'purchase'),
g AS (SELECT m.page, m.event_id, a.event_id AS anchor,
             sqrt(power(greatest(0.0, a.x0 - m.x1, m.x0 - a.x1), 2) + power(greatest(0.0, a.y0 - m.y1, m.y0 - a.y1), 2)) AS gap
      FROM m JOIN a USING (page)),
p AS (SELECT page, event_id, anchor, gap FROM g WHERE gap <= 3
      QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY gap, anchor) = 1)
SELECT m.page, m.event_id, anchor, round(gap, 6) AS gap FROM m LEFT JOIN p USING (page, event_id)""")
def attach_nearest_boxes(read):
    hours = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 / 3600.0  # in the SQL's two steps: one rounds otherwise
    rows = read("events").select(
        "event_id", "event_type", F.pmod("user_id", F.lit(10)).alias("page"), hours.alias("x0"), F.col("value").alias("y0"),
        (hours + 2).alias("x1"), (F.col("value") + 1 + F.pmod("user_id", F.lit(3))).alias("y1"),
    )
    found = marks.attach_nearest_boxes(
        rows.where("event_type <> 'purchase'"), rows.where("event_type = 'purchase'"), ["page"], "event_id", 3.0
    )
    return found.select("page", "event_id", "anchor", r6("gap").alias("gap"))


HOURS, SCALE = 720, 8.0

SQL_PROFILE = f"""
WITH bins AS (SELECT event_type, floor(epoch(ts) / 3600)::BIGINT - 473352 AS b, count(*)::DOUBLE AS x
              FROM events GROUP BY 1, 2),
k AS (SELECT o, exp(-0.5::DOUBLE * power(o / 4.0::DOUBLE, 2)) / sum(exp(-0.5::DOUBLE * power(o / 4.0::DOUBLE, 2))) OVER () AS w
      FROM range(-12, 13) t(o)),
s AS (SELECT event_type, b + o AS bin, round(sum(x * w), 9) AS height FROM bins, k WHERE b + o >= 0 AND b + o < {HOURS} GROUP BY 1, 2),
n AS (SELECT *, CASE WHEN lag(bin) OVER w = bin - 1 THEN lag(height) OVER w ELSE 0 END AS l,
             CASE WHEN lead(bin) OVER w = bin + 1 THEN lead(height) OVER w ELSE 0 END AS r,
             max(height) OVER (PARTITION BY event_type) AS top
      FROM s WINDOW w AS (PARTITION BY event_type ORDER BY bin)),
p AS (SELECT event_type, bin, height FROM n WHERE bin > 0 AND bin < {HOURS - 1} AND height > l AND height >= r AND height >= 0.08 * top),
c AS (SELECT event_type, list_reduce(list([bin] ORDER BY height DESC, bin), lambda acc, x:
        CASE WHEN len(list_filter(acc, lambda y: abs(y - x[1]) < {1.5 * SCALE})) = 0 THEN list_concat(acc, x) ELSE acc END, []::BIGINT[]) AS chosen
      FROM p GROUP BY 1),
centres AS (SELECT event_type, unnest(chosen) AS centre FROM c)
"""


def hourly(read):
    hour = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3_600_000_000) - 473352
    return read("events").groupBy("event_type", hour.cast("bigint").alias("b")).agg(F.count(F.lit(1)).cast("double").alias("x"))


def centres(read):
    return marks.bin_peaks(hourly(read), ["event_type"], "b", "x", HOURS, SCALE)


@query("smooth_profile", SQL_PROFILE + "SELECT event_type, bin, round(height, 6) AS height FROM s")
def smooth_profile(read):
    profile = marks.smooth_profile(hourly(read), ["event_type"], "b", "x", HOURS, SCALE)
    return profile.withColumn("height", r6("height"))


@query("bin_peaks", SQL_PROFILE + """
SELECT centres.event_type, centre, round(height, 6) AS height FROM centres JOIN s ON s.event_type = centres.event_type AND s.bin = centre""")
def bin_peaks(read):
    return centres(read).withColumn("height", r6("height"))


@query("median_pitch", SQL_PROFILE + """
SELECT event_type, count(*) AS lines, coalesce(quantile_cont(gap, 0.5), 24.0)::DOUBLE AS pitch
FROM (SELECT event_type, (centre - lag(centre) OVER (PARTITION BY event_type ORDER BY centre))::DOUBLE AS gap FROM centres) GROUP BY 1""")
def median_pitch(read):
    return marks.median_pitch(centres(read), ["event_type"], SCALE)


@query("stray_bins", SQL_PROFILE + """,
m AS (SELECT event_type, coalesce(quantile_cont(gap, 0.5), 24.0)::DOUBLE AS pitch
      FROM (SELECT event_type, (centre - lag(centre) OVER (PARTITION BY event_type ORDER BY centre))::DOUBLE AS gap FROM centres) GROUP BY 1)
SELECT bins.event_type, b, centre, abs(centre - b) > 0.75::DOUBLE * pitch AS stray
FROM bins JOIN m USING (event_type) JOIN centres USING (event_type)
QUALIFY row_number() OVER (PARTITION BY bins.event_type, b ORDER BY abs(centre - b), centre) = 1""")
def stray_bins(read):
    found = centres(read)
    pitch = marks.median_pitch(found, ["event_type"], SCALE).select("event_type", "pitch")
    return marks.stray_bins(hourly(read), found, pitch, ["event_type"], "b").select("event_type", "b", "centre", "stray")


@query("predicted_size", """
WITH r AS (SELECT source, avg(w) AS rate FROM (
  SELECT source, CASE WHEN length(text) > 0 THEN (1 + len(string_split(text, chr(10)))) * 100.0::DOUBLE / length(text) END AS w
  FROM documents) GROUP BY 1)
SELECT doc_id, round(CASE WHEN trim(text) <> '' THEN rate * length(text) END, 4) AS predicted FROM documents JOIN r USING (source)""")
def predicted_size(read):
    from plumbline.operators.selection import predicted_size as predict

    rows = read("documents").withColumn("size", (1 + F.size(F.split("text", "\n"))) * 100.0)
    sized = predict(rows.select("source", "size", "text"), ["source"], "size", "text", rows, "text")
    return sized.select("doc_id", F.round("predicted", 4).alias("predicted"))


@query("exact_quantiles", """
SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.1), 6) AS p10, round(quantile_cont(l_extendedprice, 0.5), 6) AS p50,
       round(quantile_cont(l_extendedprice, 0.9), 6) AS p90 FROM lineitem GROUP BY 1""")
def exact_quantiles(read):
    q = skew.exact_quantiles(read("lineitem"), ["l_returnflag"], F.col("l_extendedprice"), [0.1, 0.5, 0.9])
    return q.select("l_returnflag", *[r6(F.col("q")[i]).alias(n) for i, n in enumerate(("p10", "p50", "p90"))])


