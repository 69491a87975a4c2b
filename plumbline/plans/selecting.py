"""Best-of-K selection over line items as draws."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from plumbline import fixed
from plumbline.functions.text import letters_of
from plumbline.operators import selection, similarity
from plumbline.operators.sampling import style_refs
from plumbline.plans.registry import query, r6

ORDER = [
    "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
    "l_returnflag", "l_linestatus", "l_shipdate",
]


def draws(read):
    """An order's line items in turn are its request's attempts."""
    turn = Window.partitionBy("l_orderkey").orderBy(*ORDER)
    rows = read("lineitem").withColumn("attempt", F.row_number().over(turn))
    return rows.select(
        F.col("l_orderkey").alias("request"), "attempt",
        F.when(F.col("l_quantity") > 3, F.round(F.abs("l_discount") * 8, 4)).alias("score"),
        F.round(F.abs("l_tax") * 50).cast("int").alias("overrun"),
        F.when(F.col("l_returnflag") == "N", F.col("l_quantity") - 35).alias("support"),
        F.when(F.col("l_linestatus") == "F", F.col("l_extendedprice") / (1500.0 * F.col("l_quantity"))).alias("width_ratio"),
        F.when(F.col("l_linenumber") == 7, "the").alias("doubled"),
        (F.pmod("l_suppkey", F.lit(97)) / 97.0).alias("similarity"),
        (F.col("l_quantity") >= 45).alias("truncated"),
        F.concat_ws(" ", F.col("l_partkey"), F.col("l_returnflag")).alias("text"),
    )


SQL_DRAWS = f"""
WITH d AS (
  SELECT l_orderkey AS request, (row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(ORDER)}))::INT AS attempt,
         CASE WHEN l_quantity > 3 THEN round(abs(l_discount) * 8, 4) END AS score, round(abs(l_tax) * 50)::INT AS overrun,
         CASE WHEN l_returnflag = 'N' THEN l_quantity - 35 END AS support,
         CASE WHEN l_linestatus = 'F' THEN l_extendedprice / (1500.0::DOUBLE * l_quantity) END AS width_ratio,
         CASE WHEN l_linenumber = 7 THEN 'the' END AS doubled, (l_suppkey % 97) / 97.0::DOUBLE AS similarity,
         l_quantity >= 45 AS truncated, l_partkey || ' ' || l_returnflag AS text
  FROM lineitem),
a AS (SELECT *, coalesce(score <= 0.5 AND overrun <= 2 AND coalesce(support, 0) <= 10
                         AND coalesce(width_ratio >= 0.70 AND width_ratio < 1.40, true) AND doubled IS NULL, false) AS ok FROM d),
m AS (SELECT * FROM a WHERE attempt <= 8),
f AS (SELECT request, min(attempt) FILTER (ok) AS first FROM m GROUP BY 1),
used AS (SELECT m.* FROM m JOIN f USING (request) WHERE attempt <= coalesce(first, 8)),
hand AS (SELECT m.*, first FROM m JOIN f USING (request) WHERE attempt <= coalesce(greatest(first, 4), 8))
"""


def used(read):
    return selection.draws_used(draws(read), "request")


def hand(read):
    return selection.draws_used(draws(read), "request", "hand")


@query("acceptable", SQL_DRAWS + "SELECT request, attempt, ok FROM a")
def acceptable(read):
    ok = F.coalesce(selection.acceptable(), F.lit(False))
    return draws(read).select("request", "attempt", ok.alias("ok"))


@query("draws_used", SQL_DRAWS + "SELECT request, attempt, ok FROM used")
def draws_used(read):
    return used(read).select("request", "attempt", "ok")


@query("draws_used_hand", SQL_DRAWS + "SELECT request, attempt, ok FROM hand")
def draws_used_hand(read):
    return hand(read).select("request", "attempt", "ok")


BADNESS = "score > 0.5, coalesce(support > 10, false), doubled IS NOT NULL, score, attempt"


@query("choose_readable", SQL_DRAWS + f"""
SELECT request, attempt, score, ok FROM used WHERE score IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY request ORDER BY NOT ok, CASE WHEN ok THEN attempt END, {BADNESS}) = 1""")
def choose_readable(read):
    return selection.choose_readable(used(read), "request").select("request", "attempt", "score", "ok")


@query("choose_closest", SQL_DRAWS + f"""
SELECT request, attempt, score, ok, coalesce(attempt <> first, false) AS moved FROM hand WHERE score IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY request ORDER BY NOT ok, CASE WHEN ok THEN -similarity END NULLS LAST, CASE WHEN ok THEN attempt END, {BADNESS}) = 1""")
def choose_closest(read):
    return selection.choose_closest(hand(read), "request", "similarity").select("request", "attempt", "score", "ok", "moved")


SQL_FAULTS = """
count(*) FILTER (score <= 0.5 AND overrun > 2) AS rejected_for_overrun,
count(*) FILTER (score <= 0.5 AND coalesce(support > 10, false)) AS rejected_for_omission,
count(*) FILTER (score <= 0.5 AND NOT coalesce(width_ratio >= 0.70 AND width_ratio < 1.40, true)) AS rejected_for_width,
count(*) FILTER (score <= 0.5 AND doubled IS NOT NULL) AS rejected_for_doubling
"""


@query("rejections", SQL_DRAWS + f"SELECT {SQL_FAULTS} FROM used")
def rejections(read):
    return selection.rejections(used(read))


@query("selection_log", SQL_DRAWS + f""",
p AS (SELECT request, count(*) AS used, count(score) AS made, bool_or(ok) AS any_ok FROM used GROUP BY 1),
t AS (SELECT count(*) AS requests, sum(used)::BIGINT AS draws, round(sum(used) / count(*), 6) AS draws_per_request,
             count(*) FILTER (used = 1) AS first_draw_accepted, count(*) FILTER (made > 0 AND NOT any_ok) AS none_accepted,
             count(*) FILTER (made = 0) AS no_output FROM p),
x AS (SELECT {SQL_FAULTS} FROM used)
SELECT * FROM t, x""")
def selection_log(read):
    return selection.selection_log(used(read), "request").withColumn("draws_per_request", r6("draws_per_request"))


@query("moved_by_hand", SQL_DRAWS + f""",
c AS (SELECT *, coalesce(attempt <> first, false) AS moved FROM hand WHERE score IS NOT NULL
      QUALIFY row_number() OVER (PARTITION BY request ORDER BY NOT ok, CASE WHEN ok THEN -similarity END NULLS LAST, CASE WHEN ok THEN attempt END, {BADNESS}) = 1)
SELECT count(*) FILTER (moved) AS moved_by_hand, count(*) AS requests FROM c""")
def moved_by_hand(read):
    chosen = selection.choose_closest(hand(read), "request", "similarity")
    return chosen.agg(F.count_if("moved").alias("moved_by_hand"), F.count(F.lit(1)).alias("requests"))


@query("no_output", SQL_DRAWS + "SELECT request FROM used GROUP BY 1 HAVING count(score) = 0")
def no_output(read):
    rows = used(read)
    return selection.no_output(rows.select("request").distinct(), rows, "request")


@query("empty_log", SQL_DRAWS + """,
p AS (SELECT request, count(score) AS made, count(*) FILTER (score IS NULL) AS empty FROM used GROUP BY 1)
SELECT count(*) FILTER (made > 0 AND empty > 0) AS retried, sum(empty)::BIGINT AS extra_draws, count(*) FILTER (made = 0) AS failed FROM p""")
def empty_log(read):
    return selection.empty_log(used(read), "request")


@query("truncation_rate", SQL_DRAWS + f""",
c AS (SELECT * FROM used WHERE score IS NOT NULL
      QUALIFY row_number() OVER (PARTITION BY request ORDER BY NOT ok, CASE WHEN ok THEN attempt END, {BADNESS}) = 1)
SELECT count(*) AS generated, count(*) FILTER (truncated) AS truncated, round(avg(truncated::INT), 6) AS rate,
       arg_max(text, struct_pack(l := length(text), t := text)) FILTER (truncated) AS longest FROM c""")
def truncation_rate(read):
    chosen = selection.choose_readable(used(read), "request")
    return selection.truncation_rate(chosen, "truncated", "text").withColumn("rate", r6("rate"))


# -- references of a request: other documents of its source, by size and letters --


def request_refs(read):
    # Coverage asks only which letters occur, so the letters travel and the texts stay.
    letters = F.array_join(letters_of(F.col("text")), "").alias("text")
    d = read("documents").select("doc_id", "source", letters, (F.col("n_chars") * 0.5).alias("size"))
    refs = style_refs(d, "source", "doc_id", 5, fixed.SEED).select(
        F.col("doc_id").alias("request"), F.posexplode("refs").alias("ord", "doc_id")
    )
    with_text = refs.join(d.select("doc_id", "text", "size"), "doc_id").withColumnRenamed("doc_id", "ref")
    targets = d.select(F.col("doc_id").alias("request"), F.col("text").alias("target"))
    return with_text.join(targets, "request")


def sql_style_order(order):
    from plumbline.plans.sampling import sql_refs

    return sql_refs(5) + f""",
refs AS (SELECT w.doc_id AS request, j AS ord, r.doc_id AS ref FROM want w JOIN ring r ON r.source = w.source AND r.seat = w.seat),
x AS (SELECT request, ord, ref, d.n_chars * 0.5::DOUBLE AS size, d.text AS text, t.text AS target
      FROM refs JOIN documents d ON d.doc_id = ref JOIN documents t ON t.doc_id = request),
letters AS (SELECT doc_id, list_distinct(list_filter(string_split(replace(text, ' ', ''), ''), lambda c: c <> '')) AS ls FROM documents),
o AS (SELECT x.request, x.ord, x.ref, NOT (size BETWEEN 500 AND 1100) AS outside, abs(size - 800) AS middle,
             least(abs(size - 500), abs(size - 1100)) AS distance,
             CASE WHEN len(a.ls) = 0 THEN 0 ELSE len(list_intersect(a.ls, b.ls)) / len(a.ls) END AS coverage
      FROM x JOIN letters a ON a.doc_id = request JOIN letters b ON b.doc_id = ref)
SELECT request, ref, (row_number() OVER (PARTITION BY request ORDER BY {order}))::INT AS rank FROM o"""


@query("style_order", sql_style_order("outside, CASE WHEN outside THEN distance ELSE middle END, ord"))
def style_order(read):
    return selection.style_order(request_refs(read), ["request"], "ord", "size").select("request", "ref", "rank")


@query("style_order_letters", sql_style_order(
    "outside, CASE WHEN outside THEN distance ELSE -coverage END, CASE WHEN outside THEN 0 ELSE middle END, ord"))
def style_order_letters(read):
    ranked = selection.style_order(request_refs(read), ["request"], "ord", "size", "text", "target", "letters")
    return ranked.select("request", "ref", "rank")


@query("style_cycle", sql_style_order("outside, CASE WHEN outside THEN distance ELSE middle END, ord").replace(
    "SELECT request, ref, (row_number()", ", rk AS (SELECT request, ref, (row_number()") + """),
a AS (SELECT doc_id AS request, attempt FROM documents, range(1, 9) t(attempt))
SELECT request, attempt::INT AS attempt, ref FROM a JOIN rk USING (request) WHERE rank = (attempt - 1) % 5 + 1""")
def style_cycle(read):
    ranked = selection.style_order(request_refs(read), ["request"], "ord", "size").select("request", "rank", "ref")
    attempts = read("documents").select(
        F.col("doc_id").alias("request"), F.explode(F.sequence(F.lit(1), F.lit(selection.MAX_ATTEMPTS))).alias("attempt")
    )
    return selection.style_cycle(attempts, ranked, "request").select("request", "attempt", "ref")


@query("page_vectors", """
WITH u AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS v
           FROM embeddings),
m AS (SELECT label, list(m ORDER BY i) AS v FROM (SELECT label, i, avg(v[i]) AS m FROM u, range(1, 65) t(i) GROUP BY 1, 2) GROUP BY 1)
SELECT label, round(list_sum(list_transform(v, lambda x: x / sqrt(list_dot_product(v, v)))), 6) AS total FROM m""")
def page_vectors(read):
    pages = similarity.page_vectors(read("embeddings"), ["label"], "embedding", 64)
    return pages.select("label", F.round(F.aggregate("page", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))
