"""Pairing, baselines, checks, counts and set operations on the sample tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline import fixed
from plumbline.functions import hashing, numbers
from plumbline.functions import text as tx
from plumbline.operators import baselines, checks, joins, reasons
from plumbline.plans.registry import SQL_ENGLISH, query, r6
from plumbline.session import fresh_path


def ones(read):
    return read("labels").select("doc_id", "quality", "toxic")


@query("exclude_groups", """
SELECT count(*) FILTER (source NOT IN ('src0', 'src7')) AS kept, count(*) FILTER (source IN ('src0', 'src7')) AS excluded
FROM documents""")
def exclude_groups(read):
    marked = reasons.first_reason(
        read("documents").select("doc_id", "source"),
        [reasons.exclude("source", ["src0", "src7"], fixed.EXCLUDED_GROUP)],
    )
    return marked.agg(F.count_if(F.col("kind") == "kept").alias("kept"), F.count_if(F.col("kind") == "excluded").alias("excluded"))


@query("exclude_texts", """
SELECT count(*) FILTER (d.doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)) AS kept,
       count(*) FILTER (d.doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)) AS excluded FROM documents d""")
def exclude_texts(read):
    return joins.exclusion_counts(read("documents").select("doc_id"), read("labels").where("toxic = 1"), ["doc_id"])


@query("keep_flags", f"""
WITH t AS (
  SELECT conv_id, string_agg(text, ' ' ORDER BY turn, text) AS text, count(*) AS word_count,
         min(turn) = 0 AND max(turn) = count(*) - 1 AND count(DISTINCT turn) = count(*) AS complete
  FROM conversations WHERE role = 'user' OR length(text) > 100 GROUP BY conv_id),
c AS (SELECT DISTINCT conv_id FROM conversations)
SELECT c.conv_id, complete, coalesce(length(translate(text, {SQL_ENGLISH}, '')) = 0, false) AS in_charset,
       CASE WHEN word_count IS NULL THEN '{fixed.NO_PARTS}' WHEN trim(text) = '' THEN '{fixed.EMPTY_TEXT}' END AS reason
FROM c LEFT JOIN t USING (conv_id)""")
def keep_flags(read):
    from plumbline.operators.reassemble import manifest_groups

    turns = read("conversations")
    parts = turns.where((F.col("role") == "user") | (F.length("text") > 100))
    groups = turns.select("conv_id").distinct()
    english = tx.alphabet("english")
    rows = manifest_groups(
        groups, parts.select("conv_id", "turn", "text"), ["conv_id"], "turn", "text", english,
        writer="conv_id", passage="conv_id", exclude_writers=(), exclude_texts=(),
        keep_out_of_charset=True, keep_incomplete=True,
    )
    return rows.select(
        "conv_id", "complete", F.coalesce(english.supports(F.col("text")), F.lit(False)).alias("in_charset"), "reason"
    )


@query("require_exists", "SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def require_exists(read):
    return joins.keep_known(read("documents").select("doc_id", "source"), read("labels"), ["doc_id"])


@query("exclude_consumed", "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def exclude_consumed(read):
    return joins.without_known(read("documents").select("doc_id", "source"), read("labels"), ["doc_id"])


@query("strict_pair", """
SELECT doc_id, n_chars, quality, toxic FROM documents JOIN labels USING (doc_id)""")
def strict_pair(read):
    # Requests without a label are taken out together with their truth, then every pair must match.
    left = joins.keep_known(read("documents").select("doc_id", "n_chars"), read("labels"), ["doc_id"])
    return joins.strict_pair(left, ones(read), ["doc_id"])


@query("pairing_faults", """
SELECT doc_id, 'left' AS only_on FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def pairing_faults(read):
    return joins.pairing_faults(read("documents").select("doc_id"), ones(read), ["doc_id"])


def order_runs(read):
    """Two runs over the orders: output of each is the price of its returned or accepted items, if any."""
    items = read("lineitem")
    both = items.groupBy("l_orderkey").agg(
        F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity"))).alias("r"),
        F.sum(F.when(F.col("l_returnflag") == "A", F.col("l_quantity"))).alias("a"),
    )
    return both.select("l_orderkey", F.col("r").alias("out")), both.select("l_orderkey", F.col("a").alias("out"))


SQL_RUNS = """
WITH b AS (SELECT l_orderkey, sum(l_quantity) FILTER (l_returnflag = 'R') AS r, sum(l_quantity) FILTER (l_returnflag = 'A') AS a
           FROM lineitem GROUP BY 1)
"""


@query("paired_runs", SQL_RUNS + """
SELECT l_orderkey, r AS first_out, a AS second_out FROM b WHERE r IS NOT NULL AND a IS NOT NULL""")
def paired_runs(read):
    pairs, _ = joins.paired_runs(*order_runs(read), ["l_orderkey"], "out")
    return pairs


@query("paired_runs_lost", SQL_RUNS + """
SELECT count(*) FILTER (r IS NOT NULL AND a IS NOT NULL) AS kept,
       count(*) FILTER (r IS NULL OR a IS NULL) AS lost FROM b""")
def paired_runs_lost(read):
    _, lost = joins.paired_runs(*order_runs(read), ["l_orderkey"], "out")
    return lost


@query("rebind_run", """
SELECT doc_id, quality, source, n_chars FROM labels JOIN documents USING (doc_id)""")
def rebind_run(read):
    saved = read("labels").select("doc_id", "quality")
    return joins.rebind_run(saved, read("documents").select("doc_id", "source", "n_chars"), "doc_id")


@query("set_reconcile", """
SELECT count(*) FILTER (o.k IS NULL) AS only_left, count(*) FILTER (c.k IS NULL) AS only_right,
       count(*) FILTER (o.k IS NOT NULL AND c.k IS NOT NULL) AS shared
FROM (SELECT DISTINCT c_custkey AS k FROM customer) c
FULL JOIN (SELECT DISTINCT o_custkey AS k FROM orders) o ON c.k = o.k""")
def set_reconcile(read):
    return joins.set_reconcile(
        read("customer").select(F.col("c_custkey").alias("k")), read("orders").select(F.col("o_custkey").alias("k")), ["k"]
    )


@query("set_difference", """
SELECT 'only_customer' AS side, count(*) AS n FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders)
UNION ALL
SELECT 'only_orders', count(*) FROM (SELECT o_custkey FROM orders EXCEPT SELECT c_custkey FROM customer)""")
def set_difference(read):
    c = read("customer").select(F.col("c_custkey").alias("k"))
    o = read("orders").select(F.col("o_custkey").alias("k"))
    left = c.subtract(o).agg(F.lit("only_customer").alias("side"), F.count(F.lit(1)).alias("n"))
    return left.unionByName(o.subtract(c).agg(F.lit("only_orders").alias("side"), F.count(F.lit(1)).alias("n")))


@query("overlap_filter", """
WITH g AS (SELECT source FROM documents WHERE lang = 'de'), q AS (SELECT doc_id, source FROM documents WHERE lang = 'es'),
g2 AS (SELECT source FROM g WHERE source IN (SELECT source FROM q))
SELECT 'gallery' AS side, source, count(*) AS n FROM g2 GROUP BY 1, 2
UNION ALL SELECT 'query', source, count(*) FROM q WHERE source IN (SELECT source FROM g2) GROUP BY 1, 2""")
def overlap_filter(read):
    d = read("documents").select("doc_id", "source", "lang")
    gallery, queries = joins.overlap_filter(d.where("lang = 'de'"), d.where("lang = 'es'"), "source")
    both = gallery.withColumn("side", F.lit("gallery")).unionByName(queries.withColumn("side", F.lit("query")))
    return both.groupBy("side", "source").agg(F.count(F.lit(1)).alias("n"))


@query("union_sides", """
SELECT doc_id, n_chars, 1 - quality AS label FROM labels JOIN documents USING (doc_id)""")
def union_sides(read):
    rows = read("documents").select("doc_id", "n_chars").join(ones(read), "doc_id")
    real, made = rows.where("quality = 1"), rows.where("quality = 0")
    return joins.union_sides(real, made).select("doc_id", "n_chars", "label")


# -- metric tables: one dataset per source, figures from its documents --

SQL_METRICS = """
old AS (
  SELECT source AS dataset, unnest(['pack_records', 'fid_floor', 'cer_real']) AS name,
         unnest([count(*), avg(n_chars), count(*) FILTER (lang = 'en') / count(*)])::DOUBLE AS value
  FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) GROUP BY source),
new AS (
  SELECT source AS dataset, unnest(['pack_records', 'fid_floor', 'retrieval_real']) AS name,
         unnest([count(*), avg(n_chars), count(*) FILTER (lang = 'fr') / count(*)])::DOUBLE AS value
  FROM documents WHERE n_chars > 2000 GROUP BY source)
"""


def old_metrics(read):
    d = joins.keep_known(read("documents").select("doc_id", "source", "lang", "n_chars"), read("labels"), ["doc_id"])
    wide = d.groupBy("source").agg(
        F.count(F.lit(1)).alias("pack_records"), F.avg("n_chars").alias("fid_floor"),
        (F.count_if(F.col("lang") == "en") / F.count(F.lit(1))).alias("cer_real"),
    )
    return baselines.metric_rows(wide, F.col("source"), ["pack_records", "fid_floor", "cer_real"])


def new_metrics(read):
    d = read("documents").select("source", "lang", "n_chars").where("n_chars > 2000")
    wide = d.groupBy("source").agg(
        F.count(F.lit(1)).alias("pack_records"), F.avg("n_chars").alias("fid_floor"),
        (F.count_if(F.col("lang") == "fr") / F.count(F.lit(1))).alias("retrieval_real"),
    )
    return baselines.metric_rows(wide, F.col("source"), ["pack_records", "fid_floor", "retrieval_real"])


def datasets(read):
    return read("documents").groupBy(F.col("source").alias("dataset")).agg(F.count(F.lit(1)).alias("records"))


@query("carry_over", f"""
WITH {SQL_METRICS}
SELECT coalesce(o.dataset, n.dataset) AS dataset, coalesce(o.name, n.name) AS name,
       round(coalesce(n.value, o.value), 6) AS value, n.name IS NULL AS carried
FROM old o FULL JOIN new n ON o.dataset = n.dataset AND o.name = n.name""")
def carry_over(read):
    return baselines.carry_over(old_metrics(read), new_metrics(read)).withColumn("value", r6("value"))


@query("missing_required", f"""
WITH {SQL_METRICS}
SELECT dataset, name FROM (SELECT DISTINCT source AS dataset FROM documents),
  (SELECT unnest(['fid_floor', 'cer_real', 'retrieval_real']) AS name)
EXCEPT SELECT dataset, name FROM new""")
def missing_required(read):
    return baselines.missing_required(new_metrics(read), datasets(read))


@query("is_stale", f"""
WITH {SQL_METRICS}
SELECT d.dataset, coalesce(n.value::BIGINT <> d.records, false) AS stale
FROM (SELECT source AS dataset, count(*) AS records FROM documents GROUP BY 1) d
LEFT JOIN new n ON n.dataset = d.dataset AND n.name = 'pack_records'""")
def is_stale(read):
    recorded = new_metrics(read).where("name = 'pack_records'").select("dataset", "value")
    joined = datasets(read).join(recorded, "dataset", "left")
    return joined.select("dataset", baselines.is_stale(F.col("value"), F.col("records")).alias("stale"))


@query("baseline_lookup", f"""
WITH {SQL_METRICS},
d AS (SELECT source AS dataset, count(*) AS records FROM documents GROUP BY 1),
w(name, fallback) AS (VALUES ('fid_floor', 40.0::DOUBLE), ('cer_real', 0.2::DOUBLE), ('retrieval_real', 0.5::DOUBLE))
SELECT d.dataset, w.name, round(coalesce(n.value, fallback), 6) AS value,
       CASE WHEN n.value IS NULL THEN 'fallback' WHEN p.value::BIGINT <> records THEN 'stale'
            WHEN p.value IS NULL THEN 'measured, count not recorded' ELSE 'measured' END AS provenance
FROM d CROSS JOIN w LEFT JOIN new n ON n.dataset = d.dataset AND n.name = w.name
LEFT JOIN new p ON p.dataset = d.dataset AND p.name = 'pack_records'""")
def baseline_lookup(read):
    return baselines.baseline_lookup(datasets(read), new_metrics(read), {"fid_floor": 40.0, "cer_real": 0.2, "retrieval_real": 0.5}).withColumn("value", r6("value"))


@query("metrics_store", f"""
WITH {SQL_METRICS}
SELECT dataset, name, round(value, 6) AS value FROM new
UNION ALL SELECT dataset, name, round(value, 6) FROM old WHERE dataset NOT IN (SELECT dataset FROM new)""")
def metrics_store(read):
    # A second save replaces the datasets it holds and leaves the others.
    first, second = old_metrics(read), new_metrics(read)
    path = fresh_path(first.sparkSession, "metrics")
    baselines.save_metrics(first, path)
    baselines.save_metrics(second, path)
    stored = first.sparkSession.read.schema(baselines.SCHEMA).parquet(path)
    return stored.select("dataset", "name", r6("value").alias("value"))


@query("carry_verdict", """
SELECT source, CASE WHEN top1 < 3 * chance THEN 'not carried' WHEN top1 > 0.5 * reference THEN 'carried' ELSE 'partly' END AS verdict
FROM (SELECT source, count(*) FILTER (lang = 'en') / count(*) AS top1, count(*) FILTER (lang = 'de') / count(*) AS chance,
             1.1 * count(*) FILTER (lang <> 'es') / count(*) AS reference FROM documents GROUP BY 1)""")
def carry_verdict(read):
    n = F.count(F.lit(1))
    shares = read("documents").groupBy("source").agg(
        (F.count_if(F.col("lang") == "en") / n).alias("top1"), (F.count_if(F.col("lang") == "de") / n).alias("chance"),
        (1.1 * F.count_if(F.col("lang") != "es") / n).alias("reference"),
    )
    return shares.select("source", baselines.carry_verdict(F.col("top1"), F.col("chance"), F.col("reference")).alias("verdict"))


# -- counts --


@query("count_per_group", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1")
def count_per_group(read):
    return joins.count_per_group(read("orders"), ["o_custkey"])


@query("spread_hist", "SELECT n, count(*) AS groups FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey) GROUP BY 1")
def spread_hist(read):
    return joins.spread_hist(read("orders"), ["o_custkey"])


@query("distinct_groups", "SELECT DISTINCT source, lang FROM documents")
def distinct_groups(read):
    return read("documents").select("source", "lang").distinct()


@query("group_rows", """
SELECT source, count(*) AS n, min(doc_id) AS first, max(doc_id) AS last, sum(doc_id)::BIGINT AS total FROM documents GROUP BY 1""")
def group_rows(read):
    members = joins.group_members(read("documents"), ["source"], "doc_id")
    rows = members.select("source", F.explode("keys").alias("key"))
    return rows.groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.min("key").alias("first"), F.max("key").alias("last"), F.sum("key").alias("total")
    )


@query("dataset_summary", """
SELECT sum(n)::BIGINT AS records, count(*) AS groups, min(n) AS least, floor(quantile_cont(n, 0.5))::BIGINT AS median, max(n) AS most
FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey)""")
def dataset_summary(read):
    return joins.dataset_summary(read("orders"), ["o_custkey"])


@query("min_records", """
SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) >= 10)""")
def min_records(read):
    enough, _ = joins.min_records(read("orders").select("o_orderkey", "o_custkey"), ["o_custkey"], 10)
    return enough


@query("min_records_dropped", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) < 10")
def min_records_dropped(read):
    _, dropped = joins.min_records(read("orders").select("o_orderkey", "o_custkey"), ["o_custkey"], 10)
    return dropped


@query("eligible_groups", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) >= 12")
def eligible_groups(read):
    return joins.eligible_groups(read("orders"), ["o_custkey"], 10)


@query("most_common", "SELECT p_name, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, p_name")
def most_common(read):
    return joins.most_common(read("part"), "p_name")


@query("reconciles", "SELECT count(*) AS reported, count(*) AS seen, true AS agree FROM documents")
def reconciles(read):
    d = read("documents").select("doc_id", "text")
    marked = reasons.first_reason(d, [
        reasons.Rule(fixed.EMPTY_TEXT, tx.is_blank(F.col("text"))),
        reasons.Rule(fixed.OUT_OF_CHARSET, ~tx.alphabet("english").supports(F.col("text"))),
    ])
    return reasons.reconciles(reasons.drop_report(marked), d)


# -- checks --


@query("output_checks", """
SELECT vec_id, fault FROM (
  SELECT vec_id, CASE WHEN v IS NULL THEN 'no output for the request' WHEN len(v) = 0 THEN 'empty' WHEN len(v) <> 64 THEN 'wrong width'
                      WHEN list_max(v) - list_min(v) < 1e-6 THEN 'flat' END AS fault
  FROM (SELECT vec_id, CASE label WHEN 0 THEN NULL WHEN 1 THEN embedding[1:0] WHEN 2 THEN embedding[1:63]
               WHEN 3 THEN list_transform(embedding, lambda x: 0.5::FLOAT) ELSE embedding END AS v FROM embeddings))
WHERE fault IS NOT NULL""")
def output_checks(read):
    v = (
        F.when(F.col("label") == 0, F.lit(None)).when(F.col("label") == 1, F.slice("embedding", 1, 0))
        .when(F.col("label") == 2, F.slice("embedding", 1, 63))
        .when(F.col("label") == 3, F.transform("embedding", lambda x: F.lit(0.5).cast("float"))).otherwise(F.col("embedding"))
    )
    return checks.output_checks(read("embeddings").select("vec_id", v.alias("v")), "vec_id", "v", 64)


@query("preflight_faults", """
SELECT l_orderkey, fault, count(*) AS n FROM (
  SELECT l_orderkey, CASE WHEN l_linenumber = 7 THEN 'empty' WHEN l_returnflag = 'A' THEN 'wrong height'
    WHEN l_extendedprice / (1100.0::DOUBLE * l_quantity) < 0.3 AND l_quantity > 0 THEN 'narrow' END AS fault FROM lineitem)
WHERE fault IS NOT NULL GROUP BY 1, 2""")
def preflight_faults(read):
    rows = read("lineitem")
    size = F.when(F.col("l_linenumber") != 7, F.col("l_extendedprice"))
    height = F.when(F.col("l_returnflag") == "A", 48).otherwise(64)
    faults = checks.preflight_faults(rows, "l_orderkey", size, height, 64, 1100.0 * F.col("l_quantity"))
    return faults.groupBy("l_orderkey", "fault").agg(F.count(F.lit(1)).alias("n"))


def source_expectations(read):
    """A source is complete if half its documents are labelled, and required if it holds German."""
    labelled = joins.keep_known(read("documents").select("doc_id", "source"), read("labels"), ["doc_id"])
    observed = joins.count_per_group(labelled.select(F.col("source").alias("label")), ["label"], "found")
    expected = read("documents").groupBy(F.col("source").alias("label")).agg(
        F.floor(F.count(F.lit(1)) * 0.4).cast("bigint").alias("expected"),
        (F.count_if(F.col("lang") == "de") > 5).alias("required"),
    )
    return observed, expected


SQL_READY = """
WITH e AS (SELECT source AS label, floor(count(*) * 0.4)::BIGINT AS expected, count(*) FILTER (lang = 'de') > 5 AS required
           FROM documents GROUP BY 1),
o AS (SELECT source AS label, count(*) AS found FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) GROUP BY 1),
s AS (SELECT label, coalesce(found, 0) AS found, expected, required,
             CASE WHEN coalesce(found, 0) = 0 THEN 'miss' WHEN found = expected THEN 'ok' ELSE 'partial' END AS status
      FROM e LEFT JOIN o USING (label)),
x AS (SELECT coalesce(bool_or(status = 'ok'), false) AS any_ok FROM s WHERE label IN ('src1', 'src2'))
"""


@query("readiness", SQL_READY + """
SELECT label, found, expected, status,
       CASE WHEN label IN ('src1', 'src2') THEN NOT any_ok ELSE required END AND status <> 'ok' AS blocking FROM s, x""")
def readiness(read):
    observed, expected = source_expectations(read)
    needs = expected.select(F.lit("all").alias("capability"), "label")
    return checks.readiness(observed, expected, ("src1", "src2"), needs)[0]


@query("readiness_capabilities", SQL_READY + """,
n AS (SELECT CASE WHEN required THEN 'german' ELSE 'other' END AS capability, label FROM e
      UNION ALL SELECT 'paired', 'either'),
d AS (SELECT label, status FROM s UNION ALL SELECT 'either', CASE WHEN any_ok THEN 'ok' ELSE 'miss' END FROM x)
SELECT capability, bool_and(coalesce(status = 'ok', false)) AS ready,
       coalesce(string_agg(label, ', ' ORDER BY label) FILTER (coalesce(status, '') <> 'ok'), '') AS blockers
FROM n LEFT JOIN d USING (label) GROUP BY 1""")
def readiness_capabilities(read):
    observed, expected = source_expectations(read)
    needs = expected.select(F.when(F.col("required"), "german").otherwise("other").alias("capability"), "label")
    paired = expected.limit(1).select(F.lit("paired").alias("capability"), F.lit("either").alias("label"))
    return checks.readiness(observed, expected, ("src1", "src2"), needs.unionByName(paired))[1]


SQL_DAY_STATS = """
WITH s AS (SELECT CASE WHEN event_type = 'error' THEN 'before' ELSE 'after' END AS phase, date_trunc('day', ts) AS day,
                  avg(value) AS mean, max(value) AS peak, count(*)::DOUBLE AS n FROM events GROUP BY 1, 2),
l AS (SELECT phase, 'mean' AS stat, mean AS v FROM s UNION ALL SELECT phase, 'peak', peak FROM s UNION ALL SELECT phase, 'n', n FROM s),
w AS (SELECT stat, max(v) FILTER (phase = 'before') - min(v) FILTER (phase = 'before') AS before,
             max(v) FILTER (phase = 'after') - min(v) FILTER (phase = 'after') AS after FROM l GROUP BY 1)
"""


@query("condition_spread", SQL_DAY_STATS + """
SELECT stat, round(before, 6) AS before, round(after, 6) AS after, after > before AS worse FROM w""")
def condition_spread(read):
    rows = read("events").groupBy(
        F.when(F.col("event_type") == "error", "before").otherwise("after").alias("phase"), F.date_trunc("day", "ts").alias("day")
    ).agg(F.avg("value").alias("mean"), F.max("value").alias("peak"), F.count(F.lit(1)).alias("n"))
    spread = checks.condition_spread(rows, "day", ["mean", "peak", "n"], "phase")
    return spread.withColumns({"before": r6("before"), "after": r6("after")})


@query("condition_agree", """
SELECT count(*) AS conditions, count(DISTINCT n) AS counts, count(DISTINCT n) = 1 AS agree
FROM (SELECT date_trunc('day', ts) AS day, count(DISTINCT event_type) AS n FROM events GROUP BY 1)""")
def condition_agree(read):
    counts = read("events").groupBy(F.date_trunc("day", "ts").alias("day")).agg(F.count_distinct("event_type").alias("n"))
    return checks.condition_agree(counts, "n")


# -- expressions --


@query("id_format", "SELECT l_orderkey || '-' || l_suppkey || '-' || l_linenumber AS id, count(*) AS n FROM lineitem GROUP BY 1")
def id_format(read):
    ids = read("lineitem").select(hashing.record_id("l_orderkey", "l_suppkey", "l_linenumber").alias("id"))
    return ids.groupBy("id").agg(F.count(F.lit(1)).alias("n"))


@query("run_key", """
SELECT l_orderkey, concat_ws('_', 'eval', CASE WHEN l_linenumber <> 1 THEN 'refs' || l_linenumber END,
       CASE WHEN l_returnflag <> 'N' THEN 'by' || l_returnflag END) AS run, count(*) AS n FROM lineitem GROUP BY ALL""")
def run_key(read):
    run = hashing.run_key(F.lit("eval"), [(F.col("l_linenumber"), 1, "refs"), (F.col("l_returnflag"), "N", "by")])
    return read("lineitem").select("l_orderkey", run.alias("run")).groupBy("l_orderkey", "run").agg(F.count(F.lit(1)).alias("n"))


@query("in_band", """
SELECT l_orderkey, count(*) FILTER (coalesce(r >= 0.70 AND r < 1.40, true)) AS inside, count(*) AS n
FROM (SELECT l_orderkey, CASE WHEN l_returnflag <> 'N' THEN l_extendedprice / (1500.0::DOUBLE * l_quantity) END AS r FROM lineitem) GROUP BY 1""")
def in_band(read):
    ratio = F.when(F.col("l_returnflag") != "N", F.col("l_extendedprice") / (1500.0 * F.col("l_quantity")))
    return read("lineitem").groupBy("l_orderkey").agg(
        F.count_if(numbers.in_band(ratio)).alias("inside"), F.count(F.lit(1)).alias("n")
    )


@query("rescale_unit", """
WITH v AS (SELECT vec_id, CASE WHEN label < 3 THEN list_transform(embedding, lambda x: x::DOUBLE)
             WHEN label < 6 THEN list_transform(embedding, lambda x: abs(x::DOUBLE) * 400)
             ELSE list_transform(embedding, lambda x: abs(x::DOUBLE)) END AS v FROM embeddings)
SELECT vec_id, array_to_string(list_transform(v, lambda x: floor(greatest(0.0, least(1.0,
   CASE WHEN list_min(v) < -0.01 THEN (x + 1.0::DOUBLE) / 2.0::DOUBLE WHEN list_max(v) > 1.01 THEN x / 255.0::DOUBLE ELSE x END)) * 255.0::DOUBLE)::INT), ',') AS shades
FROM v""")
def rescale_unit(read):
    v = (
        F.when(F.col("label") < 3, F.col("embedding").cast("array<double>"))
        .when(F.col("label") < 6, F.transform("embedding", lambda x: F.abs(x.cast("double")) * 400))
        .otherwise(F.transform("embedding", lambda x: F.abs(x.cast("double"))))
    )
    rows = read("embeddings").select("vec_id", v.alias("v"))
    return rows.select("vec_id", F.array_join(numbers.rescale_unit(F.col("v")), ",").alias("shades"))


@query("length_budget", """
SELECT doc_id, greatest(32, least(384, ceil(length(text) * 5.5::DOUBLE)))::BIGINT AS budget FROM documents""")
def length_budget(read):
    return read("documents").select("doc_id", tx.length_budget(F.col("text")).alias("budget"))


@query("join_texts", """
SELECT conv_id, turn, text || ' ' || role AS joined FROM conversations""")
def join_texts(read):
    both = F.array("text", "role")
    return read("conversations").select("conv_id", "turn", tx.join_texts(both, both).alias("joined"))
