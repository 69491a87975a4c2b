"""Samples, splits, orders and batches on the sample tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline import fixed
from plumbline.functions.hashing import seeded_hash
from plumbline.operators import joins, sampling, splitting
from plumbline.operators.skew import first_per_group
from plumbline.plans.registry import h, query, r6
from plumbline.session import fresh_path

SEED = fixed.SEED
RATIOS = {"train": 0.7, "test": 0.3}


def docs(read):
    return read("documents").select("doc_id", "source", "n_chars")


def customer_orders(read):
    return read("orders").select("o_custkey", "o_orderkey")


def customer_counts(read):
    return joins.count_per_group(customer_orders(read), ["o_custkey"])


def customer_split(read):
    return splitting.group_split(customer_counts(read), "o_custkey", RATIOS, SEED)


SQL_SHARE_SPLIT = f"""
g AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1),
s AS (
  SELECT o_custkey, n, CASE WHEN coalesce(sum(n) OVER (ORDER BY {h('o_custkey')}, o_custkey
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 0.7::DOUBLE * sum(n) OVER () THEN 'train' ELSE 'test' END AS split
  FROM g)
"""


@query("dedup_first", """
SELECT host, page_id, url FROM (SELECT regexp_extract(url, '://([^/]+)/', 1) AS host, page_id, url FROM pages)
QUALIFY row_number() OVER (PARTITION BY host ORDER BY url, page_id) = 1""")
def dedup_first(read):
    rows = read("pages").select(F.regexp_extract("url", r"://([^/]+)/", 1).alias("host"), "page_id", "url")
    return first_per_group(rows, ["host"], [F.col("url"), F.col("page_id")])


SQL_GROUP_SAMPLE = f"""
WITH spare AS (SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)),
sizes AS (SELECT d.source, count(s.doc_id) AS spare FROM documents d LEFT JOIN spare s ON s.doc_id = d.doc_id GROUP BY 1),
bar AS (SELECT quantile_cont(spare, 0.25)::BIGINT AS least FROM sizes)
"""


def spare_bar(read):
    """A minimum some sources miss: the first quartile of spare documents per source."""
    spare = joins.without_known(docs(read), read("labels"), ["doc_id"])
    sizes = joins.count_per_group(spare, ["source"])
    return int(sizes.agg(F.percentile("n", 0.25).alias("q")).first()["q"] + 0.5)


@query("group_sample", SQL_GROUP_SAMPLE + f"""
SELECT source, doc_id FROM spare JOIN sizes USING (source), bar WHERE sizes.spare >= least
QUALIFY row_number() OVER (PARTITION BY source ORDER BY {h('doc_id')}, doc_id) <= 12""")
def group_sample(read):
    chosen, _ = sampling.group_sample(docs(read), "source", "doc_id", SEED, minimum=spare_bar(read), consumed=read("labels"))
    return chosen.select("source", "doc_id")


@query("group_sample_withheld", SQL_GROUP_SAMPLE + """
SELECT source, sizes.spare AS spare FROM sizes, bar WHERE sizes.spare < least""")
def group_sample_withheld(read):
    _, withheld = sampling.group_sample(docs(read), "source", "doc_id", SEED, minimum=spare_bar(read), consumed=read("labels"))
    return withheld


def sql_refs(k):
    return f"""
WITH ring AS (
  SELECT source, doc_id, count(*) OVER (PARTITION BY source) AS n,
         row_number() OVER (PARTITION BY source ORDER BY {h('doc_id')}, doc_id) - 1 AS seat FROM documents),
want AS (
  SELECT source, doc_id, j, (seat + 1 + ({h('doc_id', seed=f'{SEED}:start')} % (n - 1) + j) % (n - 1)) % n AS seat
  FROM ring, range({k}) r(j) WHERE n > 1)
"""


@query("style_refs", sql_refs(5) + """
SELECT w.source, w.doc_id, string_agg(r.doc_id::VARCHAR, ',' ORDER BY j) AS refs
FROM want w JOIN ring r ON r.source = w.source AND r.seat = w.seat GROUP BY 1, 2""")
def style_refs(read):
    refs = sampling.style_refs(docs(read), "source", "doc_id", 5, SEED)
    return refs.select("source", "doc_id", F.array_join("refs", ",").alias("refs"))


@query("pick_other", sql_refs(1) + """
SELECT w.source, w.doc_id, r.doc_id AS other FROM want w JOIN ring r ON r.source = w.source AND r.seat = w.seat""")
def pick_other(read):
    return sampling.pick_other(docs(read), "source", "doc_id", SEED)


def request_count(read):
    return docs(read).count()


def requests(read):
    return sampling.build_requests(docs(read), "source", "doc_id", 4, request_count(read), SEED)


SQL_REQUESTS = f"""
WITH RECURSIVE sizes AS (SELECT source, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) >= 6),
g AS (SELECT source, n, row_number() OVER (ORDER BY {h('source')}, source) AS g, count(*) OVER () AS groups FROM sizes),
spine AS (SELECT i AS request FROM range((SELECT count(*) FROM documents)) t(i)),
d AS (SELECT request, source, n FROM spine JOIN g ON g.g = {h('request', seed=f'{SEED}:group')} % g.groups + 1),
drawn(request, source, n, taken) AS (SELECT request, source, n, []::BIGINT[] FROM d UNION ALL
  SELECT request, source, n, list_append(taken, list_reduce(list_prepend({h('request', 'len(taken)', seed=f'{SEED}:key')} % (n - len(taken)), list_sort(taken)),
         lambda seat, t: seat + (seat >= t)::BIGINT)) FROM drawn WHERE len(taken) < 5),
seats AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY {h('doc_id')}, doc_id) - 1 AS seat FROM documents),
each AS (SELECT request, source, unnest(range(5)) AS j, unnest(taken) AS seat FROM drawn WHERE len(taken) = 5),
k AS (SELECT request, e.source, j, doc_id FROM each e JOIN seats s ON s.source = e.source AND s.seat = e.seat)
"""


@query("build_requests", SQL_REQUESTS + """
SELECT request, source, max(doc_id) FILTER (j = 0) AS target,
       string_agg(doc_id::VARCHAR, ',' ORDER BY j) FILTER (j > 0) AS refs
FROM k GROUP BY 1, 2""")
def build_requests(read):
    return requests(read).withColumn("refs", F.array_join("refs", ","))


@query("consumed_keys", SQL_REQUESTS + "SELECT DISTINCT doc_id AS key FROM k")
def consumed_keys(read):
    return sampling.consumed_keys(requests(read))


@query("three_way_plan", f"""
WITH c AS (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) >= 3 + 2 + 6),
r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY {h('o_orderkey')}, o_orderkey) AS rn
      FROM orders JOIN c USING (o_custkey))
SELECT o_custkey, o_orderkey, CASE WHEN rn <= 3 THEN 'train' WHEN rn <= 5 THEN 'target' ELSE 'rest' END AS role FROM r""")
def three_way_plan(read):
    return sampling.three_way_plan(customer_orders(read), "o_custkey", "o_orderkey", 3, 2, SEED)


@query("cap_per_group", """
SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) <= 50""")
def cap_per_group(read):
    return sampling.cap_per_group(read("events").select("user_id", "event_id"), "user_id", "event_id", 50)


@query("filtered_sample", f"""
WITH {SQL_SHARE_SPLIT}
SELECT o_custkey, o_orderkey, o_totalprice FROM orders JOIN s USING (o_custkey)
WHERE split = 'train' AND o_totalprice BETWEEN 50000 AND 110000
ORDER BY {h('o_orderkey')}, o_orderkey LIMIT 400""")
def filtered_sample(read):
    side = splitting.share_split(customer_counts(read), "o_custkey", RATIOS, SEED).where("split = 'train'")
    rows = read("orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return sampling.filtered_sample(rows, side, "o_custkey", "o_orderkey", fixed.FILTERED_LIMIT, SEED, "o_totalprice", 50000, 110000)


@query("gallery_query_split", f"""
WITH c AS (SELECT label FROM embeddings GROUP BY 1 HAVING count(*) >= 24),
r AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY {h('vec_id')}, vec_id) AS rn
      FROM embeddings JOIN c USING (label))
SELECT vec_id, label, CASE WHEN rn <= 12 THEN 'gallery' ELSE 'query' END AS side FROM r WHERE rn <= 24""")
def gallery_query_split(read):
    return sampling.gallery_query_split(read("embeddings").select("vec_id", "label"), "label", "vec_id", 12, SEED)


@query("halves", f"""
WITH r AS (SELECT vec_id, row_number() OVER (ORDER BY {h('vec_id')}, vec_id) AS rn, count(*) OVER () // 2 AS half FROM embeddings)
SELECT vec_id, CASE WHEN rn <= half THEN 1 ELSE 2 END AS half FROM r WHERE rn <= 2 * half""")
def halves(read):
    rows = read("embeddings").select("vec_id")
    return sampling.halves(rows, "vec_id", rows.count() // 2, SEED)


@query("stratified_folds", f"""
SELECT doc_id, quality, ((row_number() OVER (PARTITION BY quality ORDER BY {h('doc_id')}, doc_id) - 1) % 10)::INT AS fold
FROM labels""")
def stratified_folds(read):
    return sampling.stratified_folds(read("labels").select("doc_id", "quality"), "quality", "doc_id", 10, SEED)


@query("even_spread", """
WITH r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS p,
                  count(*) OVER (PARTITION BY source) AS n FROM documents),
t AS (SELECT DISTINCT source, least(n - 1, floor(n / 7.0::DOUBLE * k + n / 7.0::DOUBLE / 2))::BIGINT AS p FROM r, range(7) x(k))
SELECT r.source, doc_id, CASE WHEN t.p IS NULL THEN 'train' ELSE 'target' END AS role
FROM r LEFT JOIN t ON t.source = r.source AND t.p = r.p""")
def even_spread(read):
    return sampling.even_spread(docs(read).select("source", "doc_id"), "source", "doc_id", 7)


@query("balanced_sides", f"""
SELECT event_id, CASE WHEN row_number() OVER (ORDER BY {h('event_id')}, event_id) % 2 = 1 THEN 'A' ELSE 'B' END AS side
FROM events""")
def balanced_sides(read):
    return sampling.balanced_sides(read("events").select("event_id"), "event_id", SEED)


SQL_BANDS = """
WITH r AS (
  SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn,
         count(*) OVER (PARTITION BY user_id) AS n FROM events),
b AS (SELECT *, rn <= greatest(1, n // 10) AS head, rn > n - greatest(1, n // 10) AS tail FROM r)
"""


def timed_events(read):
    return read("events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("head_tail_rank", SQL_BANDS + "SELECT user_id, event_id, rn::INT AS rn, head, tail FROM b")
def head_tail_rank(read):
    rows = timed_events(read).select("user_id", "event_id", "ts")
    return sampling.head_tail_rank(rows, "user_id", F.unix_micros("ts"), "event_id").select(
        "user_id", "event_id", F.col("rn").cast("int").alias("rn"), "head", "tail"
    )


@query("loss_head_tail", SQL_BANDS + """
SELECT user_id, count(*) AS steps, round(avg(value) FILTER (head), 6) AS head_mean,
       round(avg(value) FILTER (tail), 6) AS tail_mean FROM b GROUP BY 1""")
def loss_head_tail(read):
    means = sampling.head_tail_means(timed_events(read), "user_id", F.unix_micros("ts"), "event_id", "value")
    return means.withColumns({"head_mean": r6("head_mean"), "tail_mean": r6("tail_mean")})


@query("epoch_order", f"""
WITH r AS (SELECT vec_id, row_number() OVER (ORDER BY {h('vec_id', seed=SEED * 1_000_003 + 3)}, vec_id) - 1 AS place,
                  count(*) OVER () AS n FROM embeddings)
SELECT vec_id, place, place // 32 AS batch FROM r WHERE place // 32 < n // 32""")
def epoch_order(read):
    return sampling.epoch_order(read("embeddings").select("vec_id"), "vec_id", SEED, 3, 32)


@query("batch_pad", f"""
WITH v AS (SELECT vec_id, label, embedding[1 : 1 + (label * 5 + 3) % 48] AS v, string_split(vec_id::VARCHAR, '') AS d FROM embeddings),
r AS (SELECT *, row_number() OVER (ORDER BY {h('vec_id', seed=SEED * 1_000_003)}, vec_id) - 1 AS place, count(*) OVER () AS n FROM v),
b AS (SELECT *, place // 32 AS batch FROM r WHERE place // 32 < n // 32),
w AS (SELECT *, max(len(v)) OVER (PARTITION BY batch) AS width, max(len(d)) OVER (PARTITION BY batch) AS long FROM b)
SELECT vec_id, batch, len(v)::INT AS width, len(d)::INT AS label_length, width::INT AS padded_width, long::INT AS padded_label,
       round(list_sum(v)::DOUBLE + (width - len(v)), 4) AS total, len(v)::INT AS real_cells,
       array_to_string(list_resize(d, long::INT, '0'), '') AS label_text
FROM w""")
def batch_pad(read):
    rows = read("embeddings").select(
        "vec_id", "label", F.expr("slice(embedding, 1, 1 + (label * 5 + 3) % 48)").alias("v"),
        F.transform(F.split(F.col("vec_id").cast("string"), ""), lambda c: c.cast("int")).alias("labels"),
    )
    batches = sampling.epoch_order(rows, "vec_id", SEED, 0, 32).select("vec_id", "batch", "v", "labels")
    padded = sampling.batch_pad(batches, "batch", "v", "labels")
    total = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return padded.select(
        "vec_id", "batch", "width", "label_length", F.size("v").alias("padded_width"), F.size("labels").alias("padded_label"),
        F.round(total, 4).alias("total"), F.size(F.filter("mask", lambda m: m)).alias("real_cells"),
        F.array_join("labels", "").alias("label_text"),
    )


# -- splits --


@query("group_split", f"""
WITH RECURSIVE g AS (
  SELECT o_custkey, n, row_number() OVER (ORDER BY {h('o_custkey')}, o_custkey) AS i, sum(n) OVER () AS total
  FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)),
walk AS (
  SELECT 0::BIGINT AS i, 0.3::DOUBLE * max(total) AS test, 0.7::DOUBLE * max(total) AS train, NULL::BIGINT AS o_custkey,
         0::BIGINT AS n, NULL::VARCHAR AS split FROM g
  UNION ALL
  SELECT g.i, CASE WHEN test >= train THEN test - g.n ELSE test END, CASE WHEN test >= train THEN train ELSE train - g.n END,
         g.o_custkey, g.n, CASE WHEN test >= train THEN 'test' ELSE 'train' END
  FROM walk JOIN g ON g.i = walk.i + 1)
SELECT o_custkey, n, split FROM walk WHERE i > 0""")
def group_split(read):
    return splitting.require_sides(customer_split(read), RATIOS)


@query("group_split_by_share", f"WITH {SQL_SHARE_SPLIT} SELECT o_custkey, n, split FROM s")
def group_split_by_share(read):
    return splitting.share_split(customer_counts(read), "o_custkey", RATIOS, SEED)


@query("split_summary", f"""
WITH {SQL_SHARE_SPLIT}
SELECT split, count(*) AS groups, round(count(*) / sum(count(*)) OVER (), 6) AS group_share, sum(n)::BIGINT AS records,
       round(sum(n) / sum(sum(n)) OVER (), 6) AS record_share FROM s GROUP BY 1""")
def split_summary(read):
    split = splitting.share_split(customer_counts(read), "o_custkey", RATIOS, SEED)
    return splitting.split_summary(split).withColumns({"group_share": r6("group_share"), "record_share": r6("record_share")})


@query("split_assign", f"""
WITH {SQL_SHARE_SPLIT}
SELECT o_custkey, o_orderkey, split FROM orders JOIN s USING (o_custkey)""")
def split_assign(read):
    split = splitting.share_split(customer_counts(read), "o_custkey", RATIOS, SEED)
    return joins.split_assign(customer_orders(read), split, "o_custkey")


@query("split_validate", """
SELECT user_id, count(*) AS places, array_to_string(list_sort(list_distinct(list(event_type))), ',') AS splits
FROM events GROUP BY 1 HAVING count(*) > 1""")
def split_validate(read):
    # Users as groups and event types as sides: a division that is far from disjoint.
    rows = read("events").select("user_id", F.col("event_type").alias("split"))
    return splitting.split_validate(rows, "user_id").withColumn("splits", F.array_join("splits", ","))


@query("set_overlap_guard", f"""
WITH {SQL_SHARE_SPLIT}
SELECT split, count(DISTINCT o_custkey) AS groups FROM s GROUP BY 1""")
def set_overlap_guard(read):
    split = splitting.share_split(customer_counts(read), "o_custkey", RATIOS, SEED)
    return splitting.set_overlap_guard(split, "o_custkey").groupBy("split").agg(F.count(F.lit(1)).alias("groups"))


@query("split_save", f"""
WITH {SQL_SHARE_SPLIT}
SELECT 'customers' AS name, {SEED}::BIGINT AS seed, split, count(*) AS groups,
       CASE split WHEN 'train' THEN 0.7::DOUBLE ELSE 0.3::DOUBLE END AS ratio FROM s GROUP BY split""")
def split_save(read):
    split = splitting.share_split(customer_counts(read), "o_custkey", RATIOS, SEED)
    path = fresh_path(split.sparkSession, "split")
    splitting.split_save(split, "o_custkey", path, "customers", SEED, RATIOS)
    _, header = splitting.split_load(split.sparkSession, path, "o_custkey", "bigint")
    rows = header.select("name", "seed", "ratios", F.explode("counts").alias("split", "groups"))
    return rows.select("name", "seed", "split", "groups", F.try_element_at("ratios", F.col("split")).alias("ratio"))


@query("split_load", f"WITH {SQL_SHARE_SPLIT} SELECT o_custkey, split FROM s")
def split_load(read):
    split = splitting.share_split(customer_counts(read), "o_custkey", RATIOS, SEED)
    path = fresh_path(split.sparkSession, "split")
    splitting.split_save(split, "o_custkey", path, "customers", SEED, RATIOS)
    loaded, _ = splitting.split_load(split.sparkSession, path, "o_custkey", "bigint")
    return loaded.select("o_custkey", "split")


@query("official_split", """
SELECT l_returnflag AS split, count(*) AS records, count(DISTINCT l_suppkey) AS groups FROM lineitem GROUP BY 1""")
def official_split(read):
    rows = read("lineitem").select(F.col("l_returnflag").alias("split"), "l_suppkey")
    return splitting.official_split(rows, "split", "l_suppkey")


@query("seeded_hash", f"SELECT o_orderkey, {h('o_custkey', 'o_orderkey')} AS hash FROM orders")
def seeded_hashes(read):
    return read("orders").select("o_orderkey", seeded_hash(SEED, "o_custkey", "o_orderkey").alias("hash"))
