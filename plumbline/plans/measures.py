"""Error rates, retrieval, distances, moments and detectability on the sample tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline import fixed
from plumbline.functions import hashing
from plumbline.functions import text as tx
from plumbline.functions import vectors
from plumbline.operators import baselines, detect, moments, rates, sampling, similarity
from plumbline.plans.registry import h, query, r6

# A part's reading is the name of the part with the next key; its target is its own name.


def readings(read):
    part = read("part")
    following = part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("next"))
    return part.join(following, "p_partkey", "left").select(
        "p_partkey", "p_brand", F.col("p_name").alias("target"), F.coalesce("next", F.lit("")).alias("reading"),
        F.concat(F.substring("p_name", 1, 4), F.col("p_type")).alias("second"),
    )


def turns_before(read, name):
    """Each turn with the text of the turn before it, empty for the first."""
    turns = read("conversations")
    before = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias(name))
    return turns.join(before, ["conv_id", "turn"], "left").fillna("", [name])


SQL_READINGS = """
WITH r AS (SELECT p.p_partkey, p.p_brand, p.p_name AS target, coalesce(n.p_name, '') AS reading, substr(p.p_name, 1, 4) || p.p_type AS second
  FROM part p LEFT JOIN part n ON n.p_partkey = p.p_partkey + 1)
"""


@query("edit_distance", SQL_READINGS + "SELECT p_partkey, levenshtein(reading, target)::INT AS errors, length(target)::INT AS length FROM r")
def edit_distance(read):
    return rates.error_terms(readings(read), "reading", "target").select("p_partkey", "errors", "length")


@query("cer", SQL_READINGS + """
SELECT p_partkey, round(levenshtein(reading, target) / length(target), 6) AS rate FROM r""")
def cer(read):
    return rates.error_terms(readings(read), "reading", "target").select("p_partkey", r6("rate").alias("rate"))


@query("corpus_error_rate", SQL_READINGS + """
SELECT p_brand, count(*) AS samples, sum(levenshtein(reading, target))::BIGINT AS errors, sum(length(target))::BIGINT AS length,
       round(sum(levenshtein(reading, target)) / sum(length(target)), 6) AS cer,
       round(avg(levenshtein(reading, target) / length(target)), 6) AS mean_rate FROM r GROUP BY 1""")
def corpus_error_rate(read):
    table = rates.corpus_error_rate(rates.error_terms(readings(read), "reading", "target"), ["p_brand"])
    return table.withColumns({"cer": r6("cer"), "mean_rate": r6("mean_rate")})


@query("error_gap", SQL_READINGS + """,
g AS (SELECT count(*) AS samples, sum(levenshtein(reading, target)) / sum(length(target)) AS generated,
             sum(levenshtein(second, target)) / sum(length(target)) AS real FROM r)
SELECT samples, round(generated, 6) AS generated, round(real, 6) AS real, round(generated - real, 6) AS gap FROM g""")
def error_gap(read):
    table = rates.error_gap(readings(read), "reading", "target", "second")
    return table.withColumns({c: r6(c) for c in ("generated", "real", "gap")})


@query("repeated_word", r"""
WITH c AS (SELECT conv_id, turn, text, coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), '') AS target FROM conversations),
s AS (SELECT conv_id, turn, list_filter(string_split_regex(lower(text), '\s+'), lambda w: w <> '') AS said,
             list_filter(string_split_regex(lower(target), '\s+'), lambda w: w <> '') AS asked FROM c),
e AS (SELECT conv_id, turn,
  list_filter(list_transform(range(2, len(said) + 1), lambda i: CASE WHEN said[i] = said[i - 1] THEN said[i] END), lambda w: w IS NOT NULL) AS twice,
  list_filter(list_transform(range(2, len(asked) + 1), lambda i: CASE WHEN asked[i] = asked[i - 1] THEN asked[i] END), lambda w: w IS NOT NULL) AS allowed
  FROM s)
SELECT conv_id, turn, list_filter(twice, lambda w: NOT list_contains(allowed, w))[1] AS doubled FROM e""")
def repeated_word(read):
    rows = turns_before(read, "target")
    return rows.select("conv_id", "turn", tx.doubled_word(F.col("text"), F.col("target")).alias("doubled"))


@query("overrun", SQL_READINGS + """,
d AS (SELECT DISTINCT reading, target, replace(reading, ' ', '') AS seen, replace(target, ' ', '') AS asked FROM r),
s AS (SELECT *, length(seen) AS n FROM d),
a AS (SELECT reading, target, n, i, j FROM s, generate_series(0, 40) t(i), generate_series(0, 40) u(j) WHERE i <= j AND j <= n),
c AS (SELECT a.reading, a.target, n, i AS start, j AS stop, levenshtein(substr(replace(a.reading, ' ', ''), (i + 1)::BIGINT, (j - i)::BIGINT), replace(a.target, ' ', '')) AS cost FROM a),
b AS (SELECT reading, target, min(struct_pack(cost := cost, worse := greatest(start, n - stop))) AS best FROM c GROUP BY 1, 2)
SELECT r.p_partkey, best.worse::INT AS overrun FROM r JOIN b USING (reading, target)""")
def overrun(read):
    rows = readings(read).select("p_partkey", "reading", "target")
    # Equal pairs are aligned once and joined back.
    pairs = rows.select("reading", "target").distinct()
    aligned = pairs.withColumn("overrun", tx.overrun(F.col("reading"), F.col("target")))
    return rows.join(aligned, ["reading", "target"]).select("p_partkey", "overrun")


@query("leave_one_out", r"""
WITH w AS (SELECT conv_id, turn, list_filter(string_split_regex(text, '\s+'), lambda w: w <> '') AS ws FROM conversations)
SELECT conv_id, turn, i::INT AS index, md5(array_to_string(list_concat(ws[1:i], ws[i + 2:len(ws)]), ' ')) AS text_md5
FROM (SELECT conv_id, turn, ws, unnest(range(0, greatest(len(ws) - 1, 0))) AS i FROM w)""")
def leave_one_out(read):
    rows = rates.leave_one_out(read("conversations"), ["conv_id", "turn"], "text")
    return rows.select("conv_id", "turn", "index", F.md5("text").alias("text_md5"))


@query("coverage", """
WITH c AS (SELECT conv_id, turn, text, coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), '') AS shown FROM conversations),
s AS (SELECT conv_id, turn, list_distinct(list_filter(string_split(replace(text, ' ', ''), ''), lambda x: x <> '')) AS wanted,
             list_distinct(list_filter(string_split(replace(shown, ' ', ''), ''), lambda x: x <> '')) AS there FROM c)
SELECT conv_id, turn, round(CASE WHEN len(wanted) = 0 THEN 0 ELSE len(list_intersect(wanted, there)) / len(wanted) END, 6) AS coverage FROM s""")
def coverage(read):
    rows = turns_before(read, "shown")
    return rows.select("conv_id", "turn", r6(tx.coverage(F.col("text"), F.col("shown"))).alias("coverage"))


@query("char_set_ops", """
WITH s AS (SELECT p_partkey, list_sort(list_distinct(string_split(p_name, ''))) AS a, list_sort(list_distinct(string_split(lower(p_type), ''))) AS b FROM part)
SELECT p_partkey, array_to_string(list_sort(list_intersect(a, b)), '') AS both,
       array_to_string(list_filter(a, lambda x: NOT list_contains(b, x)), '') AS only_name FROM s""")
def char_set_ops(read):
    a, b = F.array_distinct(F.split("p_name", "")), F.array_distinct(F.split(F.lower("p_type"), ""))
    return read("part").select(
        "p_partkey", F.array_join(F.array_sort(F.array_intersect(a, b)), "").alias("both"),
        F.array_join(F.array_sort(F.array_except(a, b)), "").alias("only_name"),
    )


# -- vectors: the two halves of each label's seeded order are gallery and queries --


def width(read):
    return vectors.width_of(read("embeddings"), "embedding")


def sides(read):
    rows = read("embeddings").select("vec_id", F.col("label").cast("string").alias("label"), vectors.as_doubles("embedding").alias("v"))
    return sampling.stratified_folds(rows, "label", "vec_id", 2, fixed.SEED)


def gallery_rows(read):
    return sides(read).where("fold = 0")


def query_rows(read):
    return sides(read).where("fold = 1")


def scored(read, k=5):
    gallery = vectors.vector_mean(gallery_rows(read), ["label"], "v", d=width(read))
    return similarity.score_against(query_rows(read), gallery, ["vec_id"], "label", "v", k)


SQL_SIDES = f"""
s AS (SELECT vec_id, label::VARCHAR AS label, list_transform(embedding, lambda x: x::DOUBLE) AS v,
             (row_number() OVER (PARTITION BY label ORDER BY {h('vec_id')}, vec_id) - 1) % 2 AS fold FROM embeddings)"""

SQL_MEANS = """
long AS (SELECT vec_id, label, fold, i, v[i] AS x FROM s, range(1, 65) t(i)),
means AS (SELECT label, fold, list(m ORDER BY i) AS mean FROM (SELECT label, fold, i, avg(x) AS m FROM long GROUP BY 1, 2, 3) GROUP BY 1, 2),
gallery AS (SELECT label AS g, mean FROM means WHERE fold = 0)"""

SQL_COSINES = f"""
WITH {SQL_SIDES}, {SQL_MEANS},
c AS (SELECT vec_id, label, g, list_dot_product(v, mean) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(mean, mean))) AS sim
      FROM s, gallery WHERE fold = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, g) AS rank FROM c),
hits AS (SELECT vec_id, label, bool_or(g = label AND rank = 1) AS hit1, bool_or(g = label AND rank <= 5) AS hitk, count(*) AS groups FROM r GROUP BY 1, 2)
"""


@query("vector_mean", f"""
WITH {SQL_SIDES}, {SQL_MEANS}
SELECT label, fold::INT AS fold, array_to_string(list_transform(mean, lambda x: printf('%.6f', round(x, 6) + 0.0)), ',') AS mean FROM means""")
def vector_mean(read):
    means = vectors.vector_mean(sides(read), ["label", "fold"], "v", d=width(read))
    text = F.array_join(F.transform("mean", lambda x: F.format_string("%.6f", F.round(x, 6) + 0.0)), ",")
    return means.select("label", "fold", text.alias("mean"))


@query("unit", """
SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE))))), 6) AS total
FROM embeddings""")
def unit(read):
    u = vectors.unit(vectors.as_doubles("embedding"))
    return read("embeddings").select("vec_id", F.round(F.aggregate(u, F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@query("cosine", f"""
WITH {SQL_SIDES}, {SQL_MEANS}
SELECT vec_id, round(list_dot_product(v, mean) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(mean, mean))), 6) AS cosine
FROM s JOIN gallery ON g = label WHERE fold = 1""")
def cosine(read):
    gallery = vectors.vector_mean(gallery_rows(read), ["label"], "v", d=width(read))
    joined = query_rows(read).join(gallery, "label")
    return joined.select("vec_id", F.round(vectors.cosine(F.col("v"), F.col("mean")), 6).alias("cosine"))


@query("centroid_cross", SQL_COSINES + """
SELECT vec_id, label, round(max(sim) FILTER (g = label), 6) AS own, round(sum(sim), 6) AS total, count(*) AS groups FROM r GROUP BY 1, 2""")
def centroid_cross(read):
    return scored(read).select("vec_id", "label", r6("own").alias("own"), r6("total").alias("total"), "groups")


@query("top_k", SQL_COSINES + "SELECT vec_id, rank::INT AS rank, g AS gallery_group, round(sim, 6) AS score FROM r WHERE rank <= 5")
def top_k(read):
    return similarity.top_k(scored(read), ["vec_id"]).withColumn("score", r6("score"))


def hits(read):
    return similarity.retrieval_hits(scored(read), ["vec_id"], "label", 5)


@query("retrieval_score", SQL_COSINES + """
SELECT round(avg(hit1::INT), 6) AS top1, round(avg(hitk::INT), 6) AS topk, 5::INT AS k, count(*) AS queries, max(groups) AS groups,
       round(1.0::DOUBLE / max(groups), 6) AS chance, round(avg(hit1::INT) * max(groups), 6) AS lift FROM hits""")
def retrieval_score(read):
    table = similarity.retrieval_score(hits(read), 5)
    return table.withColumns({c: r6(c) for c in ("top1", "topk", "chance", "lift")})


@query("retrieval_per_group", SQL_COSINES + "SELECT label, count(*) AS queries, round(avg(hit1::INT), 6) AS top1 FROM hits GROUP BY 1")
def retrieval_per_group(read):
    return similarity.per_group_accuracy(hits(read), "label").withColumn("top1", r6("top1"))


SQL_DAMAGES = f"""
WITH {SQL_SIDES}, {SQL_MEANS},
d AS (
  SELECT vec_id, label, damage, CASE damage WHEN 'untouched' THEN v WHEN 'softened' THEN list_transform(v, lambda x: x * 0.7::DOUBLE)
    WHEN 'coarse' THEN list_transform(v, lambda x: round(x * 8) / 8)
    WHEN 'blurred' THEN list_transform(v, lambda x, i: (x + coalesce(CASE WHEN i > 1 THEN v[i - 1] END, 0) + coalesce(CASE WHEN i < 64 THEN v[i + 1] END, 0)) / 3)
    ELSE list_transform(v, lambda x, i: x + (i - 1) * 0.004::DOUBLE) END AS v
  FROM s, (SELECT unnest(['untouched', 'softened', 'coarse', 'blurred', 'tilted']) AS damage) WHERE fold = 1),
c AS (SELECT damage, vec_id, label, g, list_dot_product(v, mean)
        / (greatest(sqrt(list_dot_product(v, v)), 1e-12) * sqrt(list_dot_product(mean, mean))) AS sim FROM d, gallery),
r AS (SELECT *, row_number() OVER (PARTITION BY damage, vec_id ORDER BY round(sim, 12) DESC, g) AS rank FROM c),
hits AS (SELECT damage, vec_id, bool_or(g = label AND rank = 1) AS hit1, bool_or(g = label AND rank <= 5) AS hitk FROM r GROUP BY 1, 2),
t AS (SELECT damage, avg(hit1::INT) AS top1, avg(hitk::INT) AS topk FROM hits GROUP BY 1)
SELECT damage, round(top1, 6) AS top1, round(topk, 6) AS topk,
       round(top1 / (SELECT top1 FROM t WHERE damage = 'untouched'), 6) AS kept FROM t"""


@query("retrieval_sensitivity", SQL_DAMAGES)
def retrieval_sensitivity(read):
    gallery = vectors.vector_mean(gallery_rows(read), ["label"], "v", d=width(read))
    table = similarity.retrieval_sensitivity(query_rows(read), gallery, "vec_id", "label", "v")
    return table.withColumns({c: r6(c) for c in ("top1", "topk", "kept")})


# -- distances: queries as the real set, softened ones as generated, tilted ones as the floor --


def three_sets(read):
    made = similarity.damages(query_rows(read), "v")
    name = F.when(F.col("damage") == "untouched", "real").when(F.col("damage") == "blurred", "generated").when(F.col("damage") == "tilted", "floor")
    return made.withColumn("set", name).where(F.col("set").isNotNull()).select("set", "vec_id", "label", "v")


def three_distances(read):
    return similarity.group_distance(three_sets(read), gallery_rows(read), ["set"], "label", "v", d=width(read))


SQL_THREE = f"""
WITH {SQL_SIDES}, {SQL_MEANS},
d AS (
  SELECT set, vec_id, label, CASE set WHEN 'real' THEN v
    WHEN 'generated' THEN list_transform(v, lambda x, i: (x + coalesce(CASE WHEN i > 1 THEN v[i - 1] END, 0) + coalesce(CASE WHEN i < 64 THEN v[i + 1] END, 0)) / 3)
    ELSE list_transform(v, lambda x, i: x + (i - 1) * 0.004::DOUBLE) END AS v
  FROM s, (SELECT unnest(['real', 'generated', 'floor']) AS set) WHERE fold = 1),
dm AS (SELECT set, label, list(m ORDER BY i) AS mean FROM (SELECT set, label, i, avg(v[i]) AS m FROM d, range(1, 65) t(i) GROUP BY 1, 2, 3) GROUP BY 1, 2),
x AS (SELECT set, label, g, list_distance(dm.mean, gallery.mean) AS dist FROM dm, gallery),
o AS (SELECT set, label, max(dist) FILTER (g = label) AS own, sum(dist) AS total, count(*) AS candidates,
             arg_min(g, struct_pack(d := dist, g := g)) = label AS nearest_is_right FROM x GROUP BY 1, 2),
w AS (SELECT set, label, own, (total - own) / (candidates - 1) AS wrong, (total - own) / (candidates - 1) - own AS gap, nearest_is_right, candidates FROM o)
"""


@query("distance_matrix", SQL_THREE + """
SELECT set, label, round(own, 6) AS own, round(wrong, 6) AS wrong, nearest_is_right, candidates FROM w""")
def distance_matrix(read):
    table = three_distances(read)
    return table.select("set", "label", r6("own").alias("own"), r6("wrong").alias("wrong"), "nearest_is_right", "candidates")


@query("own_wrong_gap", SQL_THREE + """
SELECT set, count(*) AS groups, round(avg(own), 6) AS own, round(avg(wrong), 6) AS wrong, round(avg(gap), 6) AS gap,
       round(avg(nearest_is_right::INT), 6) AS nearest FROM w GROUP BY 1""")
def own_wrong_gap(read):
    table = similarity.own_wrong_gap(three_distances(read), ["set"])
    return table.withColumns({c: r6(c) for c in ("own", "wrong", "gap", "nearest")})


@query("three_set_score", SQL_THREE + """,
f AS (SELECT avg(own) FILTER (set = 'generated') AS generated, avg(own) FILTER (set = 'real') AS real, avg(own) FILTER (set = 'floor') AS floor,
             avg(gap) FILTER (set = 'generated') AS gg, avg(gap) FILTER (set = 'real') AS gr, max(candidates) AS candidates FROM w)
SELECT round(generated, 6) AS generated, round(real, 6) AS real, round(floor, 6) AS floor,
       round(CASE WHEN floor > real THEN (generated - real) / (floor - real) END, 6) AS position,
       round(CASE WHEN gr > 0 THEN gg / gr END, 6) AS identity, round(1.0::DOUBLE / candidates, 6) AS chance, candidates FROM f""")
def three_set_score(read):
    table = similarity.three_set_score(three_distances(read))
    return table.withColumns({c: r6(c) for c in ("generated", "real", "floor", "position", "identity", "chance")})


@query("withheld", """
SELECT count(*) FILTER (source IN (SELECT source FROM documents WHERE lang = 'es' AND n_chars > 4000)) AS scored,
       count(*) FILTER (source NOT IN (SELECT source FROM documents WHERE lang = 'es' AND n_chars > 4000)) AS withheld FROM documents""")
def withheld(read):
    d = read("documents").select("doc_id", "source", "lang", "n_chars")
    return similarity.withheld(d, d.where("lang = 'es' AND n_chars > 4000"), "source")[1]


# -- moments --


def two_halves(read):
    rows = sides(read)
    return rows.withColumn("side", F.when(F.col("fold") == 0, "real").otherwise("generated")).select("side", "vec_id", "v")


@query("gaussian_stats", f"""
WITH {SQL_SIDES},
p AS (SELECT CASE fold WHEN 0 THEN 'real' ELSE 'generated' END AS side, i, j, v[i] AS x, v[j] AS y FROM s, range(1, 65) a(i), range(1, 65) b(j)),
c AS (SELECT side, i, j, count(*) AS n, covar_samp(x, y) AS c FROM p GROUP BY 1, 2, 3)
SELECT side, max(n) AS n, round(sum(c) FILTER (i = j), 6) AS trace, round(sum(c * (i * 64 + j)), 3) AS weighted,
       (SELECT round(sum(m * i), 6) FROM (SELECT i, avg(v[i]) AS m FROM s, range(1, 65) t(i) WHERE CASE fold WHEN 0 THEN 'real' ELSE 'generated' END = c.side GROUP BY i)) AS mean
FROM c GROUP BY 1""")
def gaussian_stats(read):
    stats = moments.gaussian_stats(two_halves(read), ["side"], "v", width(read))
    at = F.posexplode("cov").alias("p", "c")
    means = stats.select("side", F.round(F.aggregate(F.transform("mean", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x), 6).alias("mean"))
    long = stats.select("side", "n", at).withColumns({"i": F.floor(F.col("p") / 64) + 1, "j": F.pmod("p", F.lit(64)) + 1})
    return long.groupBy("side").agg(
        F.max("n").alias("n"), r6(F.sum(F.when(F.col("i") == F.col("j"), F.col("c")))).alias("trace"),
        F.round(F.sum(F.col("c") * (F.col("i") * 64 + F.col("j"))), 3).alias("weighted"),
    ).join(means, "side")


@query("frechet_distance")
def frechet_distance(read):
    return moments.frechet_distance(two_halves(read), "side", "v", d=width(read)).withColumn("value", r6("value"))


@query("span_project", f"""
WITH {SQL_SIDES}, m AS (SELECT i, avg(v[i]) AS m FROM s, range(1, 65) t(i) GROUP BY 1)
SELECT vec_id, 65 - 1 AS width, round(sum(2 * power(v[i] - m, 2)), 6) AS far FROM s, m GROUP BY 1""")
def span_project(read):
    # Two copies of every entry span no more than one, so the width comes back to 64.
    wide = two_halves(read).withColumn("v", F.concat("v", "v"))
    far = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    return moments.span_project(wide, "v", d=2 * width(read)).select("vec_id", F.size("v").alias("width"), r6(far).alias("far"))


@query("self_checks", """
SELECT unnest(['distance to itself is about zero', 'other half is farther than itself', 'retrieval reaches its floor',
               'error rate on real records is usable']) AS "check",
       unnest([true, true, top1 >= 0.30, cer <= 0.25]) AS passed
FROM (""" + SQL_COSINES + """ SELECT avg(hit1::INT) AS top1 FROM hits), (""" + SQL_READINGS + """
SELECT sum(levenshtein(second, target)) / sum(length(target)) AS cer FROM r)""")
def self_checks(read):
    halves = two_halves(read)
    real = halves.where("side = 'real'")
    twin = real.unionByName(real.withColumn("side", F.lit("generated")))
    figures = [
        moments.frechet_distance(twin, "side", "v", d=width(read)).select(F.col("value").alias("fid_self")),
        moments.frechet_distance(halves, "side", "v", d=width(read)).select(F.col("value").alias("fid_floor")),
        similarity.retrieval_score(hits(read), 5).select(F.col("top1").alias("retrieval_real")),
        rates.error_gap(readings(read), "second", "target").select(F.col("generated").alias("cer_real")),
    ]
    wide = figures[0]
    for f in figures[1:]:
        wide = wide.unionByName(f, allowMissingColumns=True)
    return baselines.self_checks(wide.agg(*[F.max(c).alias(c) for c in ("fid_self", "fid_floor", "retrieval_real", "cer_real")]))


# -- two samples: labelled documents by quality, told apart by text statistics --

FEATURES = ["chars", "spaces", "lines", "accents", "digits"]


def text_features(read):
    text = F.col("text")
    n = F.nullif(F.length(text), F.lit(0))
    return read("documents").join(read("labels"), "doc_id").select(
        "doc_id", (1 - F.col("quality")).alias("label"),
        F.log(n.cast("double")).alias("chars"),
        ((F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))) / n).alias("spaces"),
        ((F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))) / n).alias("lines"),
        (F.length(F.translate(text, tx.alphabet("english").characters, "")) / n).alias("accents"),
        (F.length(F.regexp_replace(text, "[^0-9]+", "")) / n).alias("digits"),
    )


SQL_FEATURES = """
WITH f AS (SELECT doc_id, 1 - quality AS label, ln(length(text)::DOUBLE) AS chars,
  (length(text) - length(replace(text, ' ', ''))) / length(text) AS spaces, (length(text) - length(replace(text, chr(10), ''))) / length(text) AS lines,
  length(regexp_replace(text, '[^0-9]', '', 'g')) / length(text) AS digits FROM documents JOIN labels USING (doc_id) WHERE length(text) > 0)
"""


@query("class_means", SQL_FEATURES + """,
l AS (SELECT label, unnest(['chars', 'spaces', 'lines', 'digits']) AS feature, unnest([chars, spaces, lines, digits]) AS x FROM f)
SELECT feature, round(avg(x) FILTER (label = 0), 6) AS real, round(avg(x) FILTER (label = 1), 6) AS generated FROM l GROUP BY 1""")
def class_means(read):
    table = rates.class_means(text_features(read), "label", ["chars", "spaces", "lines", "digits"])
    return table.withColumns({"real": r6("real"), "generated": r6("generated")})


@query("two_sample_test")
def two_sample_test(read):
    accuracy, _ = detect.two_sample_test(text_features(read), "doc_id", "label", FEATURES, seed=fixed.SEED)
    return accuracy


@query("two_sample_alone")
def two_sample_alone(read):
    _, alone = detect.two_sample_test(text_features(read), "doc_id", "label", FEATURES, seed=fixed.SEED)
    return alone


@query("by_accuracy_desc", """
SELECT lang AS feature, round(count(*) FILTER (n_chars > 1500) / count(*), 6) AS alone FROM documents GROUP BY 1 ORDER BY alone DESC, feature""")
def by_accuracy_desc(read):
    table = read("documents").groupBy(F.col("lang").alias("feature")).agg(
        r6(F.count_if(F.col("n_chars") > 1500) / F.count(F.lit(1))).alias("alone")
    )
    return detect.by_accuracy_desc(table)


# -- shares --


@query("width_report", """
WITH r AS (SELECT l_extendedprice / 1500.0::DOUBLE / greatest(l_quantity, 1.0) AS x FROM lineitem)
SELECT round(avg(x), 6) AS mean, round(quantile_cont(x, 0.5), 6) AS median, round(quantile_cont(x, 0.1), 6) AS p10,
       round(quantile_cont(x, 0.9), 6) AS p90, round(avg((x > 1.15)::INT), 6) AS wider, round(avg((x < 0.87)::INT), 6) AS narrower,
       abs(quantile_cont(x, 0.5) - 1.0) > 0.15 AS systematic FROM r""")
def width_report(read):
    table = rates.width_report(read("lineitem"), F.col("l_quantity"), F.col("l_extendedprice") / 1500.0)
    return table.withColumns({c: r6(c) for c in ("mean", "median", "p10", "p90", "wider", "narrower")})


@query("missing_share", """
SELECT l_linestatus, count(*) AS n, round(avg(coalesce(CASE WHEN l_returnflag <> 'N' THEN l_quantity END > 10, false)::INT), 6) AS share
FROM lineitem GROUP BY 1""")
def missing_share(read):
    rows = read("lineitem").withColumn("support", F.when(F.col("l_returnflag") != "N", F.col("l_quantity")))
    return rates.missing_share(rows, "l_linestatus", "support").withColumn("share", r6("share"))


TRIALS = "SELECT DISTINCT event_id % 150 AS trial FROM events"


def answers(read):
    return read("events").select(
        F.col("user_id").cast("string").alias("judge"), F.pmod("event_id", F.lit(150)).alias("trial"),
        F.when(F.col("event_type").isin("view", "click"), "A").otherwise("B").alias("choice"),
    )


def trial_key(read):
    trials = answers(read).select("trial").distinct()
    return sampling.balanced_sides(trials, "trial", fixed.SEED)


SQL_BLIND = f"""
WITH k AS (SELECT trial, CASE WHEN row_number() OVER (ORDER BY {h('trial')}, trial) % 2 = 1 THEN 'A' ELSE 'B' END AS side FROM ({TRIALS})),
hits AS (SELECT user_id::VARCHAR AS judge, event_id, (CASE WHEN event_type IN ('view', 'click') THEN 'A' ELSE 'B' END) = side AS hit
      FROM events JOIN k ON k.trial = event_id % 150)
"""


@query("blind_score", SQL_BLIND + """
SELECT count(*) AS answers, round(avg(hit::INT), 6) AS accuracy, avg(hit::INT) <= 0.60 AS passes FROM hits""")
def blind_score(read):
    return rates.blind_score(answers(read), trial_key(read))[0].withColumn("accuracy", r6("accuracy"))


@query("blind_score_per_judge", SQL_BLIND + "SELECT judge, count(*) AS answers, round(avg(hit::INT), 6) AS accuracy FROM hits GROUP BY 1")
def blind_score_per_judge(read):
    return rates.blind_score(answers(read), trial_key(read))[1].withColumn("accuracy", r6("accuracy"))


@query("content_key", """
SELECT sha1(text) AS content, count(*) AS copies, min(doc_id) AS first FROM documents GROUP BY 1""")
def content_key(read):
    keyed = read("documents").select("doc_id", hashing.content_key("text").alias("content"))
    return keyed.groupBy("content").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first"))
