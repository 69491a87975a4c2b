"""Manifests, reassembly, reasons, alphabets, readiness on the sample tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline import fixed
from plumbline.functions import text as tx
from plumbline.operators import reasons, reassemble
from plumbline.plans.registry import SQL_ENGLISH, query, r6
from plumbline.sources import files, forms

# orders stand for line crops, lineitem for word crops: line numbers repeat and have gaps.


def order_lines(read):
    return read("orders").select(
        F.format_string("%04d", F.col("o_custkey")).alias("writer_id"),
        F.substring("o_orderpriority", 1, 1).alias("text_id"),
        F.col("o_orderkey").alias("line_index"),
    )


def order_parts(read):
    names = read("part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("word"))
    return read("lineitem").join(names, "l_partkey").select(
        F.col("l_orderkey").alias("line_index"), (F.col("l_linenumber") - 1).alias("word_index"), "word"
    )


def order_manifest(read, **options):
    return reassemble.manifest_groups(
        order_lines(read), order_parts(read), ["line_index"], "word_index", "word", tx.alphabet("english"),
        exclude_writers=("0431",), exclude_texts=("3",), **options,
    )


SQL_ORDER_PARTS = """
parts AS (
  SELECT l_orderkey AS line_index, l_linenumber - 1 AS word_index, p_name AS word
  FROM lineitem JOIN part ON p_partkey = l_partkey),
built AS (
  SELECT line_index, string_agg(word, ' ' ORDER BY word_index, word) AS text, count(*) AS word_count,
         min(word_index) = 0 AND max(word_index) = count(*) - 1
           AND count(DISTINCT word_index) = count(*) AS complete
  FROM parts GROUP BY line_index),
lines AS (
  SELECT printf('%04d', o_custkey) AS writer_id, substr(o_orderpriority, 1, 1) AS text_id,
         o_orderkey AS line_index FROM orders)
"""

SQL_ORDER_MARKED = f"""
WITH {SQL_ORDER_PARTS},
marked AS (
  SELECT l.*, b.text, b.word_count, b.complete,
    CASE WHEN writer_id = '0431' THEN '{fixed.EXCLUDED_GROUP}'
         WHEN text_id = '3' THEN '{fixed.EXCLUDED_TEXT}'
         WHEN word_count IS NULL THEN '{fixed.NO_PARTS}'
         WHEN trim(text) = '' THEN '{fixed.EMPTY_TEXT}'
         WHEN length(translate(text, {SQL_ENGLISH}, '')) > 0 THEN '{fixed.OUT_OF_CHARSET}'
         WHEN NOT complete THEN '{fixed.INCOMPLETE}' END AS reason
  FROM lines l LEFT JOIN built b USING (line_index))
"""


@query("reassemble", f"""
WITH {SQL_ORDER_PARTS}
SELECT line_index, md5(text) AS text_md5, word_count, complete FROM built""")
def reassemble_parts(read):
    built = reassemble.reassemble(order_parts(read), ["line_index"], "word_index", "word")
    return built.select("line_index", F.md5("text").alias("text_md5"), "word_count", "complete")


@query("reassemble_conversations", """
SELECT conv_id, md5(string_agg(text, ' ' ORDER BY turn, text)) AS text_md5, count(*) AS word_count,
       min(turn) = 0 AND max(turn) = count(*) - 1 AND count(DISTINCT turn) = count(*) AS complete
FROM conversations GROUP BY conv_id""")
def reassemble_conversations(read):
    built = reassemble.reassemble(read("conversations"), ["conv_id"], "turn", "text")
    return built.select("conv_id", F.md5("text").alias("text_md5"), "word_count", "complete")


@query("first_reason", SQL_ORDER_MARKED + """
SELECT writer_id, text_id, line_index, reason FROM marked""")
def first_reason(read):
    return order_manifest(read).select("writer_id", "text_id", "line_index", "reason")


@query("manifest_groups", SQL_ORDER_MARKED + """
SELECT writer_id, text_id, line_index, text, word_count, complete FROM marked WHERE reason IS NULL""")
def manifest_groups(read):
    return reasons.kept(order_manifest(read)).select(
        "writer_id", "text_id", "line_index", "text", "word_count", "complete"
    )


@query("drop_report", SQL_ORDER_MARKED + f"""
SELECT coalesce(reason, 'kept') AS reason,
       CASE WHEN reason IS NULL THEN 'kept'
            WHEN reason IN ('{fixed.EXCLUDED_GROUP}', '{fixed.EXCLUDED_TEXT}') THEN 'excluded'
            ELSE 'dropped' END AS kind,
       count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share
FROM marked GROUP BY 1, 2""")
def drop_report(read):
    return reasons.drop_report(order_manifest(read, texts=False)).withColumn("share", r6("share"))


# -- file names, from url parts and from line items --


def page_paths(read):
    url = F.col("url")
    host = F.regexp_extract(url, r"://([^/]+)/", 1)
    number = F.format_string("%04d", F.regexp_extract(url, r"/([0-9]+)", 1).cast("int"))
    lang = F.regexp_extract(url, r"/([a-z]+)/[0-9]+", 1)
    text = F.when(lang == "en", "1").when(lang == "fr", "2").when(lang == "de", "3").otherwise("4")
    tail = (
        F.when(F.endswith(url, F.lit(".html")), "-cropped.tif").when(F.endswith(url, F.lit("#top")), ".TIF")
        .when(F.contains(url, F.lit("?")), ".png").when(F.endswith(url, F.lit("/")), ".txt").otherwise(".jpg")
    )
    folder = F.when(F.startswith(host, F.lit("blog.")), "/words/").otherwise("/")
    prefix = F.when(F.startswith(host, F.lit("m.")), "scan_").otherwise("")
    return read("pages").select(
        F.concat(F.lit("/pages/"), host, folder, prefix, number, F.lit("-"), text, tail).alias("path")
    )


SQL_PAGE_PATHS = r"""
WITH u AS (
  SELECT url, regexp_extract(url, '://([^/]+)/', 1) AS host,
         printf('%04d', regexp_extract(url, '/([0-9]+)', 1)::INT) AS number,
         regexp_extract(url, '/([a-z]+)/[0-9]+', 1) AS lang FROM pages),
f AS (
  SELECT '/pages/' || host || CASE WHEN host LIKE 'blog.%' THEN '/words/' ELSE '/' END
    || CASE WHEN host LIKE 'm.%' THEN 'scan_' ELSE '' END || number || '-'
    || CASE lang WHEN 'en' THEN '1' WHEN 'fr' THEN '2' WHEN 'de' THEN '3' ELSE '4' END
    || CASE WHEN url LIKE '%.html' THEN '-cropped.tif' WHEN url LIKE '%#top' THEN '.TIF'
            WHEN url LIKE '%?%' THEN '.png' WHEN url LIKE '%/' THEN '.txt' ELSE '.jpg' END AS path
  FROM u),
images AS (
  SELECT path, split_part(path, '/', -1) AS name FROM f
  WHERE regexp_matches(path, '\.(tif|tiff|png|jpg)$', 'i') AND path NOT LIKE '%/words/%'),
"""


@query("manifest_pages", SQL_PAGE_PATHS + r"""
named AS (
  SELECT regexp_extract(name, '^(\d{4})-(\d+)', 1) AS writer_id, regexp_extract(name, '^(\d{4})-(\d+)', 2) AS text_id, path
  FROM images WHERE regexp_matches(name, '^\d{4}-\d+(-cropped)?\.(tif|tiff|png|jpg)$', 'i'))
SELECT writer_id || '-' || text_id AS page_id, writer_id, text_id, path FROM named
QUALIFY row_number() OVER (PARTITION BY writer_id, text_id ORDER BY string_split(path, '/')) = 1""")
def manifest_pages(read):
    pages, _, _ = files.scan_pages(page_paths(read))
    return pages


@query("manifest_pages_unparsed", SQL_PAGE_PATHS + r"""
odd AS (SELECT path FROM images WHERE NOT regexp_matches(name, '^\d{4}-\d+(-cropped)?\.(tif|tiff|png|jpg)$', 'i'))
SELECT path, count(*) AS n FROM odd GROUP BY path""")
def manifest_pages_unparsed(read):
    _, unparsed, _ = files.scan_pages(page_paths(read))
    return unparsed.groupBy("path").agg(F.count(F.lit(1)).alias("n"))


def part_paths(read):
    names = read("part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    rows = read("lineitem").join(names, "l_partkey")
    text = F.when(F.col("l_discount") == 0, "").otherwise(F.replace("p_name", F.lit(" "), F.lit("-")))
    return rows.select(
        F.concat(
            F.lit("/crops/"), F.when(F.col("l_returnflag") == "R", "trainset").otherwise("testset"), F.lit("/words/"),
            F.format_string("%04d", F.col("l_suppkey")), F.lit("-"), F.col("l_orderkey"), F.lit("-"), F.col("l_linenumber"),
            F.lit("-"), F.col("l_quantity").cast("int"), F.lit("-"), text, F.lit(".tif"),
        ).alias("path")
    )


@query("manifest_parts", f"""
WITH p AS (
  SELECT printf('%04d', l_suppkey) AS w, l_orderkey::VARCHAR AS t, l_linenumber AS l, l_quantity::INT AS q,
         CASE WHEN l_returnflag = 'R' THEN 'trainset' ELSE 'testset' END AS split,
         l_discount <> 0 AS ok, replace(p_name, ' ', '-') AS text
  FROM lineitem JOIN part ON p_partkey = l_partkey)
SELECT CASE WHEN ok THEN w END AS writer_id, CASE WHEN ok THEN t END AS text_id,
       CASE WHEN ok THEN l END AS line_index, CASE WHEN ok THEN q END AS word_index,
       CASE WHEN ok THEN text END AS text, split,
       CASE WHEN NOT ok THEN '{fixed.UNPARSED_NAME}' WHEN w = '0043' THEN '{fixed.EXCLUDED_GROUP}'
            WHEN length(translate(text, {SQL_ENGLISH}, '')) > 0 THEN '{fixed.OUT_OF_CHARSET}' END AS reason
FROM p""")
def manifest_parts(read):
    scanned = files.scan_parts(part_paths(read), tx.alphabet("english"), exclude_writers=("0043",))
    return scanned.select("writer_id", "text_id", "line_index", "word_index", "text", "split", "reason")


@query("stable_order", """
SELECT lpad(o_custkey::VARCHAR, 9, '0') AS writer_id, o_orderkey AS line_index FROM orders ORDER BY 1, 2""")
def stable_order(read):
    rows = read("orders").select(
        F.lpad(F.col("o_custkey").cast("string"), 9, "0").alias("writer_id"), F.col("o_orderkey").alias("line_index")
    )
    return files.stable_order(rows, ids=["writer_id"])


@query("limit_records", "SELECT doc_id, source, n_chars FROM documents ORDER BY source, doc_id LIMIT 150")
def limit_records(read):
    return files.limit_records(read("documents").select("doc_id", "source", "n_chars"), ["source", "doc_id"], 150)


@query("read_numbered_text", r"""
WITH t AS (SELECT doc_id, regexp_replace(text, '\n$', '') AS body FROM documents WHERE length(text) > 0)
SELECT doc_id, line_no::INT AS line_no, md5(line) AS line_md5
FROM (SELECT doc_id, string_split(body, chr(10)) AS lines FROM t), unnest(lines) WITH ORDINALITY AS u(line, line_no)""")
def read_numbered_text(read):
    rows = files.number_lines(read("documents"), ["doc_id"], F.col("text"))
    return rows.select("doc_id", "line_no", F.md5("text").alias("line_md5"))


@query("read_codes", """
SELECT user_id::VARCHAR AS judge, (event_id % 150)::INT AS trial,
       CASE WHEN event_type IN ('view', 'click') THEN 'A' ELSE 'B' END AS choice, count(*) AS n
FROM events WHERE event_type <> 'signup' GROUP BY ALL""")
def read_codes(read):
    code = F.concat(
        F.when(F.col("event_type") == "signup", "note").otherwise(fixed.CODE_PREFIX), F.lit(";"), F.col("user_id"), F.lit(";"),
        F.pmod("event_id", F.lit(150)), F.when(F.col("event_type").isin("view", "click"), "A").otherwise("B"), F.lit(" "),
    )
    answers = files.parse_codes(read("events").select(code.alias("value")), F.col("value"))
    return answers.groupBy("judge", "trial", "choice").agg(F.count(F.lit(1)).alias("n"))


# -- XML forms: one per conversation turn; its lines are the text's lines, their words its words --


def turn_forms(read):
    def clean(c):
        for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
            c = F.replace(c, F.lit(mark), F.lit(name))
        return c

    form = F.concat_ws("-", "conv_id", "turn")

    def line_xml(line, i):
        ws = F.split(line, " ")
        items = F.transform(ws, lambda w, k: F.concat(
            F.lit('<word id="'), form, F.lit("-"), i, F.lit("-"), k, F.lit('" text="'), clean(w), F.lit('"/>')
        ))
        grade = F.when(F.size(ws) < 4, "err").otherwise("ok")
        return F.concat(F.lit('<line id="'), form, F.lit("-"), i, F.lit('" segmentation="'), grade, F.lit('">'),
                        F.array_join(items, ""), F.lit("</line>"))

    body = F.array_join(F.transform(F.split("text", "\n"), line_xml), "")
    writer = F.when(F.col("role") == "user", F.concat(F.lit(' writer-id="'), F.col("conv_id"), F.lit('"'))).otherwise("")
    xml = F.concat(F.lit('<form id="'), form, F.lit('"'), writer, F.lit("><handwritten-part>"), body, F.lit("</handwritten-part></form>"))
    return forms.forms_from_text(read("conversations").select(xml.alias("xml")), F.col("xml"))


@query("read_forms_xml", f"""
WITH l AS (
  SELECT conv_id, turn, role, line, i - 1 AS i
  FROM (SELECT *, string_split(text, chr(10)) AS ls FROM conversations), unnest(ls) WITH ORDINALITY AS u(line, i)),
w AS (
  SELECT conv_id, turn, role, i, len(ws) AS size, word, k - 1 AS k
  FROM (SELECT *, string_split(line, ' ') AS ws FROM l), unnest(ws) WITH ORDINALITY AS u(word, k))
SELECT conv_id || '-' || turn || '-' || i || '-' || k AS word_id, conv_id || '-' || turn AS form_id,
       conv_id || '-' || turn || '-' || i AS line_id, CASE WHEN role = 'user' THEN conv_id::VARCHAR END AS writer_id,
       word AS text,
       'words/' || conv_id || '/' || conv_id || '-' || turn || '/' || conv_id || '-' || turn || '-' || i || '-' || k || '.png' AS image_path,
       CASE WHEN size < 4 THEN '{fixed.BAD_SEGMENTATION}' WHEN trim(word) = '' THEN '{fixed.EMPTY_TEXT}'
            WHEN length(translate(word, {SQL_ENGLISH}, '')) > 0 THEN '{fixed.OUT_OF_CHARSET}' END AS reason
FROM w""")
def read_forms_xml(read):
    scanned = forms.scan_forms(turn_forms(read), tx.alphabet("english"))
    return scanned.select("word_id", "form_id", "line_id", "writer_id", "text", "image_path", "reason")


@query("validate_forms", """
SELECT conv_id || '-' || turn AS form, 'form has no writer-id' AS problems FROM conversations WHERE role <> 'user'""")
def validate_forms(read):
    return forms.validate_forms(turn_forms(read)).select("form", F.array_join("problems", "; ").alias("problems"))


# -- alphabets --


@query("charset_encode", f"""
WITH c AS (
  SELECT doc_id, list_transform(string_split(text, ''), lambda ch:
    CASE WHEN strpos({SQL_ENGLISH}, ch) > 0 THEN strpos({SQL_ENGLISH}, ch) + 1 ELSE 1 END) AS codes
  FROM documents)
SELECT doc_id, len(codes)::INT AS n, md5(array_to_string(codes, ',')) AS codes_md5 FROM c""")
def charset_encode(read):
    codes = read("documents").select(
        "doc_id", tx.alphabet("english").encode(F.col("text")).alias("codes")
    )
    return codes.select("doc_id", F.size("codes").alias("n"), F.md5(F.array_join("codes", ",")).alias("codes_md5"))


@query("charset_decode", f"""
SELECT p_partkey, regexp_replace(p_name || ' ' || p_type || ' %', '%', '{fixed.REPLACEMENT}', 'g') AS text,
       p_name || ' ' || p_type || ' ' AS known FROM part""")
def charset_decode(read):
    english = tx.alphabet("english")
    codes = english.encode(F.concat_ws(" ", "p_name", "p_type", F.lit("%")))
    return read("part").select(
        "p_partkey", english.decode(codes, keep_unknown=True).alias("text"), english.decode(codes).alias("known")
    )


@query("charset_unsupported", f"""
SELECT doc_id, array_to_string(list_sort(list_distinct(string_split(translate(text, {SQL_ENGLISH}, ''), ''))), '') AS missing,
       length(translate(text, {SQL_ENGLISH}, '')) = 0 AS supported
FROM documents""")
def charset_unsupported(read):
    english = tx.alphabet("english")
    return read("documents").select(
        "doc_id", F.array_join(english.unsupported(F.col("text")), "").alias("missing"),
        english.supports(F.col("text")).alias("supported"),
    )


@query("charset_filter", f"""
SELECT doc_id, length(f)::INT AS n, md5(f) AS text_md5
FROM (SELECT doc_id, translate(text, translate(text, {SQL_ENGLISH}, ''), '') AS f FROM documents)""")
def charset_filter(read):
    kept = tx.alphabet("english").keep_only(F.col("text"))
    return read("documents").select("doc_id", kept.alias("f")).select(
        "doc_id", F.length("f").alias("n"), F.md5("f").alias("text_md5")
    )


@query("charset_registry", f"""
WITH a(alphabet, size, letters) AS (VALUES ('english', 81, {SQL_ENGLISH}),
  ('english_lower', 55, translate({SQL_ENGLISH}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')))
SELECT alphabet, size, source, count(*) FILTER (length(translate(text, letters, '')) = 0) AS supported
FROM a, documents GROUP BY ALL""")
def charset_registry(read):
    found = F.array(*[
        F.struct(F.lit(n).alias("alphabet"), F.lit(len(tx.alphabet(n))).alias("size"),
                 tx.alphabet(n).supports(F.col("text")).alias("ok"))
        for n in ("english", "english_lower")
    ])
    rows = read("documents").select("source", F.explode(found).alias("f")).select("source", "f.*")
    return rows.groupBy("alphabet", "size", "source").agg(F.count_if("ok").alias("supported"))
