"""Secret scans with corpus-wide ownership, in DataFrame functions only.

Credentials that many owners hold are examples copied from manuals; a value that one owner alone holds looks live. Matches are
found by regular expressions inside the scan; their places follow from the lengths of the pieces between them, as running sums.
What shuffles afterwards are matches, never texts. Values are counted by hash per owner and repository, then per hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.session import settle

# The kinds in their order, and what they look like.
ASSIGN, ACCESS, HEX, OWNED = "assign", "access", "hex", "owned"
ASSIGN_FORM = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS_FORM = r"AKIA[A-Z0-9]{14,}"
HEX_FORM = r"[0-9a-f]{16,}"
#: Other tokens that may be credentials; they need a letter and a digit, and count only where one owner alone holds them.
TOKEN_FORM = r"[A-Za-z0-9+/_-]{20,}"
ASSIGN_LEAST = 12
KINDS = ((ASSIGN, ASSIGN_FORM), (ACCESS, ACCESS_FORM), (HEX, HEX_FORM), (OWNED, TOKEN_FORM))

#: A value held by more owners, or in more repositories, than this is a copied example.
MAX_OWNERS, MAX_REPOSITORIES = 1, 3
REDACTION = "[redacted]"


def _hits(number: int, form: str, found: Column) -> Column:
    """The matches of one kind: number, ordinal, length of the text before (since the last match), length, value."""
    text = F.col("text")
    gaps = F.split(text, form, -1)
    value = (lambda m: F.regexp_extract(m, form, 2)) if form == ASSIGN_FORM else (lambda m: m)
    hits = F.transform(found, lambda m, i: F.struct(
        F.lit(number).alias("kind"), i.alias("k"), F.length(F.element_at(gaps, i + 1)).alias("gap"), F.length(m).alias("size"), value(m).alias("value")))
    return F.when(F.size(found) > 0, hits).otherwise(F.array().cast("array<struct<kind:int,k:int,gap:int,size:int,value:string>>"))


def scan(docs: DataFrame, row: Column | None = None) -> DataFrame:
    """(row, doc_id, repository, owner, hits): raw matches of every row, written once. A NULL text is an empty one.

    ``row`` numbers the rows; without it they are numbered here, for good because the result is written.
    """
    texts = docs.select(
        (F.monotonically_increasing_id() if row is None else row).alias("row"), "doc_id", F.coalesce("source", F.lit("")).alias("owner"), F.coalesce("text", F.lit("")).alias("text"))
    found = texts.select("*", *(F.regexp_extract_all("text", F.lit(form), F.lit(0)).alias(f"found_{i}") for i, (_, form) in enumerate(KINDS)))
    hits = F.concat(*(_hits(i, form, F.col(f"found_{i}")) for i, (_, form) in enumerate(KINDS)))
    # A document stands for a repository and its source for the owner.
    return settle(found.select("row", "doc_id", F.concat_ws("/", "owner", F.col("doc_id").cast("string")).alias("repository"), "owner", hits.alias("hits")))


def spans(scanned: DataFrame, max_owners: int = MAX_OWNERS, max_repositories: int = MAX_REPOSITORIES) -> DataFrame:
    """(row, start, end, kind, owners, repositories, live): base spans, and further tokens that only one owner holds."""
    each = scanned.select("row", "owner", "repository", F.explode("hits").alias("h")).select("row", "owner", "repository", "h.*")
    run = Window.partitionBy("row", "kind").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = each.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(run)).withColumn("start", F.col("end") - F.col("size"))
    kept = placed.where(F.when(F.col("kind") == 0, F.length("value") >= ASSIGN_LEAST)
                        .when(F.col("kind") == 3, F.col("value").rlike("[0-9]") & F.col("value").rlike("[A-Za-z]")).otherwise(True))
    base = F.col("kind") < 3
    before = Window.partitionBy("row").orderBy("start", "kind", "end").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    after = Window.partitionBy("row").orderBy(F.desc("start"), F.desc("kind"), F.desc("end")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    apart = (F.coalesce(F.max(F.when(base, F.col("end"))).over(before), F.lit(0)) <= F.col("start")) & (
        F.coalesce(F.min(F.when(base, F.col("start"))).over(after), F.col("end")) >= F.col("end"))
    free = kept.withColumn("free", base | apart).where("free")
    marked = settle(free.select("row", "start", "end", "kind", "owner", "repository", F.sha2("value", 256).alias("hash")))
    held = (marked.groupBy("hash", "owner", "repository").agg(F.lit(1).alias("one"))
            .groupBy("hash", "owner").agg(F.sum("one").alias("n"))
            .groupBy("hash").agg(F.count("*").alias("owners"), F.sum("n").alias("repositories")))
    live = (F.col("owners") <= max_owners) & (F.col("repositories") <= max_repositories)
    return marked.join(held, "hash").select("row", "start", "end", "kind", "owners", "repositories", live.alias("live")).where("kind < 3 OR live")


def _listing(found: Column) -> Column:
    names = F.array(*(F.lit(k) for k, _ in KINDS))
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def secrets(docs: DataFrame, max_owners: int = MAX_OWNERS, max_repositories: int = MAX_REPOSITORIES) -> DataFrame:
    """doc_id, counts and places of base spans, all spans, and how many look live or are copied; one row for every input row.

    A NULL text has no spans; a NULL source is an owner of its own. Repeated rows keep their rows, and as one repository count once.
    """
    scanned = scan(docs)
    found = spans(scanned, max_owners, max_repositories).groupBy("row").agg(
        F.array_sort(F.collect_list(F.struct("start", "kind", "end", "live"))).alias("found"))
    rows = scanned.select("row", "doc_id").join(found, "row", "left").withColumn(
        "found", F.coalesce("found", F.array().cast("array<struct<start:bigint,kind:int,end:bigint,live:boolean>>")))
    base = F.filter("found", lambda s: s["kind"] < 3)
    of_kind = lambda i: lambda s: s["kind"] == i
    count = lambda test: F.size(F.filter("found", test)).cast("bigint")
    return rows.select(
        "doc_id", *(count(of_kind(i)).alias(f"n_{KINDS[i][0]}") for i in range(3)),
        F.sha2(_listing(base), 256).alias("base_sha256"), _listing(F.col("found")).alias("spans"),
        count(lambda s: s["live"]).alias("n_live"), count(lambda s: ~s["live"]).alias("n_copied"))


def redact(docs: DataFrame, max_owners: int = MAX_OWNERS, max_repositories: int = MAX_REPOSITORIES) -> DataFrame:
    """The documents with every live-looking span replaced, n_chars set anew; copied examples stay. All rows and columns are kept.

    A NULL or empty text holds nothing and stays as it is, as does a NULL doc_id or source; other columns may have any names.
    """
    # rows are known by what they say, each part after its length, so equal ones share their spans and nothing but matches is written in between
    parts = [F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), F.coalesce("source", F.lit("")), F.coalesce("text", F.lit(""))]
    row = F.md5(F.concat_ws(":", *[x for part in parts for x in (F.length(part).cast("string"), part)]))
    given = docs.columns
    own = lambda name: next(n for n in (name + "_" * k for k in range(len(given) + 1)) if n.lower() not in {c.lower() for c in given})
    at, found = own("__row"), own("__live")
    scanned = scan(docs, row).where(F.size("hits") > 0).dropDuplicates(["row"])
    live = spans(scanned, max_owners, max_repositories).where("live").groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("live"))
    # overlapping spans become one: a span begins where no earlier one reaches
    merged = F.aggregate("live", F.array().cast("array<struct<start:bigint,end:bigint>>"), lambda acc, s: F.when(
        (F.size(acc) > 0) & (F.element_at(acc, -1)["end"] >= s["start"]),
        F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], s["end"]).alias("end")))),
    ).otherwise(F.concat(acc, F.array(s))))
    joined = docs.withColumn(at, row).join(live.select(F.col("row").alias(at), merged.alias(found)), at, "left")
    ends = F.concat(F.array(F.lit(0).cast("bigint")), F.transform(found, lambda s: s["end"]))
    starts = F.concat(F.transform(found, lambda s: s["start"]), F.array(F.length("text").cast("bigint")))
    pieces = F.transform(F.arrays_zip(starts.alias("s"), ends.alias("e")), lambda z: F.substring(F.col("text"), (z["e"] + 1).cast("int"), (z["s"] - z["e"]).cast("int")))
    text = F.when(F.col(found).isNull(), F.col("text")).otherwise(F.array_join(pieces, REDACTION))
    done = joined.withColumn("text", text)
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.when(F.col(found).isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return done.select(*(f"`{c}`" for c in docs.columns))


def sql() -> str:
    """The same in DuckDB SQL."""
    quoted = [form.replace("'", "''") for _, form in KINDS]
    names = [k for k, _ in KINDS]
    each = " UNION ALL ".join(f"""
SELECT row, owner, repository, {i} AS kind, gaps, sizes, found, unnest(generate_series(1, len(found))) AS k FROM (
  SELECT *, list_transform(found, lambda x: length(x)) AS sizes, list_transform(string_split_regex(text, '{q}'), lambda x: length(x)) AS gaps
  FROM (SELECT *, regexp_extract_all(text, '{q}', 0) AS found FROM docs))""" for i, q in enumerate(quoted))
    kind = "CASE kind " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(names)) + " END"
    listing = f"string_agg({kind} || ':' || start || ':' || stop, ',' ORDER BY start, kind, stop)"
    return f"""
WITH docs AS (
  SELECT row_number() OVER () AS row, doc_id, coalesce(source, '') AS owner, coalesce(source, '') || '/' || doc_id AS repository, coalesce(text, '') AS text FROM documents),
each AS ({each}),
placed AS (
  SELECT row, owner, repository, kind, (list_sum(gaps[1:k]) + list_sum(sizes[1:k]))::BIGINT AS stop, sizes[k] AS size,
         CASE kind WHEN 0 THEN regexp_extract(found[k], '{quoted[0]}', 2) ELSE found[k] END AS value FROM each),
kept AS (
  SELECT *, stop - size AS start FROM placed
  WHERE CASE kind WHEN 0 THEN length(value) >= {ASSIGN_LEAST} WHEN 3 THEN regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]') ELSE true END),
free AS (
  SELECT * FROM kept a WHERE kind < 3 OR NOT EXISTS (SELECT 1 FROM kept b WHERE b.row = a.row AND b.kind < 3 AND b.start < a.stop AND b.stop > a.start)),
held AS (SELECT value, count(DISTINCT owner) AS owners, count(DISTINCT repository) AS repositories FROM free GROUP BY value),
spans AS (
  SELECT row, start, stop, kind, owners <= {MAX_OWNERS} AND repositories <= {MAX_REPOSITORIES} AS live
  FROM free JOIN held USING (value) WHERE kind < 3 OR (owners <= {MAX_OWNERS} AND repositories <= {MAX_REPOSITORIES})),
found AS (
  SELECT row, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
         coalesce({listing} FILTER (kind < 3), '') AS base, {listing} AS spans,
         count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_copied FROM spans GROUP BY row)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
       coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied
FROM docs LEFT JOIN found USING (row)
"""
