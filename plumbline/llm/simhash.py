"""SimHash near-duplicates found by multi-index hashing.

A 64-bit fingerprint is cut into two segments of 32 bits. Two fingerprints within three bits differ in at most one bit in one of
the segments, so every fingerprint is entered in a table under each segment's value, and asks that table for the values in the
ball of radius one around its own. Distances of what comes back are checked in full. Of two values one bit apart exactly one
has that bit set; asking only with a set bit cleared finds every pair once.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import slices
from plumbline.llm.components import components
from plumbline.llm.prefixtree import FAMILY, like_components
from plumbline.session import settle

SHINGLE, SEED, DISTANCE = 3, 42, 3
SEGMENT_BITS = 32
#: A table entry with more fingerprints than this is linked through centres instead of pair by pair.
CROWDED = 1000


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """XXH64 values of the text's word shingles, repeats included; none for a text without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-1]))
    last = max(0, len(words) - shingle)
    bounds = zip(starts[:last + 1].tolist(), (ends[min(shingle, len(words)) - 1:] - 1).tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in bounds), np.uint64, last + 1)


def majority(hashes: np.ndarray) -> int:
    """The bits set in more than half of the values."""
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Bits set in more than half of the XXH64 values of the text's word shingles."""
    return majority(shingle_hashes(text, shingle))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): the fingerprint of every whole text, as a BIGINT of the same bits. NULL and blank texts have zero."""

    def mark(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                marks = np.array([fingerprint(t.as_py(), shingle) for t in part.column(1)], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(marks)], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(mark, "doc_id bigint, fp bigint")


def _segment(fp: Column, k: int) -> Column:
    return F.shiftrightunsigned(fp, SEGMENT_BITS * k).bitwiseAND((1 << SEGMENT_BITS) - 1)


def _entry(k: int, value: Column) -> Column:
    """Segment number and value as one key."""
    return (F.lit(k) * (1 << SEGMENT_BITS) + value).alias("entry")


def _balls(marks: DataFrame) -> DataFrame:
    """(entry, fp, own): every fingerprint under its own segment values, and under those with one set bit cleared."""
    rows = []
    for k in range(2):
        value = _segment(F.col("fp"), k)
        rows.append(F.struct(_entry(k, value), F.lit(True).alias("own")))
        for bit in range(SEGMENT_BITS):
            mask = 1 << bit
            rows.append(F.when(value.bitwiseAND(mask) != 0, F.struct(_entry(k, value - mask), F.lit(False).alias("own"))))
    return marks.select("fp", F.explode(F.array_compact(F.array(*rows))).alias("x")).select("x.entry", "fp", "x.own")


def _distance(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def _through_centres(crowd: DataFrame) -> DataFrame:
    """Links inside crowded entries, a number of rows in proportion to their fingerprints.

    In an entry, the other segment may differ by three bits between two owners and by two between an owner and an asker. Values are
    put on the points at one and two bits from them: a value pair within three bits has a point one bit from the one and two
    from the other. At each point the least owner at one bit at most is the centre, and all others there are tied to it: owners at
    two bits at most and askers at one bit at most. No tie exceeds three bits, and whatever is linked is connected.
    """
    other = F.when(F.col("entry") < (1 << SEGMENT_BITS), _segment(F.col("fp"), 1)).otherwise(_segment(F.col("fp"), 0))
    one = [1 << i for i in range(SEGMENT_BITS)]
    two = [1 << i | 1 << j for i in range(SEGMENT_BITS) for j in range(i)]
    masks = F.when(F.col("own"), F.array(*map(F.lit, [0, *one, *two]))).otherwise(F.array(*map(F.lit, [0, *one])))
    points = crowd.select("entry", "fp", "own", other.alias("value"), F.explode(masks).alias("mask")).select(
        "entry", "fp", "own", F.col("value").bitwiseXOR(F.col("mask")).alias("point"), (F.bit_count("mask") <= 1).alias("near"))
    centres = points.where("own AND near").groupBy("entry", "point").agg(F.min("fp").alias("centre"))
    return points.join(centres, ["entry", "point"]).where("fp <> centre").select(F.col("fp").alias("a"), F.col("centre").alias("b")).distinct()


def links(marks: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """(a, b): pairs of distinct fingerprints within three bits, at least as many as connect all that are linked.

    ``marks`` holds distinct fingerprints. Entries with up to ``crowded`` fingerprints give every linked pair; larger ones give a
    connected subset of theirs, so a crowd costs rows in proportion to its size.
    """
    balls = settle(_balls(marks))
    sizes = settle(balls.groupBy("entry").agg(F.count("*").alias("n"), F.count(F.when(F.col("own"), 1)).alias("owners"))
                   .where("owners > 0 AND n > 1"))
    plain, full = sizes.where(F.col("n") <= crowded), sizes.where(F.col("n") > crowded)
    shared = balls.join(plain.select("entry"), "entry")
    table = shared.where("own").select("entry", F.col("fp").alias("b"))
    asked = shared.select("entry", F.col("fp").alias("a"), "own")
    found = asked.join(table, "entry").where((_distance("a", "b") <= DISTANCE) & F.when(F.col("own"), F.col("a") < F.col("b")).otherwise(True))
    pairs = found.select("a", "b")
    if full.limit(1).count():
        pairs = pairs.unionByName(_through_centres(balls.join(full.select("entry"), "entry")))
    return pairs


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, crowded: int = CROWDED) -> DataFrame:
    """doc_id, fingerprint (hex), component_id: the least doc_id reachable over links of three bits or fewer.

    One row for every input row. Equal fingerprints are one node, so copies cost nothing beyond their own row. A NULL doc_id is
    carried along but never names a component unless it is alone, when the name is NULL.
    """
    marked = settle(fingerprints(docs, shingle))
    nodes = settle(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(nodes.select("fp"), crowded), "a", "b")
    rooted = settle(nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(names, "root").select("fp", "component_id")
    return marked.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# -- likeness instead of a number of bits --------------------------------------------------------------------------------------

#: Words in a shingle, 64-bit words in a wide fingerprint, and the likeness (Jaccard, of shingles) of near-duplicates.
WIDE_SHINGLE, WIDE, LIKENESS = 5, 6, 0.8
#: Tables, and the bits of SimHash segment and number of least shingles that make up a table's key.
TABLES, LIKE_BITS, LEAST = 32, 4, 3

_MIX = np.uint64(0x9E3779B97F4A7C15)
_SALTS = np.random.default_rng(SEED).integers(0, 1 << 63, (2, TABLES * LEAST), np.uint64) * np.uint64(2) + np.uint64(1)


def most_apart(likeness: float, bits: int) -> int:
    """Bits by which fingerprints of two sets of this Jaccard likeness differ on the average: their cosine's angle over a half turn."""
    return round(bits * float(np.arccos(2 * likeness / (1 + likeness)) / np.pi))


def shingle_set(text: str | None, shingle: int = WIDE_SHINGLE) -> np.ndarray:
    """The distinct hashes of a text's shingles, in order."""
    return np.unique(shingle_hashes(text, shingle))


def wide_fingerprint(hashes: np.ndarray, words: int = WIDE) -> np.ndarray:
    """``words`` times 64 bits over a set of shingles, hashes mixed anew for every word."""
    marks = []
    for k in range(words):
        h = (hashes + np.uint64(k)) * _MIX
        h = (h ^ h >> np.uint64(31)) * np.uint64(0xD6E8FEB86659FD93)
        marks.append(majority(h ^ h >> np.uint64(29)) if len(h) else 0)
    return np.array(marks, np.uint64)


def like_entries(hashes: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """A set's key in every table: a SimHash segment and, as second key, the least shingles under the table's own orders.

    Sets without a common shingle meet by chance of 64 bits only, however many there are, so the segments needn't grow with the table.
    """
    if not len(hashes):
        return np.zeros(0, np.uint64)
    bits = np.unpackbits(marks.view(np.uint8), bitorder="little")
    places = np.arange(TABLES * LIKE_BITS) % len(bits)
    key = bits[places].reshape(TABLES, LIKE_BITS) @ (1 << np.arange(LIKE_BITS, dtype=np.uint64)) + np.arange(TABLES, dtype=np.uint64) * np.uint64(1 << LIKE_BITS)
    least = np.array([((hashes ^ a) * b).min() for a, b in _SALTS.T], np.uint64).reshape(TABLES, LEAST)
    for k in range(LEAST):
        key = (key ^ least[:, k]) * _MIX
        key ^= key >> np.uint64(29)
    return key


def like_marks(docs: DataFrame, shingle: int = WIDE_SHINGLE, words: int = WIDE) -> DataFrame:
    """(doc_id, key, n, wide, entries): digest and size of every text's set of shingles, its fingerprint and its keys."""

    def mark(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                keys, sizes, wide, entries = [], [], [], []
                for text in part.column(1):
                    hashes = shingle_set(text.as_py(), shingle)
                    marks = wide_fingerprint(hashes, words)
                    keys.append(xxhash.xxh3_128_digest(hashes.tobytes()))
                    sizes.append(len(hashes))
                    wide.append(marks.view(np.int64).tolist())
                    entries.append(like_entries(hashes, marks).view(np.int64).tolist())
                longs = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(keys, pa.binary()), pa.array(sizes, pa.int32()), pa.array(wide, longs), pa.array(entries, longs)],
                    names=["doc_id", "key", "n", "wide", "entries"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(
        mark, "doc_id bigint, key binary, n int, wide array<bigint>, entries array<bigint>")


def _sets(docs: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """(node, hashes): the shingle sets of ``wanted`` (node, key, least), from the texts themselves."""

    def gather(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                nodes, sets = [], []
                for node, key, text in zip(*(part.column(c) for c in ("node", "key", "text")), strict=True):
                    hashes = shingle_set(text.as_py(), shingle)
                    if xxhash.xxh3_128_digest(hashes.tobytes()) == key.as_py():  # a doc_id can have other texts too
                        nodes.append(node.as_py())
                        sets.append(hashes.view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["node", "hashes"])

    texts = docs.select(F.col("doc_id").cast("bigint").alias("least"), "text")
    return texts.join(wanted, "least").select("node", "key", "text").mapInArrow(gather, "node bigint, hashes array<bigint>").dropDuplicates(["node"])


def _likely(likeness: float, words: int) -> Column:
    """Whether the sizes and fingerprints of sides a and b leave a likeness of ``likeness`` possible.

    Fingerprints may differ by four standard deviations more than the average of pairs that are just alike enough, or by seven for
    sets of under 32 shingles, whose average is higher.
    """
    apart = sum((F.bit_count(F.element_at("wide_a", k + 1).bitwiseXOR(F.element_at("wide_b", k + 1))) for k in range(words)), F.lit(0))
    average, deviation = most_apart(likeness, 64 * words), (64 * words * 0.13) ** 0.5
    few, many = F.least("n_a", "n_b"), F.greatest("n_a", "n_b")
    return (few / many >= likeness) & (apart <= average + F.when(few < 32, round(7 * deviation)).otherwise(round(4 * deviation)))


def confirmed(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, likeness: float = LIKENESS, shingle: int = WIDE_SHINGLE, words: int = WIDE) -> DataFrame:
    """Those of ``pairs`` (a, b) whose shingle sets have a Jaccard likeness of at least ``likeness``, by the sets themselves."""
    likely = _likely_pairs(pairs, nodes, likeness, words)
    wanted = likely.select(F.col("a").alias("node")).unionByName(likely.select(F.col("b").alias("node"))).distinct()
    return _alike(likely, settle(_sets(docs, wanted.join(nodes.select("node", "key", "least"), "node"), shingle)), likeness)


def _likely_pairs(pairs: DataFrame, nodes: DataFrame, likeness: float, words: int) -> DataFrame:
    sides = [nodes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("wide").alias(f"wide_{x}")) for x in "ab"]
    return settle(pairs.join(sides[0], "a").join(sides[1], "b").where(_likely(likeness, words)).select("a", "b", "n_a", "n_b"))


def _alike(likely: DataFrame, sets: DataFrame, likeness: float) -> DataFrame:
    both = likely.join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("x")), "a").join(
        sets.select(F.col("node").alias("b"), F.col("hashes").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    return both.where(common / (F.col("n_a") + F.col("n_b") - common) >= likeness).select("a", "b")


def _stars(met: DataFrame) -> DataFrame:
    return met.where("node <> lowest").select(F.col("lowest").alias("a"), F.col("node").alias("b")).distinct()


def _mixed(met: DataFrame, roots: DataFrame) -> DataFrame:
    """(node): nodes of entries whose nodes aren't all connected yet."""
    rooted = met.select("entry", "node").join(roots.withColumnRenamed("node", "member"), F.col("node") == F.col("member"), "left").select(
        "entry", "node", F.coalesce("root", "node").alias("root"))
    sizes = rooted.groupBy("entry").agg(F.min("root").alias("r"), F.max("root").alias("s")).where("r <> s")
    return settle(rooted.join(sizes.select("entry"), "entry").select("node").distinct())


def _texts_of(docs: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, text): the nodes of ``wanted`` (node, key, least) under their numbers, with a text of their set."""

    def own(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                held = [xxhash.xxh3_128_digest(shingle_set(t.as_py(), shingle).tobytes()) == k.as_py() for k, t in zip(part.column(1), part.column(2), strict=True)]
                yield part.filter(pa.array(held, pa.bool_())).select([0, 2])  # a doc_id can have other texts too

    texts = docs.select(F.col("doc_id").cast("bigint").alias("least"), "text")
    found = texts.join(wanted, "least").select(F.col("node").alias("doc_id"), "key", "text")
    return found.mapInArrow(own, "doc_id bigint, text string")


def like_links(nodes: DataFrame, docs: DataFrame, likeness: float = LIKENESS, shingle: int = WIDE_SHINGLE, words: int = WIDE, crowded: int = FAMILY) -> DataFrame:
    """(a, b): links that connect what meets in the tables and is at least ``likeness``, in whole hundredths, alike.

    ``nodes`` has a number and a distinct set in each row. First all of an entry are compared with its least node. The nodes of all
    entries that this leaves in several groups are joined exactly, by their sets (``prefixtree``), whatever their number or their
    entries' size: each is tied to the least node that it reaches. ``crowded`` is that join's bound of what one task holds.
    """
    listed = settle(nodes.select("node", F.explode("entries").alias("entry")))
    ends = listed.groupBy("entry").agg(F.min("node").alias("lowest"), F.count("*").alias("size")).where("size > 1").drop("size")
    met = settle(listed.join(ends, "entry"))
    links = settle(confirmed(_stars(met), nodes, docs, likeness, shingle, words))
    mixed = _mixed(met, components(links, "a", "b"))
    if not mixed.limit(1).count():
        return links
    rest = settle(_texts_of(docs, mixed.join(nodes.select("node", "key", "least"), "node"), shingle))
    tied = like_components(rest, shingle, round(100 * likeness), crowded)
    return links.unionByName(tied.where("doc_id <> component_id").select(F.col("component_id").alias("a"), F.col("doc_id").alias("b")).distinct())


def like_groups(docs: DataFrame, likeness: float = LIKENESS, shingle: int = WIDE_SHINGLE, words: int = WIDE, crowded: int = FAMILY) -> DataFrame:
    """(doc_id, component_id): one row for every input row, groups linked by likeness; equal sets are always linked.

    Texts without words, NULL ones included, have the empty set and form one group.
    """
    marked = settle(like_marks(docs, shingle, words))
    # a set's name is its least doc_id; sets without one can't be named and are left alone
    first = F.first(F.struct("n", "wide", "entries")).alias("f")
    named = settle(marked.where("doc_id IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("least"), first).select("key", "least", "f.*"))
    nodes = settle(named.withColumn("node", F.monotonically_increasing_id()))
    roots = components(like_links(nodes, docs, likeness, shingle, words, crowded), "a", "b").withColumnRenamed("node", "member")
    rooted = settle(nodes.join(roots, F.col("node") == F.col("member"), "left").select("key", "least", F.coalesce("root", "node").alias("root")))
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return marked.select("doc_id", "key").join(rooted.join(names, "root").select("key", "component_id"), "key", "left").select("doc_id", "component_id")
