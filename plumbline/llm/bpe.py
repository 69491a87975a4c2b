"""BPE encoding and decoding through a table of distinct words.

Texts are split into words that the tokenizer never joins or looks beyond. Every distinct word is counted, encoded once and kept
in a table. The most frequent words, a bounded number, are handed to all tasks; the rest are joined by word and come back to
the texts that hold them, where ids are put in the words' places. Decoding looks every id up in the table of pieces.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import pyarrow as pa
import pyarrow.ipc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import SLICE_BYTES, bound_batches, slices
from plumbline.session import settle

#: Bounds of the table handed to all tasks.
HEAD_WORDS, HEAD_BYTES = 500_000, 16 << 20
#: Distinct words a task counts before it hands them on.
COUNTED = 400_000

# The tokenizer's own splitting, for texts of these characters alone: there NFC changes nothing and lower case is one to one.
SAFE = re.compile(r"[\t\n\r -~À-ÖØ-öø-ÿ]*")
WORD = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[a-zß-öø-ÿ]+|[0-9]|[^\sa-z0-9ß-öø-ÿ]+")
BLANK = re.compile(r"[ \t\n\r]+")
SPECIAL = "<|"

DIGEST_SCHEMA = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
ENCODED_SCHEMA = "doc_id bigint, ids array<int>, decoded string"


def split_words(text: str) -> list[str]:
    """Words whose encodings, one after another, are the text's encoding.

    The tokenizer drops white space, and no token spans it. A stretch with other characters than the plain ones, or with the
    beginning of a special token, is one word and left to the tokenizer whole.
    """
    if SAFE.fullmatch(text) and SPECIAL not in text:
        return WORD.findall(text.lower())
    words = []
    for stretch in BLANK.split(text):
        if SAFE.fullmatch(stretch) and SPECIAL not in stretch:
            words += WORD.findall(stretch.lower())
        elif stretch:
            words.append(stretch)
    return words


def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n): every distinct word of the texts and how often it occurs."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column(0):
                seen.update(split_words(text.as_py() or ""))
                if len(seen) > COUNTED:
                    yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], names=["word", "n"])
                    seen = Counter()
        yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], names=["word", "n"])

    return docs.select("text").mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def word_table(words: DataFrame, path: str) -> DataFrame:
    """``words`` with the ids of every word, each encoded once."""

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load(path)
        for batch in batches:
            found = tokenizer.encode_batch(batch.column(0).to_pylist(), add_special_tokens=False)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([e.ids for e in found], pa.list_(pa.int32()))], names=["word", "n", "ids"])

    return words.mapInArrow(encode, "word string, n bigint, ids array<int>")


def _rank() -> Column:
    """Words in steps of about nine per cent of frequency."""
    return F.floor(F.log2("n") * 8)


def head_of(table: DataFrame, most: int, most_bytes: int) -> tuple[bytes, int, bool]:
    """The most frequent words with their ids, the least step they reach down to, and whether any word is left out.

    Whole steps are taken while both bounds hold, so what is sent to the driver and to the tasks is bounded at any size of table. The
    driver holds the words as Arrow bytes only, never as objects of their own.
    """
    steps = table.groupBy(_rank().alias("step")).agg(F.count("*").alias("n"), F.sum(F.octet_length("word") + 4 * F.size("ids")).alias("size")).collect()
    least, words, size, left = 1 << 30, 0, 0, False
    for step in sorted(steps, key=lambda s: -s["step"]):
        words, size = words + step["n"], size + step["size"]
        if words > most or size > most_bytes:
            left = True
            break
        least = step["step"]
    head = table.where(_rank() >= least).select("word", "ids").toArrow()
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, head.schema) as writer:
        writer.write_table(head)
    return sink.getvalue().to_pybytes(), least, left


def _known(held: dict, entry: Callable) -> dict[str, tuple]:
    """The broadcast words with ``entry`` of their ids, made once in a worker and kept in the place of the bytes they came in."""
    if "known" not in held:
        head = pa.ipc.open_stream(held.pop("packed")).read_all()
        held["known"] = dict(zip(head.column(0).to_pylist(), map(entry, head.column(1).to_pylist()), strict=True))
    return held["known"]


def pieces_of(path: str) -> list[str]:
    """The table of pieces by id: the tokenizer's own vocabulary, special tokens included."""
    tokenizer = load(path)
    return [tokenizer.id_to_token(i) or "" for i in range(max(tokenizer.get_vocab(with_added_tokens=True).values()) + 1)]


def pieces_through(spark: SparkSession, path: str) -> list[str]:
    """The same, read by a task, so that the driver needn't hold the tokenizer: one text for each id of the vocabulary."""

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            pieces = pieces_of(path)
            yield pa.RecordBatch.from_arrays([pa.array(range(len(pieces)), pa.int32()), pa.array(pieces, pa.string())], names=["id", "piece"])

    found = spark.range(1, numPartitions=1).mapInArrow(read, "id int, piece string").toArrow()
    return found.sort_by("id").column("piece").to_pylist()


def _assembler(docs: DataFrame, path: str, head, entry: Callable, finish: Callable, schema: str, packed: bool) -> DataFrame:
    """What the table has for every text's words, in the words' places.

    Packed texts are words already, and bring what the table has for their own rare words, by the words' places in their order. Should
    two texts share a mark, their answers don't fit the order, and the tokenizer is asked instead.
    """

    def assemble(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _known(head.value, entry)
        open_text = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for part in slices(batch, *(("packed", SLICE_BYTES // 3) if packed else ("text",))):
                rows, last, words = [], None, []
                for i, key in enumerate(part.column(0).to_pylist()):
                    text = part.column(1)[i].as_py() or ""
                    if not packed:
                        words = list(map(known.__getitem__, split_words(text)))
                    elif text != last:
                        last, said = text, _words_of(open_text(text))
                        own = {}
                        if part.column(2)[i].is_valid:
                            rare = part.column(2)[i].values
                            order = _rare_words(said, known)
                            own = {order[k]: entry(ids) for k, ids in zip(rare.field("k").to_pylist(), rare.field("ids").to_pylist(), strict=True) if k < len(order)}
                            if not len(own) == len(order) == len(rare):
                                own = {w: entry(e.ids) for w, e in zip(order, load(path).encode_batch(order, add_special_tokens=False), strict=True)}
                        words = [known[w] if w in known else own[w] for w in said]
                    rows.append((key, words))
                yield finish(rows)

    return docs.mapInArrow(assemble, schema)


def _words_of(packed: bytes) -> list[str]:
    """Words of a packed text; no word holds a space."""
    return packed.decode("utf-8", "surrogatepass").split(" ") if packed else []


def _rare_words(words: Iterable[str], known: dict) -> list[str]:
    return sorted({w for w in words if w not in known})


def _encode_all(docs: DataFrame, path: str, entry: Callable, finish: Callable, schema: str, head_words: int, head_bytes: int) -> DataFrame:
    spark = docs.sparkSession
    bound_batches(spark)
    table = settle(word_table(count_words(docs), path))
    words, least, left = head_of(table, head_words, head_bytes)
    head = spark.sparkContext.broadcast({"packed": words})
    texts = docs.select(F.col("doc_id").cast("bigint"), "text")
    if not left:
        return _assembler(texts, path, head, entry, finish, schema, False)

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        close_text = zstandard.ZstdCompressor(level=6).compress
        for batch in batches:
            raw = [close_text(" ".join(split_words(t.as_py() or "")).encode("utf-8", "surrogatepass")) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(raw, pa.binary())], names=["doc_id", "mark", "packed"])

    def missing(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, asked = _known(head.value, entry), set()
        for batch in batches:
            for part in slices(batch):
                marks, places, rare = [], [], []
                for text, mark in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    if (seen := (mark, hash(text))) in asked:
                        continue
                    asked.add(seen)
                    new = _rare_words(split_words(text or ""), known)
                    marks += [mark] * len(new)
                    places += range(len(new))
                    rare += new
                yield pa.RecordBatch.from_arrays([pa.array(marks, pa.int64()), pa.array(places, pa.int32()), pa.array(rare, pa.string())], names=["mark", "k", "word"])

    # By a hash of the text, equal texts ask once for all; what comes back is told apart by the rare words' order.
    marked = texts.withColumn("mark", F.xxhash64(F.coalesce("text", F.lit(""))))
    asked = marked.select("text", "mark").mapInArrow(missing, "mark bigint, k int, word string")
    rare = table.where(_rank() < least).select("word", "ids")
    answers = asked.join(rare, "word").groupBy("mark").agg(F.collect_set(F.struct("k", "ids")).alias("words"))
    packed = marked.mapInArrow(pack, "doc_id bigint, mark bigint, packed binary")
    return _assembler(packed.join(answers, "mark", "left").select("doc_id", "packed", "words"), path, head, entry, finish, schema, True)


class Pieces:
    """What a word's ids come to: looked up in the table of pieces once for each word, not for each place it has."""

    def __init__(self, held):
        self.held = held

    def decode(self, ids: list[int]) -> str:
        return " ".join(map(self.held.value.__getitem__, ids))

    def listed(self, ids: list[int]) -> tuple[list[int], str]:
        return ids, self.decode(ids)

    def counted(self, ids: list[int]) -> tuple[str, str]:
        return " ".join(map(str, ids)), self.decode(ids)


def encode(docs: DataFrame, path: str, head_words: int = HEAD_WORDS, head_bytes: int = HEAD_BYTES) -> DataFrame:
    """doc_id, ids, decoded: every text's ids as the tokenizer at ``path`` gives them, and the text they decode to.

    A NULL text is an empty one and has no ids. One row for every input row, repeated rows and NULL keys included.
    """
    pieces = Pieces(docs.sparkSession.sparkContext.broadcast(pieces_through(docs.sparkSession, path)))

    def finish(rows: list) -> pa.RecordBatch:
        ids = [list(chain.from_iterable([w[0] for w in words])) for _, words in rows]
        decoded = [" ".join([w[1] for w in words if w[0]]) for _, words in rows]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())],
                                          names=["doc_id", "ids", "decoded"])

    return _encode_all(docs, path, pieces.listed, finish, ENCODED_SCHEMA, head_words, head_bytes)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, decoded: texts of (doc_id, ids) rows through a join of every id with its piece; NULL ids are none.

    The table of pieces has a row for each id of the vocabulary, so it is small whatever the texts' number.
    """
    spark = encoded.sparkSession
    pieces = spark.createDataFrame(list(enumerate(pieces_through(spark, path))), "id int, piece string")
    rows = settle(encoded.select(F.monotonically_increasing_id().alias("row"), "doc_id", "ids"))
    each = rows.select("row", F.posexplode("ids").alias("place", "id")).join(F.broadcast(pieces), "id")
    texts = each.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("place", "piece"))).alias("p"))
    return rows.join(texts, "row", "left").select("doc_id", F.coalesce(F.array_join("p.piece", " "), F.lit("")).alias("decoded"))


def digests(docs: DataFrame, path: str, head_words: int = HEAD_WORDS, head_bytes: int = HEAD_BYTES) -> DataFrame:
    """doc_id, n_tokens and digests of the decimal ids and of the decoded text, as ``encode`` finds them."""
    pieces = Pieces(docs.sparkSession.sparkContext.broadcast(pieces_through(docs.sparkSession, path)))

    def finish(rows: list) -> pa.RecordBatch:
        found = []
        for _, words in rows:
            decimal, decoded = (" ".join([w[k] for w in words if w[0]]) for k in (0, 1))
            found.append((decimal.count(" ") + 1 if decimal else 0, *(hashlib.sha256(part.encode()).hexdigest() for part in (decimal, decoded))))
        kinds = (pa.int64(), pa.string(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), *(pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True))],
                                          names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _encode_all(docs, path, pieces.counted, finish, DIGEST_SCHEMA, head_words, head_bytes)
