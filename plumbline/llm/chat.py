r"""Chat formatting by columnar byte assembly.

A turn becomes ``### role: text</turn>`` and a line feed. Inside roles and texts the strings that mark turns are preceded by a
backslash, as is a backslash itself, so reading back gives the very texts. The bytes of a batch of turns are put together in
numpy: the lengths of all segments, their running offsets, and for every byte its place in one buffer made beforehand.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import slices

OPEN, CLOSE, NAME_END, FOOT = "### ", "</turn>", ": ", "</turn>\n"
MARKS = r"(\\|###|</turn>)"
NAME_MARKS = r"(\\|###|</turn>|:)"
LOSS_ROLE = "assistant"
SEGMENT_BYTES = 1 << 20

SEGMENT_SCHEMA = "conv_id bigint, segment bigint, formatted string, loss_starts array<int>, loss_ends array<int>"
DIGEST_SCHEMA = (
    "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
)

TURN = re.compile(r"### ((?:\\(?:\\|###|</turn>|:)|[^\\:])*): ((?:\\(?:\\|###|</turn>)|[^\\<]|<(?!/turn>))*)</turn>\n")
ESCAPED = re.compile(r"\\(\\|###|</turn>|:)")


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the column's cells, as numpy arrays, and its bytes."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    return offsets, np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)


def assemble(columns: list[pa.Array]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row by row, the columns' cells one after another in one buffer: its bytes, every row's bounds and every segment's start."""
    parts = [_bytes(c) for c in columns]
    lengths = np.stack([np.diff(offsets) for offsets, _ in parts], axis=1)
    starts = np.zeros(lengths.size + 1, np.int64)
    np.cumsum(lengths.ravel(), out=starts[1:])
    buffer = np.empty(starts[-1], np.uint8)
    for k, (offsets, data) in enumerate(parts):
        target, size = starts[:-1].reshape(lengths.shape)[:, k], lengths[:, k]
        total = int(size.sum())
        if total:
            place = np.repeat(target - (np.cumsum(size) - size), size) + np.arange(total)
            buffer[place] = data[offsets[0]:offsets[0] + total]
    return buffer, starts[::len(columns)], starts[:-1].reshape(lengths.shape)


def format_conversations(turns: DataFrame) -> DataFrame:
    """The formatted text of every conversation, in segments of about 1 MB, with the bounds (code points) of what is learned from.

    Turns are ordered by turn, then role and text, NULL first; a NULL role or text is an empty one, and the turns without a
    conv_id make one conversation. A conversation's text is its segments joined in order. One conversation is one stream of
    rows in one task, in slices of bounded size; it is never held whole.
    """
    ordered = turns.select("conv_id", "turn", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def segments(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, number = object(), 0
        for batch in batches:
            for part in slices(batch, limit=SEGMENT_BYTES):
                role, text = (part.column(i).fill_null("") for i in (2, 3))
                known = role.dictionary_encode()
                heads = pc.binary_join_element_wise(OPEN, pc.replace_substring_regex(known.dictionary, NAME_MARKS, r"\\\1"), NAME_END, "")
                head = heads.take(known.indices)
                body = pc.replace_substring_regex(text, MARKS, r"\\\1")
                buffer, bounds, inner = assemble([head, body, pa.array([FOOT] * len(part))])
                learned = pc.equal(role, LOSS_ROLE).to_numpy(zero_copy_only=False)
                keys = part.column(0).to_pylist()
                cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
                whole = buffer.tobytes()
                rows = []
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    number = number + 1 if keys[a] == current else 0
                    current = keys[a]
                    piece = whole[bounds[a]:bounds[b]]
                    # bytes that begin a code point, counted up to each bound
                    begun = np.concatenate(([0], np.cumsum((buffer[bounds[a]:bounds[b]] & 0xC0) != 0x80)))
                    at = np.flatnonzero(learned[a:b]) + a
                    rows.append((current, number, piece.decode("utf-8"), begun[inner[at, 1] - bounds[a]].tolist(),
                                 begun[inner[at, 2] - bounds[a]].tolist()))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32())]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)],
                                                 names=["conv_id", "segment", "formatted", "loss_starts", "loss_ends"])

    return ordered.mapInArrow(segments, SEGMENT_SCHEMA)


def plain(text: str) -> str:
    """A text or role as it was before its marks were preceded by backslashes."""
    return ESCAPED.sub(r"\1", text) if "\\" in text else text


def read_turns(formatted: str) -> Iterator[tuple[str, str]]:
    """Roles and texts of a formatted segment."""
    at = 0
    while at < len(formatted):
        turn = TURN.match(formatted, at)
        if not turn:
            raise ValueError(f"no turn at {at}")
        yield plain(turn[1]), plain(turn[2])
        at = turn.end()


def conversation_digests(segments: DataFrame) -> DataFrame:
    """What the formatted segments, read back, say of each conversation. Segments must come in order, as they were made."""

    def digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split(" ")[0] for f in DIGEST_SCHEMA.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

        def batch_of(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        done, begun, conv, n, learned, size, all_turns, loss = [], False, None, 0, 0, 0, None, None
        for batch in batches:
            for key, segment, text, starts, ends in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if segment == 0:
                    if begun:
                        done.append((conv, n, all_turns.hexdigest(), learned, loss.hexdigest(), size))
                    begun, conv, n, learned, size, all_turns, loss = True, key, 0, 0, 0, hashlib.sha256(), hashlib.sha256()
                for role, said in read_turns(text):
                    all_turns.update(f"{role}\n{said}\n".encode())
                    n += 1
                for a, b in zip(starts, ends, strict=True):
                    said = plain(text[a:b])
                    learned += len(said)
                    loss.update(said.encode())
                size += len(text)
            if done:
                yield batch_of(done)
                done = []
        if begun:
            yield batch_of([(conv, n, all_turns.hexdigest(), learned, loss.hexdigest(), size)])

    return segments.mapInArrow(digest, DIGEST_SCHEMA)


PROBE = [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]


def with_probe(turns: DataFrame) -> DataFrame:
    """The table and one conversation whose texts hold the template's own marks."""
    extra = turns.sparkSession.createDataFrame(PROBE, "conv_id bigint, turn bigint, role string, text string")
    return turns.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), "role", "text").unionByName(extra)


SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, role AS r, text AS t FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok', 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok', 'assistant', '\### Assistant: </turn> ok'),
sized AS (
  SELECT *, length(regexp_replace(role, '(\\|###|</turn>|:)', '\\\1', 'g')) + length(regexp_replace(text, '(\\|###|</turn>)', '\\\1', 'g'))
         + 4 + 2 + 8 AS chars FROM turns)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, r NULLS FIRST, t NULLS FIRST)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, t NULLS FIRST) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""
