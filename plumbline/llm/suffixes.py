"""Repeated byte strings across documents, by suffix arrays over shards.

Only strings that begin in two documents matter, so most text never reaches a suffix array. Every 50-byte string has an anchor,
the 24-byte piece of least hash in it; equal strings have equal anchors. Anchors are counted over the corpus by documents.
Strings of consecutive places with one anchor form a stretch; stretches whose anchor occurs in several documents go to the
anchor's shard, so all places of a string meet there. A shard sorts its stretches' suffixes by induced sorting, takes the common
prefixes of neighbours in text order, and so finds for every string the least document it begins in.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pyarrow.ipc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import SLICE_BYTES, slices
from plumbline.session import settle

LENGTH, ANCHOR = 50, 24
#: Bytes of input for each counting bucket and for each shard.
BUCKET_BYTES, SHARD_BYTES = 16 << 20, 3 << 20
#: Bytes of text that a task takes together; copies inside such a block are resolved on the spot.
BLOCK_BYTES = 16 << 20
#: Anchors in more documents than this have their strings dealt out one by one, not by anchor.
COMMON = 20_000
#: Repeated anchors that fit the filter handed to all tasks; beyond, they are joined to the documents instead.
FILTER_KEYS, FILTER_BITS = 24_000_000, 16
KEY_BYTES = 6
GREATEST = (1 << 63) - 1

_ODD = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xD6E8FEB86659FD93)


def mix(h: np.ndarray) -> np.ndarray:
    for _ in range(2):
        h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(32))


def piece_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of every run of ``size`` bytes, from running sums of a polynomial."""
    n = len(data)
    power, inverse = (np.full(n, pow(_ODD, e, 1 << 64), np.uint64) for e in (1, -1))
    power[0] = inverse[0] = 1
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * np.multiply.accumulate(power), out=sums[1:])
    return mix((sums[size:] - sums[:-size]) * np.multiply.accumulate(inverse)[:n - size + 1])


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    held, reach = values, 1
    while 2 * reach <= width:
        held, reach = np.minimum(held[:-reach], held[reach:]), 2 * reach
    rest = width - reach
    return np.minimum(held[:-rest], held[rest:]) if rest else held


def stretches(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor key, first place, last place) of the runs of places whose strings have one anchor, the leftmost of least hash."""
    if len(data) < LENGTH:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none
    hashes = piece_hashes(data, ANCHOR)
    low = np.uint64((1 << 28) - 1)
    anchors = np.empty(len(data) - LENGTH + 1, np.int64)
    step, span = 1 << 20, LENGTH - ANCHOR + 1
    for at in range(0, len(anchors), step):
        part = hashes[at:at + step + span - 1]
        least = sliding_least((part & ~low) | np.arange(len(part), dtype=np.uint64), span)
        anchors[at:at + step] = (least & low).astype(np.int64) + at
    cuts = np.flatnonzero(np.diff(anchors)) + 1
    first, last = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(anchors)])) - 1
    return hashes[anchors[first]] >> np.uint64(16), first, last


# -- induced sorting -------------------------------------------------------------------------------------------------------------


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for every start and size, one after another."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


def order_of_names(names: np.ndarray) -> np.ndarray:
    """Places of the suffixes of a string of names in order, by doubled lengths; its last name is the least and occurs once.

    A suffix's rank is the place at which its group of so far equal ones begins; only groups of several are looked at again.
    """
    order = np.argsort(names, kind="stable")
    symbols = names[order]
    fresh = np.append(True, symbols[1:] != symbols[:-1])
    rank = np.empty(len(names), np.int64)
    rank[order] = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
    open_places, step = np.flatnonzero(~(fresh & np.append(fresh[1:], True))), 1
    while len(open_places):
        suffixes = order[open_places]
        # suffixes with `step` names in common don't hold the last name there, so both have a place `step` on
        key = rank[suffixes] * len(names) + rank[suffixes + step]
        by = np.argsort(key, kind="stable")
        suffixes, key = suffixes[by], key[by]
        fresh = np.append(True, key[1:] != key[:-1])
        order[open_places] = suffixes
        rank[suffixes] = open_places[fresh][np.cumsum(fresh) - 1]
        open_places = open_places[~(fresh & np.append(fresh[1:], True))]
        step *= 2
    return order


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Places of the suffixes of ``text`` in order. Its last symbol is 0 and occurs nowhere else.

    Suffixes are of the smaller or larger type as they are less or greater than their successor. The substrings between leftmost
    smaller places are sorted by one induction and named; where names repeat, doubling sorts the string of names. From the
    order of the leftmost smaller suffixes a second induction gives all. An induction goes from symbol to symbol: what a symbol's
    suffixes put in order is dealt out together, runs of one symbol a step at a time.
    """
    n = len(text)
    if n == 1:
        return np.zeros(1, np.int64)
    change = np.sign(np.diff(text.astype(np.int64)))
    known = np.where(change != 0, np.arange(n - 1), n - 1)
    following = np.minimum.accumulate(known[::-1])[::-1]
    smaller = np.append(np.append(change, 1)[following] > 0, True)
    leftmost = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    sizes = np.bincount(text)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    kind = np.int16 if len(sizes) < 1 << 15 else np.int64
    symbol_before = np.append(-1, text[:-1])
    into_larger = np.where(np.append(False, ~smaller[:-1]), symbol_before, -1).astype(kind)
    into_smaller = np.where(np.append(False, smaller[:-1]), symbol_before, -1).astype(kind)
    present = np.flatnonzero(sizes).tolist()

    def deal(suffixes: np.ndarray, before: np.ndarray, array: np.ndarray, room: np.ndarray, way: int) -> None:
        """The predecessors of ``suffixes``, in their order, to the next places of their symbols, upwards or downwards."""
        symbols = before[suffixes]
        wanted = symbols >= 0
        symbols = symbols[wanted]
        if not len(symbols):
            return
        by = np.argsort(symbols, kind="stable")
        count = np.bincount(symbols, minlength=len(room))
        nth = np.arange(len(by)) - np.repeat(np.cumsum(count) - count, count)
        first = np.repeat(room if way > 0 else room - 1, count)
        array[first + way * nth] = suffixes[wanted][by] - 1
        room += way * count

    def induce(order: np.ndarray) -> np.ndarray:
        """All suffixes from leftmost smaller ones, in ``order`` within each symbol."""
        by = order[np.argsort(text[order], kind="stable")]
        symbols = text[by]
        count = np.bincount(symbols, minlength=len(sizes))
        array = np.full(n, -1, np.int64)
        array[ends[symbols] - np.cumsum(count)[symbols] + np.arange(len(by))] = by
        heads, tails = starts.copy(), ends.copy()
        for symbol in present:
            at = starts[symbol]
            while at < (upto := heads[symbol]):
                deal(array[at:upto], into_larger, array, heads, 1)
                at = upto
            deal(array[ends[symbol] - count[symbol]:ends[symbol]], into_larger, array, heads, 1)
        for symbol in reversed(present[1:]):
            upto = ends[symbol]
            while (at := tails[symbol]) < upto:
                deal(array[at:upto][::-1], into_smaller, array, tails, -1)
                upto = at
            deal(array[starts[symbol]:heads[symbol]][::-1], into_smaller, array, tails, -1)
        return array

    if len(leftmost) > 1:
        is_leftmost = np.zeros(n, bool)
        is_leftmost[leftmost] = True
        array = induce(leftmost)
        ordered = array[is_leftmost[array]]
        reach = np.zeros(n, np.int64)
        reach[leftmost] = np.append(np.diff(leftmost), 0) + 1
        size = reach[ordered]
        same = size[1:] == size[:-1]
        pair = np.flatnonzero(same)
        a, b = _spread(ordered[pair], size[pair]), _spread(ordered[pair + 1], size[pair])
        differ = text[a] != text[b]
        if len(pair):
            same[pair] = ~np.logical_or.reduceat(differ, np.cumsum(size[pair]) - size[pair])
        names = np.zeros(n, np.int64)
        names[ordered] = np.append(0, np.cumsum(~same))
        reduced = names[leftmost]
        if reduced.max() + 1 < len(leftmost):
            order = leftmost[order_of_names(reduced)]
        else:
            order = ordered
    else:
        order = leftmost
    return induce(order)


def common_prefixes(text: np.ndarray, places: np.ndarray, most: int) -> np.ndarray:
    """For places in suffix order, how much each has in common with the one before it, up to ``most``.

    They are found in text order, through each place's predecessor in the array, and put back in suffix order.
    """
    if len(places) < 2:
        return np.zeros(len(places), np.int64)
    order = np.argsort(places[1:], kind="stable")
    here, before = places[1:][order], places[:-1][order]
    room = np.append(text, np.zeros(most, text.dtype))
    found = np.zeros(len(here), np.int64)
    alive = np.arange(len(here))
    for k in range(most):
        alive = alive[room[here[alive] + k] == room[before[alive] + k]]
        if not len(alive):
            break
        found[alive] += 1
    back = np.zeros(len(places), np.int64)
    back[1:][order] = found
    return back


def least_documents(strings: list[bytes], documents: np.ndarray) -> list[np.ndarray]:
    """For every place of every string at which LENGTH bytes are left, the least document of all strings with those bytes."""
    sizes = np.fromiter(map(len, strings), np.int64, len(strings))
    text = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8).astype(np.int64) + 2
    starts = np.cumsum(sizes + 1) - sizes - 1
    text[starts + sizes] = 1
    array = suffix_array(np.append(text, 0))
    windows = sizes - LENGTH + 1
    owner = np.full(len(text) + 1, -1, np.int64)
    owner[_spread(starts, windows)] = np.repeat(np.arange(len(strings)), windows)
    places = array[owner[array] >= 0]
    begins = np.flatnonzero(common_prefixes(text, places, LENGTH) < LENGTH)
    least = np.minimum.reduceat(documents[owner[places]], begins)
    of_place = np.empty(len(text), np.int64)
    of_place[places] = np.repeat(least, np.diff(np.append(begins, len(places))))
    return np.split(of_place[_spread(starts, windows)], np.cumsum(windows)[:-1])


# -- anchors over the corpus -----------------------------------------------------------------------------------------------------


def _blocks(batches: Iterable[pa.RecordBatch], limit: int = BLOCK_BYTES) -> Iterator[list[tuple]]:
    """Rows (document, mark, bytes) of about ``limit`` bytes together."""
    rows, held = [], 0
    for batch in batches:
        for part in slices(batch):
            for row in zip(*(part.column(i).to_pylist() for i in range(part.num_columns)), strict=True):
                data = (row[2] or "").encode("utf-8", "surrogatepass")
                rows.append((row[0], row[1], data, *row[3:]))
                held += len(data)
                if held >= limit:
                    yield rows
                    rows, held = [], 0
    if rows:
        yield rows


def _pack_keys(keys: np.ndarray) -> bytes:
    return keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES].tobytes()


def _unpack_keys(data: bytes) -> np.ndarray:
    wide = np.zeros((len(data) // KEY_BYTES, 8), np.uint8)
    wide[:, :KEY_BYTES] = np.frombuffer(data, np.uint8).reshape(-1, KEY_BYTES)
    return wide.view("<u8").ravel()


def repeated_anchors(texts: DataFrame, buckets: int) -> DataFrame:
    """(keys, common): per bucket, the packed keys of anchors that occur in two documents or more, and those of more than COMMON."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _blocks(batches):
            rows.sort(key=lambda r: r[0])
            keys, owners = [], []
            for document, _, data in rows:
                found = np.unique(stretches(np.frombuffer(data, np.uint8))[0])
                keys.append(found)
                owners.append(np.full(len(found), document))
            key, owner = np.concatenate(keys), np.concatenate(owners)
            order = np.argsort(key, kind="stable")
            key, owner = key[order], owner[order]
            fresh = np.append(True, (key[1:] != key[:-1]) | (owner[1:] != owner[:-1]))[:len(key)]
            found, times = np.unique(key[fresh], return_counts=True)
            bucket = (mix(found) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            found, times, bucket = found[order], np.minimum(times[order], 255).astype(np.uint8), bucket[order]
            cuts = np.flatnonzero(np.append(True, np.diff(bucket) != 0)) if len(bucket) else []
            ends = np.append(cuts[1:], len(bucket)).astype(np.int64) if len(bucket) else []
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(bucket[a]) for a in cuts], pa.int32()), pa.array([_pack_keys(found[a:b]) for a, b in zip(cuts, ends, strict=True)], pa.binary()),
                 pa.array([times[a:b].tobytes() for a, b in zip(cuts, ends, strict=True)], pa.binary())], names=["bucket", "keys", "times"])

    def add(table: pa.Table) -> pa.Table:
        keys = np.concatenate([_unpack_keys(k) for k in table.column("keys").to_pylist()])
        times = np.concatenate([np.frombuffer(t, np.uint8) for t in table.column("times").to_pylist()]).astype(np.int64)
        order = np.argsort(keys, kind="stable")
        keys, times = keys[order], times[order]
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        total = np.add.reduceat(times, first)
        return pa.table({"keys": pa.array([_pack_keys(keys[first][total > 1])], pa.binary()), "common": pa.array([_pack_keys(keys[first][total > COMMON])], pa.binary())})

    counted = texts.mapInArrow(count, "bucket int, keys binary, times binary")
    return counted.groupBy("bucket").applyInArrow(add, "keys binary, common binary")


def _bits_of(keys: np.ndarray, size: int) -> Iterator[np.ndarray]:
    h = mix(keys)
    yield h % np.uint64(size)
    yield (h >> np.uint64(32) | h << np.uint64(32)) * np.uint64(_ODD) % np.uint64(size)


def _filter_of(repeated: DataFrame, size: int) -> np.ndarray:
    bits = np.zeros(size, bool)
    for row in repeated.select("keys").toLocalIterator():
        for at in _bits_of(_unpack_keys(bytes(row["keys"])), size):
            bits[at.astype(np.int64)] = True
    return np.packbits(bits)


def _passes(packed: np.ndarray, size: int, keys: np.ndarray) -> np.ndarray:
    held = np.ones(len(keys), bool)
    for at in _bits_of(keys, size):
        held &= (packed[(at >> np.uint64(3)).astype(np.int64)] >> (7 - (at & np.uint64(7))).astype(np.uint8) & 1).astype(bool)
    return held


def _exploded(repeated: DataFrame, column: str) -> DataFrame:
    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for packed in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(_unpack_keys(packed).astype(np.int64))], names=["key"])

    return repeated.select(column).mapInArrow(rows, "key bigint")


def _with_own_keys(texts: DataFrame, repeated: DataFrame) -> DataFrame:
    """The texts with the repeated anchors each of them has, by a join: for more anchors than a filter may hold."""

    def own(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _blocks(batches):
            for document, mark, data in rows:
                keys = np.unique(stretches(np.frombuffer(data, np.uint8))[0]).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([document] * len(keys), pa.int64()), pa.array([mark] * len(keys), pa.int64()), pa.array(keys)],
                                                 names=["doc", "mark", "key"])

    found = texts.mapInArrow(own, "doc bigint, mark bigint, key bigint").join(_exploded(repeated, "keys"), "key")
    return texts.join(found.groupBy("doc", "mark").agg(F.collect_set("key").alias("own")), ["doc", "mark"])


# -- places to remove ------------------------------------------------------------------------------------------------------------

REMOVED_SCHEMA = "doc bigint, mark bigint, start int, end int"
SENT_SCHEMA = "shard bigint, packed binary"
#: What a packed cell holds: places of stretches with their bytes and key, or settled spans without.
CELL = pa.schema([("doc", pa.int64()), ("mark", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("stretch", pa.binary()), ("key", pa.int64())])


def _merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Overlapping or touching spans, sorted by start, as one."""
    reach = np.maximum.accumulate(ends)
    begins = np.flatnonzero(np.append(True, starts[1:] > reach[:-1]))
    return starts[begins], reach[np.append(begins[1:], len(starts)) - 1]


def _send(texts: DataFrame, shards: int, packed, size: int, common) -> DataFrame:
    """Stretches with repeated anchors on their way to shards; spans of copies inside a block are settled before.

    Of the places of one stretch in a block, those in the least document travel; at all others every string also begins in that
    lesser document, so they are removed already. One stretch is sent once per block at most, however often it is copied.
    """

    def send(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = np.sort(common.value)
        for rows in _blocks(batches):
            rows.sort(key=lambda r: r[0])
            seen: dict[bytes, int] = {}
            shard_of, docs, marks, starts, ends, pieces, of_key = out = [], [], [], [], [], [], []
            for document, mark, data, *own in rows:
                keys, first, last = stretches(np.frombuffer(data, np.uint8))
                kept = np.isin(keys, np.array(own[0], np.int64).astype(np.uint64)) if own else _passes(packed.value, size, keys)
                keys, first, last = keys[kept], first[kept], last[kept]
                single = np.isin(keys, frequent) if len(frequent) else np.zeros(len(keys), bool)
                if single.any():
                    more = np.where(single, last - first + 1, 1)
                    keys, single, last = np.repeat(keys, more), np.repeat(single, more), np.repeat(last, more)
                    first = _spread(first, more)
                    last = np.where(single, first, last)
                gone_from, gone_to = [], []
                for key, a, b, alone in zip(keys.tolist(), first.tolist(), (last + LENGTH).tolist(), single.tolist(), strict=True):
                    stretch = data[a:b]
                    if seen.setdefault(stretch, document) < document:
                        gone_from.append(a)
                        gone_to.append(b)
                        continue
                    # a common anchor's strings are told apart by all their bytes
                    at = hash_of(stretch) if alone else key
                    shard_of.append(at % shards)
                    docs.append(document)
                    marks.append(mark)
                    starts.append(a)
                    ends.append(b)
                    pieces.append(stretch)
                    of_key.append(at)
                if gone_from:
                    a, b = _merged(np.array(gone_from), np.array(gone_to))
                    for column, values in zip(out, ([mark % shards], [document], [mark], a.tolist(), b.tolist(), [None], [None]), strict=True):
                        column += values if len(values) == len(a) else values * len(a)
            yield from _packed(out)

    return texts.mapInArrow(send, SENT_SCHEMA)


def _packed(out: list[list]) -> Iterator[pa.RecordBatch]:
    """The rows of a block, those of a shard as one compressed cell."""
    shard = np.array(out[0], np.int64)
    order = np.argsort(shard, kind="stable")
    shard = shard[order]
    rows = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out[1:], CELL, strict=True)], schema=CELL).take(pa.array(order))
    cuts = np.flatnonzero(np.append(True, np.diff(shard) != 0)[:len(shard)]).tolist()
    names, cells = [], []
    for a, b in zip(cuts, [*cuts[1:], len(shard)], strict=True):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, CELL, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))) as writer:
            writer.write_batch(rows.slice(a, b - a))
        names.append(int(shard[a]))
        cells.append(sink.getvalue().to_pybytes())
    if names:
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(cells, pa.binary())], names=["shard", "packed"])


def hash_of(data: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(data) >> 16


def _resolve(table: pa.Table) -> pa.Table:
    """One shard: the spans already settled, and those of strings that begin in a lesser document."""
    table = pa.concat_tables([pa.ipc.open_stream(cell.as_buffer()).read_all() for cell in table.column("packed")])
    settled = table.filter(pa.compute.is_null(table.column("stretch")))
    open_rows = table.filter(pa.compute.is_valid(table.column("stretch")))
    columns = [settled.column(c) for c in ("doc", "mark", "start", "end")]
    if open_rows.num_rows:
        doc, mark, start, key = (open_rows.column(c).to_numpy() for c in ("doc", "mark", "start", "key"))
        known = open_rows.column("stretch").combine_chunks().dictionary_encode()
        strings, of_row = known.dictionary.to_pylist(), known.indices.to_numpy()
        least = np.full(len(strings), GREATEST, np.int64)
        np.minimum.at(least, of_row, doc)
        key_of = np.zeros(len(strings), np.int64)
        key_of[of_row] = key
        # A string alone under its anchor has nothing to be sorted among.
        _, group, together = np.unique(key_of, return_inverse=True, return_counts=True)
        several = np.flatnonzero(together[group] > 1)
        answers: dict[int, np.ndarray] = {}
        if len(several):
            answers = dict(zip(several.tolist(), least_documents([strings[i] for i in several], least[several]), strict=True))
        lowest, highest = least.copy(), least.copy()
        for i, found in answers.items():
            lowest[i], highest[i] = found.min(), found.max()
        size = np.fromiter(map(len, strings), np.int64, len(strings))
        whole = highest[of_row] < doc
        parts = [(doc[whole], mark[whole], start[whole], start[whole] + size[of_row[whole]])]
        for row in np.flatnonzero(~whole & (lowest[of_row] < doc)).tolist():
            below = np.flatnonzero(answers[int(of_row[row])] < doc[row]) + int(start[row])
            a, b = _merged(below, below + LENGTH)
            parts.append((np.full(len(a), doc[row]), np.full(len(a), mark[row]), a, b))
        joined = [np.concatenate([p[i] for p in parts]) for i in range(4)]
        order = np.lexsort((joined[2], joined[1], joined[0]))
        joined = [c[order] for c in joined]
        columns = [pa.chunked_array([*old.chunks, pa.array(new, old.type)]) for old, new in zip(columns, joined, strict=True)]
    return pa.table(columns, names=["doc", "mark", "start", "end"])


def repeated_spans(docs: DataFrame, filter_keys: int = FILTER_KEYS) -> DataFrame:
    """(doc, mark, spans): byte spans of each text covered by strings that also begin in a document with a smaller id.

    ``doc`` is the doc_id, the greatest number for NULL, and ``mark`` a hash of the text; rows equal in both have equal spans.
    """
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(GREATEST)).alias("doc"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("mark"), "text")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    repeated = settle(repeated_anchors(texts, 1 + total // BUCKET_BYTES))
    sizes = repeated.agg(F.sum(F.octet_length("keys")), F.sum(F.octet_length("common"))).first()
    n_keys, n_common = ((s or 0) // KEY_BYTES for s in sizes)
    # at most one anchor in COMMON is common, and each is in COMMON documents: fewer than documents times anchors over COMMON
    common = np.concatenate([np.zeros(0, np.uint64), *(_unpack_keys(bytes(r["common"])) for r in repeated.where(F.octet_length("common") > 0).select("common").collect())]) if n_common else np.zeros(0, np.uint64)
    if n_keys <= filter_keys:
        size = max(64, n_keys * FILTER_BITS)
        packed, source = spark.sparkContext.broadcast(_filter_of(repeated, size)), texts
    else:
        size, packed, source = 0, None, _with_own_keys(texts, repeated)
    sent = _send(source, 1 + total // SHARD_BYTES, packed, size, spark.sparkContext.broadcast(common))
    removed = sent.groupBy("shard").applyInArrow(_resolve, REMOVED_SCHEMA)
    return removed.groupBy("doc", "mark").agg(F.collect_set(F.struct("start", "end")).alias("spans"))


DIGEST_SCHEMA = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"


def _cut(spans: list) -> list[tuple[int, int]]:
    """Spans in order, overlapping or touching ones as one."""
    if not spans:
        return []
    bounds = np.array(sorted((s["start"], s["end"]) for s in spans))
    a, b = _merged(bounds[:, 0], bounds[:, 1])
    return list(zip(a.tolist(), b.tolist(), strict=True))


def _texts_with_spans(docs: DataFrame, filter_keys: int) -> DataFrame:
    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        close_text = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            raw = [close_text((t.as_py() or "").encode("utf-8", "surrogatepass")) for t in batch.column(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(raw, pa.binary())], names=["doc_id", "doc", "mark", "packed"])

    texts = docs.select(F.col("doc_id").cast("bigint"), F.coalesce(F.col("doc_id").cast("bigint"), F.lit(GREATEST)).alias("doc"),
                        F.xxhash64(F.coalesce("text", F.lit(""))).alias("mark"), "text")
    packed = texts.mapInArrow(pack, "doc_id bigint, doc bigint, mark bigint, packed binary")
    return packed.join(repeated_spans(docs, filter_keys), ["doc", "mark"], "left").select("doc_id", "packed", "spans")


def _kept(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    at, pieces = 0, []
    for a, b in spans:
        pieces.append(data[at:a])
        at = b
    return b"".join([*pieces, data[at:]])


def remove_repeats(docs: DataFrame, filter_keys: int = FILTER_KEYS) -> DataFrame:
    """doc_id, kept (the bytes that stay), spans removed: one row for every input row.

    A NULL text is an empty one; a text of fewer than LENGTH bytes stays whole. A NULL doc_id comes after all others. Rows with equal
    doc_id don't take from each other.
    """

    def keep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_text = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for part in slices(batch, "packed", SLICE_BYTES // 3):
                cuts = [_cut(s) for s in part.column(2).to_pylist()]
                kept = [_kept(open_text(t), c) for t, c in zip(part.column(1).to_pylist(), cuts, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(kept, pa.binary()), pa.array([[{"start": a, "end": b} for a, b in c] for c in cuts], part.schema.field(2).type)],
                    names=["doc_id", "kept", "spans"])

    return _texts_with_spans(docs, filter_keys).mapInArrow(keep, "doc_id bigint, kept binary, spans array<struct<start:int,end:int>>")


def digests(docs: DataFrame, filter_keys: int = FILTER_KEYS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and a digest of the bytes that stay, as ``remove_repeats`` finds them."""
    import hashlib

    def measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_text = zstandard.ZstdDecompressor().decompress
        names = [f.split(" ")[0] for f in DIGEST_SCHEMA.split(", ")]
        for batch in batches:
            for part in slices(batch, "packed", SLICE_BYTES // 3):
                rows = []
                for packed, spans in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    data, cuts = open_text(packed), _cut(spans)
                    kept = _kept(data, cuts)
                    rows.append((len(data), len(data) - len(kept), len(cuts), hashlib.sha256(kept).hexdigest()))
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3])], names=names)

    return _texts_with_spans(docs, filter_keys).mapInArrow(measure, DIGEST_SCHEMA)
