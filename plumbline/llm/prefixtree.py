"""Jaccard join of word-shingle sets through prefix trees.

Shingles stand in one order over the corpus: rare ones first. How many sets hold a shingle is counted in buckets of shingles, to which
every block of texts sends its distinct shingles, as packed differences of their sorted hashes; for those that another set holds too a
number comes back, their place among the bucket's, which from there on stands for the shingle. A set that shares too few of its
shingles to be alike to any other goes no further. Of two sets that are alike, the first few shingles of both in this order have one
in common; sets are dealt to the least set that has such a shingle, their family. A family's sets are put in a prefix tree, in
which sets with the same beginning share a path. Every set walks the tree; the overlap of a path is counted once for all below it,
and a subtree is left as soon as what remains on both sides can't reach the overlap that its sizes ask for. A subtree whose sets are
connected to the walking set already is left too, so a crowd of copies costs what its tree costs, not its pairs.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.components import components
from plumbline.session import settle

#: Words in a shingle; alike are sets whose intersection has at least so many hundredths of the union.
SHINGLE, ALIKE = 5, 80
#: Bytes of text hashed at a time, of text in a block, and of input for each counting bucket.
PIECE_BYTES, BLOCK_BYTES, BUCKET_BYTES = 1 << 20, 12 << 20, 16 << 20
#: Sets in a block, so that two bytes number them.
BLOCK_SETS = 60_000
#: Members and shingles of a family that one task joins; larger families are dealt to several.
FAMILY, FAMILY_TOKENS = 2_000, 3_000_000
#: Copies of a set beyond which its name goes to all tasks, so that its rows needn't meet in one.
HOT = 1_000_000

#: Numbers from which their planes are compressed one by one; shorter ones are left to what compresses shuffles and files.
LONG = 4_096

MANY = 0xFFFF
TOKEN_BITS = 56
_ODD = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xD6E8FEB86659FD93)
_NAME = np.uint64((1 << TOKEN_BITS) - 1)


# -- sets ------------------------------------------------------------------------------------------------------------------------


def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse."""
    base = np.full(size, _ODD, np.uint64)
    back = np.full(size, pow(_ODD, -1, 1 << 64), np.uint64)
    base[0] = back[0] = 1
    return np.multiply.accumulate(base), np.multiply.accumulate(back)


class Shingles:
    """Hashes of word shingles from running sums of a polynomial over the bytes."""

    def __init__(self, shingle: int = SHINGLE):
        self.shingle = shingle
        self.power, self.inverse = _powers(1 << 16)

    def _hashes(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if len(data) > len(self.power):
            self.power, self.inverse = _powers(2 * len(data))
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.power[:len(data)], out=sums[1:])
        h = (sums[ends] - sums[starts]) * self.inverse[starts]
        for _ in range(2):
            h = (h ^ h >> np.uint64(32)) * _MIX
        return (h ^ h >> np.uint64(32)) >> np.uint64(64 - TOKEN_BITS)

    def of(self, texts: list[bytes]) -> list[np.ndarray]:
        """The distinct shingles of each text of normalised words, hashed, in order."""
        joined = b" ".join([t for t in texts if t]) + b" "
        data = np.frombuffer(joined, np.uint8)
        ends = np.flatnonzero(data == 32) if len(joined) > 1 else np.zeros(0, np.int64)
        starts = np.append(0, ends[:-1] + 1) if len(ends) else ends
        words = np.array([t.count(b" ") + 1 if t else 0 for t in texts], np.int64)
        counts = np.where(words > 0, np.maximum(1, words - self.shingle + 1), 0)
        owner = np.repeat(np.arange(len(texts)), counts)
        first = np.repeat(np.cumsum(words) - words - (np.cumsum(counts) - counts), counts) + np.arange(len(owner))
        last = np.minimum(first + self.shingle - 1, np.repeat(np.cumsum(words), counts) - 1)
        found = self._hashes(data, starts[first], ends[last]) if len(owner) else np.zeros(0, np.uint64)
        bounds = np.append(0, np.cumsum(counts))
        return [np.unique(found[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]

    def of_one(self, text: bytes) -> np.ndarray:
        """The same of one text of any length, worked on in pieces that share the words of a shingle less one."""
        if len(text) <= PIECE_BYTES:
            return self.of([text])[0]
        found, start = [], 0
        while start < len(text):
            end = text.find(b" ", start + PIECE_BYTES)
            end = len(text) if end < 0 else end
            reach = end
            for _ in range(self.shingle - 1):  # words that begin in this piece's shingles and lie in the next
                further = text.find(b" ", reach + 1)
                reach = len(text) if further < 0 else further
            piece = text[start:reach]
            if found and piece.count(b" ") < self.shingle - 1:
                break  # all its shingles were in the piece before
            found.append(self.of([piece])[0])
            start = end + 1
        return np.unique(np.concatenate(found))


def normal(text: str | None) -> bytes:
    """Words with A-Z lower-cased, one space between them."""
    return b" ".join((text or "").encode("utf-8", "surrogatepass").lower().split())


def shingle_sets(texts: list[str | None], shingles: Shingles) -> Iterator[np.ndarray]:
    """The sets of ``texts``, about PIECE_BYTES of text at a time."""
    held, size = [], 0
    for text in texts:
        words = normal(text)
        if len(words) > PIECE_BYTES:
            yield from shingles.of(held) if held else ()
            held, size = [], 0
            yield shingles.of_one(words)
            continue
        held.append(words)
        size += len(words)
        if size > PIECE_BYTES:
            yield from shingles.of(held)
            held, size = [], 0
    yield from shingles.of(held) if held else ()


def key_of(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


# -- numbers on their way --------------------------------------------------------------------------------------------------------


def pack(values: np.ndarray) -> bytes:
    """Whole numbers as one plane for each of their bytes, lowest first; long ones are compressed where that helps, or left out if all are zeros."""
    if not len(values):
        return b""
    width = (int(values.max()).bit_length() + 7) // 8
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T)
    head = np.array([len(values), width], "<u4").tobytes()
    if len(values) < LONG:
        return head + planes.tobytes()
    cells = [min(plane.tobytes(), pa.compress(plane, codec="zstd", asbytes=True), key=len) if plane.any() else b"" for plane in planes]
    return head + np.array([len(c) for c in cells], "<u4").tobytes() + b"".join(cells)


def unpack(cell) -> np.ndarray:
    """The numbers of a cell of ``pack``."""
    view = memoryview(cell)
    if not len(view):
        return np.zeros(0, np.uint64)
    n, width = np.frombuffer(view[:8], "<u4").tolist()
    values = np.zeros((n, 8), np.uint8)
    if n < LONG:
        values[:, :width] = np.frombuffer(view[8:], np.uint8).reshape(width, n).T
        return values.view("<u8").ravel()
    at = 8 + 4 * width
    for i, size in enumerate(np.frombuffer(view[8:at], "<u4").tolist()):
        if size:
            plane = view[at:at + size]
            values[:, i] = np.frombuffer(plane if size == n else pa.decompress(plane, n, codec="zstd"), np.uint8)
            at += size
    return values.view("<u8").ravel()


def pack_sorted(values: np.ndarray) -> bytes:
    return pack(np.diff(values, prepend=np.uint64(0)))


def unpack_sorted(cell) -> np.ndarray:
    return np.cumsum(unpack(cell), dtype=np.uint64)


def pack_set(ordered: np.ndarray) -> bytes:
    """A set's shingles in order: steps from class to class, and from number to number within one."""
    kind, name = ordered >> np.uint64(TOKEN_BITS), ordered & _NAME
    turn = np.diff(kind, prepend=np.uint64(0))
    return pack(turn << np.uint64(TOKEN_BITS) | np.where(turn > 0, name, np.diff(name, prepend=np.uint64(0))))


def unpack_set(cell) -> np.ndarray:
    values = unpack(cell)
    turn, step = values >> np.uint64(TOKEN_BITS), values & _NAME
    name, starts = np.cumsum(step, dtype=np.uint64), np.flatnonzero(turn)
    if len(starts):
        name[starts[0]:] -= np.repeat((name - step)[starts], np.diff(np.append(starts, len(values))))
    return np.cumsum(turn, dtype=np.uint64) << np.uint64(TOKEN_BITS) | name


# -- how many sets hold a shingle ------------------------------------------------------------------------------------------------

SENT = "bucket bigint, block bigint, tokens binary, sets binary, times binary, own binary"
BACK = "block bigint, bucket bigint, names binary, sets binary, classes binary, own binary"
MARKED = "doc_id bigint, key binary, n bigint, shared bigint, tokens binary"
#: What a block keeps of its own, beside who holds the shingles that several of its sets hold, in their order: its documents.
OWN = pa.schema([("doc_id", pa.int64()), ("key", pa.binary()), ("n", pa.int64()), ("set", pa.int32())])


def _batch(schema: str, columns: list) -> pa.RecordBatch:
    kinds = {"bigint": pa.int64(), "binary": pa.binary(), "int": pa.int32(), "boolean": pa.bool_()}
    names, types = zip(*(f.split(" ") for f in schema.split(", ")), strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(columns, types, strict=True)], names=list(names))


def _ipc(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _block_rows(block: int, ids: list, sets: list[np.ndarray], buckets: int) -> pa.RecordBatch:
    """A block's distinct shingles on their way to the buckets, and what the block keeps, under a bucket of its own."""
    seen: dict[bytes, int] = {}
    distinct, keys, numbers = [], [], []
    for tokens in sets:
        key = key_of(tokens)
        if key not in seen:
            seen[key] = len(distinct)
            distinct.append(tokens)
        keys.append(key)
        numbers.append(seen[key])
    token = np.concatenate([np.zeros(0, np.uint64), *distinct])
    holder = np.repeat(np.arange(len(distinct)), [len(d) for d in distinct]).astype(np.uint16)
    order = np.argsort(token, kind="stable")
    token, holder = token[order], holder[order]
    first = np.flatnonzero(np.append(True, token[1:] != token[:-1])[:len(token)])
    times = np.diff(np.append(first, len(token)))
    several = np.repeat(times > 1, times)
    own = _ipc(pa.table([ids, keys, [len(s) for s in sets], numbers], schema=OWN))
    rows = [(-1 - block, block, b"", pack(holder[several]), pack(times[times > 1]), own)]
    token, holder = token[first], np.where(times > 1, MANY, holder[first]).astype(np.uint16)
    bucket = (token >> np.uint64(TOKEN_BITS - 32)) * np.uint64(buckets) >> np.uint64(32)
    cuts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])[:len(bucket)])
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(bucket)], strict=False):
        rows.append((int(bucket[a]), block, pack_sorted(token[a:b]), pack(holder[a:b]), pack(times[a:b][times[a:b] > 1]), None))
    return _batch(SENT, list(zip(*rows, strict=True)))


def _send(docs: DataFrame, buckets: int, shingle: int, block_bytes: int) -> DataFrame:
    def send(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(shingle)
        block = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
        ids, sets, size = [], [], 0
        for batch in batches:
            texts = batch.column(1)
            for key, tokens in zip(batch.column(0).to_pylist(), shingle_sets((t.as_py() for t in texts), shingles), strict=True):
                ids.append(key)
                sets.append(tokens)
                size += 6 * len(tokens)
                if size > block_bytes or len(ids) >= BLOCK_SETS:
                    yield _block_rows(block, ids, sets, buckets)
                    ids, sets, size, block = [], [], 0, block + 1
        if ids:
            yield _block_rows(block, ids, sets, buckets)

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(send, SENT)


def _class_of(held_by: np.ndarray) -> np.ndarray:
    """Steps of a fifth of the number of sets, in one byte."""
    return np.minimum(255, 4 * np.log2(held_by)).astype(np.uint64)


def _count(table: pa.Table) -> pa.Table:
    """One bucket: how many sets hold each shingle. For those of its shingles that more than one set holds every block gets their places among them."""
    if table.column("own")[0].is_valid:
        return pa.table([table.column(c) for c in ("block", "bucket", "tokens", "sets", "times", "own")], names=["block", "bucket", "names", "sets", "classes", "own"])
    cells = [unpack_sorted(t.as_buffer()) for t in table.column("tokens")]
    holders = [unpack(t.as_buffer()).astype(np.uint16) for t in table.column("sets")]
    times = []
    for holder, several in zip(holders, table.column("times"), strict=True):
        each = np.ones(len(holder), np.int64)
        each[holder == MANY] = unpack(several.as_buffer())
        times.append(each)
    token = np.concatenate(cells)
    order = np.argsort(token, kind="stable")
    token = token[order]
    first = np.flatnonzero(np.append(True, token[1:] != token[:-1])[:len(token)])
    held_by = np.add.reduceat(np.concatenate(times)[order], first)
    shared = np.flatnonzero(held_by > 1)
    kind, place = _class_of(held_by[shared]).astype(np.uint8), np.zeros(len(first), np.uint32)
    place[shared] = np.arange(1, len(shared) + 1, dtype=np.uint32)
    back = np.empty(len(order), np.uint32)  # places from 1 on, 0 for what no other set holds
    back[order] = np.repeat(place, np.diff(np.append(first, len(order))))
    rows, at, bucket = [], 0, table.column("bucket")[0].as_py()
    for block, holder in zip(table.column("block").to_pylist(), holders, strict=True):
        mine = back[at:at + len(holder)]
        at += len(holder)
        shared = mine > 0
        if shared.any():
            name = mine[shared] - np.uint32(1)
            rows.append((block, bucket, pack_sorted(name), pack(holder[shared]), pack(kind[name]), None))
    return pa.Table.from_batches([_batch(BACK, list(zip(*rows, strict=True)) or [[]] * 6)])


def _gather(table: pa.Table, buckets: int) -> pa.Table:
    """One block: its documents, and with the first of each set its shared shingles, rare ones first, if they are enough to be alike to another.

    A shingle's number is made of its bucket and its place there. Those of several sets come back in the order in which the block keeps their holders.
    """
    own = next(i for i, o in enumerate(table.column("own")) if o.is_valid)
    docs = pa.ipc.open_stream(table.column("own")[own].as_buffer()).read_all()
    times, holder_of_several = (unpack(table.column(c)[own].as_buffer()) for c in ("classes", "sets"))
    back = table.filter(pa.compute.is_null(table.column("own"))).sort_by("bucket")
    name = [unpack_sorted(x.as_buffer()) * np.uint64(buckets) + np.uint64(b) for x, b in zip(back.column("names"), back.column("bucket").to_pylist(), strict=True)]
    kind = [unpack(x.as_buffer()) << np.uint64(TOKEN_BITS) for x in back.column("classes")]
    ordered = np.concatenate([np.zeros(0, np.uint64), *(k | n for k, n in zip(kind, name, strict=True))])
    holder = np.concatenate([np.zeros(0, np.uint16), *(unpack(x.as_buffer()).astype(np.uint16) for x in back.column("sets"))])
    single = holder != MANY
    ordered = np.concatenate((ordered[single], np.repeat(ordered[~single], times.astype(np.int64))))
    holder = np.concatenate((holder[single], holder_of_several.astype(np.uint16)))
    order = np.lexsort((ordered, holder))
    ordered, holder = ordered[order], holder[order]
    number, sizes = docs.column("set").to_numpy(), docs.column("n").to_numpy()
    found: list[bytes | None] = [None] * len(number)
    many: list[int | None] = [None] * len(number)
    _, firsts = np.unique(number, return_index=True)
    bounds = np.searchsorted(holder, np.arange(len(firsts) + 1))
    for k, row in enumerate(firsts.tolist()):
        shared = int(bounds[k + 1] - bounds[k])
        if shared and 100 * shared >= ALIKE * int(sizes[row]):
            found[row], many[row] = pack_set(ordered[bounds[k]:bounds[k + 1]]), shared
    return pa.table([*(docs.column(c) for c in ("doc_id", "key", "n")), pa.array(many, pa.int64()), pa.array(found, pa.binary())],
                    names=["doc_id", "key", "n", "shared", "tokens"])


def marked_sets(docs: DataFrame, shingle: int = SHINGLE, block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(doc_id, key, n, shared, tokens): every document with its set's digest and size; with some document of each set that may have a partner its
    shared shingles in order, packed, and their number."""
    buckets = 1 + (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // bucket_bytes
    counted = _send(docs, buckets, shingle, block_bytes).groupBy("bucket").applyInArrow(_count, BACK)
    return counted.groupBy("block").applyInArrow(lambda table: _gather(table, buckets), MARKED)


# -- the tree --------------------------------------------------------------------------------------------------------------------


class Tree:
    """A prefix tree of ordered sets: nodes in preorder, each with the shingles of its edge and what is below it."""

    def __init__(self, sets: list[np.ndarray], sizes: list[int]):
        by = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u8").tobytes())
        self.order = by
        self.sets = [sets[i] for i in by]
        n = np.array([sizes[i] for i in by], np.int64)
        length = np.array([len(s) for s in self.sets], np.int64)
        shared = np.zeros(len(by), np.int64)
        for i in range(1, len(by)):
            a, b = self.sets[i - 1], self.sets[i]
            m = min(len(a), len(b))
            differ = np.flatnonzero(a[:m] != b[:m])
            shared[i] = differ[0] if len(differ) else m
        nodes, open_nodes = [], [(0, len(by), 0, -1)]
        while open_nodes:
            low, high, top, parent = open_nodes.pop()
            bottom = int(shared[low + 1:high].min()) if high - low > 1 else int(length[low])
            nodes.append((low, high, top, bottom, parent, int(n[low:high].min()), int(n[low:high].max()), int(length[low:high].max())))
            if high - low > 1:
                cuts = [low, *(low + 1 + np.flatnonzero(shared[low + 1:high] == bottom)).tolist(), high]
                open_nodes += [(a, b, bottom, len(nodes) - 1) for a, b in zip(cuts[-2::-1], cuts[:0:-1], strict=True)]
        self.nodes = nodes
        after = list(range(1, len(nodes) + 1))
        for i in range(len(nodes) - 1, -1, -1):
            parent = nodes[i][4]
            if parent >= 0:
                after[parent] = max(after[parent], after[i])
        self.after = after
        self.low = np.array([x[0] for x in nodes])
        self.high = np.array([x[1] for x in nodes])

    def connected(self, roots: np.ndarray) -> list[int]:
        """For every node the root that all its sets have, or -1."""
        bounds = np.column_stack((self.low, self.high)).ravel()
        least = np.minimum.reduceat(np.append(roots, roots[-1]), bounds)[::2]
        most = np.maximum.reduceat(np.append(roots, roots[-1]), bounds)[::2]
        return np.where(least == most, least, -1).tolist()

    def walk(self, tokens: np.ndarray, size: int, root: int, connected: list[int], beyond: int, held: np.ndarray, alike: int) -> Iterator[int]:
        """Positions of sets, none before ``beyond``, that are alike to the walking set and not in subtrees wholly of its ``root``.

        ``held`` says for each shingle of the family whether the set has it; ``tokens`` are those it has, in order.
        """
        mine, nodes, overlaps = tokens.tolist(), self.nodes, [0] * len(self.nodes)
        i = 0
        while i < len(nodes):
            low, high, top, bottom, parent, least, most, longest = nodes[i]
            if high <= beyond or connected[i] == root or 100 * min(size, most) < alike * max(size, least):
                i = self.after[i]
                continue
            overlap, left = overlaps[parent] if parent >= 0 else 0, len(mine)
            if bottom > top:
                edge = self.sets[low][top:bottom]
                overlap += int(np.count_nonzero(held[edge]))
                left -= bisect_right(mine, int(edge[-1]))
            elif bottom:
                left -= bisect_right(mine, int(self.sets[low][bottom - 1]))
            overlaps[i] = overlap
            if (100 + alike) * (overlap + min(left, longest - bottom)) < alike * (size + least):
                i = self.after[i]
                continue
            if high - low == 1 and (100 + alike) * overlap >= alike * (size + least):
                yield low
            i += 1


def family_links(members: list[tuple[int, int, np.ndarray, int, bool, bool]], alike: int = ALIKE) -> list[tuple[int, int]]:
    """Links between members (node, n, ordered shingles, root, in the tree, walks), as many as connect all that are alike.

    Members with one root count as connected already.
    """
    held = [m for m in members if m[4]]
    if not held or not any(m[5] for m in members):
        return []
    names, flat = np.unique(np.concatenate([m[2] for m in held]), return_inverse=True)
    bounds = np.append(0, np.cumsum([len(m[2]) for m in held])).tolist()
    tree = Tree([flat[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)], [m[1] for m in held])
    above: dict[int, int] = {m[3]: m[3] for m in members}

    def find(x: int) -> int:
        while above[x] != x:
            above[x] = x = above[above[x]]
        return x

    in_tree = [held[i] for i in tree.order]
    place = {m[0]: i for i, m in enumerate(in_tree)}
    connected = tree.connected(np.array([m[3] for m in in_tree]))
    all_walk = all(m[5] for m in held)
    links = []
    for node, n, tokens, first_root, _, walks in members:
        if not walks:
            continue
        at = np.searchsorted(names, tokens)
        at = at[names[np.minimum(at, len(names) - 1)] == tokens]
        mask = np.zeros(len(names), bool)
        mask[at] = True
        met = False
        # where every set of the tree walks, two of them meet once, from the one before
        beyond = place[node] + 1 if all_walk and node in place else 0
        for k in tree.walk(at, n, find(first_root), connected, beyond, mask, alike):
            other = in_tree[k]
            if find(other[3]) != find(first_root):
                links.append((node, other[0]))
                above[find(other[3])] = find(first_root)
                met = True
        if met:
            connected = tree.connected(np.array([find(m[3]) for m in in_tree]))
    return links


# -- families --------------------------------------------------------------------------------------------------------------------


def prefix_of(n: int, shared: int, alike: int = ALIKE) -> int:
    """How many of a set's shared shingles are among the first ones, of which two alike sets have one in common.

    The shingles that no other set holds come first of all and lead nowhere.
    """
    return n - -(-alike * n // 100) + 1 - (n - shared)


def _prefixes(nodes: DataFrame, alike: int) -> DataFrame:
    def first(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sets = [unpack_set(t.as_buffer()).view(np.int64) for t in part.column(2)]
                tokens = [s[:prefix_of(n, len(s), alike)] for n, s in zip(part.column(1).to_pylist(), sets, strict=True)]
                nodes = np.repeat(part.column(0).to_numpy(), [len(t) for t in tokens])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens)), pa.array(nodes)], names=["token", "node"])

    return nodes.select("node", "n", "tokens").mapInArrow(first, "token bigint, node bigint")


def _join_families(rows: DataFrame, alike: int) -> DataFrame:
    """(a, b) from rows (family, part, sub, node, n, tokens, root, held, walks): each (family, part, sub) is joined by one task, one after another."""

    def join(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(links: list) -> pa.RecordBatch:
            a, b = zip(*links, strict=True) if links else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        now, members = None, []
        for batch in batches:
            columns = [batch.column(c).to_pylist() if c != "tokens" else batch.column(c) for c in ("family", "part", "sub", "node", "n", "tokens", "root", "held", "walks")]
            for family, part, sub, node, n, tokens, root, held, walks in zip(*columns, strict=True):
                if (family, part, sub) != now:
                    yield done(family_links(members, alike))
                    now, members = (family, part, sub), []
                members.append((node, n, unpack_set(tokens.as_buffer()), root, held, walks))
        yield done(family_links(members, alike))

    keys = ["family", "part", "sub"]
    return rows.repartition(*keys).sortWithinPartitions(*keys, "node").mapInArrow(join, "a bigint, b bigint")


def like_links(nodes: DataFrame, alike: int = ALIKE, family: int = FAMILY, family_tokens: int = FAMILY_TOKENS) -> DataFrame:
    """(a, b): links between ``nodes`` (node, n, shared, tokens), all alike, enough to connect whatever is alike.

    A family beyond ``family`` members or ``family_tokens`` shingles is dealt to several tasks, each with the family's least member. Members
    that aren't connected to that one afterwards walk past all parts' trees, in blocks; no pair of the family is left out.
    """
    first = settle(_prefixes(nodes, alike))
    ends = first.groupBy("token").agg(F.min("node").alias("family"), F.count("*").alias("held")).where("held > 1").select("token", "family")
    met = settle(first.join(ends, "token").select("family", "node").distinct())
    sized = met.join(nodes.select("node", "shared"), "node")
    parts = F.ceil(F.greatest(F.count("*") / family, F.sum("shared") / family_tokens)).cast("bigint").alias("parts")
    families = settle(sized.groupBy("family").agg(F.count("*").alias("members"), parts))
    several = families.where("members > 1")
    dealt = met.join(several, "family").select("family", "parts", "node", F.pmod(F.xxhash64("node"), "parts").alias("part"))
    leads = several.where("parts > 1").select("family", F.col("family").alias("node"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("part"))
    dealt = dealt.where("parts = 1 OR node <> family").select("family", "node", "part").unionByName(leads)
    sets = nodes.select("node", "n", "tokens")

    def rows(who: DataFrame, held: str, walks: str, root: str, sub: str) -> DataFrame:
        return who.join(sets, "node").selectExpr("family", "part", f"{sub} AS sub", "node", "n", "tokens", f"{root} AS root", f"{held} AS held", f"{walks} AS walks")

    links = settle(_join_families(rows(dealt, "true", "true", "node", "0L"), alike))
    large = several.where("parts > 1")
    if not large.limit(1).count():
        return links
    roots = components(links, "a", "b").select(F.col("node").alias("member"), "root")
    placed = met.join(large, "family").join(roots, F.col("node") == F.col("member"), "left").select(
        "family", "parts", "node", F.coalesce("root", "node").alias("root"), F.pmod(F.xxhash64("node"), "parts").alias("part"))
    placed = settle(placed)
    lead = placed.where("node = family").select("family", F.col("root").alias("lead"))
    apart = settle(placed.join(lead, "family").where("root <> lead"))
    blocks = apart.groupBy("family").agg(F.ceil(F.count("*") / family).cast("bigint").alias("blocks"))
    zero = F.lit(0).cast("bigint")
    stand = placed.join(blocks, "family").select("family", "part", "node", "root", F.explode(F.sequence(zero, F.col("blocks") - 1)).alias("block"), F.lit(True).alias("held"))
    ask = apart.join(blocks, "family").select("family", F.explode(F.sequence(zero, F.col("parts") - 1)).alias("part"), "node", "root",
                                              F.pmod(F.xxhash64("node", F.lit("block")), "blocks").alias("block"), F.lit(False).alias("held"))
    tiles = stand.unionByName(ask).groupBy("family", "part", "block", "node").agg(
        F.min("root").alias("root"), F.max("held").alias("held"), F.max(~F.col("held")).alias("walks"))
    return links.unionByName(_join_families(rows(tiles, "held", "walks", "root", "block"), alike))


def _named(rows: DataFrame, names: DataFrame, hot: int) -> DataFrame:
    """``rows`` with the component_id of their key, where there is one. Keys with many copies are told to all tasks: at most rows / ``hot`` of them."""
    plain = names.where(F.col("copies") <= hot).select("key", "component_id")
    found = rows.join(plain, "key", "left")
    many = names.where(F.col("copies") > hot).select("key", "component_id")
    if not many.limit(1).count():
        return found
    crowded = F.broadcast(many.select("key"))
    return rows.join(crowded, "key", "left_anti").join(plain, "key", "left").unionByName(rows.join(F.broadcast(many), "key"))


def like_components(docs: DataFrame, shingle: int = SHINGLE, alike: int = ALIKE, family: int = FAMILY, family_tokens: int = FAMILY_TOKENS,
                    block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES, hot: int = HOT) -> DataFrame:
    """doc_id, n_shingles, component_id: one row for every input row, components over links of ``alike`` hundredths or more.

    Sets are compared by hashes of 56 bits. NULL, empty and blank texts have an empty set, are linked with nothing and name themselves.
    Documents of one set are linked. A NULL doc_id names no component; where all of one are NULL so is the name. Repeated rows come out
    repeated; other columns are not looked at; an empty table gives none.
    """
    marked = settle(marked_sets(docs, shingle, block_bytes, bucket_bytes))
    rows = marked.select("doc_id", "key", "n")
    sets = marked.where("n > 0").groupBy("key").agg(
        F.min("doc_id").alias("least"), F.count("*").alias("copies"), F.max("n").alias("n"), F.max("shared").alias("shared"), F.max("tokens").alias("tokens"))
    nodes = settle(sets.where("tokens IS NOT NULL OR copies > 1").withColumn("node", F.monotonically_increasing_id()))
    roots = components(like_links(nodes.where("tokens IS NOT NULL").select("node", "n", "shared", "tokens"), alike, family, family_tokens), "a", "b").withColumnRenamed("node", "member")
    rooted = settle(nodes.select("key", "least", "copies", "node").join(roots, F.col("node") == F.col("member"), "left")
                    .select("key", "least", "copies", F.coalesce("root", "node").alias("root")))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    names = settle(rooted.join(least, "root").select("key", "copies", "component_id"))
    return _named(rows, names, hot).select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


#: The same in SQL, by counting the shared shingles of all pairs that share one.
SQL = r"""WITH RECURSIVE texts AS (SELECT row_number() OVER () AS rn, doc_id,
  [w FOR w IN string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') IF w <> ''] AS words FROM documents),
sets AS (SELECT rn, doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
  ELSE list_distinct([array_to_string(words[i:i + 4], ' ') FOR i IN range(1, len(words) - 3)]) END AS shingles FROM texts),
each AS (SELECT rn, len(shingles) AS n, unnest(shingles) AS shingle FROM sets),
common AS (SELECT a.rn AS a, b.rn AS b, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS c FROM each a JOIN each b USING (shingle) WHERE a.rn <> b.rn GROUP BY a.rn, b.rn),
links AS MATERIALIZED (SELECT a, b FROM common WHERE 100 * c >= 80 * (n + m - c)),
reach(a, b) AS (SELECT rn, rn FROM sets UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT any_value(s.doc_id) AS doc_id, any_value(len(s.shingles))::BIGINT AS n_shingles, min(o.doc_id) AS component_id
FROM reach r JOIN sets s ON s.rn = r.a JOIN sets o ON o.rn = r.b GROUP BY r.a"""
