"""Repair of conversation structure: the cheapest edits, and of equally cheap ones the least audit.

Rows are kept, given another role, deleted, or joined by inserted ones, until the roles read ``(s?(ua)+)?``. The automaton of that
pattern has four states, so a row is a 4 x 4 table of costs, and tables of neighbouring rows combine by (min, +): costs to the end come from
doubled products, for all rows of many conversations at once. Arcs on cheapest ways make a graph, in which an audit is read letter
by letter. Its nodes are ranked by their audits' first letter, then by the first two, four, eight: a node's rank for twice the
length is that of its own rank and of the rank of the node that its pointer reaches, and pointers are doubled with the ranks. Ranks choose a
node's arc; the least path is read off through the doubled pointers.

Conversations are dealt by ranges of (conversation, turn, beginnings of role and text), so one of any length lies in several tasks, in
pieces of bounded size. Tables of pieces combine the same way as those of rows, by joins over doubled distances.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import slices
from plumbline.session import settle

#: Costs of giving a role, deleting, inserting, and of a truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Rows and bytes of text in a piece; rows of whole conversations worked on together.
PIECE_ROWS, PIECE_BYTES, TOGETHER = 4096, 4 << 20, 8192
#: Characters of role and text that take part in the order of rows of one turn.
KEY_CHARS = 64
BLANKS = " \t\n\x0b\x0c\r"

#: States: nothing yet, after s, after u, after a. An inserted or re-roled row leads to the state NEXT.
NEXT = np.array([2, 2, 3, 2])
ACCEPTED = np.array([True, False, False, True])
FAR = 1 << 60
LETTERS = np.frombuffer(b"DIKR", np.uint8)
LEGAL = {"su", "ua", "au"}

REPAIRED = ("conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, "
            "repaired_sha256 string")
MIXED = REPAIRED + ", part int, seq int, payload binary"
ROW = pa.schema([("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("blank", pa.bool_()), ("truncated", pa.bool_())])


# -- damage ----------------------------------------------------------------------------------------------------------------------


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows by a checksum of their place: dropped (marked, not left out), emptied, without end marks, repeated, or given to the user.

    NULLs read as one space. Columns conv_id, turn, role, text, dropped.
    """
    place = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    kind = F.crc32(place.cast("binary")) % 20
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    return conversations.select(
        F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind.isin(0, 1), "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"), (kind == 0).alias("dropped"),
        F.explode(F.array_repeat(F.lit(0), F.when(kind == 3, 2).otherwise(1))).alias("copy")).drop("copy")


def in_order(rows: DataFrame) -> DataFrame:
    """Rows of every conversation by turn, NULL first, then by the beginnings of role and text and a hash of the text; blank and truncated told.

    Dealt by ranges of that order, so a conversation, or one turn of it, may lie in several partitions, one after another.
    """
    order = ["conv_id", "turn", F.left("role", F.lit(KEY_CHARS)), F.left("text", F.lit(KEY_CHARS)), F.xxhash64("text")]
    bare = F.rtrim("text", F.lit(BLANKS))
    told = rows.withColumns({"blank": bare == "", "truncated": (bare != "") & ~F.right(bare, F.lit(1)).isin(".", "!", "?")})
    return told.repartitionByRange(*order).sortWithinPartitions(*order)


# -- costs and ranks -------------------------------------------------------------------------------------------------------------


def combined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(min, +) products of stacks of tables."""
    out = np.full(a.shape, FAR)
    for k in range(4):
        np.minimum(out, a[:, :, k, None] + b[:, None, k, :], out=out)
    return out


def _inserts() -> np.ndarray:
    """Least cost of insertions from state to state."""
    table = np.full((1, 4, 4), FAR)
    table[0, range(4), range(4)] = 0
    table[0, range(4), NEXT] = INSERT
    return combined(table, table)


class Rows:
    """Rows of several segments (conversations or pieces) of ``lengths``, one after another.

    Every segment has a layer of four nodes before each row and one after its last.
    """

    def __init__(self, lengths: np.ndarray, initials: np.ndarray, gone: np.ndarray, truncated: np.ndarray):
        self.lengths = lengths
        self.first = np.cumsum(lengths + 1) - lengths - 1
        count = int((lengths + 1).sum())
        self.segment = np.repeat(np.arange(len(lengths)), lengths + 1)
        self.left = self.first[self.segment] + lengths[self.segment] - np.arange(count)
        self.row_layer = np.flatnonzero(self.left > 0)
        more = np.where(truncated, TRUNCATED, 0)
        #: cost of the arc with each letter out of each node and the state it leads to
        self.cost = np.full((count, 4, 4), FAR)
        self.state = np.tile(NEXT, (count, 4, 1)).transpose(0, 2, 1).copy()  # [layer, state, letter]
        self.cost[:, :, 1] = INSERT
        rows = self.row_layer
        self.cost[rows, :, 0] = DELETE
        self.state[:, :, 0] = np.arange(4)
        stays = np.where(gone, FAR, more)
        self.cost[rows, :, 3] = np.minimum(FAR, stays + REROLE)[:, None]
        for initial, states, to in (("s", [0], 1), ("u", [0, 1, 3], 2), ("a", [2], 3)):
            some = np.flatnonzero(initials == initial)
            for s in states:
                self.cost[rows[some], s, 2] = stays[some]
                self.state[rows[some], s, 2] = to

    def tables(self) -> np.ndarray:
        """For every layer the costs from state to state up to its segment's last row."""
        rows = self.row_layer
        own = np.full((len(self.segment), 4, 4), FAR)
        own[:, range(4), range(4)] = 0
        arcs = np.full((len(rows), 4, 4), FAR)
        at = np.arange(len(rows))
        for s in range(4):
            for letter in (0, 2, 3):
                to = self.state[rows, s, letter]
                arcs[at, s, to] = np.minimum(arcs[at, s, to], self.cost[rows, s, letter])
        own[rows] = combined(np.broadcast_to(_inserts(), arcs.shape), arcs)
        reach = 1
        while len(long := np.flatnonzero(self.left > reach)):
            own[long] = combined(own[long], own[long + reach])
            reach *= 2
        return own

    def solve(self, ends: np.ndarray, final: np.ndarray) -> Paths:
        """Cheapest ways, given the cost from every state after each segment; a ``final`` one may end with insertions."""
        to_end = np.full((len(self.segment), 4), FAR)
        tables = self.tables()
        for k in range(4):
            np.minimum(to_end, tables[:, :, k] + ends[self.segment, k, None], out=to_end)
        return Paths(self, to_end, final)


class Paths:
    """The graph of cheapest arcs, its nodes' ranks, and pointers to the node 1, 2, 4, ... letters on."""

    def __init__(self, rows: Rows, to_end: np.ndarray, final: np.ndarray):
        count = len(rows.segment)
        self.rows, self.to_end = rows, to_end
        layer = np.arange(count)[:, None, None] + np.array([1, 0, 1, 1])  # an insertion stays before the row
        target = 4 * np.minimum(layer, count - 1) + rows.state
        cost = rows.cost.copy()
        cost[(rows.left == 0) & ~final[rows.segment], :, 1] = FAR
        optimal = (cost < FAR) & (to_end[:, :, None] < FAR) & (to_end[:, :, None] == cost + to_end.ravel()[target])
        optimal, target = optimal.reshape(-1, 4), target.reshape(-1, 4)
        nodes = np.arange(4 * count)
        # A letter leads out of a node to one node, so the least letters of any number lead to one node as well.
        letter = np.where(optimal.any(axis=1), optimal.argmax(axis=1), -1)
        reached = np.where(letter >= 0, target[nodes, np.maximum(letter, 0)], nodes)
        rank, steps = letter + 1, (letter >= 0).astype(np.int64)
        while (letter[reached] >= 0).any():
            _, rank = np.unique(rank * (rank.max() + 1) + rank[reached], return_inverse=True)
            steps = steps + steps[reached]
            reached = reached[reached]
        score = np.where(optimal, np.arange(4) * (rank.max() + 1) + rank[target], np.iinfo(np.int64).max)
        self.letter = np.where(letter >= 0, score.argmin(axis=1), -1)
        step = np.where(letter >= 0, target[nodes, np.maximum(self.letter, 0)], nodes)
        self.pointers = [step]
        while (self.letter[self.pointers[-1]] >= 0).any():
            self.pointers.append(self.pointers[-1][self.pointers[-1]])
        self.steps, self.end = steps, self.pointers[-1]

    def exits(self) -> np.ndarray:
        """(segments, 4): the state in which the least path from each state before the segment leaves it."""
        return self.end[4 * self.rows.first[:, None] + np.arange(4)] % 4

    def path(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(segment, layer, node) of the nodes on the paths from ``entries``, one state a segment, in order; ends left out."""
        on = np.zeros(len(self.letter), bool)
        on[4 * self.rows.first + entries] = True
        for pointer in reversed(self.pointers):
            on[pointer[on]] = True
        nodes = np.flatnonzero(on & (self.letter >= 0))
        segment = self.rows.segment[nodes // 4]
        nodes = nodes[np.lexsort((-self.steps[nodes], segment))]
        return self.rows.segment[nodes // 4], nodes // 4, nodes


# -- segments --------------------------------------------------------------------------------------------------------------------


def _ends_after_all() -> np.ndarray:
    return _inserts()[0][:, ACCEPTED].min(axis=1)


def _marks(segment: pa.Table) -> list[bytes]:
    """A digest of every row's role and text."""
    pairs = zip(segment.column("role").to_pylist(), segment.column("text").to_pylist(), strict=True)
    return [hashlib.blake2b(f"{len(r)}:{r}{t}".encode("utf-8", "surrogatepass"), digest_size=16).digest() for r, t in pairs]


def _repeats(marks: list[bytes], before: Iterable[int] = ()) -> np.ndarray:
    """Which rows have been seen earlier in the segment, or have a place among ``before``."""
    seen, found = set(), np.zeros(len(marks), bool)
    for i, mark in enumerate(marks):
        found[i] = mark in seen
        seen.add(mark)
    known = {marks[i] for i in before}
    return found | np.array([m in known for m in marks], bool) if known else found


class Segments:
    """Segments as tables of ROW, with every row's fault."""

    def __init__(self, tables: list[pa.Table], before: list[Iterable[int]] | None = None):
        self.tables = tables
        lengths = np.array([t.num_rows for t in tables], np.int64)
        whole = pa.concat_tables([ROW.empty_table(), *tables])
        self.roles, self.texts = whole.column("role").to_pylist(), whole.column("text").to_pylist()
        self.initials = np.array([r[:1] for r in self.roles], "U1")
        self.blank = whole.column("blank").to_numpy().astype(bool)
        repeats = [_repeats(_marks(t), b) for t, b in zip(tables, before or [()] * len(tables), strict=True)]
        self.duplicate = np.concatenate([np.zeros(0, bool), *repeats]) & ~self.blank
        self.truncated = whole.column("truncated").to_numpy().astype(bool) & ~self.blank & ~self.duplicate
        self.rows = Rows(lengths, self.initials, self.blank | self.duplicate, self.truncated)
        self.bounds = np.append(0, np.cumsum(lengths)).tolist()

    def facts(self, k: int) -> dict:
        """Counts of a segment and what its neighbours need to know."""
        a, b = self.bounds[k], self.bounds[k + 1]
        initials = self.initials[a:b].tolist()
        turns = sorted({t for t in self.tables[k].column("turn").to_pylist() if t is not None})
        return {"blank": int(self.blank[a:b].sum()), "duplicate": int(self.duplicate[a:b].sum()), "truncated": int(self.truncated[a:b].sum()),
                "illegal": sum(x + y not in LEGAL for x, y in zip(initials, initials[1:], strict=False)), "opens": initials[0] if initials else None,
                "closes": initials[-1] if initials else None, "low": turns[0] if turns else None, "high": turns[-1] if turns else None, "turns": len(turns)}

    def outcome(self, paths: Paths, entries: np.ndarray) -> list[tuple[str, list[str]]]:
        """(audit, repaired lines) of every segment."""
        segment, layer, node = paths.path(entries)
        letters = paths.letter[node]
        audit = LETTERS[letters].tobytes().decode()
        cuts = np.searchsorted(segment, np.arange(len(self.tables) + 1)).tolist()
        lines: list[list[str]] = [[] for _ in self.tables]
        row = (layer - segment).tolist()  # a layer more than rows in every segment before
        to = self.rows.state[layer, node % 4, letters].tolist()
        for s, r, letter, state in zip(segment.tolist(), row, letters.tolist(), to, strict=True):
            if letter:
                role = self.roles[r] if letter == 2 else "user" if state == 2 else "assistant"
                lines[s].append(f"{role}:{'' if letter == 1 else self.texts[r]}")
        return [(audit[a:b], x) for a, b, x in zip(cuts[:-1], cuts[1:], lines, strict=True)]


def _digest(lines: list[str]) -> str:
    return hashlib.sha256("\n".join(lines).encode("utf-8", "surrogatepass")).hexdigest()


def repaired(ids: list, tables: list[pa.Table]) -> list[tuple]:
    """Rows of REPAIRED for whole conversations."""
    segments = Segments(tables)
    paths = segments.rows.solve(np.tile(_ends_after_all(), (len(tables), 1)), np.ones(len(tables), bool))
    costs = paths.to_end[segments.rows.first, 0].tolist()
    found = []
    for k, (audit, lines) in enumerate(segments.outcome(paths, np.zeros(len(tables), np.int64))):
        f = segments.facts(k)
        gaps = f["high"] - f["low"] + 1 - f["turns"] if f["turns"] else 0
        found.append((ids[k], gaps, f["blank"], f["duplicate"], f["truncated"], f["illegal"], costs[k], audit, _digest(lines)))
    return found


def _table(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"bigint": pa.int64(), "string": pa.string(), "int": pa.int32(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64())}
    names, types = zip(*(f.split(" ") for f in schema.split(", ")), strict=True)
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(columns, types, strict=True)], names=list(names))


def _close(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, ROW, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _open(payload) -> pa.Table:
    return pa.ipc.open_stream(payload.as_buffer()).read_all()


def _first_pass(rows: DataFrame, piece_rows: int, piece_bytes: int) -> DataFrame:
    """MIXED: results of conversations that lie whole inside a partition and fit a piece; pieces of all others, in order of (part, seq).

    The first and the last conversation of a partition may go on in the next one, so they travel as pieces.
    """

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() if TaskContext.get() else 0
        nothing = (None,) * 8
        done_ids, done, waiting, heavy = [], [], 0, 0
        now, held, count, size, seq, opening = None, [], 0, 0, 0, True

        def piece() -> pa.RecordBatch:
            table = pa.concat_tables([ROW.empty_table(), *held])
            return _table(MIXED, [(now[0], *nothing, part, seq, _close(table))])

        for batch in batches:
            for run in slices(batch, "text", piece_bytes // 4):
                ids = run.column(0)
                keys = ids.to_numpy(zero_copy_only=False) if not ids.null_count else np.array([(x is None, x or 0) for x in ids.to_pylist()], "?,i8")
                cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), run.num_rows]
                live = pa.Table.from_batches([run]).select(["turn", "role", "text", "blank", "truncated"]).cast(ROW)
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    key = (ids[a].as_py(),)
                    if key != now:
                        if now is not None:
                            if opening or seq:
                                yield piece()
                            else:
                                done_ids.append(now[0])
                                done.append(pa.concat_tables([ROW.empty_table(), *held]))
                                waiting, heavy = waiting + count, heavy + size
                                if waiting > TOGETHER or heavy > piece_bytes:
                                    yield _table(MIXED, [(*r, None, None, None) for r in repaired(done_ids, done)])
                                    done_ids, done, waiting, heavy = [], [], 0, 0
                            opening = False
                        now, held, count, size, seq = key, [], 0, 0, 0
                    for at in range(a, b, piece_rows):
                        some = live.slice(at, min(piece_rows, b - at)).filter(pa.compute.invert(run.column(5).slice(at, min(piece_rows, b - at))))
                        if held and (count + some.num_rows > piece_rows or size > piece_bytes):
                            yield piece()
                            held, count, size, seq = [], 0, 0, seq + 1
                        held.append(some)
                        count, size = count + some.num_rows, size + some.nbytes
        if done:
            yield _table(MIXED, [(*r, None, None, None) for r in repaired(done_ids, done)])
        if now is not None:
            yield piece()

    return rows.select("conv_id", "turn", "role", "text", "blank", "dropped", "truncated").mapInArrow(cut, MIXED)


# -- conversations in pieces -----------------------------------------------------------------------------------------------------

FACTS = "conv string, idx bigint, costs array<bigint>, blank bigint, duplicate bigint, truncated bigint, illegal bigint, opens string, closes string, low bigint, high bigint, turns bigint"


def _each_piece(pieces: DataFrame, schema: str, work: Callable[[dict, Segments], tuple]) -> DataFrame:
    """One row of ``schema`` for every piece; ``pieces`` has payload and before beside what ``work`` reads."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            payloads = batch.column(batch.schema.names.index("payload"))
            others = batch.drop_columns(["payload"])
            for i in range(batch.num_rows):
                row = others.slice(i, 1).to_pylist()[0]
                yield _table(schema, [work(row, Segments([_open(payloads[i])], [row["before"] or ()]))])

    return pieces.mapInArrow(run, schema)


def _numbered(pieces: DataFrame) -> DataFrame:
    """Pieces with conv (a name that isn't NULL), idx (0, 1, ... in the conversation) and of (their number). One row a partition is looked at together."""
    named = pieces.withColumn("conv", F.coalesce(F.col("conv_id").cast("string"), F.lit("none")))
    parts = named.groupBy("conv", "part").agg(F.count("*").alias("here"))
    by = Window.partitionBy("conv")
    parts = parts.select("conv", "part", (F.sum("here").over(by.orderBy("part")) - F.col("here")).alias("earlier"), F.sum("here").over(by).alias("of"))
    place = F.row_number().over(Window.partitionBy("conv", "part").orderBy("seq")) - 1
    return named.withColumn("place", place).join(parts, ["conv", "part"]).withColumn("idx", (F.col("earlier") + F.col("place")).cast("bigint"))


def _sql_combined(a: str, b: str) -> Column:
    cell = lambda i, j: f"least({FAR}L, {', '.join(f'{a}[{4 * i + k}] + {b}[{4 * k + j}]' for k in range(4))})"
    return F.expr(f"array({', '.join(cell(i, j) for i in range(4) for j in range(4))})")


def _doubled(rows: DataFrame, column: str, most: int, onward: int, step: Callable[[str, str], Column]) -> DataFrame:
    """(conv, idx, column): ``column`` combined with those of all pieces in the direction of ``onward``, by joins over 1, 2, 4, ... pieces."""
    held, reach = settle(rows.select("conv", "idx", column)), 1
    while reach < most:
        other = held.select("conv", (F.col("idx") - onward * reach).alias("idx"), F.col(column).alias("further"))
        held = settle(held.join(other, ["conv", "idx"], "left").select(
            "conv", "idx", F.when(F.col("further").isNull(), F.col(column)).otherwise(step(column, "further")).alias(column)))
        reach *= 2
    return held


def _in_pieces(pieces: DataFrame, most: int) -> DataFrame:
    """REPAIRED of conversations of up to ``most`` pieces each, none of them empty."""
    marks = pieces.select("conv", "idx", "payload").mapInArrow(_marked, "conv string, idx bigint, place int, mark binary")
    marks = settle(marks)
    owners = marks.groupBy("conv", "mark").agg(F.min("idx").alias("owner"))
    later = marks.join(owners, ["conv", "mark"]).where("idx > owner").groupBy("conv", "idx").agg(F.collect_list("place").alias("before"))
    told = settle(pieces.select("conv", "conv_id", "idx", "of", "payload").join(later, ["conv", "idx"], "left"))

    def facts(row: dict, segment: Segments) -> tuple:
        f = segment.facts(0)
        return (row["conv"], row["idx"], segment.rows.tables()[0].ravel().tolist(), *(f[c] for c in ("blank", "duplicate", "truncated", "illegal", "opens", "closes", "low", "high", "turns")))

    known = settle(_each_piece(told.select("conv", "idx", "before", "payload"), FACTS, facts))
    onward = _doubled(known, "costs", most, 1, _sql_combined)
    after = _ends_after_all().tolist()
    least = lambda i: f"least({FAR}L, {', '.join(f'costs[{4 * i + k}] + {after[k]}L' for k in range(4))})"
    to_end = onward.select("conv", "idx", F.expr(f"array({', '.join(least(i) for i in range(4))})").alias("ends"))
    placed = settle(told.join(to_end.select("conv", (F.col("idx") - 1).alias("idx"), "ends"), ["conv", "idx"], "left").withColumn("last", F.col("idx") == F.col("of") - 1))

    def paths(row: dict, segment: Segments) -> Paths:
        return segment.rows.solve(np.array([after if row["last"] else row["ends"]]), np.array([row["last"]]))

    def exits(row: dict, segment: Segments) -> tuple:
        return row["conv"], row["idx"], paths(row, segment).exits()[0].tolist()

    leave = _each_piece(placed.select("conv", "idx", "before", "payload", "ends", "last"), "conv string, idx bigint, leaves array<bigint>", exits)
    # what a path from each state before the conversation has come to after the piece
    through = _doubled(leave, "leaves", most, -1, lambda own, further: F.transform(further, lambda s: F.get(own, s)))
    entry = through.select("conv", (F.col("idx") + 1).alias("idx"), F.get("leaves", F.lit(0)).alias("entry"))

    def outcome(row: dict, segment: Segments) -> tuple:
        audit, lines = segment.outcome(paths(row, segment), np.array([row["entry"] or 0]))[0]
        return row["conv"], row["conv_id"], row["idx"], audit, "\n".join(lines).encode("utf-8", "surrogatepass")

    told = placed.join(entry, ["conv", "idx"], "left")
    written = _each_piece(told.select("conv", "conv_id", "idx", "before", "payload", "ends", "last", "entry"),
                          "conv string, conv_id bigint, idx bigint, audit string, lines binary", outcome)
    whole = written.repartition("conv").sortWithinPartitions("conv", "idx").mapInArrow(_joined, "conv string, conv_id bigint, audit string, repaired_sha256 string")
    before = known.select("conv", (F.col("idx") + 1).alias("idx"), F.col("closes").alias("closed"), F.col("high").alias("reached"))
    border = known.join(before, ["conv", "idx"], "left").withColumns({
        "apart": F.when(F.col("closed").isNotNull() & ~F.concat("closed", "opens").isin(*LEGAL), 1).otherwise(0), "again": F.when(F.col("reached") == F.col("low"), 1).otherwise(0)})
    sums = border.groupBy("conv").agg(
        F.coalesce(F.max("high") - F.min("low") + 1 - F.sum(F.col("turns") - F.col("again")), F.lit(0)).alias("gaps"),
        *(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")), F.sum(F.col("illegal") + F.col("apart")).alias("illegal"))
    cost = to_end.where("idx = 0").select("conv", F.get("ends", F.lit(0)).alias("cost"))
    return whole.join(sums, "conv").join(cost, "conv").selectExpr(*(f.split(" ")[0] for f in REPAIRED.split(", ")))


def _marked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first place of every different row of each piece."""
    for batch in batches:
        for conv, idx, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            first: dict[bytes, int] = {}
            for place, mark in enumerate(_marks(_open(payload))):
                first.setdefault(mark, place)
            yield _table("conv string, idx bigint, place int, mark binary", [(conv, idx, p, m) for m, p in first.items()])


def _joined(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Audits joined and lines digested over each conversation's pieces in order; one piece's lines are held at a time."""
    schema = "conv string, conv_id bigint, audit string, repaired_sha256 string"
    now, audits, digest, some = None, [], hashlib.sha256(), False
    for batch in batches:
        for conv, conv_id, _, audit, lines in zip(*(c if i == 4 else c.to_pylist() for i, c in enumerate(batch.columns)), strict=True):
            if now is not None and conv != now[0]:
                yield _table(schema, [(*now, "".join(audits), digest.hexdigest())])
                audits, digest, some = [], hashlib.sha256(), False
            now, lines = (conv, conv_id), lines.as_py()
            audits.append(audit)
            if lines:
                digest.update(b"\n" + lines if some else lines)
                some = True
    if now is not None:
        yield _table(schema, [(*now, "".join(audits), digest.hexdigest())])


def repair(rows: DataFrame, piece_rows: int = PIECE_ROWS, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation in ``rows``.

    ``rows`` has conv_id, turn, role, text (neither NULL) and dropped; a dropped row only makes its conversation known, and one without other
    rows has zeros, an empty audit and the digest of nothing. Rows of one turn stand by role, text and then a hash of it, repeated rows next to
    each other; NULL turns come first and rows of a NULL conv_id are one conversation. No row comes out of an empty table.
    """
    mixed = settle(_first_pass(in_order(rows), piece_rows, piece_bytes))
    names = [f.split(" ")[0] for f in REPAIRED.split(", ")]
    done = mixed.where("payload IS NULL").select(names)
    pieces = mixed.where("payload IS NOT NULL").select("conv_id", "part", "seq", "payload")
    filled = pieces.mapInArrow(_with_size, "conv_id bigint, part int, seq int, payload binary, n bigint")
    numbered = settle(_numbered(filled.where("n > 0")))
    empty = filled.groupBy("conv_id").agg(F.sum("n").alias("n"), F.first("payload").alias("payload")).where("n = 0").select("conv_id", "payload")
    alone = numbered.where("of = 1").select("conv_id", "payload").unionByName(empty)
    found = done.unionByName(alone.mapInArrow(_alone, REPAIRED))
    most = numbered.agg(F.max("of")).first()[0] or 0
    return found.unionByName(_in_pieces(numbered.where("of > 1"), most)) if most > 1 else found


def _with_size(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = pa.array([_open(p).num_rows for p in batch.column(3)], pa.int64())
        yield pa.RecordBatch.from_arrays([*batch.columns, sizes], names=["conv_id", "part", "seq", "payload", "n"])


def _alone(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for conv_id, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            yield _table(REPAIRED, repaired([conv_id], [_open(payload)]))


def damage_and_repair(conversations: DataFrame, piece_rows: int = PIECE_ROWS, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """``repair`` of ``damaged`` conversations."""
    return repair(damaged(conversations), piece_rows, piece_bytes)


def sql() -> str:
    """The same in SQL: the checksum bit by bit, the cheapest edits row by row from the end, costs before audits."""
    least = lambda *options: f"list_sort([x FOR x IN [{', '.join(options)}] IF x IS NOT NULL])[1]"
    arc = lambda cost, letter, line, to: f"{{'c': {to}.c + {cost}, 'a': '{letter}' || {to}.a, 'r': {line} || {to}.r}}"
    own = {}
    for s, to, initials in ((0, 2, {"s": 1, "u": 2}), (1, 2, {"u": 2}), (2, 3, {"a": 3}), (3, 2, {"u": 2})):
        role = "user" if to == 2 else "assistant"
        options = [arc(DELETE, "D", "''", f"s{s}"), f"CASE WHEN NOT gone THEN {arc(f'{REROLE} + more', 'R', f"chr(10) || '{role}:' || text", f's{to}')} END"]
        options += [f"CASE WHEN NOT gone AND left(role, 1) = '{i}' THEN {arc('more', 'K', "chr(10) || role || ':' || text", f's{k}')} END" for i, k in initials.items()]
        own[s] = least(*options)
    insert = lambda to: arc(INSERT, "I", f"chr(10) || '{'user' if to == 2 else 'assistant'}:'", f"w{to}")
    far = "{'c': 1000000000000, 'a': '', 'r': ''}"
    nothing = "{'c': 0, 'a': '', 'r': ''}"
    with_inserts = f"""{least('w2', insert(3))} AS s2, {least('w3', insert(2))} AS s3,
  {least('w0', insert(2), "{'c': w3.c + 10, 'a': 'II' || w3.a, 'r': chr(10) || 'user:' || chr(10) || 'assistant:' || w3.r}")} AS s0,
  {least('w1', insert(2), "{'c': w3.c + 10, 'a': 'II' || w3.a, 'r': chr(10) || 'user:' || chr(10) || 'assistant:' || w3.r}")} AS s1"""
    bare = r"regexp_replace(text, '[\x20\x09-\x0D]+$', '')"
    return f"""WITH RECURSIVE given AS (SELECT row_number() OVER () AS rn, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS place FROM conversations),
crc(rn, place, i, c) AS (SELECT rn, place, 0, 4294967295::UBIGINT FROM given UNION ALL
  SELECT rn, place, i + 1, xor(x >> 1, (x & 1) * 3988292384::UBIGINT) FROM (
    SELECT rn, place, i, xor(c, CASE WHEN i % 8 = 0 THEN ascii(substr(place, i // 8 + 1, 1)) ELSE 0 END::UBIGINT) AS x FROM crc WHERE i < 8 * length(place))),
kinds AS (SELECT rn, xor(c, 4294967295::UBIGINT) % 20 AS kind FROM crc WHERE i = 8 * length(place)),
after AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
  CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
  FROM given JOIN kinds USING (rn) WHERE kind <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM after),
faults AS (SELECT *, {bare} = '' AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS seen, right({bare}, 1) NOT IN ('.', '!', '?') AS cut,
  lead(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS next FROM placed),
told AS (SELECT *, blank OR seen AS gone, CASE WHEN NOT blank AND NOT seen AND cut THEN {TRUNCATED} ELSE 0 END AS more FROM faults),
counted AS (SELECT conv_id, count(*) AS n, count(*) FILTER (blank) AS blank, count(*) FILTER (seen AND NOT blank) AS duplicate, count(*) FILTER (more > 0) AS truncated,
  count(*) FILTER (next IS NOT NULL AND left(role, 1) || next NOT IN ('su', 'ua', 'au')) AS illegal,
  coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps FROM told GROUP BY conv_id),
ways AS (SELECT conv_id, n AS i, {with_inserts} FROM (SELECT conv_id, n, {nothing} AS w0, {far} AS w1, {far} AS w2, {nothing} AS w3 FROM counted)
UNION ALL SELECT conv_id, i, {with_inserts} FROM (SELECT w.conv_id, w.i - 1 AS i, {own[0]} AS w0, {own[1]} AS w1, {own[2]} AS w2, {own[3]} AS w3
  FROM ways w JOIN told t ON t.conv_id IS NOT DISTINCT FROM w.conv_id AND t.i = w.i))
SELECT g.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, coalesce(s0.c, 0)::BIGINT AS cost, coalesce(s0.a, '') AS audit, sha256(coalesce(substr(s0.r, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) g LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM g.conv_id
LEFT JOIN ways w ON w.conv_id IS NOT DISTINCT FROM g.conv_id AND w.i = 0"""
