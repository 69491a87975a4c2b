"""Structure repair against a plain search over edits, in one piece and in many, and against SQL."""

import hashlib
import itertools
import random
import re
import sys
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
import pytest
from oracle import compare, connect
from plumbline.llm import structure
from plumbline.llm.queries import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"
sys.setrecursionlimit(20_000)
STEP = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}


def faults(rows):
    seen, found = set(), []
    for role, text in rows:
        bare = text.rstrip(" \t\n\x0b\x0c\r")
        found.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return found


def cheapest(rows):
    """(cost, audit, lines) by trying every edit of every row."""
    kinds = faults(rows)

    @cache
    def best(i, state, inserted=0):
        options = [(0, "", ())] if i == len(rows) and state in (0, 3) else []
        if inserted < 3:
            to = 3 if state == 2 else 2
            c, a, lines = best(i, to, inserted + 1)
            options.append((c + 5, "I" + a, (("user:" if to == 2 else "assistant:"), *lines)))
        if i < len(rows):
            role, text = rows[i]
            c, a, lines = best(i + 1, state)
            options.append((c + 2, "D" + a, lines))
            if kinds[i] not in ("blank", "duplicate"):
                more = 5 if kinds[i] == "truncated" else 0
                if role[:1] in STEP[state]:
                    c, a, lines = best(i + 1, STEP[state][role[:1]])
                    options.append((c + more, "K" + a, (f"{role}:{text}", *lines)))
                for other, to in (("user", STEP[state].get("u")), ("assistant", STEP[state].get("a"))):
                    if to:
                        c, a, lines = best(i + 1, to)
                        options.append((c + more + 1, "R" + a, (f"{other}:{text}", *lines)))
        return min(options, default=(10 ** 9, "", ()))

    return best(0, 0)


def by_hand(rows):
    conversations = {}
    for conv, turn, role, text in rows:
        place = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind, role, text = zlib.crc32(place.encode()) % 20, " " if role is None else role, " " if text is None else text
        kept = conversations.setdefault(conv, [])
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            kept += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    found = []
    for conv, kept in conversations.items():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1][:64], r[2][:64]))
        pairs = [(r, t) for _, r, t in kept]
        turns = {t for t, _, _ in kept if t is not None}
        cost, audit, lines = cheapest(pairs)
        kinds = faults(pairs)
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(pairs))
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        found.append((conv, gaps, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(found, key=str)


def table(rows):
    bare = [t.rstrip(structure.BLANKS) for _, t in rows]
    return pa.Table.from_pylist([{"turn": i, "role": r, "text": t, "blank": not b, "truncated": bool(b) and b[-1] not in ".!?"}
                                 for i, ((r, t), b) in enumerate(zip(rows, bare, strict=True))], schema=structure.ROW)


def random_rows(rng, n):
    return [(rng.choice(["system", "user", "assistant", "assistant", "user", "tool", ""]), rng.choice(["a.", "b?", "c", "", " ", "d!\n", "e. f", f"{rng.random()}."])) for _ in range(n)]


def test_repairs_like_a_plain_search():
    rng = random.Random(1)
    many = [random_rows(rng, rng.randrange(0, 12)) for _ in range(400)]
    for (cost, audit, digest), rows in zip((r[6:] for r in structure.repaired(list(range(len(many))), [table(r) for r in many])), many, strict=True):
        expected = cheapest(rows)
        assert (cost, audit) == expected[:2], rows
        assert digest == hashlib.sha256("\n".join(expected[2]).encode()).hexdigest()


def test_ranks_order_whole_audits():
    rng = random.Random(5)
    segments = structure.Segments([table(random_rows(rng, 30))])
    paths = segments.rows.solve(np.array([structure._ends_after_all()]), np.array([True]))

    def audit(node):
        letters = ""
        while paths.letter[node] >= 0:
            letters += "DIKR"[paths.letter[node]]
            node = paths.pointers[0][node]
        return letters

    audits = [audit(n) for n in range(len(paths.letter))]
    assert all(len(a) == s for a, s in zip(audits, paths.steps.tolist(), strict=True))
    assert structure.LETTERS[paths.letter[paths.path(np.array([0]))[2]]].tobytes().decode() == audits[0]


def sample():
    rng = random.Random(9)
    rows = [(c, t, r, x) for c in range(60) for t, (r, x) in enumerate(random_rows(rng, rng.randrange(1, 9)))]
    rows += [(777, t, r, x) for t, (r, x) in enumerate(random_rows(rng, 300))]  # a long one
    rows += [(888, t // 3, "user" if t % 2 else "assistant", f"text {t}.") for t in range(90)]
    rows += [(None, None, None, None), (None, None, "user", "x."), (901, None, "user", "q."), (901, None, "assistant", None), (901, 4, None, "z."), (901, 2 ** 40, "user", "long " * 3000)]
    rows += [(902, 1, "user", "same."), (902, 1, "user", "same."), (902, 1, "user", "same.")]
    dropped = next(c for c in range(10_000, 20_000) if zlib.crc32(f"{c}:1".encode()) % 20 == 0)
    return [*rows, (dropped, 1, "user", "gone.")], dropped


@pytest.mark.parametrize("sizes", [{}, {"piece_rows": 7}, {"piece_rows": 1}, {"piece_rows": 50, "piece_bytes": 400}])
def test_damage_and_repair_like_a_plain_search(spark, sizes):
    rows, dropped = sample()
    random.Random(3).shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS dropped", "'x' AS blank", "2 AS idx", "3 AS audit").repartition(4)
    found = sorted((tuple(r) for r in structure.damage_and_repair(df, **sizes).collect()), key=str)
    assert found == by_hand(rows)
    assert (dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) in found


def test_empty_table(spark):
    assert structure.damage_and_repair(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_query_like_sql(spark):
    equal, message = compare(QUERIES["op12_structure_repair"](spark, SMALL), connect(SMALL), ORACLES["op12_structure_repair"])
    assert equal, message
