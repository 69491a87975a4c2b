"""Chat formatting and TIFF columns: round trips, edge cases, brute force."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from plumbline.llm import chat, tiff

TURNS = "conv_id long, turn long, role string, text string"


def test_turns_survive_any_mark(spark):
    parts = ["\\", "###", "### ", "</turn>", ":", ": ", "\n", "a", "é", "🎉", "<", "#", "\\### Assistant: </turn> ok"]
    random.seed(4)
    rows = [(c, t, random.choice(["user", "assistant", "sys: tem", "a\\b", "###"]), "".join(random.choices(parts, k=random.randrange(9))))
            for c in range(20) for t in range(random.randrange(1, 9))]
    got = {r.conv_id: r for r in chat.conversation_digests(chat.format_conversations(spark.createDataFrame(rows, TURNS))).collect()}
    for conv in {r[0] for r in rows}:
        own = [(role, text) for c, _, role, text in rows if c == conv]
        learned = "".join(text for role, text in own if role == "assistant")
        said = "".join(f"{role}\n{text}\n" for role, text in own)
        assert got[conv].n_turns == len(own)
        assert got[conv].turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())


def test_chat_edge_rows(spark):
    rows = [(1, 2, None, "b"), (1, None, "assistant", None), (1, 1, "assistant", "x"), (1, 1, "assistant", "x"), (None, 0, "user", "no id"), (2, 0, "user", "")]
    df = spark.createDataFrame(rows, TURNS).selectExpr("*", "1 AS formatted", "2 AS segment")
    got = {r.conv_id: r for r in chat.conversation_digests(chat.format_conversations(df)).collect()}
    assert {k: r.n_turns for k, r in got.items()} == {1: 4, None: 1, 2: 1}
    assert got[1].turns_sha256 == hashlib.sha256(b"assistant\n\nassistant\nx\nassistant\nx\n\nb\n").hexdigest()
    assert chat.conversation_digests(chat.format_conversations(spark.createDataFrame([], TURNS))).count() == 0


def test_long_conversation_comes_in_segments(spark, monkeypatch):
    monkeypatch.setattr(chat, "SEGMENT_BYTES", 500)
    rows = [(7, t, "assistant" if t % 2 else "user", f"turn {t} " * 9) for t in range(200)]
    segments = chat.format_conversations(spark.createDataFrame(rows, TURNS))
    assert segments.count() > 5
    row = chat.conversation_digests(segments).first()
    assert row.n_turns == 200
    assert row.loss_sha256 == hashlib.sha256("".join(r[3] for r in rows if r[2] == "assistant").encode()).hexdigest()


@pytest.mark.parametrize("n", [0, 1, 3, 127, 128, 129, 600, 5000, 40000])
def test_codecs_round_trip(n):
    random.seed(n)
    for data in (random.randbytes(n), b"a" * n, (b"the quick brown fox " * 3000)[:n], bytes(random.choice(b"ab") for _ in range(n))):
        assert tiff.unpack_bits(tiff.pack_bits(data), n) == data
        assert tiff.lzw_decode(tiff.lzw_encode(data), n) == data


def test_every_scheme_reads_back():
    random.seed(1)
    payload = random.randbytes(576 * 70)
    for scheme in [*tiff.SCHEMES, (tiff.STORED, 1, False), (tiff.LZW, 2, True)]:
        pages = list(tiff.read_pages(tiff.encode(payload, 576, 16, (scheme,))))
        assert [p.height for p in pages] == [16, 16, 16, 16, 6]
        assert b"".join(p.pixels for p in pages) == payload


def test_big_endian_sixteen_bit_page():
    values = np.arange(12, dtype=">u2").reshape(3, 4)
    coded = np.diff(values.astype("u2"), axis=1, prepend=np.uint16(0)).astype(">u2").tobytes()
    import struct

    fields = [(256, 3, 4), (257, 3, 3), (258, 3, 16), (259, 3, 1), (262, 3, 1), (273, 4, 8), (277, 3, 1), (278, 3, 3), (279, 4, len(coded)), (317, 3, 2)]
    entries = b"".join(struct.pack(">HHI", t, k, 1) + (struct.pack(">H", v) + b"\0\0" if k == 3 else struct.pack(">I", v)) for t, k, v in fields)
    cell = b"MM\0*" + struct.pack(">I", 8 + len(coded)) + coded + struct.pack(">H", len(fields)) + entries + b"\0\0\0\0"
    (page,) = tiff.read_pages(cell)
    assert np.frombuffer(page.pixels, ">u2").tolist() == list(range(12))


def test_pages_of_cells(spark):
    good = tiff.encode(bytes(range(256)) * 9 * 20, 576)
    rows = [(1, good), (1, good), (2, None), (3, b""), (4, b"II*\0\xff\xff\xff\x7f"), (5, good[:200]), (None, good)]
    df = spark.createDataFrame(rows, "page_id long, media binary").selectExpr("*", "'x' AS pixels", "0 AS page")
    found = tiff.decode_pages(df.drop("pixels", "page"), "page_id", "media").collect()
    assert sum(r.page_id == 1 for r in found) == 2 * len(list(tiff.read_pages(good)))
    assert all(r.error for r in found if r.page_id in (2, 3, 4, 5))
    assert sum(r.page_id is None for r in found) == len(list(tiff.read_pages(good)))


def test_text_media_of_odd_texts(spark):
    texts = ["", None, "a", "é" * 288, "x" * 576, "y" * 577, "long text " * 20000, "a"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 AS media")
    got = {r.doc_id: r for r in tiff.text_media(df).collect()}
    for i, text in enumerate(texts):
        raw = (text or "").encode()
        payload = raw + b"\xff" * (576 if not raw else -len(raw) % 576)
        assert (got[i].n_bytes, got[i].payload_bytes) == (len(raw), len(payload))
        assert (got[i].payload_sha256, got[i].tail_crc32) == (hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
    assert got[2].media_sha256 == got[7].media_sha256 and got[2].feature == got[7].feature
    assert tiff.text_media(df.limit(0)).count() == 0


def test_damaged_cells_give_error_pages(spark):
    good = tiff.encode(b"\1" * 576 * 3, 576)
    zero_counts = good[:4] + good[4:8]
    at = int.from_bytes(good[4:8], "little")
    entry = at + 2
    emptied = bytearray(good)
    for k in range(int.from_bytes(good[at:at + 2], "little")):
        emptied[entry + 12 * k + 4:entry + 12 * k + 8] = bytes(4)  # no values in any field
    cells = [bytes(emptied), zero_counts, b"", None, good[: len(good) // 2], b"II*\0\xff\xff\xff\xff"]
    rows = tiff.decode_pages(spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "k int, media binary"), "k", "media").collect()
    assert {r.k for r in rows if r.error} == set(range(len(cells)))
