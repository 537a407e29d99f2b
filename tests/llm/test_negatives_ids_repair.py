"""Hard negatives, packed token ids and repaired conversations."""

from __future__ import annotations

import hashlib
import heapq
import random
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from assayframe.llm import packed_ids, strassen_negatives, turn_repair

FILE = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("shape", [(1, 1, 1), (5, 3, 7), (33, 17, 40), (64, 64, 64), (100, 65, 37), (3, 0, 4), (0, 5, 2)])
def test_strassen_is_the_product(shape):
    rng = np.random.default_rng(sum(shape))
    a, b = rng.integers(-1000, 1000, shape[:2]), rng.integers(-1000, 1000, shape[1:])
    for leaf in (1, 4, 16):
        assert (strassen_negatives.strassen(a, b, leaf) == a @ b).all()


def test_strassen_wraps_around_like_int64():
    a = np.full((9, 9), 2**61, np.int64)
    assert (strassen_negatives.strassen(a, a, 2) == a @ a).all()


def test_heaps_merge_to_the_best_of_all():
    rng = random.Random(3)
    entries = [(rng.randint(0, 4), rng.randint(0, 6), i) for i in range(300)]
    whole, parts = strassen_negatives.Heaps(5, 4), [strassen_negatives.Heaps(5, 4) for _ in range(3)]
    for slot, score, i in entries:
        parts[i % 3].offer(*(np.array([x], np.int64) for x in (slot, score, i)))
    for part in parts:
        whole.merge(part)
    for slot in range(5):
        best = sorted((-score, i) for s, score, i in entries if s == slot)[:4]
        mine = whole.slot == slot
        assert list(zip((-whole.score[mine]).tolist(), whole.id[mine].tolist(), strict=True)) == best


VECTOR_SPEC = "vec_id long, embedding array<float>, label int, uid long, score string"


def vector_rows():
    rng = np.random.default_rng(8)
    base = rng.normal(size=(4, 9))
    rows = []
    for i in range(700):
        one = base[i % 4] + 0.6 * rng.normal(size=9)
        rows.append((i, [float(x) for x in one / np.linalg.norm(one)], 1 if i % 3 == 0 else int(rng.integers(0, 10)), 5, "s"))
    rows += [(1000 + i, rows[100][1], 1 + i % 2, 5, "s") for i in range(60)]  # ties with an anchor
    rows += [(2000, None, 1, 5, "s"), (2100, [0.1, None], 1, 5, "s"), (2200, [float("nan")] * 9, 1, 5, "s"), (2300, [float("inf")] * 9, 1, 5, "s")]
    rows += [(None, rows[0][1], 1, 5, "s"), (2400, rows[0][1], None, 5, "s"), (200, rows[1][1], 2, 5, "s"), (300, rows[300][1], rows[300][2], 5, "s")]
    return rows


@pytest.mark.parametrize(("tile", "block"), [(512, 512), (37, 3)])
def test_hard_negatives_equal_scoring_every_pair(spark, monkeypatch, tile, block):
    monkeypatch.setattr(strassen_negatives, "TILE_ROWS", tile)
    monkeypatch.setattr(strassen_negatives, "BLOCK_ROWS", block)
    monkeypatch.setattr(strassen_negatives, "HELD_BLOCKS", 2)
    table = spark.createDataFrame(vector_rows(), VECTOR_SPEC).repartition(3)
    found = strassen_negatives.hard_negatives(table)
    columns = found.columns
    got = sorted(map(tuple, found.collect()))
    db = duckdb.connect()
    db.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[], label INTEGER)")
    db.executemany("INSERT INTO embeddings VALUES (?, ?, ?)", [list(row[:3]) for row in vector_rows()])
    want = db.execute(f"SELECT {', '.join(columns)} FROM ({strassen_negatives.negatives_sql()})").fetchall()
    assert got == sorted(want)
    assert len(got) > 50


def test_hard_negatives_of_odd_tables(spark):
    spec = "vec_id long, embedding array<double>, label int"
    assert strassen_negatives.hard_negatives(spark.createDataFrame([], spec)).count() == 0
    # Shorter vectors count as followed by zeros, an empty one scores 0, and 2^62 * 256 wraps around to 0.
    rows = [(100, [1.0, 1.0], 1), (1, [1.0], 1), (2, [1.0, -0.5], 2), (3, [], 1), (4, [], 3), (5, [0.9, 0.0, 7.0], 2), (6, [1e300], 4)]
    found = strassen_negatives.hard_negatives(spark.createDataFrame(rows, spec)).collect()
    assert sorted(tuple(row) for row in found) == [(100, 1, 1, 5, 65536, 58880), (100, 3, 1, 4, 0, 0), (100, 3, 2, 6, 0, 0)]


@pytest.mark.parametrize("bits", [1, 7, 16, 17, 31, 32])
def test_pack_and_unpack_round_trip(bits):
    rng = np.random.default_rng(bits)
    for count in (0, 1, 63, 64, 65, 1000):
        ids = rng.integers(0, 1 << bits, count, dtype=np.uint64).astype(np.uint32)
        payload = packed_ids.pack(ids, bits)
        assert len(payload) == -(-count // 64) * 8 * bits
        assert (packed_ids.unpack(payload, bits)[:count] == ids).all()


def test_least_width():
    assert [packed_ids.bits_for(n) for n in (0, 1, 2, 255, 256, 49407)] == [1, 1, 2, 8, 9, 16]


def test_shard_reads_any_range_and_document():
    rng = np.random.default_rng(2)
    parts = [rng.integers(0, 5000, n).astype(np.uint32) for n in (0, 1, 300, 64, 0, 777)]
    keys = [5, None, 7, 7, -3, 2**62]
    shard = packed_ids.Shard(packed_ids.shard_image(keys, parts, 13, block_ids=128))
    ids = np.concatenate(parts)
    assert (shard.ids() == ids).all()
    for start, stop in [(0, 1), (127, 129), (128, 256), (500, 5000), (1142, 1142), (900, 100)]:
        assert (shard.ids(start, stop) == ids[start : max(start, stop)]).all()
    assert [shard.doc_id(i) for i in range(6)] == keys
    assert all((shard.document(i) == part).all() for i, part in enumerate(parts))
    with pytest.raises(ValueError, match="not a shard"):
        packed_ids.Shard(b"x" * 64)


def expected_ids(rows):
    """(doc_id, ids with the end) in file order, by the library alone."""
    tokenizer = Tokenizer.from_file(FILE)
    found = [(row[0], [*tokenizer.encode(row[1] or "", add_special_tokens=False).ids, 1]) for row in rows]
    return sorted(found, key=lambda one: (one[0] is not None, one[0] or 0))


def test_packed_ids_equal_the_library(spark, docs, doc_rows, monkeypatch, tmp_path):
    special = [(2_000_000, "A<|endoftext|>b <|startoftext|> c\u0085d e İSTANBUL ΣΑΣ é don't 42", "en", "s", 1, "k", "s", "n", "x", "r")]
    table = docs.unionByName(spark.createDataFrame(special, docs.schema))
    want = expected_ids(doc_rows + special)
    monkeypatch.setattr(packed_ids, "PART_BYTES", 40_000)
    path = str(tmp_path / "ids")
    packed_ids.write_ids(table, FILE, path, shard_ids=3000)
    got = packed_ids.read_documents(spark, path).collect()
    starts = np.cumsum([0, *[len(ids) for _, ids in want]]).tolist()
    expected = [(key, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for (key, ids), start in zip(want, starts, strict=False)]
    order = lambda row: (row[1], repr(row))
    assert sorted(map(tuple, got), key=order) == sorted(expected, key=order)
    assert spark.read.parquet(f"{path}/shards").count() > 10
    every = np.concatenate([np.array(ids, np.uint32) for _, ids in want])
    for start, count in [(0, 5), (2500, 4000), (len(every) - 3, 10), (len(every), 4)]:
        assert (packed_ids.read_range(spark, path, start, count) == every[start : start + count]).all()
    files = packed_ids.export(spark, path, str(tmp_path / "plain")).collect()
    for row in files:
        shard = packed_ids.Shard(np.memmap(row["file"], np.uint8, "r"))
        assert (shard.ids() == every[row["first"] : row["first"] + row["n_ids"]]).all()
    assert sum(row["n_ids"] for row in files) == len(every)


def test_letters_are_merged_once(monkeypatch):
    """Words that differ in case or in punctuation after them share their letters' merges; ids stay those of the library."""
    monkeypatch.setattr(packed_ids, "GATHER_WORDS", 3)
    engine = packed_ids.WordIds(FILE, cache_words=8)
    asked, merge = [], engine.merge
    engine.merge = lambda letters: asked.append(letters) or merge(letters)
    texts = ["Stone stone, STONE! stone", None, "", "  \n", "Été été. ÉTÉ x1 STONE?!", "\u0130stone a,b <unk>", "one two three four five six seven"]
    found = [part.tolist() for part in engine.encode(pa.array(texts, pa.string()))]
    library = packed_ids.tokenizer(FILE)
    assert found == [[*library.encode(text or "", add_special_tokens=False).ids, 1] for text in texts]
    assert asked.count("stone") == 1 and len(engine.merged) <= 4
    assert list(engine.encode(pa.array([], pa.string()))) == []


def test_packed_ids_of_an_empty_table(spark, no_docs):
    assert packed_ids.round_trip(no_docs, FILE).count() == 0


STATE = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
NAMES = {"u": "user", "a": "assistant"}


def cheapest(turns):
    """Dijkstra over (turn, state) by (cost, audit, lines): the first path to reach the end is the answer."""
    heap, done = [(0, "", 0, 0, ())], set()
    while heap:
        cost, audit, at, state, lines = heapq.heappop(heap)
        if (at, state) in done:
            continue
        done.add((at, state))
        if at == len(turns) and state in (0, 3):
            return cost, audit, lines
        for letter, to in STATE[state].items():
            if letter in NAMES:
                heapq.heappush(heap, (cost + 2, audit + "I", at, to, (*lines, NAMES[letter] + ":")))
        if at < len(turns):
            role, text, fault = turns[at]
            heapq.heappush(heap, (cost + 3, audit + "D", at + 1, state, lines))
            if fault not in ("blank", "duplicate"):
                extra = int(fault == "truncated")
                for letter, to in STATE[state].items():
                    if role[:1] == letter:
                        heapq.heappush(heap, (cost + extra, audit + "K", at + 1, to, (*lines, f"{role}:{text}")))
                    if letter in NAMES:
                        heapq.heappush(heap, (cost + 2 + extra, audit + "R", at + 1, to, (*lines, f"{NAMES[letter]}:{text}")))
    raise AssertionError


def brute_repair(rows):
    """The whole contract in plain Python."""
    blank = " \t\n\v\f\r"
    kept = {row[0]: [] for row in rows}
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if fate == 0:
            continue
        text = "" if fate == 1 else "".join(c for c in text if c not in ".!?") if fate == 2 else text
        kept[conv] += [(turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    out = []
    for conv, some in kept.items():
        some.sort(key=lambda row: (row[0] is not None, row[0] or 0, row[1].encode(), row[2].encode()))
        seen, turns = set(), []
        for _, role, text in some:
            bare = text.rstrip(blank)
            fault = "blank" if not text.strip(blank) else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
            seen.add((role, text))
            turns.append((role, text, fault))
        numbers = [row[0] for row in some if row[0] is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:], strict=False))
        cost, audit, lines = cheapest(turns)
        counts = [sum(t[2] == name for t in turns) for name in ("blank", "duplicate", "truncated")]
        out.append((conv, gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return out


def test_search_equals_the_cheapest_path():
    rng = random.Random(9)
    faults = [None, None, None, "truncated", "blank"]
    for _ in range(1500):
        turns = [(rng.choice(["system", "user", "assistant", "user", "assistant", "tool"]), f"t{i}", rng.choice(faults)) for i in range(rng.randint(0, 12))]
        codes = bytes(turn_repair.code_of(role[:1].encode(), {None: 0, "truncated": 3, "blank": 1}[fault]) for role, _, fault in turns)
        cost, audit, lines = cheapest(turns)
        assert turn_repair.search(codes) == (cost, audit)
        roles, texts = [t[0].encode() for t in turns], [t[1].encode() for t in turns]
        assert [line.decode() for line in turn_repair.repaired_lines(audit, 0, roles, texts)] == list(lines)
        # Cut into blocks, searched between states and joined by ranks.
        cuts = sorted(rng.sample(range(len(codes) + 1), min(2, len(codes) + 1)))
        parts = [codes[a:b] for a, b in zip([0, *cuts], [*cuts, len(codes)], strict=True)]
        total, ways = turn_repair.join_blocks([turn_repair.block_table(part, i == len(parts) - 1) for i, part in enumerate(parts)])
        assert (total, "".join(turn_repair.search(part, *way)[1] for part, way in zip(parts, ways, strict=True))) == (cost, audit)


def test_search_of_a_long_conversation_is_linear():
    rng = random.Random(1)
    codes = bytes(rng.choice([1, 2, 3, 0]) | rng.choice([0, 0, 8, 16]) for _ in range(20_000))
    cost, audit = turn_repair.search(codes)
    assert cost > 0
    assert sum(letter != "I" for letter in audit) == len(codes)


TURN_SPEC = "conv_id long, turn long, role string, text string, part int, fault string"


def turn_rows():
    rng = random.Random(21)
    roles = ["system", "user", "assistant", "user", "assistant", "user", "assistant", "tool", "", None]
    texts = ["Hello there.", "Yes!", "cut", "", " \t\n", None, "Same answer.", "No?\n ", "odd ", "a.b.c", "end.\u0085", "."]
    rows = []
    for conv in [*range(120), None]:
        for turn in range(rng.randint(1, 9)):
            number = rng.choice([turn, turn, turn, turn + 3, None])
            rows.append((conv, number, rng.choice(roles), rng.choice(texts), 7, "x"))
    rows += [(500, i, ("user", "assistant")[i % 2], f"turn {i % 40}.", 7, "x") for i in range(300)]
    rows += [(501, 2**62, "user", "a.", 7, "x"), (501, -(2**61), "assistant", "b.", 7, "x"), (502, 1, "user", "long " * 60_000 + ".", 7, "x")]
    rows += [(503, 3, "user", "twice.", 7, "x")] * 4
    rows += [(c, 0, "user", "only.", 7, "x") for c in range(600, 1000)]
    return rows


@pytest.mark.parametrize(("parts", "block_turns"), [(1, 2048), (5, 7), (8, 1)])
def test_repair_equals_brute_force(spark, parts, block_turns):
    rows = turn_rows()
    old = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = turn_repair.repair_damaged(spark.createDataFrame(rows, TURN_SPEC).repartition(4), block_turns=block_turns).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old[1])
    assert sorted(map(tuple, got), key=repr) == sorted(brute_repair([row[:4] for row in rows]), key=repr)
    assert any(row["cost"] == 0 and row["audit"] == "" for row in got)  # nothing left after damage


def test_repair_of_an_empty_table(spark):
    assert turn_repair.repair_damaged(spark.createDataFrame([], TURN_SPEC)).count() == 0


def test_repair_sql_equals_brute_force():
    rows = [row[:4] for row in turn_rows() if row[0] != 501]
    db = duckdb.connect()
    db.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    db.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", [list(row) for row in rows])
    assert sorted(db.execute(turn_repair.repair_sql()).fetchall(), key=repr) == sorted(brute_repair(rows), key=repr)
