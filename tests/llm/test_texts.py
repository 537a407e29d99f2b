"""Operators on documents, against brute force and on every odd case."""

from __future__ import annotations

import hashlib
import math
import random
import struct
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from assayframe.llm import byte_cnn, context_mixing, fertility, lsh_forest, pair_bpe, source_mix, weak_toxicity
from assayframe.llm.batches import crc_remainder

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def multiset(rows):
    return Counter(tuple(row) for row in rows)


# -- BPE -------------------------------------------------------------------------------------


def test_bpe_equals_the_library(docs, doc_rows):
    library = Tokenizer.from_file(VOCABULARY)
    expected = []
    for row in doc_rows:
        ids = library.encode(row[1] or "", add_special_tokens=False).ids
        packed = struct.pack(f"<{len(ids)}I", *ids)
        shown = library.decode(ids, skip_special_tokens=False)
        expected.append((row[0], len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(shown.encode()).hexdigest()))
    assert multiset(pair_bpe.encode_texts(docs, VOCABULARY).collect()) == Counter(expected)


def test_bpe_of_odd_texts_and_a_full_cache():
    library, rng = Tokenizer.from_file(VOCABULARY), random.Random(1)
    engine = pair_bpe.Encoder(VOCABULARY, cache_words=300)
    letters = "abÀéß'’ \n\t漢😀.,!1２Σσςİ\u0301\u00a0\x1c\x85<|>"
    texts = ["<|endoftext|>x<|startoftext|> <|EndOfText|>", "aaaaaaa aaaaaaaaaaaaaa !!!!!!", "ΣΑΣ it's we'll 12½ ﬁ"]
    texts += ["".join(rng.choice(letters) for _ in range(50)) for _ in range(150)]
    for text in texts:
        ((ids, shown),) = engine.encode([text.encode()])
        wanted = library.encode(text, add_special_tokens=False).ids
        assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == wanted
        assert shown.decode() == library.decode(wanted, skip_special_tokens=False) == pair_bpe.decode_ids(ids, VOCABULARY)


def test_bpe_keeps_ids(docs, no_docs):
    rows = pair_bpe.encode_texts(docs, VOCABULARY, keep_ids=True).collect()
    assert all(len(row["ids"]) == 4 * row["n_tokens"] and hashlib.sha256(row["ids"]).hexdigest() == row["ids_sha256"] for row in rows)
    assert pair_bpe.encode_texts(no_docs, VOCABULARY).count() == 0


# -- near-duplicates -------------------------------------------------------------------------


def brute_components(rows, percent):
    def shingles(text):
        found = (text or "").encode().lower().split()
        return frozenset(zip(*[found[i:] for i in range(5)], strict=False)) if len(found) >= 5 else frozenset([tuple(found)] if found else [])

    sets = [(row[0], shingles(row[1])) for row in rows if row[0] is not None]
    top = {key: key for key, _ in sets}

    def root(key):
        while top[key] != key:
            key = top[key]
        return key

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and 100 * len(x & y) >= percent * len(x | y):
                a_root, b_root = root(a), root(b)
                top[max(a_root, b_root)] = min(a_root, b_root)
    return {key: (len(s), root(key)) for key, s in sets}


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates(docs, doc_rows, percent):
    rows = lsh_forest.near_duplicates(docs, percent).collect()
    assert len(rows) == len(doc_rows)
    expected = brute_components(doc_rows, percent)
    for row in rows:
        if row["doc_id"] is not None:
            assert (row["n_shingles"], row["component_id"]) == expected[row["doc_id"]]
            assert row["kept"] == (row["doc_id"] == row["component_id"])
    assert len({c for _, c in expected.values()}) < len(expected) - 20


def test_dense_regions_cuts_and_tiny_tasks(spark, monkeypatch):
    """A large group of near copies, orders cut over many tasks, regions of three."""
    for name, value in {"REGION": 3, "ORDER_ROWS": 50, "NEIGHBOURS": 2}.items():
        monkeypatch.setattr(lsh_forest, name, value)
    rng = random.Random(2)
    base = [f"w{rng.randint(0, 9999)}" for _ in range(220)]
    rows = []
    for i in range(120):
        changed = list(base)
        changed[rng.randrange(220)] = f"x{i}"
        rows.append((i, " ".join(changed)))
    rows += [(1000 + i, " ".join(f"v{rng.randint(0, 9999)}" for _ in range(80))) for i in range(60)]
    found = lsh_forest.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 85).collect()
    expected = brute_components(rows, 85)
    assert {row["doc_id"]: row["component_id"] for row in found} == {key: c for key, (_, c) in expected.items()}


def test_keep_one(docs, doc_rows, no_docs):
    kept = lsh_forest.keep_one(docs, 80)
    assert kept.columns == docs.columns
    ids = Counter(row["doc_id"] for row in kept.select("doc_id").collect())
    expected = brute_components(doc_rows, 80)
    assert ids == Counter({key for key, (_, component) in expected.items() if key == component} | {None})
    assert lsh_forest.keep_one(no_docs, 80).count() == 0 and lsh_forest.near_duplicates(no_docs).count() == 0


# -- mixing ----------------------------------------------------------------------------------


def water_level(sizes, share=1.5, most=2.0, weights=(5.0, 2.0, 1.0)):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {source: weights[i % len(weights)] for i, source in enumerate(order)}
    left, open_, targets = share * sum(sizes.values()), set(order), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] >= most * sizes[s]}
        if not full:
            return targets | {s: level * weight[s] for s in open_}
        targets |= {s: most * sizes[s] for s in full}
        left -= sum(most * sizes[s] for s in full)
        open_ -= full
    return targets


@pytest.mark.parametrize("range_rows", [2, 4096])
def test_mix(docs, doc_rows, range_rows):
    rows = source_mix.mix_taken(docs, range_rows=range_rows).collect()
    assert multiset((r["doc_id"], r["size"]) for r in rows) == Counter((r[0], len((r[1] or "").encode().split())) for r in doc_rows)
    source_of = {row[0]: row[3] for row in doc_rows}
    sizes = Counter()
    for row in doc_rows:
        sizes[row[3]] += len((row[1] or "").encode().split())
    targets, taken = water_level(sizes), Counter()
    for row in rows:
        source = source_of[row["doc_id"]]
        assert row["source_size"] == sizes[source] and math.isclose(row["target"], targets[source]) and 0 <= row["taken"] <= 2 * row["size"]
        taken[source] += row["taken"]
    assert all(taken[source] == math.floor(target) for source, target in targets.items())
    assert multiset(source_mix.mix_taken(docs, range_rows=7).collect()) == multiset(rows)


def test_mixed_documents(docs, doc_rows, no_docs):
    mixed = source_mix.mix_documents(docs)
    assert mixed.columns == docs.columns
    given, times = {row[0]: row for row in doc_rows}, Counter(row["doc_id"] for row in mixed.collect())
    plan = {row["doc_id"]: row for row in source_mix.mix_taken(docs).collect()}
    longest = Counter()
    held = Counter()
    for key, row in given.items():
        size = plan[key]["size"]
        held[row[3]] += size * times[key]
        longest[row[3]] = max(longest[row[3]], size)
    for key, row in plan.items():
        assert abs(held[given[key][3]] - row["target"]) <= longest[given[key][3]] + 8
    assert source_mix.mix_documents(no_docs).count() == 0 and source_mix.mix_taken(no_docs).count() == 0


# -- language ID, toxicity, fertility, language model ---------------------------------------------


def test_language_id(docs, doc_rows, no_docs):
    rows = byte_cnn.identify(docs).collect()
    assert len(rows) == len(doc_rows)
    given = {row[0]: row for row in doc_rows}
    right = [row["lang_pred"] == given[row["doc_id"]][2] for row in rows if row["held_out"] and row["doc_id"] < 240]
    assert sum(right) >= 0.95 * len(right) > 50
    for row in rows:
        assert row["held_out"] == (crc_remainder(row["doc_id"], 3) == 1) and 0 <= row["score"] <= 1
        letters = any(c.isalpha() for c in (given[row["doc_id"]][1] or ""))
        assert (row["lang_pred"] == "und") == (not letters)
    kept = byte_cnn.keep_known(docs, byte_cnn.fit(docs))
    assert kept.columns == docs.columns and {1_000_000, 1_000_001, 1_000_002, 1_000_003}.isdisjoint(r["doc_id"] for r in kept.collect())
    assert byte_cnn.identify(no_docs).count() == 0
    assert {row["lang_pred"] for row in byte_cnn.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_toxicity(spark, docs, doc_rows, no_docs):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(600):
        toxic = i % 4 == 0
        text = " ".join("".join(rng.choice("thandofri") for _ in range(rng.randint(2, 6))) for _ in range(40)).split()
        if toxic:
            text[rng.randrange(40)] = rng.choice(["scum", "zarkad", "zarkom", "zarkit", "zarken", "zarkul", "moron,"])
        rows.append((i, " ".join(text), "x"))
        labels.append((i, int(toxic), "extra"))
    labels += [(1, None, "x"), (None, 1, "x"), (4, 1, "again")]
    frame = spark.createDataFrame([*rows, (1_000_000, None, "x"), (1_000_001, "", "x")], "doc_id long, text string, score string")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int, text string")
    found = weak_toxicity.judge(frame, marks).collect()
    assert len(found) == 602
    truth = {key: toxic for key, toxic, _ in labels[:600]}
    for row in found:
        assert row["held_out"] == (crc_remainder(row["doc_id"], 3) == 1) and row["predicted"] == int(row["score"] >= 0.7)
    wrong = [row["doc_id"] for row in found if row["held_out"] and row["predicted"] != truth.get(row["doc_id"], 0)]
    assert len(wrong) <= 3
    assert {row["predicted"] for row in found if row["doc_id"] >= 1_000_000} == {0}
    kept = weak_toxicity.keep_clean(frame, weak_toxicity.fit(frame, marks))
    assert kept.columns == frame.columns and 440 <= kept.count() <= 470
    assert weak_toxicity.judge(docs, marks.where("false")).where("predicted = 1").count() == 0
    assert weak_toxicity.judge(no_docs, marks).count() == 0


def test_toxicity_counts_all_texts_but_equal_word_sets(spark):
    rng = random.Random(11)
    rows = []
    for i in range(400):  # all share their most common words
        own = ["zarkad"] if i % 4 == 0 else []
        rows.append((i, " ".join(["the", "and", "of", *own, *("".join(rng.choice("thandofri") for _ in range(7)) for _ in range(6))]), int(i % 4 == 0)))
    rows += [(1000 + i, rows[0][1] + " of", 1) for i in range(50)]
    rows += [(2000, "the of and !!!", 0), (1999, "and the of", 0)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    found = [weak_toxicity.evidence(frame.repartition(n)).collect() for n in (1, 7)]
    assert Counter(row["toxic"] for row in found[0]) == {0: 301, 1: 100}
    key = lambda row: (row["toxic"], row["words"], row["patterns"])
    assert sorted(map(key, found[0])) == sorted(map(key, found[1]))
    assert [row["patterns"] for row in found[0] if row["words"] == ["and", "of", "the"]] == [[]]  # of the least id


def test_label_model_finds_accuracies_and_correlations():
    import numpy as np

    rng = np.random.default_rng(3)
    truth = rng.random(4000) < 0.2
    fires = lambda p, q: np.where(truth, rng.random(4000) < p, rng.random(4000) < q)
    first, third = fires(0.8, 0.02), fires(0.5, 0.05)
    votes = np.stack([first, first, third], axis=1).astype(float)
    gold = np.where(rng.random(4000) < 0.05, ~truth, truth).astype(int)
    posterior, rates, correlation = weak_toxicity.label_model(votes, gold)
    assert np.allclose(rates[[0, 2]], [[0.02, 0.8], [0.05, 0.5]], atol=0.06)
    assert correlation[0, 1] > 0.9 and abs(correlation[0, 2]) < 0.3
    assert ((posterior > 0.5) == truth).mean() >= (gold == truth).mean() - 0.01


def test_fertility_counts(docs, doc_rows, no_docs):
    file = public_tokenizers.path("piece_bpe_32k.model")
    rows = fertility.judge(docs, file).collect()

    def base(text):
        found, lines, seen, repeated = (text or "").encode().split(), (text or "").split("\n"), set(), 0
        for line in lines:
            if line.strip(" \t\n\x0b\x0c\r"):
                repeated += line in seen
                seen.add(line)
        windows = Counter(zip(found, found[1:], found[2:], strict=False))
        twice = {i + k for i in range(len(found) - 2) if windows[tuple(found[i : i + 3])] > 1 for k in range(3)}
        failed = len(found) < 50 or 100 * len(twice) > 50 * len(found)
        return len(found), sum(len(w.decode()) for w in found), sum(c in "#*$%&|<>" for c in text or ""), repeated, len(twice), failed

    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert Counter(tuple(row[n] for n in names) for row in rows) == Counter((row[0], *base(row[1])) for row in doc_rows)
    assert not any(row["kept"] and row["base_failed"] for row in rows)
    plain = [row["kept"] for row in rows if not row["base_failed"]]
    assert sum(plain) >= 0.95 * len(plain)
    assert fertility.judge(no_docs, file).count() == 0


def test_fertility_rejects_signs_in_words(spark, doc_rows):
    rows = [(row[0], row[1], row[2]) for row in doc_rows if row[0] is not None and row[0] < 240]
    rows += [(900 + i, " ".join(word + "$%&*"[i % 4] * 3 for word in rows[i * 4][1].split()), "en") for i in range(6)]
    found = fertility.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string"), public_tokenizers.path("piece_bpe_32k.model"))
    kept = {row["doc_id"]: row["kept"] for row in found.collect()}
    assert not any(kept[900 + i] for i in range(6)) and sum(kept[i] for i in range(240)) >= 225


def test_fertility_of_rare_languages_and_small_tables(spark, doc_rows):
    rng, file = random.Random(8), public_tokenizers.path("piece_bpe_32k.model")
    letters = {"el": "αβγδειοσκτνρ", "zh": "的一是在不了有和人这中大为上个国我以要他时来用们", "am": "ሀለሐመሠረሰቀበተነአከወዘየደገ", "ru": "оеаинтсрвлкм"}
    rows = [(row[0], row[1], "en") for row in doc_rows if row[0] is not None and row[0] < 240 and row[2] == "en"]
    for place, (lang, used) in enumerate(letters.items()):
        for i in range(10):
            text = " ".join("".join(rng.choice(used) for _ in range(rng.randint(1, 3) if lang == "zh" else rng.randint(2, 8))) for _ in range(120))
            rows.append((1000 + 100 * place + i, text, lang if i % 2 else None))
    spec = "doc_id long, text string, lang string"
    found = {r["doc_id"]: r for r in fertility.judge(spark.createDataFrame(rows, spec), file).collect()}
    assert {r["script"] for key, r in found.items() if key >= 1000} == {"Greek", "Han", "other", "Cyrillic"}
    assert all(r["kept"] for key, r in found.items() if key >= 1000), [(k, r) for k, r in found.items() if k >= 1000 and not r["kept"]]
    few = rows[:15] + [(900 + i, " ".join(rng.choice("#$%&*|<>") * 2 + rng.choice("#$%&*|<>") for _ in range(80)), "en") for i in range(5)]
    kept = {r["doc_id"]: (r["kept"], r["base_failed"]) for r in fertility.judge(spark.createDataFrame(few, spec), file).collect()}
    assert all(kept[row[0]][0] for row in few[:15]) and not any(kept[900 + i][0] for i in range(5))


def test_context_mixing(docs, doc_rows, no_docs):
    rows = context_mixing.score(docs).collect()
    tokens = {row[0]: [*(row[1] or "").encode().lower().split(), b"\n"] for row in doc_rows}
    count = Counter()
    for row in doc_rows:
        if crc_remainder(row[0], 5) != 1:
            count.update(tokens[row[0]])
    total, kinds = sum(count.values()), len(count)
    assert len(rows) == len(doc_rows)
    for row in rows:
        own = tokens[row["doc_id"]]
        assert row["held_out"] == (crc_remainder(row["doc_id"], 5) == 1)
        assert (row["n_tokens"], row["n_known"], row["train_tokens"]) == (len(own), sum(count[t] > 0 for t in own), total)
        assert math.isclose(row["base_score"], sum(math.log10((count[t] + 0.5) / (total + 0.5 * (kinds + 1))) for t in own), rel_tol=1e-9)
        assert row["score"] < 0
    held = [row for row in rows if row["held_out"] and row["n_tokens"] > 50]
    assert sum(row["bits_per_byte"] for row in held) / len(held) < 4.5
    assert context_mixing.score(no_docs).count() == 0


def test_each_pair_is_predicted_once_for_all_tasks(docs, doc_rows, monkeypatch, tmp_path):
    import uuid
    from types import SimpleNamespace

    from pyspark import cloudpickle

    plain, folder = context_mixing.Model, str(tmp_path)

    class Logged:
        def __init__(self, *parts):
            model = plain(*parts)

            def sizes(pairs):
                with open(f"{folder}/{uuid.uuid4().hex}", "w") as out:
                    out.write(str(len(pairs)))
                return model.sizes(pairs)

            self.sizes = sizes

        def __reduce__(self):
            return cloudpickle.loads, (cloudpickle.dumps(SimpleNamespace(sizes=self.sizes)),)

    monkeypatch.setattr(context_mixing, "Model", Logged)
    assert context_mixing.score(docs.repartition(4)).count() == len(doc_rows)
    pairs = {pair for row in doc_rows for pair in context_mixing.pairs_of((row[1] or "").encode())[1]}
    assert sum(int(file.read_text()) for file in tmp_path.iterdir()) == len(pairs)


def test_joined_pairs_score_like_broadcast_ones(docs, monkeypatch):
    """Scores do not depend on which pairs are broadcast: none, some and all."""
    found = []
    for most in (0, 60, context_mixing.HEAD_PAIRS):
        monkeypatch.setattr(context_mixing, "HEAD_PAIRS", most)
        found.append({r["doc_id"]: r for r in context_mixing.score(docs).collect()})
    for key, first in found[0].items():
        for other in (found[1][key], found[2][key]):
            assert (first["n_tokens"], first["n_known"]) == (other["n_tokens"], other["n_known"])
            for name in ("base_score", "score", "bits_per_byte"):
                assert math.isclose(first[name], other[name], rel_tol=1e-9), (key, name)


def test_pairs_of_a_column_are_those_of_its_texts():
    import pyarrow as pa

    rng = random.Random(1)
    for _ in range(200):
        texts = [
            None if rng.random() < 0.1 else "".join(rng.choice("aB.é9 \n\t\v\f\r\x1c\x00") for _ in range(rng.choice([0, 1, 2, 5, 30]))) for _ in range(rng.randint(2, 8))
        ]
        for column, held in ((pa.array(texts, pa.string()), texts), (pa.array(texts, pa.string()).slice(1, len(texts) - 2), texts[1:-1])):
            keys, numbers = context_mixing.pairs_in(column)
            expected = [context_mixing.pairs_of(None if text is None else text.encode())[1] for text in held]
            assert numbers.tolist() == [len(pairs) for pairs in expected]
            every = [pair for pairs in expected for pair in pairs]
            assert keys.to_pylist() == [b"%c%b" % pair for pair in every]
            kinds, words = context_mixing.parted(keys)
            assert list(zip(kinds.to_pylist(), words.to_pylist(), strict=True)) == every


def test_bits_of_all_words_are_a_distribution():
    """The probabilities of all single bytes at one place add up to one."""
    import numpy as np

    rng = np.random.default_rng(1)
    tables = [rng.integers(0, 9, (2, 1 << bits)).astype(np.float32) for bits in context_mixing.TABLE_BITS]
    model = context_mixing.Model(tables, np.full((context_mixing.GATES, len(tables)), 0.4), context_mixing.first_refinement())
    sizes = model.sizes([(2, b"ab" + bytes([byte])) for byte in range(256)])
    after = model.sizes([(2, b"ab" + bytes([byte]) + b"c") for byte in range(256)])
    assert (after > 0).all() and (sizes > 0).all()
    bits = context_mixing.Bits([(2, b"ab" + bytes([byte])) for byte in range(256)])
    stretched = sum(0.4 * model.stretched[k][slots] for k, slots in enumerate(bits.slots))
    mixed = 1 / (1 + np.exp(-np.clip(stretched, -15, 15)))
    final = (mixed + model.refined[bits.node, context_mixing.step_of(stretched)]) / 2
    chance = np.where(bits.value > 0, final, 1 - final).reshape(256, 4, 8)[:, 2].prod(axis=1)
    assert math.isclose(chance.sum(), 1.0, rel_tol=1e-5)


def test_bytes_that_pairs_share_are_held_once():
    """Pairs in order hold the bytes of a common beginning once; slots and sizes are those of each pair alone."""
    import numpy as np

    rng = random.Random(3)
    pairs = sorted({(rng.randrange(3), bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 9)))) for _ in range(400)} | {(1, b"x" * 70_000), (1, b"x" * 70_001), (2, b"\n")})
    once, each = context_mixing.Bits(pairs, once=True), context_mixing.Bits(pairs)
    assert len(once.value) < len(each.value) * 0.7
    for name in ("value", "node", "place"):
        assert (getattr(once, name).reshape(-1, 8)[once.byte] == getattr(each, name).reshape(-1, 8)).all(), name
    for k, slots in each.slots.items():
        assert (once.slots[k].reshape(-1, 8)[once.byte] == slots.reshape(-1, 8)).all(), k
    numbers = np.arange(len(pairs)) + 1.0
    assert math.isclose(once.weights(numbers).sum(), each.weights(numbers).sum()) and each.weights(numbers)[0] == 1
    tables = [np.random.default_rng(1).integers(0, 9, (2, 1 << bits)).astype(np.float32) for bits in context_mixing.TABLE_BITS]
    model = context_mixing.Model(tables, np.full((context_mixing.GATES, len(tables)), 0.4), context_mixing.first_refinement())
    shuffled = rng.sample(pairs[:-1], 60)
    assert np.allclose(model.sizes(shuffled), [model.sizes([pair])[0] for pair in shuffled], rtol=1e-6)


def test_dense_family_loses_no_link(spark):
    """Texts of one template, too different from each other to be linked, and some with one partner each."""
    rng = random.Random(11)
    base = [f"w{i}" for i in range(220)]

    def changed(words, places, mark):
        words = list(words)
        for place in places:
            words[place] = f"{mark}.{place}"
        return words

    rows, expected = [], {}
    for i in range(2_400):
        places = rng.sample(range(5, 215, 5), 7)
        mine = changed(base, places[:4], f"x{i}")
        rows.append((i, " ".join(mine)))
        expected[i] = i
        if i % 4 == 0:
            rows.append((10_000 + i, " ".join(changed(mine, places[4:], f"y{i}"))))
            expected[10_000 + i] = i
    found = lsh_forest.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 85).collect()
    assert {row["doc_id"]: row["component_id"] for row in found} == expected
