"""Operators against brute force, exact round trips and held-out labels."""

import hashlib
import random
import textwrap
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from churnkit.llm import (components, cotraining, decontaminate, jaccard, langid, licenses, packing, pii, quality_rules,
                          queries, repeats, sharding, textkit)
from tests.llm import brute

SF = "/root/testdata/sf0.001"
words = st.text(st.sampled_from("ab c\n\t.é"), max_size=80)


def table(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")


# --- words and hashes ---

@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), words), max_size=8))
def test_word_bounds(texts):
    buf, off = textkit.utf8(pa.array(texts, pa.string()))
    s, e, d = textkit.word_bounds(buf, off)
    raw = buf.tobytes()
    assert [(int(i), raw[a:b].decode()) for a, b, i in zip(s, e, d)] == \
        [(i, w) for i, t in enumerate(texts) for w in brute.WORD.findall(t or "")]


def test_word_hash_depends_on_the_word_alone():
    long = "x" * 300
    buf, off = textkit.utf8(pa.array([f"one {long} two", f"  two\n{long}"]))
    s, e, _ = textkit.word_bounds(buf, off)
    h = textkit.word_hashes(buf, s, e)
    assert h[2] == h[3] and h[1] == h[4] and len(set(h.tolist())) == 3


# --- packing ---

def test_tokens_equal_the_tokenizer(small):
    _, texts = small
    tok = packing.WordTokenizer(queries.tokenizer_path())
    odd = ["<|endoftext|> a", "İ ΑΣ", "it's we'll 'tis O'Neil's", "a b c", "éé", "1234 5.6", "ÀÉß×÷ ÿ", "", None, "x" * 500]
    many = list(texts.values()) + odd
    want = [[] if t is None else tok.tokenizer.encode(t, add_special_tokens=False).ids for t in many]
    for _ in range(2):  # cold, then from memory
        assert [np.frombuffer(b, "<u4").tolist() for b in tok.encode(many)] == want


def check_packing(rows, texts, tok, sequence=4096):
    want = {i: tok.tokenizer.encode(t or "", add_special_tokens=False).ids + [1] for i, t in texts.items()}
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
    assert set(by_doc) == set(want)
    for i, parts in by_doc.items():
        parts.sort(key=lambda r: r["piece"])
        assert [r["piece"] for r in parts] == list(range(len(parts)))
        assert [r["start"] for r in parts] == [sequence * n for n in range(len(parts))]
        assert sum(r["length"] for r in parts) == len(want[i]) and all(r["length"] == sequence for r in parts[:-1])
        for r in parts:
            ids = want[i][r["start"]:r["start"] + r["length"]]
            assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
    for parts in by_seq.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= sequence
    total = sum(map(len, want.values()))
    return len(by_seq), -(-total // sequence)


def test_packing_round_trip(spark, small):
    docs, texts = small
    rows = packing.pack_documents(docs, queries.tokenizer_path(), keep_ids=True).collect()
    tok = packing.tokenizer(queries.tokenizer_path())
    used, least = check_packing(rows, texts, tok)
    assert used <= least * 1.1 + 8
    assert all(len(r["ids"]) == r["length"] for r in rows)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 32), max_size=120), st.integers(1, 6))
def test_best_fit_matches_its_definition(lengths, most):
    bins, closed = [], []  # [number, used]
    want = []
    for n in lengths:
        fitting = [b for b in bins if b[1] + n <= 32]
        if fitting:
            b = max(fitting, key=lambda b: b[1])
        else:
            if len(bins) == most:
                full = max(bins, key=lambda b: b[1])
                bins.remove(full)
                closed.append(full)
            b = [len(want and {x[0] for x in want} or ()), 0]
            bins.append(b)
        want.append((b[0], b[1]))
        b[1] += n
        if b[1] == 32:
            bins.remove(b)
    got = list(packing.pack(lengths, 32, most))
    # among equally full bins any may be taken: the fills must agree
    assert [g[1] for g in got] == [w[1] for w in want]


# --- licenses ---

def test_license_notices():
    s = licenses.Scanner(licenses.TEMPLATES)
    assert [x[2] for x in s.scan("one\nLicensed under the Apache License, Version 2.0.\ntwo")] == ["Apache-2.0"]
    assert [x[2] for x in s.scan("Licensed under CC BY-NC 4.0.\nReleased under the MIT License.")] == ["CC-BY-NC-4.0", "MIT"]
    assert [x[2] for x in s.scan("This work is licensed under the GNU General Public License, version 3.")] == ["GPL-3.0"]
    assert [x[2] for x in s.scan("This work is licensed under the GNU General Public License, version 2.")] == ["GPL-2.0"]
    changed = licenses.TEMPLATES["MIT grant"][1].replace("free of charge", "at no cost").lower()
    (got,) = s.scan(changed)
    assert got[2] == "MIT" and sum(got[5:]) > 0
    assert list(s.scan("a driving license is needed here")) == [] and list(s.scan(None)) == []


def test_license_inside_a_long_line():
    pad = "lorem ipsum dolor sit amet " * 200
    (got,) = licenses.Scanner(licenses.TEMPLATES).scan(pad + licenses.TEMPLATES["Apache-2.0 header"][1] + " " + pad)
    assert got[2] == "Apache-2.0"


@pytest.mark.parametrize("mark", ["", "# ", " * ", "// ", "dnl "])
@pytest.mark.parametrize("width", [30, 78])
def test_wrapped_notices(mark, width):
    s = licenses.Scanner(licenses.TEMPLATES)
    for name, (license, notice) in licenses.TEMPLATES.items():
        lines = "\n".join(mark + line for line in textwrap.wrap(notice, width, break_long_words=False, break_on_hyphens=False))
        text = f"int before;\n{lines}\nint after;"
        (got,) = s.scan(text)
        assert got[2:4] == (license, name) and sum(got[5:]) == 0, name
        assert text[got[0]:got[1]] in lines and got[1] - got[0] >= len(lines) - len(mark) - 1


def test_every_notice_of_a_block_is_found():
    s = licenses.Scanner(licenses.TEMPLATES)
    parts = [licenses.TEMPLATES[n] for n in ("MIT notice", "GPL-2.0 notice", "LGPL-3.0 notice", "GPL-2.0 notice", "CC-BY-4.0 notice",
                                             "BSD-3-Clause grant", "AGPL-3.0 notice", "MPL-2.0 header")]
    for between in (" ", " or ", "\n", " some words of another kind, " * 40):
        assert [x[2] for x in s.scan(between.join(p for _, p in parts))] == [v for v, _ in parts]
    changed = licenses.TEMPLATES["Apache-2.0 header"][1].replace("obtain", "get").replace(" may not ", " must not ")
    assert [(x[3], sum(x[5:])) for x in s.scan(changed)] == [("Apache-2.0 header", 2)]
    pages = "\n".join(p for _, p in licenses.TEMPLATES.values())
    assert [x[3] for x in s.scan(pages * 3)] == list(licenses.TEMPLATES) * 3


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from("abc"), min_size=1, max_size=7), st.lists(st.sampled_from("abcd"), max_size=12))
def test_fewest_differences_equal_brute_force(template, said):
    s = licenses.Scanner({"t": ("T", " ".join(template))})
    row = list(range(len(template) + 1))
    want = []
    for v in said:
        above, row = row, [0]
        for i, w in enumerate(template):
            row.append(min(above[i] + (w != v), above[i + 1] + 1, row[i] + 1))
        want.append(row[-1])
    assert s.distances(0, said) == want
    assert [sum(s.align(template, said[:j + 1])[2:]) for j in range(len(said))] == want


def test_every_planted_notice_is_found(spark, small):
    docs, texts = small
    found = {r["doc_id"]: r["found"] for r in licenses.license_scan(docs).collect()}
    for i, t in texts.items():
        n = sum(t.count(p) for _, p in licenses.TEMPLATES.values())
        assert (len(found[i]) > 0) == (n > 0)


# --- repeated strings ---

@pytest.mark.parametrize("hot", [4096, 1])
def test_repeats_equal_brute_force(spark, hot):
    rng = random.Random(5)
    base = ["".join(rng.choice("abc \né") for _ in range(n)) for n in (90, 150, 400, 60)]
    texts = [None, "", "short", "z" * 95, base[0] + base[1], base[1] + base[0], base[2][100:300] + base[3], base[2], base[2],
             base[3] * 4, "aé" * 50 + base[0], base[1][5:60] + "!" + base[1][70:], "".join(rng.choice("ab") for _ in range(500))]
    for n in range(40):  # one passage between different neighbours
        texts.append("".join(rng.choice("xyz") for _ in range(30)) + base[0][10:10 + 30 + n % 25] + "".join(rng.choice("uvw") for _ in range(30)))
    got = {r["doc_id"]: (r["n_bytes"], r["n_bytes"] - len(r["kept"]), len(r["spans"]), bytes(r["kept"]))
           for r in repeats.remove_repeats(table(spark, texts), length=40, hot=hot).collect()}
    want = brute.remove_repeats(texts, 40)
    assert [got[i] for i in range(len(texts))] == want


def test_repeats_on_the_documents(spark, small):
    docs, texts = small
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in queries.op3_suffix_dedup(spark, SF).collect()}
    want = dict(zip(texts, brute.remove_repeats(list(texts.values()))))
    assert got == {i: (w[0], w[1], w[2], hashlib.sha256(w[3]).hexdigest()) for i, w in want.items()}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.binary(max_size=12).map(lambda b: bytes(97 + c % 2 for c in b)), st.integers(0, 2)), min_size=1, max_size=30))
def test_suffix_mergesort(items):
    items.sort(key=lambda x: x[1])
    data = np.frombuffer(b"".join(t for t, _ in items) + b"#", np.uint8)
    size = np.array([len(t) for t, _ in items])
    start, group = np.cumsum(size) - size, np.array([g for _, g in items])
    order, common = repeats.sorted_groups(data, start, size, group, 12)
    assert [(group[i], items[i][0]) for i in order] == sorted((g, t) for t, g in items)
    for x, y, n in zip(order, order[1:], common[1:]):
        a, b = items[x][0], items[y][0]
        assert n == (next((i for i, (p, q) in enumerate(zip(a, b)) if p != q), min(len(a), len(b))) if group[x] == group[y] else 0)


def test_a_spoilt_order_is_mended(monkeypatch):
    monkeypatch.setattr(repeats.PrefixHash, "of", lambda self, s, n: s * 0)  # every hash collides
    texts = [b"banana", b"bandit", b"apple", b"ban"]
    data, size = np.frombuffer(b"".join(texts), np.uint8), np.array([len(t) for t in texts])
    order, common = repeats.sorted_groups(data, np.cumsum(size) - size, size, np.zeros(4, int), 6)
    assert [texts[i] for i in order] == sorted(texts) and common.tolist() == [0, 0, 3, 3]


# --- languages ---

def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = queries.op4_language(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang", "n_chars"), "doc_id").where("held_out")
    n, right = got.where("n_chars > 40").agg(F.count("*"), F.sum((F.col("lang") == F.col("lang_pred")).cast("int"))).first()
    assert n > 200 and right / n > 0.99
    assert {zlib.crc32(str(r["doc_id"]).encode()) % 4 for r in got.select("doc_id").collect()} == {2}


def test_one_versus_one_nodes():
    rng = np.random.default_rng(1)
    x = np.eye(12, dtype=np.float32)[rng.integers(0, 12, 600)] + rng.normal(0, 0.1, (600, 12)).astype(np.float32)
    y = x.argmax(1) // 4
    node = langid.Node(["a", "b", "c"]).fit(x, y)
    best, sure = node.decide(x)
    assert (best == y).mean() > 0.98 and len(node.pairs) == 3 and ((0 <= sure) & (sure <= 1)).all()


def test_labels_are_never_inputs(spark, small):
    docs, _ = small
    model = langid.fit_language_model(docs)
    a = langid.predict_languages(docs, model).collect()
    b = langid.predict_languages(docs.withColumn("lang", F.lit(None).cast("string")).withColumn("source", F.lit("z")), model).collect()
    assert a == b


# --- repetition rules ---

@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), words), min_size=1, max_size=6))
def test_repetition_counts(texts):
    m = quality_rules.measure(pa.array(texts, pa.string()))
    failed, _ = quality_rules.verdict(m)
    for i, t in enumerate(texts):
        want = brute.repetition(t)
        assert {c: int(m[c][i]) for c in want if c != "base_failed"} | {"base_failed": bool(failed[i])} == want
        assert m["dup_5_chars"][i] == brute.covered_chars(t or "", 5)


def test_repetition_on_the_documents(spark, small):
    _, texts = small
    rows = {r["doc_id"]: r for r in queries.op5_quality_rules(spark, SF).collect()}
    for i, t in texts.items():
        want = brute.repetition(t)
        assert {c: rows[i][c] for c in want} == want
        assert not (rows[i]["base_failed"] and rows[i]["kept"])
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = [rows[i]["kept"] for i, q in labels.items() if q == 1 and not rows[i]["base_failed"]]
    poor = [rows[i]["kept"] for i, q in labels.items() if q == 0]
    assert np.mean(good) > 0.97 and np.mean(poor) < 0.1


# --- quality classifier ---

def test_classifier_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    train, test = labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1")
    got = cotraining.score_quality(docs, cotraining.fit_quality(docs, train)).join(test, "doc_id")
    n, right = got.agg(F.count("*"), F.sum((F.col("kept") == (F.col("quality") == 1)).cast("int"))).first()
    assert n > 100 and right / n > 0.95


def test_views_teach_each_other():
    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 900).astype(float)
    view = lambda d: y[:, None] * 2 - 1 + rng.normal(0, 1.2, (900, d))
    xt, xm = view(3), view(3)
    few = slice(0, 12)
    model = cotraining.co_train(xt[few], xm[few], y[few], xt[12:500], xm[12:500], np.arange(12) % 4 == 0)
    _, _, p = model.score(xt[500:], xm[500:])
    assert ((p > 0.5) == (y[500:] > 0)).mean() > 0.93


# --- decontamination ---

@settings(max_examples=120, deadline=None)
@given(st.lists(st.sampled_from("abcd"), min_size=1, max_size=14), st.lists(st.sampled_from("abcd"), max_size=20))
def test_tiles_equal_brute_force(a, b):
    k = 3
    numbers = {c: n for n, c in enumerate("abcd")}
    got = decontaminate.tiles(*(np.array([numbers[c] for c in s], np.uint64) + np.uint64(11) for s in (a, b)), k)
    for i, j, n in got:
        assert a[i:i + n] == b[j:j + n] and n >= k
    assert len({x for i, _, n in got for x in range(i, i + n)}) == sum(t[2] for t in got)
    assert len({x for _, j, n in got for x in range(j, j + n)}) == sum(t[2] for t in got)
    assert sum(t[2] for t in got) == brute.tiling(a, b, k)


def test_contamination_equals_brute_force(spark, small):
    docs, texts = small
    items = spark.read.parquet(f"{SF}/benchmark.parquet").limit(12)
    passages = {r["item_id"]: r["text"] for r in items.collect()}
    some = {i: t for i, t in texts.items() if len(t) < 900}
    frame = docs.where(F.length("text") < 900)
    got = {(r["doc_id"], r["item_id"]): r["n_covered"] for r in decontaminate.contamination(frame, items).collect()}
    want = {}
    for i, t in some.items():
        b = brute.passage_words(t)
        for j, p in passages.items():
            a = brute.passage_words(p)
            if len(set(zip(a, a[1:], a[2:], a[3:])) & set(zip(b, b[1:], b[2:], b[3:]))):
                n = brute.tiling(a, b, decontaminate.SEED_WORDS)
                if len(a) >= decontaminate.MIN_WORDS and n >= decontaminate.THRESHOLD * len(a):
                    want[i, j] = n
    assert got == want


def test_short_items_match_as_a_whole(spark):
    docs = table(spark, ["So: who wrote the Iliad? Nobody knows.", "who wrote the Odyssey, the Iliad?", "the end", None, "", "... !"])
    items = spark.createDataFrame([(1, "Who wrote the Iliad?"), (2, "THE END"), (3, "who wrote the Iliad"), (4, "?!"), (5, None),
                                   (6, "iliad")], "item_id bigint, text string")
    for size in (10, decontaminate.BLOCK_CHARS):
        got = decontaminate.contamination(docs, items, block_chars=size).collect()
        assert sorted((r["doc_id"], r["item_id"], r["n_covered"], r["n_item_words"], r["coverage"]) for r in got) == [
            (0, 1, 4, 4, 1.0), (0, 3, 4, 4, 1.0), (0, 6, 1, 1, 1.0), (1, 6, 1, 1, 1.0), (2, 2, 2, 2, 1.0)]
    assert [r["doc_id"] for r in decontaminate.drop_contaminated(docs, items).collect()] == [3, 4, 5]
    long = " ".join(f"w{i}" for i in range(70))
    items = spark.createDataFrame([(1, long), (2, long + " end"), (3, long + " END")], "item_id bigint, text string")
    got = decontaminate.contamination(table(spark, [long + " other", "w0 " + long + " end"]), items, min_words=90).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in got) == [(0, 1), (1, 1), (1, 2), (1, 3)]


def test_passage_words_of_any_script():
    texts = ["Né à l’été — “déjà vu”", "今天天气很好，我们去公园。", "カレーを食べた", "สวัสดี", "한국어 문장", "a今b\U00020000c 1\u00a02", "é今", "今é", None, "😀 x"]
    want = [["né", "à", "l", "été", "déjà", "vu"], list("今天天气很好我们去公园"), list("カレーを食べた"), list("สวัสดี"), ["한국어", "문장"],
            ["a", "今", "b", "\U00020000", "c", "1", "2"], ["é", "今"], ["今", "é"], [], ["x"]]
    buf, off = textkit.utf8(pa.array(texts, pa.string()))
    raw = textkit.LOWER[buf]
    s, e, d = textkit.passage_bounds(raw, off)
    got = [[] for _ in texts]
    for a, b, i in zip(s, e, d):
        got[i].append(raw.tobytes()[a:b].decode())
    assert [[w.replace("É", "é") for w in g] for g in got] == [[w for w in g] for g in want]


def test_items_of_unspaced_scripts_are_found(spark):
    item = "下列哪一项不是太阳系中的行星？请从四个选项中选择正确答案并说明理由"
    docs = table(spark, ["前面的文字，" + item + "。后面还有别的内容", item[:9] + item[20:], "今天天气很好，我们去公园散步"])
    items = spark.createDataFrame([(1, item), (2, "太阳系")], "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]): r["coverage"] for r in decontaminate.contamination(docs, items).collect()}
    assert got[0, 1] == 1.0 and got[0, 2] == 1.0 and got[1, 1] >= 0.5 and not any(i == 2 for i, _ in got)


def test_long_passage_of_a_longer_item_is_caught(spark):
    w = [f"w{i}" for i in range(200)]
    docs = table(spark, ["before " + " ".join(w[60:140]) + " after", " ".join(w[60:105]),
                         " other ".join(" ".join(w[i:i + 10]) for i in range(0, 80, 10))])
    items = spark.createDataFrame([(1, " ".join(w))], "item_id bigint, text string")
    got = decontaminate.contamination(docs, items).collect()
    assert [(r["doc_id"], r["n_covered"], r["coverage"]) for r in got] == [(0, 80, 0.4)]
    assert [r["doc_id"] for r in decontaminate.drop_contaminated(docs, items).collect()] == [1, 2]
    assert decontaminate.contamination(docs, items, passage_words=10**9).collect() == []


def test_reordered_passage_is_caught_in_any_block(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi"
    w = item.split()
    moved = "Intro words here. " + " ".join(w[8:]).title() + ", then! " + " ".join(w[:8])
    docs = table(spark, [moved, "nothing of the kind in this text at all", None])
    items = spark.createDataFrame([(7, item), (8, None), (9, "too short"), (10, item + " extra")], "item_id bigint, text string")
    whole = decontaminate.contamination(docs, items).collect()
    assert {(r["doc_id"], r["item_id"], r["n_tiles"]) for r in whole} == {(0, 7, 2), (0, 10, 2)}
    blocks = decontaminate.contamination(docs, items, block_chars=10).collect()
    assert sorted(map(repr, whole)) == sorted(map(repr, blocks))
    assert [r["doc_id"] for r in decontaminate.drop_contaminated(docs, items).collect()] == [1, 2]


# --- sharding ---

def test_lookup_table():
    names = [f"s{i}" for i in range(10)]
    t = sharding.fill(names, 1009)
    load = np.bincount(t, minlength=10)
    assert load.sum() == 1009 and load.max() - load.min() <= 1
    fewer = sharding.fill(names[:-1], 1009)
    moved = np.mean([names[a] != names[b] for a, b in zip(t, fewer) if a != 9])
    assert moved < 0.15
    heavy = np.bincount(sharding.fill(names, 1009, {"s0": 3}))
    assert heavy[0] > 2.5 * heavy[1:].mean()
    for bad in (lambda: sharding.fill(names, 1000), lambda: sharding.fill([]), lambda: sharding.fill(["a", "a"])):
        with pytest.raises(ValueError):
            bad()


def test_every_document_has_its_shard(spark, small):
    _, texts = small
    t = sharding.fill(queries.SHARDS)
    for r in queries.op8_sharding(spark, SF).collect():
        slot = int(hashlib.md5(str(r["doc_id"]).encode()).hexdigest()[:15], 16) % sharding.SLOTS
        assert (r["slot"], r["shard"]) == (slot, queries.SHARDS[t[slot]])
    assert queries.op8_sharding(spark, SF).count() == len(texts)


# --- Jaccard join ---

def variants(seed=2):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts = []
    for g in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(30, 160))]
        for _ in range(rng.randint(1, 7)):
            t = list(base)
            for _ in range(rng.randint(0, max(1, len(t) // 30))):
                t[rng.randrange(len(t))] = rng.choice(vocabulary)
            texts.append(" ".join(t))
    common = " ".join(vocabulary[:40])
    texts += [common + " " + " ".join(rng.choice(vocabulary) for _ in range(n)) for n in range(0, 60, 2)]
    return texts + ["", None, "a b", "A  b", "a b c d"]


@pytest.mark.parametrize("block", [8192, 3])
def test_jaccard_equals_brute_force(spark, block):
    texts = variants()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(table(spark, texts), block=block).collect()}
    assert got == brute.jaccard_components(dict(enumerate(texts)))


def test_jaccard_on_the_documents(spark, small):
    _, texts = small
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in queries.op9_ngram_jaccard(spark, SF).collect()}
    assert got == brute.jaccard_components(texts)


def test_tree_keeps_every_link():
    sets = jaccard.shingle_sets(pa.array([t or "" for t in variants(4)]))
    sets = sorted((s for s in sets if len(s)), key=len)
    size = np.array([len(s) for s in sets])
    bits = [jaccard.signature(s) for s in sets]
    words = min(map(len, bits))
    tree = jaccard.SignatureTree(size, np.stack([jaccard.folded(b, words) for b in bits]), np.arange(len(sets)), 85)
    got = {(int(i), int(j)) for a, b in tree.pairs() for i, j in zip(a, b) if jaccard.pair_can_link(tree, bits, i, j)}
    linked = set()
    for i in range(len(sets)):
        for j in range(i + 1, len(sets)):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 85 * (size[i] + size[j] - both):
                linked.add((i, j))
    assert linked <= got and len(got) < len(sets) * (len(sets) - 1) / 4


@pytest.mark.parametrize("edges", [[], [(1, 2)], [(i, i + 1) for i in range(200)], [(5, 5)],
                                   [(0, i) for i in range(1, 50)] + [(60, 61), (62, 61)]])
def test_components(spark, edges):
    frame = spark.createDataFrame(edges, "a bigint, b bigint").repartition(3)
    got = {r["node"]: r["component"] for r in components.components(frame).collect()}
    forest = components.Forest()
    for a, b in edges:
        forest.union(a, b)
    assert got == {x: forest.find(x) for e in edges for x in e if e[0] != e[1]}


# --- personal data ---

pii_text = st.text(st.sampled_from("a@.-+ 0123456789()@..x"), max_size=60)


@settings(max_examples=600, deadline=None)
@given(pii_text)
def test_base_spans_equal_the_patterns(text):
    got = [s[:3] for s in pii.find_spans(text) if s[0] in pii.BASE_KINDS]
    assert got == brute.base_spans(text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["4111111111111111", "4111 1111-1111 1111", "10.0.0.256", "1.2.3.4", "+1 (234) 567-8900", "a.b@c.de",
                                 "a@b", " ", ".", "-", "é", "x@y.z@w.v", "+", "00001.2.3.4.5.6.7.8", "@"]), max_size=10))
def test_base_spans_equal_the_patterns_on_pieces(parts):
    text = "".join(parts)
    assert [s[:3] for s in pii.find_spans(text) if s[0] in pii.BASE_KINDS] == brute.base_spans(text)


def test_pii_query_equals_the_patterns(spark, small):
    _, texts = small
    for r in queries.op10_pii(spark, SF).collect():
        want = brute.base_spans(texts[r["doc_id"]])
        line = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r["base_sha256"] == hashlib.sha256(line.encode()).hexdigest() and r["spans"].startswith(line)
        assert [r[f"n_{k}"] for k in pii.BASE_KINDS] == [sum(s[0] == k for s in want) for k in pii.BASE_KINDS]


def test_checksums_context_and_redaction():
    text = "IBAN DE89 3704 0044 0532 0130 00, not DE88 3704 0044 0532 0130 00; ssn 123-45-6789 but part 123-45-6789"
    got = pii.find_spans(text)
    assert [(k, text[a:b]) for k, a, b, _ in got if k == "iban"] == [("iban", "DE89 3704 0044 0532 0130 00")]
    assert [k for k, *_ in pii.find_spans("part number 123-45-6789 here")] == []
    assert [k for k, *_ in pii.find_spans("social security 123-45-6789 here")] == ["ssn"]
    clean = "mail a.b@c.de or +1 (234) 567-8900."
    assert pii.redact(clean, pii.find_spans(clean)) == "mail <EMAIL> or <PHONE>."
    assert pii.find_spans("9" * 50000) == [] and pii.find_spans("a" * 200000 + "@") == []
