"""Ranked search against scoring every document for every item."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from churnkit.llm import lexical as x
from churnkit.llm.queries import op13_lexical_search
from tests.llm.conftest import odd_rows

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(UPPER))


def brute(docs, items, k=10):
    """Sorted (item_id, rank, doc_id, score); docs and items are (id, text) rows."""
    rows = [(i, Counter(terms(t))) for i, t in docs]
    rows = [(i, c) for i, c in rows if c]
    total = sum(sum(c.values()) for _, c in rows)
    df = Counter(t for _, c in rows for t in c)
    out = []
    for item, text in items:
        got = []
        for doc, c in rows:
            m = 10 + 90 * sum(c.values()) * len(rows) // total
            score = sum(math.floor(1000 * math.log((2 * len(rows) + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
                        for t in set(terms(text)) if c[t])
            if score > 0:
                got.append((-score, doc is None, doc or 0, doc))
        out += [(item, n, doc, -s) for n, (s, _, _, doc) in enumerate(sorted(got)[:k], 1)]
    return sorted(out, key=repr)


def rows_of(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


@settings(max_examples=80, deadline=None)
@given(st.sets(st.tuples(st.integers(0, 40), st.integers(0, 25)), min_size=1, max_size=200), st.integers(0, 99), st.integers(1, 7))
def test_descent_equals_adding_up_rows(cells, seed, ranges):
    rng = np.random.default_rng(seed)
    rows, cols = np.array(sorted(cells)).T
    impact = rng.integers(1, 9, len(rows))
    treap = x.Treap.load(*x.Treap.build(rows, cols, impact, 6), 6)
    grid = np.zeros((64, 64), np.int64)
    grid[rows, cols] = impact
    for level in range(7):  # every node's maximum is that of its square
        side = 64 >> level
        squares = grid.reshape(64 // side, side, 64 // side, side).max(axis=(1, 3))
        assert sorted(squares[squares > 0].tolist()) == sorted(treap.maxima[level][:-1].tolist())
    asked = np.unique(rng.integers(0, 41, 6))
    weights = rng.integers(0, 5, len(asked))
    best = x.Best(4)
    level, nodes = treap.rows(asked, 26)
    x.descend(treap, level, nodes, asked, weights, list(range(26)), best, ranges)
    scores = weights @ grid[asked, :26]
    want = sorted((-int(s), False, i) for i, s in enumerate(scores) if s > 0)[:4]
    assert best.rows == want


@pytest.mark.parametrize("block_bytes", [3000, x.BLOCK_BYTES])
def test_equals_brute_force(spark, small, block_bytes):
    docs, texts = small
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    got = rows_of(x.search(x.build_index(docs, block_bytes=block_bytes), items))
    assert got == brute(texts.items(), [(r["item_id"], r["text"]) for r in items.collect()])


def test_query_has_the_same_rows(spark, small):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    assert rows_of(op13_lexical_search(spark, "/root/testdata/sf0.001")) == brute(small[1].items(), items)


ITEMS = [(1, "word3 other2 THING5 thing5"), (1, "ab"), (2, None), (3, ""), (None, "one É éé word1"), (4, "nowhere"),
         (5, "İstanbul ΑΣ \U0001f600"), (6, "q" * 70000 + " two"), (7, "ab " * 4000)]


def test_odd_rows_and_clashing_columns(spark, odd, clashing, empty):
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    want = brute([(r[0], r[1]) for r in odd_rows()], ITEMS)
    assert want and rows_of(x.lexical_search(odd, items)) == want
    more = items.selectExpr("*", "'x' as score", "'y' as number", "'z' as doc_id", "0 as rank")
    assert rows_of(x.lexical_search(clashing, more)) == want
    assert rows_of(x.search(x.build_index(odd, block_bytes=50), items, item_chars=1)) == want
    assert rows_of(x.lexical_search(empty, items)) == [] and rows_of(x.lexical_search(odd, items.limit(0))) == []


def test_equal_scores_go_by_id(spark):
    docs = [(i, "same text here") for i in (9, 3, 3, None, 12, 40, 41, 8, 7, 6, 5, 4)] + [(100 + i, f"other{i}") for i in range(30)]
    items = [(1, "same"), (2, "here other7")]
    got = rows_of(x.lexical_search(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3),
                                   spark.createDataFrame(items, "item_id bigint, text string")))
    assert got == brute(docs, items)


def test_ids_of_other_types_and_null_items(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "b c")], "doc_id int, text string")
    for kind, value in (("int", 5), ("string", "x"), ("int", None)):
        items = spark.createDataFrame([(value, "c")], f"item_id {kind}, text string")
        assert rows_of(x.lexical_search(docs, items)) == [(value, 1, 2, brute([(1, "a b"), (2, "b c")], [(value, "c")])[0][3])]


def test_ids_may_be_text(odd):
    items = odd.selectExpr("'i' || doc_id as item_id", "text")
    named = odd.selectExpr("'n' || doc_id as doc_id", "text")
    assert len(rows_of(x.lexical_search(named, items))) > 0


def test_most_ranges_stay_closed(small, monkeypatch):
    """The bounds decide: far fewer cells are opened than the item's rows hold."""
    _, texts = small
    import pyarrow as pa

    ids = sorted(texts)
    got = x.grid_block(pa.array(ids), pa.array([texts[i] for i in ids]), len(ids), 60000)
    treap = x.Treap.load(got["masks"], got["maxima"], got["height"])
    place = {t: i for i, t in enumerate(got["terms"].to_pylist())}
    opened = []
    child = x.Treap.child
    monkeypatch.setattr(x.Treap, "child", lambda self, level, nodes, q: (opened.append((level, nodes.shape[0])), child(self, level, nodes, q))[1])
    text = texts[ids[5]]
    rows = np.array([place[t] for t in sorted(set(terms(text)))][:40])
    level, nodes = treap.rows(rows, len(got["ids"]))
    opened.clear()
    best = x.Best(1)
    counts = got["counts"][rows]
    x.descend(treap, level, nodes, rows, np.floor(1000 * np.log(402 / (2 * counts + 1))).astype(np.int64), got["ids"].to_pylist(), best, 2)
    assert sum(n for lv, n in opened if lv == treap.height - 1) < len(ids)


def test_a_task_holds_few_rows_of_the_index(spark):
    """Blocks are megabytes long: those that one task writes come in several row groups, each about as large as a block."""
    import pyarrow.parquet as pq

    rng = np.random.default_rng(7)
    texts = [" ".join(f"{v:x}" for v in rng.integers(0, 1 << 40, 100_000).tolist()) for _ in range(16)]
    docs = spark.createDataFrame([(f"d{i:02d}", t) for i, t in enumerate(texts)], "doc_id string, text string").coalesce(1)
    index = x.build_index(docs, block_bytes=1 << 20)
    groups = [m.row_group(g) for f in index.blocks.inputFiles() if (m := pq.read_metadata(f.removeprefix("file://"))).num_rows
              for g in range(m.num_row_groups)]
    assert sum(g.num_rows for g in groups) == 16
    assert max(g.num_rows for g in groups) <= 4 and max(g.total_byte_size for g in groups) <= 4 * x.BLOCK_BYTES
    items = spark.createDataFrame([(1, texts[5][:200])], "item_id int, text string")
    assert x.search(index, items).first()["doc_id"] == "d05"
