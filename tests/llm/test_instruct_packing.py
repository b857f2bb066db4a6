"""Vector packing: every id lies in one piece, limits hold, no padding is needed."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from churnkit.llm import instruct_packing as p
from churnkit.llm.queries import op12_vector_packing, tokenizer_path


def examples(sizes):
    """Examples from (prompt ids, response ids)."""
    return [p.Example(i, np.arange(a + b, dtype="<u4").tobytes(), max(a, 1)) for i, (a, b) in enumerate(sizes)]


def check(sizes, limits, window):
    spans, lengths = defaultdict(list), []
    for pieces in p.sequences(iter(examples(sizes)), limits, window):
        total = sum(stop - start for _, start, stop in pieces)
        assert 0 < total <= limits.tokens and total & (total - 1) == 0
        assert len(pieces) <= limits.segments and sum(e.loss(a, b) for e, a, b in pieces) <= limits.loss
        assert all(a < b for _, a, b in pieces) and len({e.key for e, _, _ in pieces}) == len(pieces)
        for e, a, b in pieces:
            spans[e.key].append((a, b))
        lengths.append(total)
    for i, (a, b) in enumerate(sizes):
        got = sorted(spans[i])
        assert [s for s, _ in got] == [0, *[e for _, e in got[:-1]]] and got[-1][1] == a + b
    return lengths


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 90), st.integers(1, 90)), max_size=60), st.integers(1, 9), st.integers(1, 64),
       st.integers(1, 20))
def test_any_examples_under_any_limits(sizes, segments, loss, window):
    check(sizes, p.Limits(64, segments, loss), window)


def test_sequences_are_full_but_for_the_last_ones():
    rng = random.Random(7)
    sizes = [(0, rng.choice([3, 40, 700, 9000])) for _ in range(800)]
    lengths = check(sizes, p.Limits(4096, 128, 4096), 256)
    assert sum(n == 4096 for n in lengths) >= len(lengths) - 13


def test_each_limit_binds():
    tiny = check([(0, 4)] * 64, p.Limits(64, 4, 64), 16)
    assert set(tiny) == {16}  # four segments of four ids
    talk = check([(12, 4)] * 64, p.Limits(64, 64, 8), 16)
    assert sum(talk) == 1024 and len(talk) > 16  # two responses in each, so the last ones are not full


def test_dot_product_prefers_what_uses_the_room_that_is_left():
    """After a response-heavy start little loss is left: a prompt-heavy example goes in before an equally long one."""
    packer = p.VectorPacker(p.Limits(64, 8, 32))
    for e in examples([(0, 31), (30, 1), (2, 29)]):
        packer.add(e)
    first = packer.sequence()
    assert [e.key for e, _, _ in first][:2] == [0, 1] or [e.key for e, _, _ in first][:2] == [2, 1]


def test_bad_limits():
    with pytest.raises(ValueError):
        p.VectorPacker(p.Limits(100))


def verify(rows, encoded, ids_of=None):
    """Rows of pack_examples against the whole id lists (by doc_id, each once)."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    assert set(by_doc) == set(encoded)
    for key, got in by_doc.items():
        ids, at = encoded[key], 0
        for r in sorted(got, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            at += r["length"]
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"]:at], "<u4").tobytes())
        assert at == len(ids)
    for got in by_sequence.values():
        at = 0
        for r in sorted(got, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 4096 and at & (at - 1) == 0


def test_query_keeps_every_id(spark, small):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    encoded = {k: tok.encode(t or "", add_special_tokens=False).ids + [2] for k, t in small[1].items()}
    rows = op12_vector_packing(spark, "/root/testdata/sf0.001").collect()
    verify(rows, encoded)
    assert all(r["loss_tokens"] == r["length"] - (r["start"] == 0) for r in rows)


def test_conversations_with_prompts(spark):
    """Each reply is an example whose prompt is the turn before it; prompts bear no loss."""
    from tokenizers import Tokenizer

    turns = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    reply = turns.where("turn % 2 = 1").selectExpr("conv_id", "turn", "text as response")
    asked = turns.selectExpr("conv_id as c", "turn + 1 as t", "text as prompt")
    pairs = reply.join(asked, (reply.conv_id == asked.c) & (reply.turn == asked.t)).selectExpr(
        "conv_id || ':' || turn as name", "prompt", "response").dropDuplicates(["name"])
    texts = {r["name"]: (r["prompt"], r["response"]) for r in pairs.collect()}
    tok = Tokenizer.from_file(tokenizer_path())

    def ids(text):
        return tok.encode(text or "", add_special_tokens=False).ids

    df = spark.createDataFrame([(k, *v) for k, v in texts.items()], "name string, prompt string, response string")
    rows = p.pack_examples(df, tokenizer_path(), "name", "response", "prompt", limits=p.Limits(4096, 16, 512),
                           keep_ids=True).collect()
    verify(rows, {k: ids(a) + ids(b) + [2] for k, (a, b) in texts.items()})
    load = defaultdict(lambda: [0, 0])
    for r in rows:
        start = max(r["start"], max(len(ids(texts[r["doc_id"]][0])), 1))
        assert r["loss_tokens"] == max(0, r["start"] + r["length"] - start) and len(r["ids"]) == r["length"]
        load[r["sequence_id"]][0] += 1
        load[r["sequence_id"]][1] += r["loss_tokens"]
    assert all(n <= 16 and loss <= 512 for n, loss in load.values())


def test_odd_rows_and_clashing_columns(odd, clashing, empty):
    assert p.pack_examples(empty, tokenizer_path()).collect() == []
    rows = p.pack_examples(odd, tokenizer_path()).collect()
    assert sum(r["length"] for r in rows if r["doc_id"] == 2) == 2 * next(r["doc_tokens"] for r in rows if r["doc_id"] == 2)
    assert [(r["start"], r["length"], r["doc_tokens"], r["loss_tokens"]) for r in rows if r["doc_id"] == 3] == [(0, 1, 1, 0)]
    again = p.pack_examples(clashing, tokenizer_path()).collect()
    assert sorted(map(repr, rows)) == sorted(map(repr, again))
    text_ids = p.pack_examples(odd.selectExpr("'n' || doc_id as doc_id", "text"), tokenizer_path()).collect()
    assert len(text_ids) == len(rows)
