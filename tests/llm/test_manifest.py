"""The manifest against hashing every row by hand."""

import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from churnkit.llm import manifest as m
from churnkit.llm.queries import op11_merkle_manifest
from tests.llm.conftest import SCHEMA, odd_rows


def H(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(row, more=0):
    doc_id, text, lang, source, n_chars = row
    if n_chars is not None:
        n_chars += more
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)])


def levels_of(nodes, fanout):
    rows = [nodes]
    while len(rows[-1]) > 1:
        rows.append([H(*rows[-1][i:i + fanout]) for i in range(0, len(rows[-1]), fanout)])
    return rows


def steps(rows, i, fanout):
    out = []
    for row in rows[:-1]:
        s = i - i % fanout
        out.append(("".join(row[s:i]), "".join(row[i + 1:s + fanout])))
        i //= fanout
    return out


def brute(rows, fanout=2):
    """Sorted result rows; rows are (doc_id, text, lang, source, n_chars)."""
    trees = {}
    for r in rows:
        trees.setdefault(r[2], []).append((r[0] is not None, r[0], leaf(r), r))
    names = sorted(trees, key=lambda v: (v is not None, (v or "").encode()))
    built = {}
    for name in names:
        ordered = sorted(trees[name], key=lambda t: (t[0], t[1] if t[0] else 0, t[2]))
        built[name] = ordered, levels_of([t[2] for t in ordered], fanout)
    top = levels_of([built[name][1][-1][0] for name in names], fanout)
    root = top[-1][0] if names else None
    out = []
    for g, name in enumerate(names):
        ordered, rows_ = built[name]
        for i, (_, doc_id, digest, row) in enumerate(ordered):
            path = steps(rows_, i, fanout) + steps(top, g, fanout)
            tampered = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0
            at = leaf(row, 1) if tampered else digest
            for left, right in path:
                at = H(left, at, right)
            out.append((doc_id, name, i, digest, rows_[-1][0], root, H(*[x for s in path for x in s]), at, at == root))
    return sorted(out, key=repr)


def run(df, **kw):
    changed = (F.coalesce(F.pmod(F.crc32(df["doc_id"].cast("string")), F.lit(7)) == 0, F.lit(False)),
               {"n_chars": df["n_chars"].cast("decimal(20,0)") + 1})
    return sorted((tuple(r) for r in m.manifest(df, changed=changed, **kw).collect()), key=repr)


@pytest.mark.parametrize("fanout, levels", [(2, 1), (2, 3), (3, 2), (2, 9)])
def test_equals_hashing_by_hand(small, fanout, levels):
    docs, _ = small
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    got = run(docs, fanout=fanout, levels=levels)
    assert got == brute(rows, fanout)
    assert any(not r[-1] for r in got) and any(r[-1] for r in got)


@pytest.mark.parametrize("levels", [1, 4])
def test_odd_rows(odd, clashing, levels):
    rows = odd_rows() + [(2**63 - 1, "end", None, "x", 2**63 - 1)] + [(20 + i, f"t{i}", f"l{i}", None, i) for i in range(9)]
    df = odd.sparkSession.createDataFrame(rows, SCHEMA)
    assert run(df, levels=levels) == brute(rows)
    assert run(clashing) == brute(odd_rows())


def test_small_tables(spark, empty):
    assert run(empty) == []
    one = [(7, "lone", "en", "a", 4)]
    got = run(spark.createDataFrame(one, SCHEMA))
    assert got == brute(one) and got[0][3] == got[0][4] == got[0][5] and got[0][6] == H("")


def test_many_copies_of_one_row_and_few_partitions(spark):
    rows = [(5, "same", "en", "a", 4)] * 300 + [(i, f"t{i}", "fr", "b", 3) for i in range(41)]
    assert run(spark.createDataFrame(rows, SCHEMA).repartition(5), levels=3) == brute(rows)


def test_ids_may_be_text(odd):
    got = m.manifest(odd.selectExpr("'n' || doc_id as doc_id", "text", "lang", "source", "n_chars")).collect()
    assert len(got) == odd.count() and all(r["verified"] for r in got)


def test_query_checks_tampered_rows(spark):
    rows = op11_merkle_manifest(spark, "/root/testdata/sf0.001").collect()
    for r in rows:
        assert r["verified"] == (zlib.crc32(str(r["doc_id"]).encode()) % 7 != 0) == (r["folded_root"] == r["root"])
