"""Every operator on nulls, empty and very long texts, repeated rows, empty tables and clashing columns."""

import pytest

from churnkit.llm import (cotraining, decontaminate, jaccard, langid, licenses, packing, pii, quality_rules, repeats,
                          sharding)
from churnkit.llm.queries import tokenizer_path
from tests.llm.conftest import odd_rows


def languages(df):
    return langid.predict_languages(df, langid.fit_language_model(df))


def quality(df):
    return cotraining.score_quality(df, cotraining.fit_quality(df, df.selectExpr("doc_id", "int(n_chars > 20) as quality")))


def items(df):
    return df.selectExpr("doc_id as item_id", "text")


OPERATORS = {
    "packing": lambda df: packing.pack_documents(df, tokenizer_path()),
    "licenses": licenses.license_scan,
    "repeats": repeats.remove_repeats,
    "languages": languages,
    "rules": quality_rules.repetition,
    "classifier": quality,
    "contamination": lambda df: decontaminate.contamination(df, items(df)),
    "sharding": lambda df: sharding.place(df, ["a", "b", "c"], slots=101),
    "jaccard": jaccard.jaccard_components,
    "pii": pii.pii_spans,
}
ONE_ROW_EACH = set(OPERATORS) - {"packing", "contamination"}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(name, empty):
    assert OPERATORS[name](empty).collect() == []


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows_and_clashing_columns(name, odd, clashing):
    plain = OPERATORS[name](odd)
    rows = plain.collect()
    if name in ONE_ROW_EACH:
        assert sorted(map(repr, (r["doc_id"] for r in rows))) == sorted(map(repr, (r[0] for r in odd_rows())))
    again = OPERATORS[name](clashing)
    assert again.columns == plain.columns
    order = [c for c in plain.columns if c not in ("sequence_id", "offset")]
    assert sorted(map(repr, again.select(*order).collect())) == sorted(map(repr, plain.select(*order).collect()))


def test_languages_of_odd_rows(odd):
    got = {r["doc_id"]: r for r in languages(odd).collect() if r["doc_id"] is not None}
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (3, 4, 5, 7))
    assert all(got[i]["lang_pred"] != "und" and 0 <= got[i]["score"] <= 1 for i in (1, 2, 6, 8, 9, 10, 11))


def test_components_of_odd_rows(odd):
    got = {}
    for r in jaccard.jaccard_components(odd).collect():
        got.setdefault(r["doc_id"], set()).add((r["n_shingles"], r["component_id"]))
    assert got[1] == got[2] == {(267, 1)}
    assert got[3] == {(0, 3)} and got[4] == {(0, 4)} and got[5] == {(0, 5)}
    assert got[12] == got[13] == {(1, 12)}
    assert {c for _, c in got[None]} == {None}
    assert got[9] == {(1, 9)}


def test_repeated_rows_lose_what_they_share(odd):
    got = {(r["doc_id"], r["n_bytes"], len(r["kept"])) for r in repeats.remove_repeats(odd).collect()}
    size = len(odd_rows()[0][1])
    assert (1, size, 0) in got and (2, size, 0) in got  # the null-id row holds the same text and a tail
    assert (None, size + 5, 5) in got and (8, 6000, 0) in got and (9, 180000, 0) in got and (10, 70000, 0) in got


def test_ids_may_be_text(odd):
    named = odd.selectExpr("'n' || doc_id as doc_id", "text", "lang", "source", "n_chars")
    for name in ("packing", "licenses", "repeats", "rules", "contamination", "sharding", "pii"):
        assert OPERATORS[name](named).count() == OPERATORS[name](odd).count()


def test_language_features_stay_small_on_many_short_texts():
    """10,000 texts of 150 characters take under 100 MB beyond the texts."""
    import tracemalloc

    import pyarrow as pa

    texts = [f"some short words number {i} again and again " * 4 for i in range(10_000)]
    model = langid.fit_nodes(langid.features(*langid.utf8(pa.array(texts[:40]))), ["en", "de"] * 20)
    column = pa.array(texts)
    tracemalloc.start()
    lang, score = langid.predict_batch(model, column)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(lang) == len(score) == 10_000 and peak < 100 << 20
