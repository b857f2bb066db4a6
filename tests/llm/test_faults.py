"""Cases that the operators once got wrong."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from churnkit.llm import cotraining, decontaminate, jaccard, licenses, pii
from churnkit.llm.textkit import hash_sample


# --- licenses ---

def names(text, templates=None):
    return [x[2] for x in licenses.Scanner(templates or licenses.TEMPLATES).scan(text)]


def test_a_deciding_number_must_agree():
    assert names("This work is licensed under the GNU General Public License, version 4.") == []
    assert names("SPDX-License-Identifier: MIT") == ["MIT"] and names("// SPDX-License-Identifier: Apache-2.0\n") == ["Apache-2.0"]
    assert names("Licensed under the BSD 4-Clause License.") == []


def test_alike_licenses_are_told_apart():
    t = licenses.TEMPLATES
    for name in ("GPL-2.0 header", "GPL-3.0 header", "LGPL-2.1 header", "LGPL-3.0 header", "AGPL-3.0 header", "BSD sentence",
                 "BSD-2-Clause grant", "BSD-3-Clause grant"):
        text = t[name][1].replace("published by", "put out by")
        assert names(text) == [t[name][0]], name
        both = t["LGPL-3.0 header"][1] + "\n" + text + "\n" + t["GPL-3.0 header"][1]
        assert names(both) == ["LGPL-3.0", t[name][0], "GPL-3.0"], name
    assert len({v for v, _ in t.values()}) >= 30


def test_templates_need_no_license_word():
    own = {"house": ("House-1", "All visitors may borrow the garden tools after asking at the gate.")}
    assert names("before. All visitors may borrow the garden tools after asking at the gate! after", own) == ["House-1"]


def test_the_ranking_decides(monkeypatch):
    """Without the sizes that the templates save nothing is looked at, and a ranking turned round gives other results."""
    text = licenses.TEMPLATES["Apache-2.0 header"][1] + " " + licenses.TEMPLATES["BSD-3-Clause grant"][1]
    s = licenses.Scanner(licenses.TEMPLATES)
    right = [x[3] for x in s.scan(text)]
    assert right == ["Apache-2.0 header", "BSD-3-Clause grant"]
    order = licenses.Scanner.ranking
    monkeypatch.setattr(licenses.Scanner, "ranking", lambda self, said: order(self, said)[::-1])
    assert [x[3] for x in s.scan(text)] != right
    monkeypatch.setattr(licenses.Scanner, "ranking", order)
    s.saved = lambda i, passage: 0
    assert list(s.scan(text)) == []


# --- decontamination ---

def test_short_items_are_reported_but_remove_nothing_else(spark):
    docs = spark.createDataFrame([(1, "the cat sat in the house"), (2, "in the"), (3, "The!"), (4, "other words"),
                                  (5, "one two three four five six seven eight nine ten and the rest")], "doc_id int, text string")
    items = spark.createDataFrame([(1, "the"), (2, "in the"), (3, "one two three four five six seven eight nine ten")], "item_id int, text string")
    hits = {(r["doc_id"], r["item_id"]) for r in decontaminate.contamination(docs, items).collect()}
    assert {(1, 1), (1, 2), (2, 2), (3, 1), (5, 1), (5, 3)} <= hits
    left = decontaminate.drop_contaminated(docs, items, drop_words=8, drop_chars=24)
    assert [r["doc_id"] for r in left.orderBy("doc_id").collect()] == [1, 4]


def test_characters_of_unspaced_scripts_count_too(spark):
    item = "東京は日本の首都です"  # ten words of one character each, but few characters
    docs = spark.createDataFrame([(1, item + "と書いてある長い文章"), (2, item)], "doc_id int, text string")
    items = spark.createDataFrame([(1, item)], "item_id int, text string")
    assert [r["doc_id"] for r in decontaminate.drop_contaminated(docs, items, drop_words=8, drop_chars=24).collect()] == [1]
    assert [r["doc_id"] for r in decontaminate.drop_contaminated(docs, items, drop_words=8, drop_chars=5).collect()] == []


# --- personal data ---

IBAN = "GB82 WEST 1234 5698 7654 32"


@pytest.mark.parametrize("text, kinds", [
    (f"the latest ship took {IBAN} away", ["iban"]), (f"a test {IBAN} of it", ["iban"]),
    ("social security order 123-45-6789", ["ssn"]), ("tax id 123-45-6789", ["ssn"]), ("number 123-45-6789", []),
    ("orderly taxidermy 123-45-6789", []), ("taxpayers 123-45-6789", [])])
def test_context_counts_in_whole_words(text, kinds):
    assert [k for k, *_ in pii.find_spans(text)] == kinds


def test_a_word_that_the_window_cuts_is_none():
    pad = "x" * (pii.CONTEXT_CHARS - len("test "))
    assert pii.score(f"latest {pad}{IBAN}", "iban", len(f"latest {pad}"), len(f"latest {pad}{IBAN}")) == 70
    assert pii.score(f"a test {pad}{IBAN}", "iban", len(f"a test {pad}"), len(f"a test {pad}{IBAN}")) == 50


# --- samples ---

@pytest.mark.parametrize("per", [1, 50, 333, 10_000])
def test_a_sample_keeps_its_bound(spark, monkeypatch, per):
    from churnkit.llm import textkit

    monkeypatch.setattr(textkit, "SLOTS", 4)
    df = spark.range(5000).select(F.when(F.col("id") < 2000, 7).otherwise(F.col("id")).alias("k"), (F.col("id") % 2).alias("g"))
    got = {r["g"]: r["count"] for r in df.where(hash_sample(df, "k", per, "g")).groupBy("g").count().collect()}
    assert all(n <= per for n in got.values())
    if per == 10_000:
        assert got == {0: 2500, 1: 2500}
    if per in (50, 333):
        assert all(n > per // 2 for n in got.values()) and len(got) == 2
    again = df.repartition(3)
    assert again.where(hash_sample(again, "k", per, "g")).count() == sum(got.values())


def test_a_sample_of_null_ids(spark):
    df = spark.range(900).select(F.when(F.col("id") > 600, F.col("id")).alias("k"))
    assert df.where(hash_sample(df, "k", 100)).count() in range(80, 101)


# --- n-gram join ---

def test_components_of_text_ids(spark):
    words = " ".join(f"w{i}" for i in range(60))
    rows = [("b", words), ("a", words + " more"), ("c", "something else altogether here"), (None, words), ("d", ""), ("b", words)]
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert sorted((r["doc_id"] or "", r["component_id"]) for r in got) == [("", None), ("a", "a"), ("b", "a"), ("b", "a"), ("c", "c"), ("d", "d")]


# --- co-training ---

def two_views(seed, n=1500, noise=1.6):
    rng = np.random.default_rng(seed)
    y = (rng.random(n) < 0.4).astype(float)
    return y, *(y[:, None] * 2 - 1 + rng.normal(0, noise, (n, 4)) for _ in range(2))


def test_rounds_beat_no_rounds_on_forty_labels():
    gain, changed = [], 0
    for seed in range(12):
        y, xt, xm = two_views(seed)
        few, pool, rest = slice(0, 40), slice(40, 900), slice(900, None)
        aside = np.arange(40) % 3 == 0
        none, some = (cotraining.co_train(xt[few], xm[few], y[few], xt[pool], xm[pool], aside, rounds=r, per_round=0.5) for r in (0, 8))
        gain.append(cotraining.log_loss(none, xt[rest], xm[rest], y[rest]) - cotraining.log_loss(some, xt[rest], xm[rest], y[rest]))
        changed += int(((none.score(xt[rest], xm[rest])[2] > 0.5) != (some.score(xt[rest], xm[rest])[2] > 0.5)).sum())
    assert np.mean(gain) > 0 and changed > 0


def test_a_round_that_does_not_help_is_not_kept():
    y, xt, xm = two_views(3, 60)
    aside = np.arange(60) % 3 == 0

    def misled(model, most):
        return {(v, c): (xt[y != c][:20], xm[y != c][:20]) for v in ("t", "m") for c in (0, 1)}

    a, b = cotraining.train(xt, xm, y, aside, misled, rounds=3), cotraining.train(xt, xm, y, aside, misled, rounds=0)
    assert np.allclose(a.score(xt, xm)[2], b.score(xt, xm)[2])


def test_all_pages_teach_and_the_surest_come_back(spark, small):
    docs, texts = small
    y, xt, xm = two_views(1, 50)
    pages = cotraining._pages(docs, "doc_id", "text", "source", "lang", "n_chars").withColumn("page", F.col("doc_id"))
    rows = pages.orderBy("page").toArrow()
    ct, cm = cotraining._views(rows.combine_chunks().to_batches()[0])
    rng = np.random.default_rng(0)
    model = cotraining.CoTrained(cotraining.Logistic(rng.normal(size=ct.shape[1]), 0.1), cotraining.Logistic(rng.normal(size=cm.shape[1]), 0.0), 0.0)
    teach = cotraining.from_pages(pages.repartition(5))
    for turn in range(2):  # pages taught in the first round do not come again
        got = teach(model, {0: 3, 1: 5})
        for v, x, c in (("t", ct, model.text), ("m", cm, model.meta)):
            order = np.lexsort((rows["page"].to_numpy(), c.margin(x)))
            if v == "t" and not turn:
                assert np.allclose(got[v, 0][0], ct[order[:3]], atol=2e-3)
            assert len(got[v, 0][0]) == len(got[v, 0][1]) == 3 and len(got[v, 1][0]) == 5
    assert sum(len(a) for a, _ in got.values()) == 16


def test_a_repeated_label_row_counts_once(spark):
    rows = [(1, "good words in a row", "a", "en", 19)] * 400 + [(2, "#### $$$ ####", "b", "en", 13)] * 300
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string, n_chars bigint")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id bigint, quality int")
    seen = []
    import churnkit.llm.cotraining as c

    collected = c._collected
    try:
        c._collected = lambda rows: seen.append(rows.count()) or collected(rows)
        c.fit_quality(docs, labels)
    finally:
        c._collected = collected
    assert seen == [2]


def test_rounding_of_scores():
    assert isinstance(pii.score("mail a@b.c", "email", 5, 10), (int, np.integer))
