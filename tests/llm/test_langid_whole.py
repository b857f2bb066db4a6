"""The language model and its least scores come from all labelled rows."""

import random

import numpy as np
from pyspark.sql import functions as F

from churnkit.llm import langid

WORDS = {"en": ["the", "house", "which", "though", "wind", "why"], "de": ["der", "zug", "nicht", "jetzt", "zwei", "auch"],
         "fr": ["quelle", "oiseau", "beaucoup", "eux", "rue", "lequel"]}
SCHEMA = "doc_id bigint, text string, lang string"


def rows_of(counts, seed=1):
    """Texts of one language's words; every fortieth of a language holds nearly as many of another's."""
    rng, out = random.Random(seed), []
    for lang, n in counts.items():
        other = "de" if lang == "en" else "en"
        for i in range(n):
            mixed = 7 if i % 40 == 20 else 0
            words = rng.choices(WORDS[lang], k=12 - mixed // 2) + rng.choices(WORDS[other], k=mixed)
            rng.shuffle(words)
            out.append((len(out), " ".join(words), lang))
    return out


def test_rows_unlike_a_sample_are_kept(spark):
    docs = spark.createDataFrame(rows_of({"en": 400, "de": 400}), SCHEMA)
    model, least = langid.fit_language_filter(docs, per_lang=30)
    predicted = langid.predict_languages(docs, model).join(docs, "doc_id").where("lang = lang_pred").count()
    assert predicted > 790 and langid.keep_languages(docs, model, min_score=least).count() >= predicted - 2


def test_every_row_is_in_a_part_and_parts_are_bounded(spark):
    counts = {"en": 900, "de": 300, "fr": 25}
    docs = spark.createDataFrame(rows_of(counts), SCHEMA)
    got, parts = langid.dealt(langid.labelled_rows(docs, "doc_id", "text", "lang"), per_lang=50, least=20)
    assert parts == 13
    per = {(r["part"], r["lang"]): r["count"] for r in got.groupBy("part", "lang").count().collect()}
    assert {p for p, _ in per} == set(range(parts)) and len(per) == 3 * parts and max(per.values()) < 130
    totals = {v: sum(n for (_, w), n in per.items() if w == v) for v in counts}
    assert totals["en"] == 900 and totals["de"] == 300 and totals["fr"] == 25 * parts  # a rare language is in all parts
    assert got.select("lang", "text").distinct().count() == docs.select("lang", "text").distinct().count()


def test_the_model_is_the_mean_over_the_parts(spark):
    docs = spark.createDataFrame(rows_of({"en": 200, "de": 120, "fr": 60}), SCHEMA)
    rows = langid.labelled_rows(docs, "doc_id", "text", "lang")
    got, parts = langid.dealt(rows, per_lang=40)
    models = langid.fit_parts(rows, 40, folds=3)
    assert parts == 5 and set(models) == {-1, 0, 1, 2}
    weight, bias = {}, {}
    for p in range(parts):
        some = got.where(F.col("part") == p).toArrow()
        x = langid.features(*langid.utf8(some["text"])).astype(np.float16)
        for f in models:
            use = None if f < 0 else np.array([langid.text_fold(r, 3) != f for r in x])
            one = langid.fit_nodes(x, some["lang"].to_pylist(), use)
            weight.setdefault(f, []).append(one.within["germanic"].weight)
            bias.setdefault(f, []).append(one.family.bias)
    for f, m in models.items():
        assert np.allclose(m.within["germanic"].weight, np.mean(weight[f], axis=0), atol=1e-4)
        assert np.allclose(m.family.bias, np.mean(bias[f], axis=0), atol=1e-4)


def test_lower_quantiles_are_exact(spark):
    rng = np.random.default_rng(4)
    scores = {"a": rng.random(5000), "b": np.repeat(rng.random(3), 700), "c": rng.random(1) * 1e-300, "d": np.zeros(10),
              "e": np.concatenate([rng.random(3000) * 1e-12, [0.0, 1.0]])}
    frame = spark.createDataFrame([(v, float(s)) for v, some in scores.items() for s in some], "lang string, score double")
    for q in (0.0, 0.001, 0.37, 1.0):
        assert langid.lower_quantiles(frame, q) == {v: float(np.quantile(s, q, method="lower")) for v, s in scores.items()}


def test_a_language_without_company_in_a_part(spark):
    """Repeated rows of one id lie in one group: other parts then lack the language."""
    docs = spark.createDataFrame(rows_of({"de": 150}) + [(-1, "why the wind though", "en")] * 450, SCHEMA)
    model, least = langid.fit_language_filter(docs, per_lang=50)
    assert set(least) == {"en", "de"} and {r["lang_pred"] for r in langid.predict_languages(docs, model).collect()} == {"en", "de"}
    assert langid.fit_language_filter(docs.where("lang is null")) == (None, {})
