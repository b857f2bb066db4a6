"""The pipeline, stage by stage, against brute force."""

import corpus_pipeline as cp
from churnkit.llm import decontaminate, packing, pii, queries
from tests.llm import brute
from tests.llm.conftest import by_id
from tests.llm.test_operators import check_packing

SF = "/root/testdata/sf0.001"


def test_stages_on_the_documents(spark, small, tmp_path):
    docs, texts = small
    stages = dict(cp.STAGES)
    assert list(stages) == ["language", "near_duplicates", "decontamination", "personal_data", "packing"]

    one = stages["language"](spark, docs, SF)
    assert one.columns == docs.columns
    lettered = {i: t for i, t in texts.items() if any(map(str.isalpha, t))}
    assert by_id(one.collect(), "text") == sorted(lettered.items(), key=repr)

    two = stages["near_duplicates"](spark, one, SF)
    assert two.columns == docs.columns
    groups = brute.jaccard_components(lettered, 5, 80)
    kept = {i: t for i, t in lettered.items() if groups[i][1] == i}
    assert by_id(two.collect(), "text") == sorted(kept.items(), key=repr)

    three = stages["decontamination"](spark, two, SF)
    assert three.columns == docs.columns
    items = [brute.passage_words(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = {}
    for i, t in kept.items():
        b = brute.passage_words(t)
        seeds = set(zip(b, b[1:], b[2:], b[3:]))
        near = [a for a in items if len(a) >= decontaminate.MIN_WORDS
                and sum(s in seeds for s in zip(a, a[1:], a[2:], a[3:])) * 4 >= decontaminate.THRESHOLD * len(a)]
        if not any(brute.tiling(a, b, 4) >= decontaminate.THRESHOLD * len(a) for a in near):
            clean[i] = t
    got = three.collect()
    assert by_id(got, "text") == sorted(clean.items(), key=repr)

    four = stages["personal_data"](spark, three, SF)
    assert four.columns == docs.columns
    safe = {i: pii.redact(t, pii.find_spans(t)) for i, t in clean.items()}
    rows = four.collect()
    assert by_id(rows, "text") == sorted(safe.items(), key=repr)
    assert all(brute.base_spans(r["text"]) == [] for r in rows)
    assert all(r["n_chars"] == len(r["text"]) for r in rows if safe[r["doc_id"]] != clean[r["doc_id"]])

    five = stages["packing"](spark, four, SF)
    check_packing(five.collect(), safe, packing.tokenizer(queries.tokenizer_path()))


def test_language_stage_rejects_what_was_not_learned(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    other = {
        -1: "Съешь же ещё этих мягких французских булок, да выпей чаю. Сегодня хорошая погода.",
        -2: "今天天气很好我们一起去公园散步然后回家吃饭", -3: "Η γρήγορη καφέ αλεπού πηδά πάνω από το τεμπέλικο σκυλί",
        -4: "Hızlı kahverengi tilki tembel köpeğin üzerinden atlar ve ormana koşar",
        -5: "Con cáo nâu nhanh nhẹn nhảy qua con chó lười biếng và chạy vào rừng", -6: "xqzv kjwq zzxk vqpj wkxz qqjv xzkw",
    }
    strange = spark.createDataFrame([(i, t, None) for i, t in other.items()], docs.schema)
    kept = {r["doc_id"] for r in dict(cp.STAGES)["language"](spark, docs.unionAll(strange), SF).collect()}
    lettered = {r["doc_id"] for r in docs.collect() if any(map(str.isalpha, r["text"] or ""))}
    assert not kept & set(other)
    assert kept <= lettered and len(kept) >= 0.995 * len(lettered)


def test_run_equals_its_stages(spark, small):
    docs, _ = small
    step = docs
    for _, f in cp.STAGES:
        step = f(spark, step, SF)
    cols = ("piece", "start", "length", "ids_crc32")
    assert by_id(cp.run(spark, SF).collect(), *cols) == by_id(step.collect(), *cols)


def test_stages_on_odd_and_empty_tables(spark, odd, empty, clashing):
    for name, f in cp.STAGES:
        assert f(spark, empty, SF).collect() == []
        out = f(spark, clashing, SF)
        if name != "packing":
            assert out.columns == clashing.columns
        ids = {r["doc_id"] for r in out.collect()}
        assert 1 in ids and (name in ("language",) or {None, 3, 4, 5} <= ids)
        assert name != "near_duplicates" or 2 not in ids


def test_queries_are_registered():
    import __spark_entry__ as e

    names = e.queries()
    assert "pipeline" in names and {f"op{n}_" for n in range(1, 11)} == {x.split("_")[0] + "_" for x in names if x.startswith("op")}
