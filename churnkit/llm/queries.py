"""Registered queries of the text operators: each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from churnkit.llm import (cotraining, decontaminate, instruct_packing, jaccard, langid, lexical, licenses, manifest, packing,
                          pii, quality_rules, repeats, sharding)
from churnkit.llm.textkit import held_out

SHARDS = [f"shard-{i:04d}" for i in range(1024)]
TOKENIZER_FILE = "word_bpe_49k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER_FILE)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its confirmed notices and the licenses they name."""
    found = licenses.license_scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.size("found").cast("bigint").alias("n_notices"),
                        F.array_join(F.array_sort(F.array_distinct("found.license")), ",").alias("licenses"),
                        F.array_join(F.transform("found", lambda f: F.concat_ws(
                            ":", f["license"], f["start"].cast("string"), f["end"].cast("string"),
                            (f["missing"] + f["changed"] + f["added"]).cast("string"))), ",").alias("notices"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = repeats.remove_repeats(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).cast("bigint").alias("n_removed"),
                      F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit_language_model(docs.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull()))
    return langid.predict_languages(docs, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.repetition(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return cotraining.score_quality(docs, cotraining.fit_quality(docs, table(spark, sf_dir, "labels")))


def op7_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(table(spark, sf_dir, "documents"), SHARDS)


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.pii_spans(table(spark, sf_dir, "documents"))

    def text_of(kinds):
        parts = F.filter("found", lambda s: s["kind"].isin(*kinds))
        return F.array_join(F.transform(parts, lambda s: F.concat_ws(
            ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count_of(kind):
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    counts = [count_of(k) for k in pii.BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(text_of(pii.BASE_KINDS), 256).alias("base_sha256"),
                        text_of(pii.KINDS).alias("spans"),
                        F.array_join(F.transform("found", lambda s: F.round(s["score"] * 100).cast("int").cast("string")), ",").alias("scores"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where 7 divides crc32(doc_id), the row comes back with 1 more in n_chars."""
    docs = table(spark, sf_dir, "documents")
    tampered = F.coalesce(F.pmod(F.crc32(docs["doc_id"].cast("string")), F.lit(7)) == 0, F.lit(False))
    # decimals, as the largest long has no successor
    return manifest.manifest(docs, changed=(tampered, {"n_chars": docs["n_chars"].cast("decimal(20,0)") + 1}))


def op12_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents are examples without a prompt: all ids but the first bear loss, so the limit on segments is the one
    that binds beside that on tokens."""
    return instruct_packing.pack_examples(table(spark, sf_dir, "documents"), tokenizer_path())


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.lexical_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (
    op1_packing, op2_licenses, op3_suffix_dedup, op4_language, op5_quality_rules, op6_quality_classifier,
    op7_contamination, op8_sharding, op9_ngram_jaccard, op10_pii, op11_merkle_manifest,
    op12_vector_packing, op13_lexical_search)}

# Fixed values of the manifest: H is SHA-256 in lowercase hex; crc32 is worked out from its polynomial.
MERKLE_SQL = """
with recursive codes as (
  select list_transform(range(256), lambda b: list_reduce(range(8), lambda c, i: case when c & 1 = 1 then xor(c >> 1, 3988292384)
         else c >> 1 end, b::bigint)) as tab),
rows as (
  select d.*, row_number() over () as k, case when doc_id is null then null else xor(4294967295, list_reduce(
         list_transform(string_split(doc_id::varchar, ''), lambda c: ord(c)::bigint),
         lambda a, c: xor(a >> 8, tab[(xor(a, c) & 255) + 1]), 4294967295::bigint)) end as crc from documents d, codes),
fields as (
  select *, coalesce(octet_length(encode(doc_id::varchar)) || ':' || doc_id, '-')
         || coalesce(octet_length(encode(source)) || ':' || source, '-')
         || coalesce(octet_length(encode(lang)) || ':' || lang, '-') as a,
         coalesce(octet_length(encode(text)) || ':' || text, '-') as z from rows),
leaves as (
  select k, doc_id, lang, sha256(a || coalesce(length(n_chars::varchar) || ':' || n_chars, '-') || z) as leaf,
         case when crc % 7 = 0 then sha256(a || coalesce(length((n_chars::hugeint + 1)::varchar) || ':' || (n_chars::hugeint + 1), '-')
         || z) end as changed from fields),
-- level by level: node number, digest, nodes left
low(lang, lvl, pos, h, n) as (
  select lang, 0, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1, leaf,
         count(*) over (partition by lang) from leaves
  union all
  select lang, lvl + 1, pos // 2, sha256(string_agg(h, '' order by pos)), (any_value(n) + 1) // 2
  from low where n > 1 group by lang, lvl, pos // 2),
sub as (select lang, h, lvl, row_number() over (order by lang nulls first) - 1 as pos, count(*) over () as n from low where n = 1),
high(lvl, pos, h, n) as (
  select 0, pos, h, n from sub
  union all
  select lvl + 1, pos // 2, sha256(string_agg(h, '' order by pos)), (any_value(n) + 1) // 2 from high where n > 1 group by lvl, pos // 2),
placed as (
  select *, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as pos from leaves),
-- siblings of every leaf: first in the tree of its language, then above it
steps as (
  select p.k, l.lvl as step, l.h as h, l.pos as pos from placed p join low l
    on l.lang is not distinct from p.lang and l.pos = xor(p.pos >> l.lvl, 1)
    and (l.n > 1)
  union all
  select p.k, 1000 + g.lvl, g.h, g.pos from placed p join sub s on s.lang is not distinct from p.lang
    join high g on g.pos = xor(s.pos >> g.lvl, 1) and g.n > 1),
walk as (
  select p.k, l.lvl as step, (p.pos >> l.lvl) as pos from placed p join (select distinct lang, lvl from low where n > 1) l
    on l.lang is not distinct from p.lang
  union all
  select p.k, 1000 + g.lvl, (s.pos >> g.lvl) from placed p join sub s on s.lang is not distinct from p.lang,
    (select distinct lvl from high where n > 1) g),
paths as (
  select w.k, list({'l': case when s.pos < w.pos then s.h else '' end, 'r': case when s.pos > w.pos then s.h else '' end} order by w.step) as path
  from walk w left join steps s on s.k = w.k and s.step = w.step group by w.k),
proofs as (
  select p.*, sub.h as subroot, (select h from high where n = 1) as root, coalesce(t.path, []) as path
  from placed p join sub on sub.lang is not distinct from p.lang left join paths t on t.k = p.k),
folds as (
  select *, sha256(list_aggregate(list_concat([''], list_transform(path, lambda s: coalesce(s.l, '') || coalesce(s.r, ''))), 'string_agg', '')) as proof_sha256,
         list_reduce(list_transform(path, lambda s: struct_pack(l := coalesce(s.l, ''), r := coalesce(s.r, ''))),
           lambda acc, s: struct_pack(l := sha256(s.l || acc.l || s.r), r := ''),
           struct_pack(l := coalesce(changed, leaf), r := '')).l as folded_root from proofs)
select doc_id, lang, pos as position, leaf, subroot, root, proof_sha256, folded_root, folded_root = root as verified from folds
"""

_TERMS = ("regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
          r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')")
LEXICAL_SQL = f"""
with d as (select row_number() over () as k, doc_id, {_TERMS} as terms from documents),
sizes as (select k, doc_id, len(terms) as n from d where len(terms) > 0),
total as (select count(*) as big_n, cast(sum(n) as bigint) as l from sizes),
weak as (select k, doc_id, 100 - 90 + (90 * n * big_n) // l as m from sizes, total),
cells as (select k, term, count(*) as tf from (select k, unnest(terms) as term from d) group by k, term),
items as (select row_number() over () as q, item_id, {_TERMS} as terms from benchmark),
asked as (select distinct q, item_id, term from (select q, item_id, unnest(terms) as term from items)),
held as (select term, count(*) as df from cells group by term),
weights as (select q, item_id, a.term, cast(floor(1000 * ln(cast(2 * big_n + 2 as double) / cast(2 * df + 1 as double))) as bigint) as w
            from asked a join held h on a.term = h.term, total),
scores as (select q, item_id, c.k, doc_id, cast(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) as bigint) as score
           from weights w join cells c on c.term = w.term join weak on weak.k = c.k group by q, item_id, c.k, doc_id)
select item_id, cast(rank as integer) as rank, doc_id, score from (
  select *, row_number() over (partition by q order by score desc, doc_id) as rank from scores where score > 0) where rank <= 10
"""

ORACLE: dict[str, str] = {"op11_merkle_manifest": MERKLE_SQL, "op13_lexical_search": LEXICAL_SQL}
