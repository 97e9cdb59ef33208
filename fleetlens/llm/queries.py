"""The named queries of the corpus operators over the given tables, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm import alignment, chunks, fingerprints, leaks, licences, mixing, negatives, quality, rollups, similarity, suffixes, templates, toxicity
from fleetlens.llm.tables import documents, whole_text
from fleetlens.session import cut_lineage, shared_folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


@query("op1_page_texts")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.extract_text(documents(spark, sf_dir, "pages")).select(
        "page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def held_out(key: str = "doc_id"):
    return F.crc32(F.col(key).cast("string")) % 4 == 2


@query("op2_toxicity")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    labels = documents(spark, sf_dir, "labels").filter(~held_out())
    model = toxicity.fit_toxicity(docs, labels)
    scored = docs.select("doc_id", held_out().alias("held_out"), toxicity.toxicity_score(model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


@query("op3_benchmark_leaks")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = leaks.find_leaks(docs, documents(spark, sf_dir, "benchmark"))
    return docs.select("doc_id", F.monotonically_increasing_id().alias("row")).join(found, "row").select(
        "doc_id", F.col("item").alias("item_id"), "cosine", "shared", "answer")


@query("op4_repeated_bytes")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digest_repeats(documents(spark, sf_dir))


@query("op5_token_totals")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents are inserted; then those of low quality are deleted and toxic ones revised to lose their digits; the
    second batch is delivered twice.  A document whose label rows ask for several changes gets one: a delete before a revision."""
    digits = F.when(F.col("text").rlike("[0-9]"), F.regexp_replace("text", "[0-9]", ""))
    versions = {f"{name}@1": rollups.token_count(f"{rollups.TOKENIZER_FOLDER}/{name}.tiktoken") for name in ("byte_bpe_50k", "byte_bpe_multi_50k")}
    # Every text is counted where it is read, as it is and as it would be revised; from here on only counts move.
    counts = cut_lineage(documents(spark, sf_dir).select("doc_id", "source", "lang", F.explode(F.array(*[
        F.struct(F.lit(v).alias("tokenizer"), count(whole_text()).alias("tokens"), count(digits).alias("revised"))
        for v, count in versions.items()])).alias("c")).select("doc_id", "source", "lang", "c.*"))
    first = counts.select(*rollups.KEYS, F.lit("insert").alias("op"), F.lit(None).cast("bigint").alias("before"), F.col("tokens").alias("after"))
    op = F.when(F.col("quality") == 0, "delete").when(F.col("toxic") == 1, "revise")
    asked = rollups.one_op_per_document(documents(spark, sf_dir, "labels").select("doc_id", op.alias("op")), "doc_id")
    second = counts.join(asked, "doc_id").select(
        *rollups.KEYS, "op", F.col("tokens").alias("before"), F.coalesce("revised", "tokens").alias("after"))
    totals = rollups.TokenTotals(spark, shared_folder(spark, "token-totals"))
    totals.commit("1-load", rollups.deltas_of_counts(first))
    for _ in range(2):
        totals.commit("2-clean", rollups.deltas_of_counts(second))
    return totals.totals()


@query("op6_similar_documents")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.near_duplicates(documents(spark, sf_dir)).select("doc_id", "class_id", "n_links")


@query("op7_source_mix", r"""
with sized as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size from documents),
sources as (
  select source, sum(size)::bigint as source_size,
         ((row_number() over (order by source nulls last) - 1) % 3 + 1)::double as weight
  from sized group by source),
caps as (
  select *, 3.0::double * source_size as cap, 3.0::double * source_size / weight as ratio,
         sum(source_size) over ()::double as total from sources where source_size > 0),
levels as (
  select *, coalesce(sum(cap) over before, 0) as clamped,
         sum(weight) over () - coalesce(sum(weight) over before, 0) as open_weight
  from caps window before as (order by ratio, source nulls last rows between unbounded preceding and 1 preceding)),
level as (
  select min_by((total - clamped) / open_weight, ratio) as level from levels
  where (total - clamped) / open_weight <= ratio),
targets as (
  select source, source_size,
         case when source_size > 0 then least(weight * (select level from level), 3.0::double * source_size)
              else 0.0::double end as target from sources),
placed as (
  select d.doc_id, d.size, t.source_size, t.target,
         case when t.source_size > 0 then floor(t.target / t.source_size) else 0 end as whole,
         coalesce(sum(d.size) over (partition by d.source order by md5(concat_ws('|', 'mix', d.doc_id::varchar)), d.size
                                    rows between unbounded preceding and 1 preceding), 0) as before
  from sized d join targets t on d.source is not distinct from t.source)
select doc_id, size::bigint as size, source_size, target,
       (whole * size + greatest(0, least(size, floor(target - whole * source_size + 0.5)::bigint - before)))::bigint as taken
from placed
""")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


@query("op8_quality")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = quality.fit_quality(docs, documents(spark, sf_dir, "labels").filter(~held_out()))
    scored = quality.with_quality(docs, model).select("doc_id", held_out().alias("held_out"), "score", "text_score", "meta_score")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


@query("op9_repeated_passages")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).withColumn("n_bytes", F.octet_length(whole_text()).cast("long"))
    return chunks.remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "text")


@query("op10_fingerprints")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", whole_text().alias("text"))
    pairs = fingerprints.with_next_text(docs, "next_text").withColumn(
        "edited", fingerprints.edited_text("text", "next_text"))
    for text, sketch in (("text", "own"), ("edited", "changed"), ("next_text", "following")):
        pairs = fingerprints.with_sketch(pairs, text, sketch)
    return pairs.select(
        "doc_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        fingerprints.as_text("own").alias("fingerprint"), fingerprints.as_text("changed").alias("edited_fingerprint"),
        fingerprints.jaccard("own", "changed").alias("near_edited"),
        fingerprints.jaccard("own", "following").alias("near_next"))


@query("op11_token_links")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.Alignment(documents(spark, sf_dir), f"{rollups.TOKENIZER_FOLDER}/byte_bpe_50k.json",
                               f"{rollups.TOKENIZER_FOLDER}/piece_bpe_32k.model").documents


@query("op12_hard_negatives", """
with valid as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
         list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v
  from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
  select a.vec_id as anchor_id, a.label as anchor_label, c.vec_id as other, c.label,
         list_inner_product(a.v::double[], c.v::double[])::bigint as score
  from valid a, valid c where a.vec_id % 50 = 0),
positives as (
  select anchor_id, anchor_label, other as positive_id, score as positive_score from scored
  where label = anchor_label and other <> anchor_id
  qualify row_number() over (partition by anchor_id order by score desc, other) <= 5)
select anchor_id, positive_id, row_number() over w::int as rank, s.other as negative_id, positive_score, s.score as negative_score
from positives p join scored s using (anchor_id)
where s.label <> p.anchor_label and 50 * positive_score <= 100 * s.score and 100 * s.score <= 95 * positive_score
window w as (partition by anchor_id, positive_id order by s.score desc, s.other)
qualify row_number() over w <= 3
""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = documents(spark, sf_dir, "embeddings").withColumn("label", label)
    return negatives.hard_negatives(vectors, F.col("vec_id") % 50 == 0)


@query("op13_licence_places")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licences.scan_licences(documents(spark, sf_dir))
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return found.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min("base.start").alias("first_word"),
        F.array_max("base.start").alias("last_word"), joined(F.col("base.label")).alias("base_labels"),
        joined(F.concat("base.label", "finds.label")).alias("labels"), F.coalesce(F.array_max("finds.share"), F.lit(0.0)).alias("score"))
