"""Registered queries of the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from buildlens.llm.contamination import find_contamination
from buildlens.llm.languages import fit_languages, predict_languages
from buildlens.llm.lines import drop_repeated_lines
from buildlens.llm.merkle import fold, leaf_digest, merkle_proofs
from buildlens.llm.mixing import mix_sources
from buildlens.llm.quality import fit_quality, score_quality
from buildlens.llm.resampling import resample
from buildlens.llm.secrets import BASE_KINDS, scan_secrets
from buildlens.llm.simhash import near_components
from buildlens.llm.suffixes import remove_repeats
from buildlens.llm.topk import exact_top_k
from buildlens.llm.toxicity import ChainModel, fit_chain, score_chain
from buildlens.llm.urls import judge_urls, page_edges
from buildlens.sources.tables import read_table

URL_RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)


def op1_redirect_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages")
    judged = judge_urls(pages.select("page_id", "url"), page_edges(pages), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op3_pareto_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(read_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op4_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_components(read_table(spark, sf_dir, "documents"))
    shown = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return found.select("doc_id", shown.alias("fingerprint"), "component_id")


def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(read_table(spark, sf_dir, "embeddings"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = F.sha2(F.coalesce("text", F.lit("")), 256)
    return drop_repeated_lines(docs).select(
        "doc_id", "n_lines", "n_dropped", kept.alias("kept_sha256")
    )


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return find_contamination(docs, read_table(spark, sf_dir, "benchmark"))


def _joined(spans: Column) -> Column:
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(read_table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
    )


# Languages in which toxicity is a category of its own, before the category of any language.
TOXIC_LANGUAGES = ("en", "de", "fr", "es")
TOXIC_FROM = 0.5


def _known(labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, label) of the documents whose labels agree; null ones are left out."""
    ends = labels.select("doc_id", label).dropna().groupBy("doc_id").agg(F.min(label).alias(label), F.max(label).alias("_most"))
    return ends.filter(F.col(label) == F.col("_most")).drop("_most")


def toxicity_model(documents: DataFrame, labels: DataFrame) -> ChainModel:
    """The chain toxic_en, toxic_de, toxic_fr, toxic_es, toxic, from the labelled documents."""
    rows = documents.select("doc_id", "text", "lang").join(_known(labels, "toxic"), "doc_id")
    for lang in TOXIC_LANGUAGES:
        here = F.col("lang").eqNullSafe(F.lit(lang)) & (F.col("toxic") == 1)
        rows = rows.withColumn(f"toxic_{lang}", here.cast("int"))
    return fit_chain(rows, [*[f"toxic_{lang}" for lang in TOXIC_LANGUAGES], "toxic"])


def op2_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = toxicity_model(docs, read_table(spark, sf_dir, "labels"))
    scored = score_chain(docs, model)
    return scored.withColumn("toxic", (F.col("p_toxic") >= TOXIC_FROM).cast("int"))


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )


def op10_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = _known(read_table(spark, sf_dir, "labels"), "quality").withColumnRenamed("quality", "label")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    learn = docs.join(labels.filter(fold != 0), "doc_id")
    scored = score_quality(docs, fit_quality(learn))
    return scored.select(
        "doc_id",
        F.coalesce(fold == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op12_language_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    said = predict_languages(docs, fit_languages(docs.filter(~held_out)))
    return said.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


ROW = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tampered rows are hashed beside the originals, so that texts are read once and never move."""
    docs = read_table(spark, sf_dir, "documents").select(*ROW)
    changed = [F.translate(c, UPPER, LOWER) if c == "text" else F.col(c) for c in ROW]
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    proofs = merkle_proofs(
        docs,
        tree=F.col("source"),
        leaf=leaf_digest([F.col(c) for c in ROW]),
        order=[F.col("doc_id")],
        keep={"doc_id": F.col("doc_id"), "changed": F.when(tampered, leaf_digest(changed))},
    )
    siblings = F.array_join(F.transform("path", lambda s: F.concat(s["before"], s["after"])), "")
    now = F.coalesce(F.lower(F.hex("changed")), F.col("leaf"))
    checked = proofs.withColumns({"proof_sha256": F.sha2(siblings, 256), "folded_root": fold(now, F.col("path"))})
    verified = (F.col("folded_root") == F.col("root")).alias("verified")
    return checked.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", verified)


QUERIES = {
    "op1_redirect_url_filter": op1_redirect_url_filter,
    "op2_toxicity_chain": op2_toxicity_chain,
    "op3_pareto_mixing": op3_pareto_mixing,
    "op4_simhash_components": op4_simhash_components,
    "op5_exact_top_k": op5_exact_top_k,
    "op6_line_dedup": op6_line_dedup,
    "op7_decontamination": op7_decontamination,
    "op8_secret_scan": op8_secret_scan,
    "op9_suffix_array_dedup": op9_suffix_array_dedup,
    "op10_compression_quality": op10_compression_quality,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_language_filters": op12_language_filters,
    "op13_merkle_manifest": op13_merkle_manifest,
}
