"""Registered queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, hmm, licences, line_dedup, merkle, mixing, near_dup, oracle, page_text, periodic_runs, revisits, topk, toxicity, word_pieces


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: how far each margin is levelled, and the share of the tokens that is drawn
MIX_POWERS = {"source": 0.5, "lang": 0.7, "topic": 0.9}
MIX_FRACTION = 0.5


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(_table(spark, sf_dir, "documents"), MIX_POWERS, MIX_FRACTION)
    return out.select("doc_id", "source", "lang", "topic", "tokens", F.round("rate", 6).alias("rate"), "copies")


def op2_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op3_super_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(_table(spark, sf_dir, "documents"), k=4, percent=80)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.line_report(_table(spark, sf_dir, "documents"), least=1)
    return out.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.size("removed").cast("long").alias("n_removed"),
                      F.sha2(F.array_join(F.col("removed").cast("array<string>"), ","), 256).alias("removed_sha256"))


def op5_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = revisits.resolve_revisits(revisits.crawl_records(_table(spark, sf_dir, "pages")))
    pairs = F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return out.withColumn("headers", F.array_join(pairs, ";"))


def op6_word_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_pieces.token_counts(_table(spark, sf_dir, "documents"))


def _fold(doc_id, folds: int):
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def op7_hmm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.language_scores(_table(spark, sf_dir, "documents"), _fold(F.col("doc_id"), 7) == 2)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    out = toxicity.toxicity(docs, labels.where(_fold(F.col("doc_id"), 5) != 0))
    return out.select("doc_id", F.coalesce(_fold(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "score",
                      (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


#: the documents as files: short ones are licence files, in directories by source and language
FILES = "SELECT concat('/', source, '/', lang, '/', CASE WHEN n_chars < 400 THEN 'LICENSE-' ELSE 'doc-' END, doc_id) AS path, text FROM documents"


def op10_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = spark.sql(FILES.replace("FROM documents", "FROM {docs}"), docs=_table(spark, sf_dir, "documents"))
    return licences.scan_licences(files)


def op11_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_text.main_texts(_table(spark, sf_dir, "pages"))


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _crc(doc_id):
    return F.crc32(doc_id.cast("string").cast("binary"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    leaf = lambda text: merkle.leaf_digest(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text)
    own = leaf(F.col("text"))
    claimed = F.when(_crc(F.col("doc_id")) % 5 == 0, leaf(F.translate("text", UPPER, LOWER))).otherwise(own)
    out = merkle.manifest(docs, own, claimed, "doc_id", "source")
    return out.select("doc_id", "leaf", "subroot", "root", F.sha2("proof", 256).alias("proof_sha256"), "folded_root", "verified")


def _looped(docs: DataFrame) -> DataFrame:
    """``docs`` with the texts whose id's checksum ends in 0 made periodic from some word on, as op13's contract has it."""
    spaces = "[\\x20\\x09-\\x0D]+"
    words = F.filter(F.split("text", spaces), lambda w: w != "")
    h = _crc(F.col("doc_id"))
    one = docs.select("doc_id", "text", F.when(h % 10 == 0, words).alias("w"), F.floor(h / 10).alias("g"))
    n = F.size("w")
    one = one.withColumn("a", F.when(n > 0, F.col("g") % n)).withColumn("p", 1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8)))
    loop = F.transform("w", lambda x, i: F.when(i < F.col("a"), x).otherwise(F.get("w", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))))
    return one.select("doc_id", F.when(n > 0, F.array_join(loop, " ")).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = periodic_runs.periodic_runs(_looped(_table(spark, sf_dir, "documents")))
    best = periodic_runs.longest_power(F.col("runs"))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    listed = F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), "")
    return out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), listed.alias("listed"), "collapsed").select(
        "doc_id", "n_runs", "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2("listed", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


QUERIES = {f.__name__: f for f in (op1_mix_sources, op2_top_k, op3_super_minhash, op4_line_dedup, op5_revisits,
                                  op6_word_pieces, op7_hmm_scores, op8_toxicity, op9_decontaminate, op10_licences, op11_main_text,
                                  op12_merkle_manifest, op13_periodic_runs)}
ORACLE = {"op1_mix_sources": oracle.mix(MIX_POWERS, MIX_FRACTION), "op2_top_k": oracle.top_k(), "op5_revisits": oracle.revisits(),
          "op9_decontaminate": oracle.decontaminate(), "op10_licences": oracle.licences(FILES), "op12_merkle_manifest": oracle.merkle()}
