"""One query opN_<name> for each operator, over its whole tables, and SQL where that can express it."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import chat, decontaminate, jaccard_join, language, line_dedup, packing, ppm, secrets, topk, toxicity, unigrams
from plumbline.llm.common import NO_ID, crc_mod, table, texts


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    template = chat.Template()
    marks = "</s>[INST] ok [/INST]"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.createDataFrame([(-1, 0, "user", marks), (-1, 1, "assistant", marks)], "conv_id long, turn long, role string, text string")
    messages = chat.linear_messages(rows.withColumn("conv_id", F.coalesce("conv_id", F.lit(NO_ID))).unionByName(own))
    formatted = chat.format_trees(messages, 1, template)
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def read_back(batches):
        for batch in batches:
            out = []
            for conv, text, spans in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                turns = template.parse(text)
                loss = "".join(template.unescape(text[s["start"] : s["end"]]) for s in spans)
                digest = hashlib.sha256("".join(f"{role}\n{said}\n" for role, said in turns).encode()).hexdigest()
                out.append((None if conv == NO_ID else conv, len(turns), digest, len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 6, kinds, strict=True)], names=names)

    kinds = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return formatted.select("tree", "formatted", "loss").mapInArrow(read_back, kinds)


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similarity_groups(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", crc_mod("doc_id", 5) == 0)
    model = language.fit_languages(docs.where(~F.col("held_out")))
    found = language.predict_languages(docs.select("doc_id", "text", "held_out"), model)
    return found.select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"))


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", crc_mod("doc_id", 4) == 2)
    weights = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels").where(crc_mod("doc_id", 4) != 2))
    scored = toxicity.score_toxicity(docs, weights)
    return scored.select("doc_id", "held_out", F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.3).cast("int").alias("predicted"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    joined = line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs))
    names = ["doc_id", "n_lines", "n_dropped", "kept_sha256"]

    def digests(batches):
        for batch in batches:
            done = [line_dedup.kept_lines(t, k) for t, k in zip(texts(batch.column(1)), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.int64()), pa.array([hashlib.sha256(d[0].encode()).hexdigest() for d in done], pa.string())], names=names)

    return joined.select("doc_id", "text", "_keep").mapInArrow(digests, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.withColumn("held_out", crc_mod("doc_id", 10) == 0)
    training = docs.where(~F.col("held_out")).select("text")
    scorer = ppm.TextScorer(spark, ppm.fit_ppm(training))
    both = unigrams.score_unigrams(docs, training, also={"ppm_log10": scorer})
    return both.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", F.col("ppm_log10").alias("score"))


def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.usable(table(spark, sf_dir, "embeddings"))
    return topk.pivot_top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0), 5)


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]

    def digests(batches):
        for batch in batches:
            out = []
            for doc_id, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                spans = [(s["kind"], s["start"], s["end"]) for s in found]
                base = [s for s in spans if s[0] in ("assign", "access", "hex")]
                out.append((doc_id, *(sum(s[0] == k for s in base) for k in ("assign", "access", "hex")), secrets.spans_digest(base), secrets.spans_text(spans)))
            kinds = (pa.int64(),) * 4 + (pa.string(),) * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 6, kinds, strict=True)], names=names)

    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    return found.mapInArrow(digests, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


QUERIES = {
    f.__name__: f
    for f in (
        op1_best_fit_packing,
        op2_chat_formatting,
        op3_ngram_jaccard_join,
        op4_language_id,
        op5_benchmark_decontamination,
        op6_toxicity,
        op7_line_dedup,
        op8_lm_scoring,
        op9_exact_top_k,
        op10_secret_scans,
    )
}
