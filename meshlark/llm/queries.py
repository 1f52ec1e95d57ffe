"""The queries of this subpackage: (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return small_batches(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import BASE, find_pii, joined

    found = find_pii(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    kinds = F.transform("spans", lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.size("spans").cast("long").alias("n_spans"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def bpe() -> str:
    """The file of the tokenizer that the queries use."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op2_packing(spark: SparkSession, sf_dir: str, tokenizer_path: str | None = None) -> DataFrame:
    from .packing import pack_tokens

    packed = pack_tokens(table(spark, sf_dir, "documents"), tokenizer_path or bpe())
    return packed.withColumn("ids", F.crc32("ids")).withColumnRenamed("ids", "padded_crc32")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontam import contamination

    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, h: n + h["end_word"] - h["first_word"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    import hashlib

    import pyarrow as pa

    from .common import utf8
    from .line_dedup import keep_bitmaps, kept_lines, with_bitmaps

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")

    def digest(batches):
        for b in batches:
            got = [kept_lines((t or b"").decode(), m) for t, m in zip(utf8(b.column(1)), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([n for n, _ in got], pa.int64()), pa.array([n - len(x) for n, x in got], pa.int64()), pa.array([hashlib.sha256("\n".join(x).encode()).hexdigest() for _, x in got])],
                names=["doc_id", "n_lines", "n_dropped", "kept_sha256"],
            )

    return with_bitmaps(docs, keep_bitmaps(docs)).mapInArrow(digest, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import event_log, read_back, reconstruct, render

    said = F.lit(r"\### Assistant: </turn> ok")
    turn = F.col("id")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), turn.alias("turn"), F.when(turn == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    back = read_back(render(reconstruct(event_log(rows))))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("trained", "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import identify_languages, train_language_id

    docs = table(spark, sf_dir, "documents")
    fold = F.crc32(F.col("doc_id").cast("string")) % 4
    model = train_language_id(docs, where=fold != 2)
    return identify_languages(docs, model).select("doc_id", (fold == 2).alias("held_out"), "lang_pred", "score")


def op7_token_index(spark: SparkSession, sf_dir: str, tokenizer_path: str | None = None) -> DataFrame:
    from .token_index import look_up, read_ids, write_store

    docs = table(spark, sf_dir, "documents")
    store = write_store(docs, tokenizer_path or bpe())
    return read_ids(look_up(docs, store), store)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score_toxicity, train_toxicity

    docs = table(spark, sf_dir, "documents")
    model = train_toxicity(docs, table(spark, sf_dir, "labels"), where=F.crc32(F.col("id").cast("string")) % 5 != 0)
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    return score_toxicity(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprint import edited_pairs

    return edited_pairs(table(spark, sf_dir, "documents"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), shingle=3, percent=85).drop("text_fp")


def op11_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hash_forest import nearest_neighbours

    return nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hard_negatives import hard_negatives

    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label_col=label)


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .centroids import cluster_vectors, with_inertia

    return with_inertia(*cluster_vectors(table(spark, sf_dir, "embeddings")))


def queries() -> dict:
    return {k: f for k, f in sorted(globals().items()) if k.startswith("op")}
