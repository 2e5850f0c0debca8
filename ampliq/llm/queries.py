"""The registered queries of this folder's operators, and SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ampliq.llm.chat import format_chats, masked_text, read_back, unescaped
from ampliq.llm.common import table, text_of
from ampliq.llm.divergence import source_divergence
from ampliq.llm.lexical import ranked_search
from ampliq.llm.minhash import near_duplicates
from ampliq.llm.mixing import mix
from ampliq.llm.oracle import SQL
from ampliq.llm.secrets import find_secrets, listed
from ampliq.llm.sentencepiece_wfst import MARK, PieceModel, encode_texts
from ampliq.llm.sharding import hypergeometric_shards
from ampliq.llm.simhash import fingerprint_edits
from ampliq.llm.topk import top_k
from ampliq.llm.toxicity import score_toxicity, train
from ampliq.llm.url_filter import Rule, judge_urls
from ampliq.llm.warc import read_warc, write_warc
from ampliq.session import scratch_path

__all__ = ["QUERIES", "SQL"]

QUERIES: dict = {}


def query(run):
    QUERIES[run.__name__] = run
    return run


@query
def op1_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    laid = hypergeometric_shards(table(spark, sf_dir, "documents"), n_shards=16)
    return laid.select(
        "doc_id", (F.octet_length(text_of("text")) + 1).cast("long").alias("size"),
        F.crc32(text_of("text")).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query
def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(table(spark, sf_dir, "documents"))


#: The rules of the URL filter's contract.
RULES = [
    Rule("com", "/", "allow"), Rule("example.com", "/en/", "block"), Rule("www.example.com", "/en/", "allow"),
    Rule("net", "/es/", "block"), Rule("net", "/fr/", "block"),
]


@query
def op3_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), RULES).drop("url")


@query
def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query
def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), k=5, scale=256, every=50)


#: Fixed value: the conversation that the chat contract adds.
ADDED_CHAT = [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]


@query
def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = rows.unionByName(spark.createDataFrame(ADDED_CHAT, "conv_id long, turn long, role string, text string"))
    chats = format_chats(rows)
    told = F.transform(read_back(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    learnt = F.array_join(F.transform(masked_text(F.col("formatted"), F.col("loss_spans")), unescaped), "")
    return chats.select(
        "conv_id", F.size(told).cast("long").alias("n_turns"), F.sha2(F.array_join(told, ""), 256).alias("turns_sha256"),
        F.length(learnt).cast("long").alias("loss_chars"), F.sha2(learnt, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


@query
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_toxicity(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % 5 == 0).alias("held_out"), "score", "predicted")


@query
def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"),
    )


#: Place of the public model's file, read by the driver.
PIECES = "/opt/tokenizers/piece_bpe_32k.model"


@query
def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = encode_texts(table(spark, sf_dir, "documents").select("doc_id", "text"), PieceModel.read(PIECES))
    return encoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_pieces"), F.xxhash64("ids").alias("ids_xxhash64"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        (F.col("decoded") == F.replace("text", F.lit(MARK), F.lit(" "))).alias("round_trip"),
    )


@query
def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = scratch_path(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), archives)
    return read_warc(spark, archives).select(
        F.col("record_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to").cast("long").alias("refers_to"),
    )


@query
def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents").select("lang", "source", "text"))


@query
def op13_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
