"""The registered queries of this subpackage, with their production parameters."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsweft.llm import bpe, chat, linededup, packing, periodic, pii, quality, repeats, search, secrets, simhash, tokenfile, whitening
from newsweft.llm.common import documents, sha256, spans_text

QUERY_STEP = 50  # queries of a search: rows whose id is divisible by this
BEST = 10


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode_decode(documents(spark, sf_dir), tokenizer("word_bpe_49k.json"))
    ids = F.concat_ws(" ", F.col("ids").cast("array<string>"))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), sha256(ids).alias("ids_sha256"), sha256(F.col("decoded")).alias("decoded_sha256"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = simhash.near_duplicates(documents(spark, sf_dir))
    return classes.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.secrets(documents(spark, sf_dir))
    base = F.filter("spans", lambda s: s["kind"].isin("assign", "access", "hex"))
    number = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", number("assign"), number("access"), number("hex"), sha256(spans_text(base)).alias("base_sha256"), spans_text(F.col("spans")).alias("spans")
    )


def op4_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(documents(spark, sf_dir))


def op5_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    asked = docs.filter(F.col("doc_id") % QUERY_STEP == 0).select(F.col("doc_id").alias("query_id"), "text")
    return search.top_k(docs, asked, BEST)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.spans(documents(spark, sf_dir))
    number = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[number(k) for k in pii.KINDS], sha256(spans_text(F.col("base"))).alias("base_sha256"), spans_text(F.col("spans")).alias("spans"))


def op8_tokenfile(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = tokenfile.shared_folder(spark, "tokens")
    tokenfile.write_files(documents(spark, sf_dir), folder, tokenizer("byte_bpe_50k.json"))
    return tokenfile.read_files(spark, folder)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), tokenizer("byte_bpe_50k.json"))


def op10_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = linededup.drop_boilerplate(documents(spark, sf_dir))
    return cleaned.select("doc_id", "n_lines", "n_removed", sha256(F.coalesce("text", F.lit(""))).alias("kept_sha256"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def planted_period(name: int | None, words: list[str]) -> list[str]:
    """One text in ten repeats a stretch of its words to its end; which and how follows from its id."""
    h, n = zlib.crc32(str(name).encode()), len(words)
    if name is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    stretch = words[a : a + 1 + (n - a) // (3 + g % 8)]
    return words[:a] + (stretch * -(-(n - a) // len(stretch)))[: n - a]


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.find_runs(documents(spark, sf_dir), planted_period)
    ranked = F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period")))
    listed = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    best = found.withColumn("best", F.array_max(ranked))
    return best.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.expr("1000 * best.length div -best.period").alias("exponent_milli"),
        sha256(F.array_join(listed, "")).alias("runs_sha256"),
        sha256(F.col("collapsed")).alias("collapsed_sha256"),
    )


MARKED = "\\### Assistant: </turn> ok"  # a text made of what the template uses


def op13_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    added = spark.createDataFrame([(-7, 0, "user", MARKED), (-7, 1, "assistant", MARKED)], "conv_id long, turn long, role string, text string")
    folder = tokenfile.shared_folder(spark, "formatted")
    chat.write_formatted(chat.event_log(rows.union(added)), folder)
    return chat.read_back(chat.read_formatted(spark, folder))


QUERIES = {f.__name__: f for f in (op1_bpe, op2_simhash, op3_secrets, op4_repeats, op5_search, op6_quality, op7_pii, op8_tokenfile, op9_packing, op10_linededup, op11_whitening, op12_runs, op13_chat)}

# A line is spread over the sites of all documents that have it, a short one over more; it stays in the first of them.
ORACLE = {
    "op10_linededup": r"""
WITH lines AS (
  SELECT doc_id, source, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT *, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key FROM lines
), spread AS (
  SELECT key, min(doc_id) AS first_id FROM keyed WHERE key <> '' GROUP BY key
  HAVING count(DISTINCT source) >= 5 * power(greatest(ceil(20.0 / length(key)), 1), 2)
)
SELECT doc_id, count(*) AS n_lines, count(first_id) FILTER (doc_id > first_id) AS n_removed,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (first_id IS NULL OR doc_id <= first_id), '')) AS kept_sha256
FROM keyed LEFT JOIN spread USING (key) GROUP BY doc_id
""",
}
