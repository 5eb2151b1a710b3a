"""The registered queries of the training-data operators: thin wrappers with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.llm import bpe, chat, decontaminate, langid, merkle, quality, secrets, simhash, substring, suffixtree
from rowloom.llm.common import id_hash_mod, stored, table


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    network = quality.train(docs, labels.where(id_hash_mod(labels["doc_id"], 3) != 1))
    return quality.score(docs, network, F.coalesce(id_hash_mod(docs["doc_id"], 3) == 1, F.lit(False)).alias("held_out"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(table(spark, sf_dir, "documents"), window=13, digests=True)


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    scripts = stored(chat.transcripts(turns), "transcripts")  # read twice: to learn and to parse
    held_out = id_hash_mod(scripts["conv_id"], 3) == 1
    model = chat.train(scripts.where(~held_out))
    found = chat.parse(scripts, model, ("conv_id", "part", "roles"))
    right = F.transform("turns", lambda t: t["role"]) == F.col("roles")
    return found.select("conv_id", "part", F.coalesce(id_hash_mod(F.col("conv_id"), 3) == 1, F.lit(False)).alias("held_out"), F.size("roles").cast("long").alias("n_turns"), F.size("turns").cast("long").alias("n_found"), right.alias("right"), F.sha2(F.col("chat").cast("binary"), 256).alias("chat_sha256"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"), vocabulary_path(), digests=True)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), distance=2, words=3)


def op6_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return suffixtree.score(docs, id_hash_mod(docs["doc_id"], 5) == 1)


def op7_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = merkle.compared(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next", F.col("changed.first").alias("changed_from"), F.col("changed.last").alias("changed_to"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = id_hash_mod(docs["doc_id"], 4) == 2
    return langid.identify(docs, langid.train(docs.where(~held_out)), F.coalesce(held_out, F.lit(False)).alias("held_out"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=13, share=20)
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "item_ids").cast("binary"), 256).alias("items_sha256"), "contaminated")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = secrets.scan(docs, secrets.train(secrets.labelled_findings(spark)), docs["source"])
    kept = F.filter("findings", lambda x: x["score"] >= secrets.THRESHOLD)
    return found.select("doc_id", F.size("findings").cast("long").alias("n_candidates"), F.size(kept).cast("long").alias("n_secrets"), F.sha2(F.array_join(F.transform(kept, lambda x: x["value"]), "\n").cast("binary"), 256).alias("secrets_sha256"), F.sha2(F.col("redacted").cast("binary"), 256).alias("redacted_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality, op2_substring_dedup, op3_chat, op4_bpe, op5_simhash, op6_suffix_tree, op7_merkle, op8_language, op9_decontamination, op10_secrets)}


#: Every window of 13 words as text, the smallest document that has it, and the places that a smaller one covers.
REPEATS = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
win AS (SELECT doc_id, p, array_to_string(w[p:p + 12], ' ') AS s FROM d, unnest(range(1, len(w) - 11)) t(p)),
first AS (SELECT s, min(doc_id) AS m FROM win GROUP BY s),
gone AS (SELECT DISTINCT doc_id, q FROM (SELECT win.doc_id, unnest(range(p, p + 13)) AS q FROM win JOIN first USING (s) WHERE m < win.doc_id)),
kept AS (SELECT doc_id, string_agg(w[q], ' ' ORDER BY q) AS k FROM (SELECT doc_id, q, w FROM d, unnest(range(1, len(w) + 1)) t(q)) ANTI JOIN gone USING (doc_id, q) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(c, 0)::BIGINT AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS c FROM gone GROUP BY doc_id) USING (doc_id)
"""
#: Items' windows and documents' windows of the same sizes, joined as text.
PASSAGES = r"""
WITH split AS (SELECT 0 AS side, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark),
words AS (SELECT side, id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM split),
items AS (SELECT DISTINCT id::VARCHAR AS item, size, array_to_string(w[s:s + size - 1], ' ') AS win FROM (SELECT id, w, least(13, len(w)) AS size FROM words WHERE side = 1 AND len(w) > 0), unnest(range(1, len(w) - size + 2)) t(s)),
wins AS (SELECT id AS doc_id, p, size, array_to_string(w[p:p + size - 1], ' ') AS win FROM (SELECT id, w, size FROM words, (SELECT DISTINCT size FROM items) WHERE side = 0), unnest(range(1, len(w) - size + 2)) t(p)),
hits AS (SELECT doc_id, p, size, item FROM wins JOIN items USING (size, win)),
places AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(range(p, p + size)) AS q FROM hits) GROUP BY doc_id),
names AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS s FROM hits GROUP BY doc_id)
SELECT id AS doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n, 0) > 0 AND 20 * coalesce(n, 0) >= len(w) AS contaminated
FROM (SELECT * FROM words WHERE side = 0) LEFT JOIN places ON id = places.doc_id LEFT JOIN names ON id = names.doc_id
"""


def oracle_sql() -> dict[str, str]:
    """SQL can express neither the trained operators nor XXH64, the tokenizer or the tree's hashes; they are tested against brute force."""
    return {"op2_substring_dedup": REPEATS, "op9_decontamination": PASSAGES}
