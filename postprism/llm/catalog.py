"""The registered queries of the text operators, each over its whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postprism.llm import (
    bpe_trie,
    chat,
    decontaminate,
    embedding_dedup,
    langid,
    line_dedup,
    quality,
    sharding,
    simhash_dedup,
    spelling,
    suffix_dedup,
    token_files,
    vector_codes,
)
from postprism.session import work_folder

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    """All conversations and one whose texts hold another template's control strings, read back from the formatted text."""
    said = F.lit("</s>[INST] ok [/INST]")
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        said.alias("text"),
    )
    rows = _table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").union(extra)
    read = chat.format_chats(rows).select(
        "conv_id",
        chat.read_turns(F.col("formatted")).alias("turns"),
        F.array_join(chat.read_learned(F.col("formatted"), F.col("loss_runs")), "").alias("learned"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
    written = F.transform("turns", lambda turn: F.concat(turn["role"], F.lit("\n"), turn["text"], F.lit("\n")))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(written, ""), 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op2_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Each benchmark item that a document holds, and where."""
    found = decontaminate.leaks(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))
    return found.select("doc_id", "item_id", "edits", "first_word", "end_word")


def op3_token_files(spark: SparkSession, folder: str) -> DataFrame:
    target = work_folder(spark, "tokens")
    files = token_files.write_token_files(_table(spark, folder, "documents"), VOCABULARY, target)
    read = token_files.read_token_files(files, target)
    return read.select(
        "doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").cast("long").alias("ids_crc32")
    )


def op4_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shard(_table(spark, folder, "documents"))


def op5_quality_votes(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    model = quality.fit(docs, _table(spark, folder, "labels"))
    scored = docs.select("doc_id", quality.held_out().alias("held_out"), quality.score(docs, model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= quality.THRESHOLD).cast("int"))


def op6_embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return embedding_dedup.near_vectors(_table(spark, folder, "embeddings"))


def op7_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(_table(spark, folder, "documents"))
    return found.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
        F.octet_length("kept").cast("long").alias("n_kept"),
        (F.size("spans") > 0).alias("repeats"),
    )


def op8_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = line_dedup.drop_repeated_lines(_table(spark, folder, "documents"), counts=True)
    return found.select(
        "doc_id", "n_lines", "n_dropped", F.length("text").cast("long").alias("kept_chars"), F.sha2("text", 256).alias("kept_sha256")
    )


def op9_bpe_trie(spark: SparkSession, folder: str) -> DataFrame:
    return bpe_trie.digests(bpe_trie.encode_and_decode(_table(spark, folder, "documents"), VOCABULARY), "doc_id")


def op10_simhash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash_dedup.simhash_groups(_table(spark, folder, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


def op11_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    coded, books = vector_codes.compress(_table(spark, folder, "embeddings"))
    return coded.select(
        "vec_id", F.lower(F.hex("entries")).alias("code"), "error", "label_error", F.lit(vector_codes.digest(books)).alias("codebooks_sha256")
    )


def op12_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text", "lang", quality.held_out().alias("held_out"))
    model = langid.fit(docs.where(~F.col("held_out")), PIECES)
    return langid.predict(docs.drop("lang"), model).select("doc_id", "held_out", "lang_pred", "score")


def op13_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.variants(_table(spark, folder, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        op1_chat_format,
        op2_decontamination,
        op3_token_files,
        op4_sharding,
        op5_quality_votes,
        op6_embedding_dedup,
        op7_suffix_dedup,
        op8_line_dedup,
        op9_bpe_trie,
        op10_simhash_dedup,
        op11_vector_codes,
        op12_language_id,
        op13_spelling_variants,
    ]
    return {query.__name__: query for query in found}


def _times(control: str) -> str:
    """SQL for how many characters escaping one control string adds to a text: its occurrences, backslashes apart."""
    return rf"len(regexp_extract_all(t, '{_quoted(control[0])}\\*{_quoted(control[1:])}'))"


def _quoted(text: str) -> str:
    return "".join(f"[{char}]" if char in "[]|<>/" and char not in "[]" else "\\" + char if char in "[]" else char for char in text)


_OP1 = rf"""
WITH r AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS t FROM conversations
    UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), s AS (
    SELECT *, lag(role) OVER w IS DISTINCT FROM role AS opens,
        length(t) + {" + ".join(map(_times, chat.CONTROLS))} AS chars
    FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, t)
)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || t || chr(10), '' ORDER BY turn, role, t)) AS turns_sha256,
    sum(CASE WHEN role = 'assistant' THEN length(t) ELSE 0 END)::BIGINT AS loss_chars,
    sha256(string_agg(CASE WHEN role = 'assistant' THEN t ELSE '' END, '' ORDER BY turn, role, t)) AS loss_sha256,
    sum(chars + CASE WHEN opens THEN {len(chat.BLOCK + chat.TEXT + chat.END)} + length(role) ELSE {len(chat.PART)} END)::BIGINT AS formatted_chars
FROM s GROUP BY conv_id
"""


# Parts of all vectors meet all entries here; the rounds are written out one after another.
_OP11_ASSIGN = """
    SELECT vec_id, q.p, min(struct_pack(d := list_sum(list_transform(list_zip(q.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), e := c.e)) AS best
    FROM parts q JOIN {book} c USING (p) GROUP BY vec_id, q.p
"""
_OP11_UPDATE = """
    SELECT c.p, c.e, coalesce(m.x, c.x) AS x FROM {book} c LEFT JOIN (
        SELECT p, e, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY j) AS x FROM (
            SELECT p, best.e AS e, j, sum(x[j]) AS s, count(*) AS n
            FROM {near} JOIN parts USING (vec_id, p), generate_series(1, (SELECT max(len(x)) FROM parts)) AS g(j) GROUP BY ALL
        ) GROUP BY p, e
    ) m USING (p, e)
"""
_OP11 = f"""
WITH kept AS MATERIALIZED (
    SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS MATERIALIZED (
    SELECT vec_id, p, v[p * len(v) // 16 + 1 : (p + 1) * len(v) // 16] AS x FROM kept, range(16) AS r(p)
), book0 AS MATERIALIZED (
    SELECT p, e, x FROM (SELECT p, x, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e FROM parts) WHERE e < 64
), near1 AS MATERIALIZED ({_OP11_ASSIGN.format(book="book0")}
), book1 AS MATERIALIZED ({_OP11_UPDATE.format(book="book0", near="near1")}
), near2 AS MATERIALIZED ({_OP11_ASSIGN.format(book="book1")}
), book2 AS MATERIALIZED ({_OP11_UPDATE.format(book="book1", near="near2")}
), near3 AS MATERIALIZED ({_OP11_ASSIGN.format(book="book2")}
), coded AS (
    SELECT vec_id, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM near3 GROUP BY vec_id
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
    (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) FROM book2) AS codebooks_sha256
FROM coded JOIN kept USING (vec_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_format": _OP1, "op11_vector_codes": _OP11}
