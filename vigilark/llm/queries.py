"""Queries op1 to op13 over whole tables, and SQL counterparts where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilark.llm import (
    attention, chat, codes, decontaminate, jaccard, language, lattice, mixing, negatives, pseudonyms, shard, suffix, warc,
)
from vigilark.llm.common import stored, table, text_of
from vigilark.session import shared_dir


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.near_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard.balanced_shards(table(spark, sf_dir, "documents")).drop("key")


TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"
SCORING_FOLDS, HELD_OUT_FOLD = 7, 2


def op4_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", language.in_fold(SCORING_FOLDS) == HELD_OUT_FOLD)
    return attention.score_documents(docs.select("doc_id", "held_out", "text"), docs.filter("not held_out"), TOKENIZER)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.copies(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("n_copies")).alias("taken"), "source", "n_copies")


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


PSEUDONYM_KEY = "corpus"  # a real run passes a secret of its own


def op7_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonyms.pseudonymised(table(spark, sf_dir, "documents").select("doc_id", "text"), PSEUDONYM_KEY)


def op8_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("spans")


PROBE = (-7, r"\### Assistant: </turn> ok")  # a conversation whose texts look like a template's marks


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = spark.range(2).select(
        F.lit(PROBE[0]).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE[1]).alias("text"))
    every = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    return every.select("conv_id", "turn", "role", chat.text_parts(text_of()).alias("parts"))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = chat.format_conversations(_turns(spark, sf_dir))
    turns = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return (
        made.withColumn("turns", chat.read_turns(F.col("formatted")))
        .withColumn("loss", F.array_join(chat.read_loss(F.col("formatted"), F.col("loss_spans")), ""))
        .select(
            "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.array_join(turns, ""), 256).alias("turns_sha256"),
            F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
            F.length("formatted").cast("long").alias("formatted_chars"))
    )


LANGUAGE_FOLDS = 5  # documents of fold 0 are held out


def language_model(docs: DataFrame) -> language.LanguageModel:
    return language.fit_languages(docs.filter(language.in_fold(LANGUAGE_FOLDS) != 0))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", (language.in_fold(LANGUAGE_FOLDS) == 0).alias("held_out"), "text")
    return language.identify(rows, language_model(docs)).drop("text")


SHIFTED, LABELS, ANCHORS = 7, 10, 50  # ids divisible by the first have the next label, by the last are anchors


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.col("label").cast("long").alias("label"))
    shifted = F.when(F.col("vec_id") % SHIFTED == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label"))
    return negatives.hard_negatives(rows.withColumn("label", shifted), F.col("id") % ANCHORS == 0)


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, codebooks = codes.compressed(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    return coded.select("vec_id", "code", "error", "label_error", F.lit(codes.digest(codebooks)).alias("codebooks_sha256"))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = shared_dir(spark, "arc"), shared_dir(spark, "warc")
    warc.write_arc(table(spark, sf_dir, "pages").select("page_id", "url", "html"), old)
    warc.convert(spark, old, new)
    found = warc.with_referred_page(stored(warc.read_warc(spark, new), "warc-read"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_near_vectors": op2_near_vectors,
    "op3_sharding": op3_sharding,
    "op4_scoring": op4_scoring,
    "op5_mixing": op5_mixing,
    "op6_jaccard": op6_jaccard,
    "op7_pseudonyms": op7_pseudonyms,
    "op8_suffix": op8_suffix,
    "op9_chat_format": op9_chat_format,
    "op10_language": op10_language,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_vector_codes": op12_vector_codes,
    "op13_warc": op13_warc,
}

_CLEAN = r"trim(lower(coalesce(text, '')), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
_WHOLE = """v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)"""


def _rounds_sql(rounds: int) -> str:
    """Assignments a0, a1, ... to the codebooks c0, c1, ..., each made from the one before."""
    out = []
    for r in range(rounds + 1):
        out.append(f"""d{r} AS MATERIALIZED (
  SELECT x.vec_id, x.part, c.entry, sum((x.v - c.v) * (x.v - c.v)) AS d FROM x JOIN c{r} c USING (part, position) GROUP BY ALL),
a{r} AS MATERIALIZED (SELECT vec_id, part, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM d{r} GROUP BY ALL)""")
        if r < rounds:
            out.append(f"""m{r} AS (
  SELECT part, entry, position, sum(x.v) AS s, count(*) AS n FROM a{r} JOIN x USING (vec_id, part) GROUP BY ALL),
c{r + 1} AS MATERIALIZED (
  SELECT part, entry, position, CASE WHEN n IS NULL THEN v ELSE CAST((s - ((s % n) + n) % n) // n AS BIGINT) END AS v
  FROM c{r} LEFT JOIN m{r} USING (part, entry, position))""")
    return ",\n".join(out)


ORACLE_SQL: dict[str, str] = {
    "op1_decontamination": rf"""
WITH w AS (
  SELECT 'd' AS kind, doc_id AS id, string_split_regex({_CLEAN}, '[ \t-\r]+') AS w FROM documents WHERE {_CLEAN} <> ''
  UNION ALL SELECT 'i', item_id, string_split_regex({_CLEAN}, '[ \t-\r]+') FROM benchmark WHERE {_CLEAN} <> ''),
k AS (SELECT DISTINCT least(len(w), 5) AS k FROM w WHERE kind = 'i'),
s AS (
  SELECT DISTINCT kind, id, k, array_to_string(w[i:i + k - 1], ' ') AS s
  FROM (SELECT kind, id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i
        FROM w JOIN k ON CASE kind WHEN 'i' THEN k = least(len(w), 5) ELSE len(w) >= k END)),
n AS (SELECT id, k, count(*) AS n FROM s WHERE kind = 'i' GROUP BY id, k),
p AS (SELECT d.id AS doc_id, i.id AS item_id, count(*) AS n_shared
      FROM s d JOIN s i ON d.kind = 'd' AND i.kind = 'i' AND d.k = i.k AND d.s = i.s GROUP BY 1, 2)
SELECT doc_id, item_id, n AS n_shingles, n_shared, n_shared / n AS containment
FROM p JOIN n ON n.id = item_id WHERE 100 * n_shared >= 75 * n""",
    "op9_chat_format": r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (
  SELECT *, replace(replace(role, '\', '\\'), '<|', '<\|') AS er, replace(replace(text, '\', '\\'), '<|', '<\|') AS et FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, et)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, et) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(24 + length(er) + length(et)) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id""",
    "op11_hard_negatives": f"""
WITH {_WHOLE},
r AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, CAST(v AS DOUBLE[]) AS v
  FROM v WHERE label IS NOT NULL),
s AS (SELECT a.id AS anchor_id, r.id, a.label = r.label AS same, CAST(list_inner_product(a.v, r.v) AS BIGINT) AS score
  FROM r a JOIN r ON a.id % 50 = 0 AND a.id <> r.id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS rank,
  id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3""",
    "op12_vector_codes": f"""
WITH {_WHOLE},
x AS MATERIALIZED (
  SELECT vec_id, CAST(i // (n // 16) AS INT) AS part, i % (n // 16) AS position, v[i + 1] AS v
  FROM (SELECT vec_id, v, len(v) AS n, unnest(range(len(v))) AS i FROM v)),
k AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM v QUALIFY entry < 64),
c0 AS MATERIALIZED (SELECT part, entry, position, x.v FROM k JOIN x USING (vec_id)),
{_rounds_sql(2)},
o AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a2 GROUP BY 1),
b AS (SELECT sha256(string_agg(v, ',' ORDER BY part, entry, position)) AS codebooks_sha256 FROM c2)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM o JOIN v USING (vec_id), b""",
    "op13_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last FROM pages),
d AS (SELECT *, sha1(h) AS hex FROM p)
SELECT page_id, octet_length(encode(h)) AS payload_bytes, (
  SELECT string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(hex, 1 + 5 * (i // 4), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS INT) + 1, 1), '' ORDER BY i)
  FROM range(32) t(i)) AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to
FROM d""",
}
