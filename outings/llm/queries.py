"""The registered queries of the operators in this subpackage, with their SQL where it exists."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from outings.llm import ann, bpe, chat, decontaminate, hilbert, langid, lmscore, merkle, neardup, pqcodes, tokenfile, toxicity, windows
from outings.llm.tables import written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(build):
    QUERIES[build.__name__] = build
    return build


def table(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}.parquet")


@query
def op10_byte_bpe(spark: SparkSession, path: str) -> DataFrame:
    docs = table(spark, path, "documents").select("doc_id", "text")
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.round_trip(docs, ranks, public_tokenizers.PATTERN, keep=["doc_id"])


def _crc(name: str, modulus: int):
    return F.crc32(F.col(name).cast("string").cast("binary")) % modulus


@query
def op1_language_id(spark: SparkSession, path: str) -> DataFrame:
    docs = table(spark, path, "documents")
    held_out = F.coalesce(_crc("doc_id", 4) == 2, F.lit(True))
    profiles = langid.fit(docs.filter(~held_out), "lang")
    out = langid.predict(docs.select("doc_id", "text"), profiles, keep=["doc_id"])
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query
def op5_toxicity(spark: SparkSession, path: str) -> DataFrame:
    docs = table(spark, path, "documents").select("doc_id", "text")
    held_out = F.coalesce(_crc("doc_id", 5) == 0, F.lit(True))
    model = toxicity.fit(docs, table(spark, path, "labels").filter(~held_out))
    out = toxicity.predict(docs, model, keep=["doc_id"])
    return out.select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


@query
def op6_decontaminate(spark: SparkSession, path: str) -> DataFrame:
    return decontaminate.find_passages(table(spark, path, "documents"), table(spark, path, "benchmark"))


@query
def op4_near_duplicates(spark: SparkSession, path: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, path, "documents"), shingle=2, percent=80)


@query
def op7_hilbert_shards(spark: SparkSession, path: str) -> DataFrame:
    rows = hilbert.assign(table(spark, path, "documents"), shards=8)
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "curve", *[c for c in rows.columns if c.startswith("bin_")],
    )


@query
def op9_chat_format(spark: SparkSession, path: str) -> DataFrame:
    rows = table(spark, path, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], rows.schema)
    formatted = chat.format_log(chat.rows_to_events(rows.unionAll(extra)))
    return chat.read_back(written(formatted, "formatted"))


@query
def op2_nearest_vectors(spark: SparkSession, path: str) -> DataFrame:
    vectors = table(spark, path, "embeddings").select("vec_id", "embedding")
    return ann.nearest(vectors, vectors.filter(F.col("vec_id") % 20 == 0), k=20)


@query
def op8_lm_score(spark: SparkSession, path: str) -> DataFrame:
    docs = table(spark, path, "documents").select("doc_id", "text")
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    out = lmscore.score(docs, _crc("doc_id", 7) != 2, ranks, public_tokenizers.PATTERN)
    return out.withColumn("held_out", ~F.col("learned")).drop("learned")


#: The control strings that are escaped, each of which makes a text five characters longer.
_ADDED = " + ".join(
    f"5 * (length(t) - length(replace(t, '{c}', ''))) // {len(c)}" for c in chat.CONTROL
)
ORACLE_SQL["op9_chat_format"] = f"""
WITH said AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM said
), sized AS (
  SELECT *, length(r) + length(t) + length(t) - length(replace(t, chr(92), '')) + {_ADDED}
    + length('{chat.BEGIN}{chat.END}') + 2 AS chars FROM turns
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(r || chr(10) || t || chr(10), '' ORDER BY turn, r)) AS turns_sha256,
  CAST(coalesce(sum(length(t)) FILTER (WHERE r = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(t, '' ORDER BY turn) FILTER (WHERE r = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id"""


@query
def op3_token_files(spark: SparkSession, path: str) -> DataFrame:
    docs = table(spark, path, "documents").select("doc_id", "text")
    files = tokenfile.write_files(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return tokenfile.read_files(files)


#: The columns of a document, in the order in which they enter its leaf.
DOCUMENT = ["doc_id", "source", "lang", "n_chars", "text"]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@query
def op13_merkle_manifest(spark: SparkSession, path: str) -> DataFrame:
    docs = table(spark, path, "documents").select(*DOCUMENT)
    tampered = F.when(_crc("doc_id", 5) == 0, F.translate("text", UPPER, LOWER)).otherwise(F.col("text"))
    rows = merkle.manifest(docs, DOCUMENT, group="source", id="doc_id", shown={"text": tampered})
    return rows.select(
        F.col("id").alias("doc_id"), "leaf", "subroot", "root", merkle.proof_digest(F.col("steps")).alias("proof_sha256"),
        "folded_root", "verified",
    )


def _field(expression: str) -> str:
    return f"coalesce(strlen(CAST({expression} AS VARCHAR)) || ':' || CAST({expression} AS VARCHAR), '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_field(c) for c in [*DOCUMENT[:-1], text]) + ")"


#: CRC-32 bit by bit: DuckDB has no such function.
_CRC_STEP = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
_CRC = f"""
crcs(crc_id, digits, c, i) AS (
  SELECT DISTINCT doc_id, CAST(doc_id AS VARCHAR), CAST(4294967295 AS BIGINT), 0 FROM documents
  WHERE doc_id IS NOT NULL
  UNION ALL
  SELECT crc_id, digits, CASE WHEN i % 9 = 0 THEN xor(c, ascii(substr(digits, i // 9 + 1, 1))) ELSE {_CRC_STEP} END,
    i + 1
  FROM crcs WHERE i < 9 * length(digits)
), crc AS (
  SELECT crc_id, xor(c, 4294967295) AS crc FROM crcs WHERE i = 9 * length(digits)
)"""


def _levels(name: str) -> str:
    """The levels of the trees in ``{name}0``, and the siblings of every node."""
    return f"""
{name}(tree, level, idx, n, hash) AS (
  SELECT tree, 0, idx, n, hash FROM {name}0
  UNION ALL
  SELECT tree, level + 1, idx // 16, (n + 15) // 16, sha256(string_agg(hash, '' ORDER BY idx))
  FROM {name} WHERE n > 1 GROUP BY tree, level, idx // 16, n
), {name}_steps AS (
  SELECT tree, level, idx, hash, n,
    coalesce(string_agg(hash, '' ORDER BY idx) OVER (PARTITION BY tree, level, idx // 16 ORDER BY idx
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
    coalesce(string_agg(hash, '' ORDER BY idx) OVER (PARTITION BY tree, level, idx // 16 ORDER BY idx
      ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after
  FROM {name}
)"""


ORACLE_SQL["op13_merkle_manifest"] = f"""
WITH RECURSIVE {_CRC.strip()}, leaves AS (
  SELECT doc_id, coalesce('=' || source, '') AS tree, {_leaf("text")} AS hash,
    CASE WHEN crc % 5 = 0 THEN {_leaf(f"translate(text, '{UPPER}', '{LOWER}')")} ELSE {_leaf("text")} END AS seen
  FROM documents d LEFT JOIN crc ON crc_id = doc_id
), low0 AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, hash) - 1 AS idx,
    count(*) OVER (PARTITION BY tree) AS n FROM leaves
), {_levels("low").strip()}, top0 AS (
  SELECT '' AS tree, tree AS member, row_number() OVER (ORDER BY tree) - 1 AS idx, count(*) OVER () AS n, hash
  FROM low WHERE n = 1
), {_levels("top").strip()}, walk(doc_id, tree, idx, level, leaf, h, proof, n) AS (
  SELECT doc_id, tree, idx, 0, hash, seen, '', n FROM low0
  UNION ALL
  SELECT w.doc_id, w.tree, w.idx // 16, w.level + 1, leaf, sha256(before || h || after), proof || before || after,
    (w.n + 15) // 16
  FROM walk w JOIN low_steps s ON s.tree = w.tree AND s.level = w.level AND s.idx = w.idx WHERE w.n > 1
), climb(doc_id, subroot, idx, level, leaf, h, proof, n) AS (
  SELECT doc_id, t.hash, t.idx, 0, leaf, h, proof, t.n FROM walk w JOIN top0 t ON t.member = w.tree WHERE w.n = 1
  UNION ALL
  SELECT doc_id, subroot, c.idx // 16, c.level + 1, leaf, sha256(before || h || after), proof || before || after,
    (c.n + 15) // 16
  FROM climb c JOIN top_steps s ON s.level = c.level AND s.idx = c.idx WHERE c.n > 1
)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, h AS folded_root, h = root AS verified
FROM climb, (SELECT hash AS root FROM top WHERE n = 1) WHERE n = 1"""


@query
def op12_repeated_windows(spark: SparkSession, path: str) -> DataFrame:
    rows = windows.drop_repeats(table(spark, path, "documents").select("doc_id", "text"), size=20)
    return rows.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE_SQL["op12_repeated_windows"] = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), starts AS (
  SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM words WHERE len(w) >= 20
), ranked AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(w[i:i + 19], ' ') ORDER BY doc_id, i) AS place
  FROM starts
), covered AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM ranked WHERE place > 1
), every AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM words
), kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS body
  FROM every ANTI JOIN covered USING (doc_id, i) GROUP BY doc_id
)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(body, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (doc_id)"""


@query
def op11_vector_codes(spark: SparkSession, path: str) -> DataFrame:
    rows = table(spark, path, "embeddings").select("vec_id", "embedding", "label")
    coded, books = pqcodes.fit_encode(rows, parts=8, entries=16, rounds=6)
    listed = ",".join(str(v) for book in books for v in book.ravel())
    code = F.array_join(F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    return pqcodes.with_label_error(coded).select(
        F.col("id").alias("vec_id"), code.alias("code"), "error", "label_error",
        F.lit(hashlib.sha256(listed.encode()).hexdigest()).alias("codebooks_sha256"),
    )


def _assigned(book: str) -> str:
    """Entry and squared distance of each part under a codebook."""
    return f"""SELECT id, part, min(far) AS far, arg_min(entry, (far, entry)) AS entry FROM (
    SELECT id, x.part, entry, sum((v - c) * (v - c)) AS far
    FROM x JOIN {book} b ON b.part = x.part AND b.place = x.place GROUP BY id, x.part, entry
  ) GROUP BY id, part"""


_FLOOR = "CAST((sum(v) - ((sum(v) % count(*)) + count(*)) % count(*)) / count(*) AS BIGINT)"
_ROUNDS = "".join(
    f""", a{r} AS MATERIALIZED ({_assigned(f"b{r}")}), m{r} AS (
  SELECT x.part, entry, place, {_FLOOR.replace("/", "//")} AS c FROM x JOIN a{r} USING (id, part) GROUP BY x.part, entry, place
), b{r + 1} AS MATERIALIZED (
  SELECT part, entry, place, coalesce(m{r}.c, b{r}.c) AS c FROM b{r} LEFT JOIN m{r} USING (part, entry, place)
)"""
    for r in range(6)
)
ORACLE_SQL["op11_vector_codes"] = f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS id, vec_id, label,
    [CAST(floor(4096 * CAST(v AS DOUBLE)) AS BIGINT) FOR v IN embedding] AS xs, len(embedding) // 8 AS width
  FROM embeddings
  WHERE embedding IS NOT NULL AND len([1 FOR v IN embedding IF v IS NULL OR NOT isfinite(v)]) = 0
), x AS MATERIALIZED (
  SELECT id, (i - 1) // width AS part, (i - 1) % width AS place, v
  FROM (SELECT id, width, unnest(xs) AS v, unnest(range(1, len(xs) + 1)) AS i FROM kept)
), b0 AS (
  SELECT part, id - 1 AS entry, place, v AS c FROM x WHERE id <= 16
){_ROUNDS}, last AS ({_assigned("b6")}), coded AS (
  SELECT id, string_agg(printf('%02x', CAST(entry AS INTEGER)), '' ORDER BY part) AS code, CAST(sum(far) AS BIGINT) AS error
  FROM last GROUP BY id
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY part, entry, place)) FROM b6) AS codebooks_sha256
FROM coded JOIN kept USING (id)"""
