"""The registered queries of the training-data operators, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import chat, codes, fingerprint, hypervectors, language, licences, mixing, neighbours, packing, prefix_trie, quality, simhash, toxicity
from tessera.llm.common import id_hash, table


def op10_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document over links of at most four fingerprint bits."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", simhash.hex64(F.col("fp")).alias("fingerprint"), "component_id")


#: The labelled categories in the order of the chain; the last one decides.
TOXIC_CHAIN = ["low_quality", "toxic"]


def toxicity_chain(docs: DataFrame, labels: DataFrame) -> toxicity.Chain:
    own = labels.select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")
    return toxicity.train(docs, own, TOXIC_CHAIN)


def op1_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probabilities and verdict of the classifier chain for every document."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return toxicity.score(docs, toxicity_chain(docs, table(spark, sf_dir, "labels"))).drop("text")


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that the mix of all sources takes."""
    return mixing.mix(table(spark, sf_dir, "documents", "doc_id", "text", "source"))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk fingerprints of every document and of its edited text."""
    return fingerprint.fingerprints(table(spark, sf_dir, "documents", "doc_id", "text"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every formatted conversation, and of one that holds the template's own marks."""
    marks = "</s>[INST] ok [/INST]"
    planted = spark.createDataFrame([(-1, 0, "user", marks), (-1, 1, "assistant", marks)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text").unionByName(planted)
    return chat.digests(chat.format_conversations(rows))


def op5_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence of every document, its own or that of the nearest directory of the tree source/lang/id."""
    path = F.concat_ws("/", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("source", "lang", "doc_id")])
    docs = table(spark, sf_dir, "documents", "doc_id", "source", "lang", "text")
    found = licences.scan(docs.select(F.col("doc_id").alias("file_id"), path.alias("path"), "text"))
    return found.withColumnRenamed("file_id", "doc_id")


def op6_language_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language-model score of every document, learned from rows whose id hash mod 7 is not 2."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    model = language.train(docs.where(id_hash() % 7 != 2))
    return language.score(docs, model, (id_hash() % 7 == 2).alias("held_out"))


def op8_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learned from rows whose id hash mod 3 is not 1."""
    docs, labels = table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels")
    model = quality.train(docs, labels, where=id_hash() % 3 != 1)
    scored = quality.score(docs, model)
    return scored.select("doc_id", (id_hash() % 3 == 1).alias("held_out"), "score", "predicted")


def op9_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every row whose vec_id is divisible by 20."""
    return neighbours.search(table(spark, sf_dir, "embeddings", "vec_id", "embedding"), F.col("vec_id") % 20 == 0)


def op7_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every document in sequences of at most 4096 tokens."""
    return packing.pack(table(spark, sf_dir, "documents", "doc_id", "text"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the prefix trie of all conversations, each rebuilt to begin like the first of its hundred."""
    rows = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    return prefix_trie.nodes(prefix_trie.spliced(prefix_trie.ordered(rows)))


def op12_language_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from rows whose id hash mod 5 is not 0."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    model = hypervectors.train(docs, where=id_hash() % 5 != 0)
    found = hypervectors.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (id_hash() % 5 == 0).alias("held_out"), "lang_pred", "score")


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all vectors in eight parts by codebooks of 16 entries, after six rounds."""
    return codes.compress(table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity_chain": op1_toxicity_chain,
        "op2_mix_sources": op2_mix_sources,
        "op3_fingerprints": op3_fingerprints,
        "op4_chat_format": op4_chat_format,
        "op5_licence_scan": op5_licence_scan,
        "op6_language_scores": op6_language_scores,
        "op8_quality_trees": op8_quality_trees,
        "op7_pack_sequences": op7_pack_sequences,
        "op9_nearest_vectors": op9_nearest_vectors,
        "op10_simhash_near_duplicates": op10_simhash_near_duplicates,
        "op11_prefix_trie": op11_prefix_trie,
        "op12_language_profiles": op12_language_profiles,
        "op13_vector_codes": op13_vector_codes,
    }


OP4_SQL = """
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), marked AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k,
    lag(role, 1, '') OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before,
    length(text) + length(text) - length(replace(text, chr(92), ''))
      + (length(text) - length(replace(text, '</s>', ''))) // 4 + (length(text) - length(replace(text, '<s>', ''))) // 3
      + (length(text) - length(replace(text, '[/INST]', ''))) // 7 + (length(text) - length(replace(text, '[INST]', ''))) // 6
      + (length(text) - length(replace(text, '[/SYS]', ''))) // 6 + (length(text) - length(replace(text, '[SYS]', ''))) // 5
      + (length(text) - length(replace(text, '[/ROLE]', ''))) // 7 + (length(text) - length(replace(text, '[ROLE]', ''))) // 6
      + (length(text) - length(replace(text, '[TEXT]', ''))) // 6 AS escaped,
    CASE role WHEN 'system' THEN 14 WHEN 'user' THEN 15 WHEN 'assistant' THEN 10 ELSE 24 + length(role) END AS marks
  FROM rows_
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(escaped + marks)::BIGINT AS formatted_chars,
  bool_and((before, role) IN (('', 'system'), ('', 'user'), ('system', 'user'), ('user', 'assistant'), ('assistant', 'user'))) AS valid
FROM marked GROUP BY conv_id
"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_TEMPLATE_ROWS = ", ".join(f"({k}, {_quoted(name)}, {_quoted(text)})" for k, (name, text) in enumerate(licences.TEMPLATES))
_ANCHORED = " OR ".join(f"contains(lower({{0}}), {_quoted(a)})" for a in licences.ANCHORS)
OP5_SQL = f"""
WITH docs AS (
  SELECT doc_id, coalesce(source, '') || '/' || coalesce(lang, '') || '/' || coalesce(doc_id::VARCHAR, '') AS path, coalesce(text, '') AS text FROM documents
),
split_ AS (
  SELECT doc_id, path, text, string_split(text, chr(10)) AS lines, string_split_regex(text, '{licences.PARAGRAPH}') AS paragraphs
  FROM docs WHERE {_ANCHORED.format("text")}
),
headed AS (
  SELECT *, list_position(list_transform(lines, lambda x: NOT regexp_matches(x, {_quoted(licences.HEADER_LINE)})), true) AS k FROM split_
),
parts AS (
  SELECT doc_id, path, true AS whole, text AS unit FROM split_
  UNION ALL SELECT doc_id, path, false, unit FROM (
    SELECT DISTINCT doc_id, path, unnest(list_concat([array_to_string(CASE WHEN k > 0 THEN lines[1:k - 1] ELSE lines END, chr(10))], paragraphs, lines)) AS unit FROM headed
  ) WHERE {_ANCHORED.format("unit")}
),
units AS (SELECT DISTINCT unit FROM parts),
templates(template, licence, text) AS (VALUES {_TEMPLATE_ROWS}),
a AS (
  SELECT unit, term, count(*) AS tf
  FROM (SELECT unit, unnest(regexp_split_to_array(lower(unit), '{licences.BETWEEN}')) AS term FROM units) WHERE term <> '' GROUP BY ALL
),
b AS (
  SELECT template, licence, term, count(*) AS tf
  FROM (SELECT template, licence, unnest(regexp_split_to_array(lower(text), '{licences.BETWEEN}')) AS term FROM templates) WHERE term <> '' GROUP BY ALL
),
idf AS (
  SELECT term, ln((1.0 + (SELECT count(*) FROM units) + {len(licences.TEMPLATES)}) / (1 + count(*))) + 1 AS idf
  FROM (SELECT term FROM a UNION ALL SELECT term FROM b) GROUP BY term
),
aw AS (SELECT unit, term, tf * idf AS w FROM a JOIN idf USING (term)),
bw AS (SELECT template, licence, term, tf * idf AS w FROM b JOIN idf USING (term)),
al AS (SELECT unit, sqrt(sum(w * w)) AS n FROM aw GROUP BY unit),
bl AS (SELECT template, sqrt(sum(w * w)) AS n FROM bw GROUP BY template),
scored AS (
  SELECT d.unit, d.licence, round(d.dot / (al.n * bl.n), 6) AS cosine
  FROM (SELECT unit, template, licence, sum(aw.w * bw.w) AS dot FROM aw JOIN bw USING (term) GROUP BY unit, template, licence) d
  JOIN al USING (unit) JOIN bl USING (template)
),
found AS (
  SELECT unit, licence, cosine FROM scored WHERE cosine >= {licences.LIKE}
  QUALIFY row_number() OVER (PARTITION BY unit ORDER BY cosine DESC, licence) = 1
),
own AS (
  SELECT doc_id, path, licence, cosine, speaks OR regexp_matches(path, '{licences.FILE_NAME}') AS is_file
  FROM (
    SELECT doc_id, path, licence, cosine, bool_or(whole) OVER (PARTITION BY doc_id) AS speaks,
      row_number() OVER (PARTITION BY doc_id ORDER BY cosine DESC, licence) AS k
    FROM parts JOIN found USING (unit)
  ) WHERE k = 1
),
licensed AS (
  SELECT regexp_replace(path, '/[^/]*$', '') AS dir, licence, cosine FROM own WHERE is_file
  QUALIFY row_number() OVER (PARTITION BY dir ORDER BY cosine DESC, licence) = 1
),
inherited AS (
  SELECT doc_id, dir, licence, cosine FROM docs JOIN licensed ON dir = '' OR starts_with(path, dir || '/')
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length(dir) DESC) = 1
)
SELECT d.doc_id, d.path, coalesce(o.licence, i.licence) AS licence, coalesce(o.cosine, i.cosine) AS cosine,
  CASE WHEN o.licence IS NOT NULL THEN 'statement' WHEN i.licence IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin,
  CASE WHEN o.licence IS NULL THEN i.dir END AS directory
FROM docs d LEFT JOIN own o USING (doc_id) LEFT JOIN inherited i USING (doc_id)
"""


# crc32 of decimal ids byte by byte; a path is the digests of its turns in a row, 32 characters each.
OP11_SQL = """
WITH RECURSIVE steps(i, k, v) AS (
  SELECT i, 0, i FROM range(256) t(i)
  UNION ALL SELECT i, k + 1, CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM steps WHERE k < 8
), crc_table AS (SELECT list(v ORDER BY i) AS t FROM steps WHERE k = 8
), ids AS (SELECT conv_id, count(*) AS n FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), crc(conv_id, k, v) AS (
  SELECT conv_id, 0, 4294967295 FROM ids
  UNION ALL
  SELECT conv_id, k + 1, xor(v >> 8, t[xor(v & 255, ascii(substr(conv_id::VARCHAR, k + 1, 1))) + 1]) FROM crc, crc_table WHERE k < length(conv_id::VARCHAR)
), heads AS (
  SELECT conv_id, n, conv_id - conv_id % 100 AS base, xor(v, 4294967295) % 6 AS h FROM crc JOIN ids USING (conv_id) WHERE k = length(conv_id::VARCHAR)
), turns AS (
  SELECT conv_id, md5(concat_ws(chr(10), length(role)::VARCHAR, role, text)) AS turn, length(text) AS chars,
    row_number() OVER (PARTITION BY conv_id ORDER BY t NULLS FIRST, role, text) - 1 AS position
  FROM (SELECT conv_id, turn AS t, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)
), rebuilt AS (
  SELECT conv_id, position, turn, chars FROM turns JOIN heads USING (conv_id) WHERE conv_id = base
  UNION ALL
  SELECT h.conv_id, t.position, turn, chars FROM heads h JOIN turns t ON t.conv_id = h.base AND t.position < h.h WHERE h.conv_id <> h.base
  UNION ALL
  SELECT h.conv_id, t.position - h.h + least(h.h, coalesce(b.n, 0)), turn, chars
  FROM heads h JOIN turns t ON t.conv_id = h.conv_id AND t.position >= h.h LEFT JOIN heads b ON b.conv_id = h.base WHERE h.conv_id <> h.base
), paths AS (
  SELECT conv_id, position + 1 AS depth, turn, chars, string_agg(turn, '') OVER (PARTITION BY conv_id ORDER BY position) AS path FROM rebuilt
  UNION ALL SELECT conv_id, 0, NULL, 0, '' FROM heads
), tree AS (
  SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(turn) AS turn, any_value(chars) AS chars FROM paths GROUP BY path, depth
), childless AS (SELECT path FROM tree WHERE path NOT IN (SELECT left(path, length(path) - 32) FROM tree WHERE depth > 0)
), below AS (
  SELECT p.path, sum((t.n_convs - 1) * t.chars) AS saved_tokens, count(c.path) AS n_leaves
  FROM tree t JOIN paths p ON p.conv_id = t.conv_id AND p.depth <= t.depth LEFT JOIN childless c ON c.path = t.path GROUP BY p.path
), ends AS (
  SELECT path, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends_sha256
  FROM (SELECT conv_id, path FROM paths QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY depth DESC) = 1) GROUP BY path
), children AS (SELECT left(path, length(path) - 32) AS path, count(*) AS n_children FROM tree WHERE depth > 0 GROUP BY 1)
SELECT t.conv_id, t.depth, p.conv_id AS parent_conv_id, t.n_convs, coalesce(n_children, 0) AS n_children, n_leaves,
  saved_tokens::BIGINT AS saved_tokens, coalesce(ends_sha256, sha256('')) AS ends_sha256, t.turn
FROM tree t JOIN below USING (path) LEFT JOIN ends USING (path) LEFT JOIN children USING (path)
LEFT JOIN tree p ON t.depth > 0 AND p.path = left(t.path, length(t.path) - 32)
"""


def _op13_sql() -> str:
    """The rounds written out: books0, near0, books1, ... near6."""
    near = """near{k} AS MATERIALIZED (
  SELECT * FROM (SELECT r, d, part, x, e, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS distance FROM cuts JOIN books{k} USING (d, part))
  QUALIFY row_number() OVER (PARTITION BY r, part ORDER BY distance, e) = 1
)"""
    means = """books{n} AS MATERIALIZED (
  SELECT b.d, b.part, b.e, coalesce(m.c, b.c) AS c FROM books{k} b LEFT JOIN (
    SELECT d, part, e, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY place) AS c
    FROM (SELECT d, part, e, place, sum(v) AS s, count(*) AS n FROM (SELECT d, part, e, unnest(x) AS v, generate_subscripts(x, 1) AS place FROM near{k}) GROUP BY d, part, e, place)
    GROUP BY d, part, e
  ) m USING (d, part, e)
)"""
    rounds = ",\n".join(near.format(k=k) + ",\n" + means.format(k=k, n=k + 1) for k in range(codes.ROUNDS))
    return f"""
WITH kept AS (
  SELECT vec_id, label, len(embedding) AS d, list_transform(embedding, lambda x: floor({codes.SCALE} * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), numbered AS (
  SELECT *, row_number() OVER () AS r, row_number() OVER (PARTITION BY d ORDER BY vec_id NULLS LAST, v) AS k FROM kept
), cuts AS MATERIALIZED (
  SELECT r, k, d, part, v[d * part // {codes.PARTS} + 1 : d * (part + 1) // {codes.PARTS}] AS x FROM numbered, range({codes.PARTS}) t(part)
), books0 AS (SELECT d, part, k AS e, x AS c FROM cuts WHERE k <= {codes.ENTRIES}),
{rounds},
{near.format(k=codes.ROUNDS)},
coded AS (SELECT r, string_agg(printf('%02x', e - 1), '' ORDER BY part) AS code, sum(distance)::BIGINT AS error FROM near{codes.ROUNDS} GROUP BY r),
digests AS (SELECT d, sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, e)) AS codebooks_sha256 FROM books{codes.ROUNDS} GROUP BY d)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256, label
FROM numbered JOIN coded USING (r) JOIN digests USING (d)
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_chat_format": OP4_SQL, "op5_licence_scan": OP5_SQL, "op11_prefix_trie": OP11_SQL, "op13_vector_codes": _op13_sql()}
