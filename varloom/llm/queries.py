"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varloom.llm.common import shared_path, table

TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from varloom.llm.line_dedup import line_dedup

    return line_dedup(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_removed")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from varloom.llm.warc import assemble, read_records, write_archives

    path = shared_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    captures = assemble(read_records(spark, path))
    return captures.select(F.col("metadata.page_id").alias("page_id"), "response.payload_bytes", "response.payload_digest", "record_type", "response.refers_to")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from varloom.llm.licenses import scan_licenses

    return scan_licenses(table(spark, sf_dir, "documents"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str, model_path: str = TOKENIZER) -> DataFrame:
    from varloom.llm.sentencepiece import PieceModel, decode, encode

    model = PieceModel.load(model_path)
    tokens = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), model)
    return decode(tokens, model).select("doc_id", "n_tokens", "token_ids", F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    from varloom.llm.html_extract import extract_main_text

    pages = extract_main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from varloom.llm.toxicity import fit, held_out, score

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from varloom.llm.exact_dedup import exact_dedup

    return exact_dedup(table(spark, sf_dir, "documents"))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from varloom.llm.ngram_join import ngram_join

    return ngram_join(table(spark, sf_dir, "documents"))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from varloom.llm.embedding_dedup import embedding_dedup

    return embedding_dedup(table(spark, sf_dir, "embeddings"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from varloom.llm.mixing import mix_sources

    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from varloom.llm.hard_negatives import hard_negatives

    vectors = table(spark, sf_dir, "embeddings")
    vectors = vectors.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives(vectors, F.col("vec_id") % 100 == 0)


def op12_best_fit_packing(spark: SparkSession, sf_dir: str, tokenizer_path: str | None = None) -> DataFrame:
    from varloom.llm.packing import best_fit_packing

    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = str(public_tokenizers.path("word_bpe_49k.json"))
    return best_fit_packing(table(spark, sf_dir, "documents"), tokenizer_path)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from varloom.llm.filter_audit import filter_audit

    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_warc": op2_warc,
    "op3_license_scan": op3_license_scan,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_html_extract": op5_html_extract,
    "op6_toxicity": op6_toxicity,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_ngram_join": op8_ngram_join,
    "op9_mixing": op9_mixing,
    "op10_embedding_dedup": op10_embedding_dedup,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_best_fit_packing": op12_best_fit_packing,
    "op13_filter_audit": op13_filter_audit,
}

OP1_SQL = """
WITH lines AS (
  SELECT doc_id, coalesce('=' || source, '-') AS site, trim(unnest(list_distinct(string_split(text, chr(10)))), ' ' || chr(9) || chr(13)) AS line FROM documents
), wide AS (
  SELECT line, min(doc_id) AS first_doc FROM lines WHERE length(line) >= 20 GROUP BY line HAVING count(DISTINCT site) >= 10
), each AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS part, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents
), judged AS (
  SELECT e.*, w.line IS NOT NULL AND e.doc_id <> w.first_doc AS gone
  FROM each e LEFT JOIN wide w ON trim(e.part, ' ' || chr(9) || chr(13)) = w.line
)
SELECT doc_id, coalesce(string_agg(part, chr(10) ORDER BY pos) FILTER (WHERE NOT coalesce(gone, false)), '') AS text,
       CAST(count(*) FILTER (WHERE gone) AS INTEGER) AS n_removed
FROM judged GROUP BY doc_id
"""

OP2_SQL = """
WITH p AS (
  SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), g AS (
  SELECT payload_digest, max(page_id) AS top FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest HAVING count(*) > 1
)
SELECT page_id, payload_bytes, p.payload_digest, CASE WHEN top <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN top <> page_id THEN top END AS refers_to
FROM p LEFT JOIN g ON p.payload_digest = g.payload_digest
"""

OP7_SQL = """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents),
g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY norm)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(n.norm) AS text_sha256 FROM n JOIN g ON n.norm = g.norm
"""

OP10_SQL = """
WITH RECURSIVE ok AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.93
), reach AS (
  SELECT vec_id AS node, vec_id AS low FROM embeddings
  UNION
  SELECT l.b, r.low FROM reach r JOIN links l ON l.a = r.node WHERE r.low < l.b
), component AS (SELECT node, min(low) AS component_id FROM reach GROUP BY node)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN component ON node = vec_id LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) ON a = vec_id
"""

OP13_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(CAST(lang AS VARCHAR), '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), first AS (SELECT t, min(doc_id) AS low FROM d GROUP BY t
), m AS (
  SELECT part, CASE WHEN len(w) < 100 THEN 1 ELSE 0 END + CASE WHEN 100 * list_unique(w) < 80 * len(w) THEN 2 ELSE 0 END
    + CASE WHEN 100 * (length(d.t) - length(regexp_replace(d.t, '[A-Z]', '', 'g'))) > 10 * length(d.t) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(d.t, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN doc_id > low THEN 16 ELSE 0 END AS mask, doc_id
  FROM d JOIN first ON first.t = d.t
), l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id
), cells AS (SELECT part, mask, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, count(*) AS n FROM m LEFT JOIN l ON l.doc_id = m.doc_id GROUP BY ALL
), bits AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) b(f, bit)
), walk AS (
  SELECT f AS o, bit AS used, 1 AS k FROM bits
  UNION ALL SELECT o || f, used + bit, k + 1 FROM walk JOIN bits ON used & bit = 0
), steps AS (SELECT o AS filter_order, CAST(s AS INTEGER) AS step, substr(o, s, 1) AS f, substr(o, 1, s - 1) AS earlier FROM walk, range(1, 6) r(s) WHERE k = 5
), placed AS (SELECT s.filter_order, s.step, s.f, b.bit, coalesce((SELECT sum(e.bit) FROM bits e WHERE contains(s.earlier, e.f)), 0)::BIGINT AS past FROM steps s JOIN bits b ON b.f = s.f
), seen AS (
  SELECT part, filter_order, step, bit, CAST(coalesce(sum(n) FILTER (WHERE mask & (bit | past) = 0), 0) AS BIGINT) AS kept,
    CAST(coalesce(sum(n) FILTER (WHERE mask & bit <> 0 AND mask & past = 0), 0) AS BIGINT) AS removed, CAST(coalesce(sum(n) FILTER (WHERE mask & bit <> 0 AND mask & past <> 0), 0) AS BIGINT) AS redundant,
    CAST(coalesce(sum(n) FILTER (WHERE mask = bit), 0) AS BIGINT) AS unique_fails, CAST(coalesce(sum(n) FILTER (WHERE mask & bit <> 0 AND mask & past = 0 AND good = 1), 0) AS BIGINT) AS good_lost,
    CAST(coalesce(sum(n) FILTER (WHERE mask & bit <> 0 AND mask & past = 0 AND toxic = 1), 0) AS BIGINT) AS toxic_lost
  FROM cells, placed GROUP BY ALL
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM seen
"""
OP11_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)
), positives AS (
  SELECT * FROM (SELECT anchor_id, other_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) AS place FROM pairs WHERE same) WHERE place <= 5
), windows AS (
  SELECT p.*, n.other_id AS negative_id, n.score AS negative_score, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY n.score DESC, n.other_id) AS INTEGER) AS rank
  FROM positives p JOIN pairs n ON n.anchor_id = p.anchor_id AND NOT n.same AND 30 * positive_score <= 100 * n.score AND 100 * n.score <= 90 * positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM windows WHERE rank <= 10
"""

ORACLE_SQL = {"op11_hard_negatives": OP11_SQL, "op13_filter_audit": OP13_SQL, "op10_embedding_dedup": OP10_SQL, "op1_line_dedup": OP1_SQL, "op2_warc": OP2_SQL, "op7_exact_dedup": OP7_SQL}
