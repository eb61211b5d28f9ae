"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import embed_dedup, exact_dedup, hard_negatives, langid, licences, packing, pii, quality, sepscan, simhash, sp_codec, warc, whitening
from .common import table

#: Parameter: the tokenizers file that the token queries use.
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
#: Parameter: the id that ends a document in flat token files; no ordinary text has it.
END_ID = 50256
#: Parameter: the weights of the residual tokens, documents and attention cost in packing.
WEIGHTS = (1.0, 0.05, 0.05)
#: Parameter: the SentencePiece model file.
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings of equal label at cosine 0.98."""
    return embed_dedup.near_vectors(table(spark, sf_dir, "embeddings"), threshold=0.98)


OP1_SQL = """
WITH v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (WITH RECURSIVE r(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, link.b FROM r JOIN link ON r.b = link.a) SELECT a, min(b) AS b FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, reach.b AS component_id, e.vec_id = reach.b AS kept
FROM embeddings e JOIN reach ON reach.a = e.vec_id LEFT JOIN n ON n.a = e.vec_id
"""


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens.

    As few sequences as can be are asked for, so the other two capacities stand at what 2048 tokens can hold; all three
    residuals weigh in the choice of a bin.
    """
    return packing.pack(table(spark, sf_dir, "documents"), TOKENIZER, weights=WEIGHTS)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents, learned from the labels outside the held-out fold."""
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal-data spans of all documents."""
    d = pii.detect_all(table(spark, sf_dir, "documents"))
    counts = [f"n_{k}" for k in pii.BASE]
    spans = pii.listed(pii.by_kind(F.concat("base", "extra")))
    return d.select("doc_id", *counts, F.sha2(pii.listed(pii.by_kind(F.col("base"))), 256).alias("base_sha256"), spans.alias("spans"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to WARC archives and read back."""
    return warc.round_trip(table(spark, sf_dir, "pages"), least=0)


OP5_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last FROM pages),
h AS (SELECT page_id, strlen(html) AS n, sha1(html) AS h, last FROM p)
SELECT page_id, n AS payload_bytes,
  list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    ((('0x' || substr(h, 5 * (i // 4) + 1, 5))::INTEGER >> (15 - 5 * (i % 4))::INTEGER) & 31) + 1, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to
FROM h
"""


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents with equal normalised texts."""
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


OP6_SQL = """
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS n FROM documents),
g AS (SELECT n, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY n)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.n) AS text_sha256
FROM d JOIN g ON d.n = g.n
"""


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents, learned from those outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    fold = lambda c: F.coalesce(F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))
    model = langid.learn(docs.where(~fold(F.col("doc_id"))))
    d = langid.identify(docs, model)
    return d.select("doc_id", fold(F.col("doc_id")).alias("held_out"), "lang_pred", "score", F.size("spans").cast("long").alias("n_spans"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents: four-word shingles, at most four differing bits."""
    return simhash.near_groups(table(spark, sf_dir, "documents"), width=4, radius=4)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written as flat token files, and their tokens counted by the separator scan."""
    return sepscan.token_counts(table(spark, sf_dir, "documents"), TOKENIZER, END_ID)


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded by the SentencePiece model."""
    return sp_codec.round_trip(table(spark, sf_dir, "documents"), PIECES)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hard negatives of every hundredth vector against all vectors."""
    finite = F.forall("embedding", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) != float("inf")), F.lit(False)))
    label = F.when(F.pmod("vec_id", F.lit(7)) == 0, F.pmod(F.col("label") + 1, F.lit(10))).otherwise(F.col("label"))
    x = F.transform("embedding", lambda c: F.floor(F.lit(256.0) * c.cast("double")))
    v = table(spark, sf_dir, "embeddings").where(finite)
    return hard_negatives.mine(v.select(F.col("vec_id").alias("id"), label.alias("label"), x.alias("x"), (F.pmod("vec_id", F.lit(100)) == 0).alias("anchor")))


OP11_SQL = """
WITH v AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS x
  FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (SELECT a.id AS anchor_id, b.id, a.label = b.label AS same, list_inner_product(a.x, b.x)::BIGINT AS score
  FROM v a JOIN v b ON a.id % 100 = 0 AND a.id <> b.id AND len(a.x) = len(b.x)),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)::INTEGER AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings whitened on their four leading components."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"), components=4)


def op13_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and notices in all documents."""
    return licences.scan(table(spark, sf_dir, "documents")).drop("found")


def _quoted(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


_TEMPLATES = [(label, phrase, True, []) for label, phrase in licences.BASE] + [(label, notice, False, keys) for label, notice, keys in licences.NOTICES]
OP13_SQL = f"""
WITH t(t, label, words, base, keys) AS (VALUES {", ".join(f"({i}, '{label}', string_split('{words}', ' '), {base}, {_quoted(keys)}::VARCHAR[])" for i, (label, words, base, keys) in enumerate(_TEMPLATES))}),
d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(lower(replace(coalesce(text, ''), 'K', 'ĸ')), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
h AS MATERIALIZED (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS i FROM d),
tw AS (SELECT t, base, unnest(words) AS w, generate_subscripts(words, 1) - 1 AS j, len(words) AS size FROM t),
df AS (SELECT w, count(DISTINCT doc_id) AS n FROM h WHERE w IN (SELECT w FROM tw) GROUP BY w),
p AS (SELECT t, w, j, CASE WHEN base THEN size ELSE least({licences.AGREE}, size) END AS need FROM tw LEFT JOIN df USING (w)
  QUALIFY base OR row_number() OVER (PARTITION BY t ORDER BY coalesce(n, 0), j) <= {licences.RARE}),
c AS (SELECT doc_id, t, i - j AS s FROM h JOIN p USING (w) GROUP BY ALL HAVING count(*) >= min(need)),
k AS (SELECT t, words, string_split(unnest(keys), ' ') AS key FROM t),
ka AS (SELECT t, key, list_min(list_filter(range(len(words)), lambda i: words[i + 1:i + len(key)] = key)) AS place FROM k),
failed AS (SELECT DISTINCT c.doc_id, c.t, c.s FROM c JOIN ka ON ka.t = c.t JOIN d ON d.doc_id = c.doc_id
  WHERE len(list_filter(range(c.s + place - {licences.SLACK}, c.s + place + {licences.SLACK} + 1), lambda i: i >= 0 AND ws[i + 1:i + len(key)] = key)) = 0),
found AS (SELECT c.doc_id, t.label, t.base, c.s, len(list_filter(range(len(words)), lambda j: c.s + j >= 0 AND ws[c.s + j + 1] = words[j + 1])) / len(words) AS share
  FROM c JOIN t ON t.t = c.t JOIN d ON d.doc_id = c.doc_id WHERE NOT EXISTS (SELECT 1 FROM failed f WHERE f.doc_id = c.doc_id AND f.t = c.t AND f.s = c.s)),
g AS (SELECT doc_id, count(*) FILTER (WHERE base) AS n_base, min(s) FILTER (WHERE base) AS first_word, max(s) FILTER (WHERE base) AS last_word,
  string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score FROM found GROUP BY doc_id)
SELECT d.doc_id, len(ws) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM d LEFT JOIN g ON g.doc_id = d.doc_id
"""


def queries() -> dict:
    found = (op1_embedding_dedup, op2_packing, op3_quality, op4_pii, op5_warc, op6_exact_dedup, op7_language, op8_simhash, op9_token_counts, op10_sentencepiece, op11_hard_negatives, op12_whitening, op13_licences)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op1_embedding_dedup": OP1_SQL, "op5_warc": OP5_SQL, "op6_exact_dedup": OP6_SQL, "op11_hard_negatives": OP11_SQL, "op13_licences": OP13_SQL}
