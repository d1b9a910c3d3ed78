"""One query per operator over its whole table, and SQL where that can express it."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelgrid.llm import bpe, suffix
from labelgrid.llm.common import table
from labelgrid.llm.lm import lm_scores
from labelgrid.llm.lines import drop_recurring_lines
from labelgrid.llm.media import DIGEST, page_digest, texts_as_media, tiff_pages
from labelgrid.llm.packing import pack
from labelgrid.llm.sharding import extendible_shards
from labelgrid.llm.simhash import near_duplicates
from labelgrid.llm.sketches import edited_documents
from labelgrid.llm.toxicity import CATEGORIES, THRESHOLD, chain_labels, score, train

#: Bytes of text in a shard: so few that even the smallest tables split.
SHARD_BYTES = 1 << 20


def word_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_best_fit_packing(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"), word_bpe())


def op2_maxent_lm(spark, sf_dir):
    return lm_scores(table(spark, sf_dir, "documents"))


def op3_byte_bpe(spark, sf_dir):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encoded(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, bpe.digest, bpe.DIGEST)


def op4_suffix_dedup(spark, sf_dir):
    return suffix.remove_repeats(table(spark, sf_dir, "documents"), suffix.digest, suffix.DIGEST)


def op5_line_templates(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = drop_recurring_lines(docs, shortest=1)
    return out.select("doc_id", F.col("lines_total").cast("long").alias("n_lines"), F.col("lines_dropped").cast("long").alias("n_dropped"), F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256).alias("kept_sha256"))


def op6_simhash(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))


def op7_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    chain = train(docs, chain_labels(table(spark, sf_dir, "labels")), CATEGORIES)
    return score(docs, chain).select("doc_id", "p_junk", "p_toxic", (F.col("p_toxic") >= THRESHOLD).alias("toxic"))


def op8_fingerprints(spark, sf_dir):
    return edited_documents(table(spark, sf_dir, "documents"))


def op9_tiff(spark, sf_dir):
    media = texts_as_media(table(spark, sf_dir, "documents"))
    kept = ["doc_id", "n_bytes", "payload_bytes", "media_bytes", "media_sha256"]
    pages = tiff_pages(media, "media", kept, page_digest, DIGEST)  # one page a document
    return pages.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height", "compression")


def op10_extendible_shards(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return extendible_shards(docs, "doc_id", F.octet_length("text"), SHARD_BYTES).drop("oversized")


QUERIES = {f.__name__: f for f in (op1_best_fit_packing, op2_maxent_lm, op3_byte_bpe, op4_suffix_dedup, op5_line_templates, op6_simhash, op7_toxicity, op8_fingerprints, op9_tiff, op10_extendible_shards)}

_LINES = """
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
m AS (
  SELECT doc_id, pos, line, regexp_replace(regexp_replace(regexp_replace(
    lower(line), '[ \\t\\r]+', ' ', 'g'), '^ | $', '', 'g'),
    '(^| )[^ 0-9]*[0-9][^ ]*', '\\1<*>', 'g') AS m FROM l),
k AS (
  SELECT doc_id, pos, string_split(m, ' ') AS t, len(string_split(m, ' ')) AS n,
    concat(len(string_split(m, ' ')), ' ', array_to_string(string_split(m, ' ')[1:LEADING], ' ')) AS leaf FROM m WHERE m <> ''),
hot AS (SELECT leaf FROM k GROUP BY leaf HAVING count(DISTINCT doc_id) >= MIN_DOCS),
h AS (SELECT k.* FROM k SEMI JOIN hot USING (leaf)),
w AS (SELECT leaf, doc_id, pos, n, unnest(t) AS t, generate_subscripts(t, 1) AS i FROM h),
best AS (SELECT leaf, i, max(struct_pack(c := c, t := t)).t AS t FROM (SELECT leaf, i, t, count(*) AS c FROM w GROUP BY ALL) GROUP BY leaf, i),
member AS (
  SELECT w.leaf, w.doc_id, w.pos FROM w JOIN best ON w.leaf = best.leaf AND w.i = best.i
  GROUP BY w.leaf, w.doc_id, w.pos, w.n HAVING count(*) FILTER (w.t = best.t) >= w.n * AGREE::DOUBLE),
other AS (SELECT w.* FROM w ANTI JOIN member ON w.leaf = member.leaf AND w.doc_id = member.doc_id AND w.pos = member.pos),
common AS (SELECT leaf, i, t FROM other GROUP BY ALL HAVING count(*) >= MIN_DOCS),
own AS (
  SELECT o.leaf, o.doc_id, o.pos, string_agg(coalesce(c.t, '<*>'), ' ' ORDER BY o.i) AS template FROM other o LEFT JOIN common c ON o.leaf = c.leaf AND o.i = c.i AND o.t = c.t
  GROUP BY o.leaf, o.doc_id, o.pos, o.n HAVING count(c.t) >= o.n * AGREE::DOUBLE),
placed AS (SELECT leaf, '' AS template, doc_id, pos FROM member UNION ALL SELECT leaf, template, doc_id, pos FROM own),
spread AS (SELECT leaf, template, min(struct_pack(d := doc_id, p := pos)) AS f FROM placed GROUP BY leaf, template HAVING count(DISTINCT doc_id) >= MIN_DOCS),
gone AS (SELECT DISTINCT p.doc_id, p.pos FROM placed p JOIN spread s ON p.leaf = s.leaf AND p.template = s.template WHERE NOT (p.doc_id = f.d AND p.pos = f.p)),
rest AS (
  SELECT l.doc_id, count(*) AS n_lines, count(gone.pos) AS n_dropped, coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (gone.pos IS NULL), '') AS body
  FROM l LEFT JOIN gone ON l.doc_id = gone.doc_id AND l.pos = gone.pos GROUP BY l.doc_id)
SELECT doc_id, n_lines, n_dropped, sha256(body) AS kept_sha256 FROM rest
"""

_SHARDS = """
WITH d AS (
  SELECT doc_id, octet_length(encode(text)) AS n_bytes, CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 9) AS BIGINT) AS h FROM documents),
p AS (SELECT doc_id, n_bytes, h, CAST(k AS INTEGER) AS depth, sum(n_bytes) OVER (PARTITION BY k, h >> (36 - k)) AS shard_bytes FROM d CROSS JOIN range(0, 37) t(k)),
f AS (SELECT doc_id, n_bytes, h, min(struct_pack(k := depth, b := shard_bytes)) AS s FROM p WHERE shard_bytes <= LIMIT_BYTES GROUP BY ALL)
SELECT doc_id, n_bytes, substr(lpad(bin(h), 36, '0'), 1, s.k) AS shard, s.k AS depth, CAST(s.b AS BIGINT) AS shard_bytes FROM f
"""


def shards_sql(limit: int) -> str:
    """Sizes of every prefix of every key (no key here is shared by rows or larger than the limit)."""
    return _SHARDS.replace("LIMIT_BYTES", str(limit))


def lines_sql() -> str:
    from labelgrid.llm.lines import AGREE, LEADING, MIN_DOCS

    return _LINES.replace("LEADING", str(LEADING)).replace("MIN_DOCS", str(MIN_DOCS)).replace("AGREE", str(AGREE))


ORACLES = {"op5_line_templates": lines_sql(), "op10_extendible_shards": shards_sql(SHARD_BYTES)}
