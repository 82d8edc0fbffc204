"""The training-data operators' queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, langid, line_dedup, media, minhash, packing, periodic, repair, sharding, substring, token_io, toxicity, warc

#: Names of public tokenizers' files; each machine finds them by public_tokenizers.path().
WORD_BPE, BYTE_BPE = "word_bpe_49k.json", "byte_bpe_50k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(_table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "n_links", "kept_sha256")


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_io.ids_digest(token_io.token_files(_table(spark, sf_dir, "documents"), WORD_BPE))


def op4_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard_by_bytes(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digest(media.store_texts(_table(spark, sf_dir, "documents")))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminations(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    models = langid.train(docs.filter(langid.learnable()))
    return langid.identify(docs.select(F.col("doc_id").cast("long"), "text"), models).select("doc_id", (~langid.learnable()).alias("held_out"), "lang_pred", "score", "rejected")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(_table(spark, sf_dir, "documents")).drop("kept")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_along_curve(_table(spark, sf_dir, "documents"), BYTE_BPE)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels.filter(toxicity.learnable()))
    return toxicity.score(docs, model).select("doc_id", (~toxicity.learnable()).alias("held_out"), "score", "predicted")


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.write_archives(_table(spark, sf_dir, "pages"))
    return warc.read_archives(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.runs_digest(periodic.periodic_runs(_table(spark, sf_dir, "documents"), placed=periodic.repeat_tail))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair_conversations(repair.damaged(_table(spark, sf_dir, "conversations")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_line_dedup, op2_near_duplicates, op3_token_files, op4_shards, op5_media, op6_decontamination, op7_language, op8_substring_dedup, op9_packing, op10_toxicity, op11_warc, op12_periodic_runs, op13_conversation_repair)
    return {f.__name__: f for f in ops}


_LINES_SQL = r"""
WITH RECURSIVE docs AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM docs),
c AS (SELECT line, min((doc_id, pos)) AS first, length(line) AS n FROM l WHERE trim(line, chr(32) || chr(9) || chr(13)) <> '' GROUP BY line),
near AS (
  SELECT a.line AS x, b.line AS y, a.first AS xf, b.first AS yf
  FROM c a JOIN c b ON b.n BETWEEN a.n AND a.n + 2 AND a.line <> b.line AND (a.n < b.n OR a.line < b.line)
  WHERE a.n >= 16
    AND (contains(b.line, substring(a.line, 1, a.n // 3)) OR contains(b.line, substring(a.line, a.n // 3 + 1, a.n // 3)) OR contains(b.line, substring(a.line, 2 * (a.n // 3) + 1)))
    AND levenshtein(a.line, b.line) <= 2),
ends AS (SELECT x AS line, yf < xf AS late FROM near UNION ALL SELECT y, xf < yf FROM near),
judged AS (SELECT c.line, c.first, count(ends.line) AS links, coalesce(bool_or(late), false) AS late FROM c LEFT JOIN ends ON ends.line = c.line GROUP BY c.line, c.first),
marked AS (
  SELECT l.doc_id, l.pos, l.line, j.line IS NULL OR (j.first = (l.doc_id, l.pos) AND NOT j.late) AS keep,
         CASE WHEN j.first = (l.doc_id, l.pos) THEN j.links ELSE 0 END AS links
  FROM l LEFT JOIN judged j ON j.line = l.line)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (NOT keep) AS n_removed, sum(links)::BIGINT AS n_links,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (keep), '')) AS kept_sha256
FROM marked GROUP BY doc_id
UNION ALL SELECT doc_id, 1, 0, 0, sha256('') FROM documents WHERE text IS NULL
"""

_NEAR_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
r(a, b) AS (SELECT a, b FROM e UNION SELECT b, a FROM e UNION SELECT r.a, f.b FROM r JOIN (SELECT a, b FROM e UNION SELECT b, a FROM e) f ON f.a = r.b)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(c.m, d.doc_id)) AS component_id, d.doc_id <= coalesce(c.m, d.doc_id) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a, min(b) AS m FROM r GROUP BY a) c ON c.a = d.doc_id
"""

_SUBSTRING_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(list_slice(w, i, i + 49), ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
late AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS m FROM win) WHERE m < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS pos FROM late),
g AS (SELECT doc_id, list(pos) AS poss FROM gone GROUP BY doc_id),
k AS (SELECT d.doc_id, len(w) AS n, CASE WHEN poss IS NULL THEN w ELSE list_transform(list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(poss, i)), lambda i: w[i]) END AS kept
      FROM d LEFT JOIN g USING (doc_id))
SELECT doc_id, n::BIGINT AS n_words, (n - len(kept))::BIGINT AS n_removed, sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256 FROM k
"""


def _decontamination_sql() -> str:
    """Every alignment with enough equal words, compared word by word; no mask takes part in finding them."""
    words = "list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')"
    held = " + ".join(f"len(list_filter(range(0, n - {decontam.SPAN - 1}), lambda p: {' AND '.join(f'eq[p + {j + 1}] = 1' for j, c in enumerate(mask) if c == '#')}))" for mask in decontam.MASKS)
    return f"""
WITH d AS (SELECT doc_id, {words} AS w FROM documents), b AS (SELECT DISTINCT item_id, {words} AS w FROM benchmark),
dw AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
bw AS (SELECT item_id, unnest(w) AS word, generate_subscripts(w, 1) AS i, least(len(w), 13) AS len_of FROM b),
hits AS (SELECT doc_id, item_id, dw.i - bw.i AS doc_word FROM dw JOIN bw USING (word) GROUP BY ALL HAVING count(*) * 100 >= max(len_of) * 80),
al AS (SELECT h.*, least(len(b.w), 13) AS len_of, list_transform(range(1, len(b.w) + 1), lambda k: CASE WHEN h.doc_word + k >= 1 AND d.w[greatest(h.doc_word + k, 1)] = b.w[k] THEN 1 ELSE 0 END) AS eq, len(b.w) AS n
       FROM hits h JOIN d USING (doc_id) JOIN b USING (item_id)),
best AS (SELECT doc_id, item_id, doc_word, len_of, list_max(list_transform(range(1, n - len_of + 2), lambda p: list_sum(list_slice(eq, p, p + len_of - 1)))) AS matched,
                CASE WHEN n >= {decontam.SPAN} THEN {held} WHEN list_sum(eq) = n THEN 1 ELSE 0 END AS seeds FROM al),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY matched DESC, doc_word) AS r FROM best WHERE matched * 100 >= len_of * 80)
SELECT doc_id, item_id, matched::INT AS matched, len_of::INT AS "of", doc_word::INT AS doc_word, seeds::BIGINT AS seeds FROM ranked WHERE r = 1
"""


_WARC_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS f FROM pages),
d AS (SELECT *, list_transform(range(0, 8), lambda k: ('0x' || substr(sha1(h), 5 * k + 1, 5))::INT) AS fives FROM p)
SELECT page_id, strlen(h)::BIGINT AS payload_bytes,
       array_to_string(list_transform(fives, lambda v: array_to_string(list_transform([15, 10, 5, 0], lambda b: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> b) & 31) + 1, 1)), '')), '') AS payload_digest,
       CASE WHEN page_id = f THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> f THEN f END AS refers_to
FROM d
"""


def oracle_sql() -> dict[str, str]:
    """SQL where it can say what a query does. It can't where the result is a checksum it has no
    function for (3, 4, 5, 9, 12, 13) or that of a fitted model (7, 10); those are tested by brute force."""
    return {"op1_line_dedup": _LINES_SQL, "op2_near_duplicates": _NEAR_SQL, "op6_decontamination": _decontamination_sql(), "op8_substring_dedup": _SUBSTRING_SQL, "op11_warc": _WARC_SQL}
