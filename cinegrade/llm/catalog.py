"""The queries of the training-data operators over the driver tables, and SQL twins where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from cinegrade.llm import (
    chunked_bpe,
    conversation_repair,
    divergence_audit,
    exact_dedup,
    jaccard_join,
    language_bits,
    license_scan,
    mixing,
    ordinal,
    pu_toxicity,
    token_counts,
    token_files,
    tree_rules,
)
from cinegrade.llm.common import table
from cinegrade.session import scratch_path


def file_bytes(name: str) -> bytes:
    """A vocabulary file, read once by the driver and sent along with the tasks."""
    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), file_bytes("piece_bpe_32k.model"))


def held_out_rows() -> Column:
    """Rows that teach nothing: the checksum of the id leaves 2."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op2_language_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fitted = language_bits.fit_filter(docs.where(~held_out_rows()).select("lang", "text"))
    return language_bits.predict(docs, fitted, held_out=held_out_rows())


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_matches(table(spark, sf_dir, "documents"), license_scan.notices(spark))


def op4_tree_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return tree_rules.judge(docs, tree_rules.fit_rules(docs, table(spark, sf_dir, "labels")))


def op5_ordinal_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = ordinal.fit_ordinal(docs, ordinal.grades_of(table(spark, sf_dir, "labels")), grades=ordinal.GRADES)
    return ordinal.grade(docs, model, select=ordinal.GRADES - 1)


def op6_chunked_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = file_bytes("byte_bpe_multi_50k.tiktoken")
    ids = chunked_bpe.encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    return chunked_bpe.decode_table(ids, ranks).select(
        "doc_id", "n_tokens", F.sha2(F.col("listed").cast("binary"), 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))


def op7_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(table(spark, sf_dir, "documents")).drop("whole")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = file_bytes("byte_bpe_50k.json").decode()
    path = scratch_path(spark, "token-files")
    width = token_files.write_token_files(table(spark, sf_dir, "documents"), path, model, vocab_size=50_257)
    return token_files.read_token_files(spark, path, width)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"), text_sha256=F.sha2(text.cast("binary"), 256))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_groups(table(spark, sf_dir, "documents"), words_each=3, at_least=(9, 10))


def op11_pu_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = pu_toxicity.fit_toxicity(docs.where(~held_out_rows()), labels.where(~held_out_rows()))
    return pu_toxicity.predict(docs, model, held_out_rows())


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return conversation_repair.report(rows, conversation_repair.damaged(rows))


def op13_divergence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence_audit.audit(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_token_counts, op2_language_bits, op3_license_scan, op4_tree_rules, op5_ordinal_grades,
    op6_chunked_bpe, op7_temperature_mixing, op8_token_files, op9_exact_dedup, op10_jaccard_join, op11_pu_toxicity, op12_conversation_repair,
    op13_divergence_audit,
)}
QUERIES["pipeline"] = corpus_pipeline.run

ORACLES = {
    "op9_exact_dedup": """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW same AS (PARTITION BY coalesce(text, ''))
""",
    "op12_conversation_repair": r"""
WITH RECURSIVE keyed AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
           xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(
                   string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::UBIGINT)),
               lambda c, b: list_reduce(list_prepend(xor(c, b), list_transform(range(8), lambda z: 0::UBIGINT)),
                   lambda d, z: xor(d >> 1, 3988292384::UBIGINT * (d & 1)))), 4294967295::UBIGINT) % 20 AS kind
    FROM conversations),
rows AS (
    SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
           CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
    FROM keyed, unnest(CASE WHEN kind = 0 THEN []::INT[] WHEN kind = 3 THEN [1, 2] ELSE [1] END) WHERE kind <> 0),
numbered AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, left(text, 64), sha256(length(role) || ':' || role || text)) AS i,
           regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z', 1) AS ending FROM rows),
faults AS (
    SELECT conv_id, turn, role, text, i,
           CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE 'x' END AS initial,
           CASE WHEN ending = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
                WHEN ending NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
           lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS beside
    FROM numbered),
facts AS (
    SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
           count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
           count(*) FILTER (beside NOT IN ('su', 'ua', 'au')) AS illegal
    FROM faults GROUP BY conv_id),
-- cost to go from the states before row i: b (nothing), s, u, a; and what each edit of the row costs
costs AS (
    SELECT conv_id, n + 1 AS i, 0 AS b, 10 AS s, 5 AS u, 0 AS a, '' AS eb, 'I' AS es, 'I' AS eu, '' AS ea FROM facts
    UNION ALL
    SELECT conv_id, i, least(b0, 5 + least(u0, 5 + a0)), least(s0, 5 + least(u0, 5 + a0)), least(u0, 5 + a0), least(a0, 5 + u0),
           CASE WHEN db <= b0 AND db <= 5 + least(u0, 5 + a0) THEN 'D' WHEN 5 + least(u0, 5 + a0) <= b0 THEN 'I' WHEN kb <= b0 THEN 'K' ELSE 'R' END,
           CASE WHEN ds <= s0 AND ds <= 5 + least(u0, 5 + a0) THEN 'D' WHEN 5 + least(u0, 5 + a0) <= s0 THEN 'I' WHEN ks <= s0 THEN 'K' ELSE 'R' END,
           CASE WHEN du <= u0 AND du <= 5 + a0 THEN 'D' WHEN 5 + a0 <= u0 THEN 'I' WHEN ku <= u0 THEN 'K' ELSE 'R' END,
           CASE WHEN da <= a0 AND da <= 5 + u0 THEN 'D' WHEN 5 + u0 <= a0 THEN 'I' WHEN ka <= a0 THEN 'K' ELSE 'R' END
    FROM (
        SELECT *, least(db, kb, ru) AS b0, least(ds, ks, ru) AS s0, least(du, ku, ra) AS u0, least(da, ka, ru) AS a0
        FROM (
            SELECT c.conv_id, f.i, 2 + c.b AS db, 2 + c.s AS ds, 2 + c.u AS du, 2 + c.a AS da, h + 1 + c.u AS ru, h + 1 + c.a AS ra,
                   CASE initial WHEN 's' THEN h + c.s WHEN 'u' THEN h + c.u ELSE 1000000000 END AS kb,
                   CASE initial WHEN 'u' THEN h + c.u ELSE 1000000000 END AS ks, CASE initial WHEN 'a' THEN h + c.a ELSE 1000000000 END AS ku,
                   CASE initial WHEN 'u' THEN h + c.u ELSE 1000000000 END AS ka
            FROM costs c JOIN (SELECT *, CASE fault WHEN '' THEN 0 WHEN 'truncated' THEN 5 ELSE 1000000 END AS h FROM faults) f
              ON f.conv_id IS NOT DISTINCT FROM c.conv_id AND f.i = c.i - 1))),
walk AS (
    SELECT conv_id, 1::BIGINT AS i, 'b' AS state, 0 AS step, '' AS edit, '' AS line FROM facts
    UNION ALL
    SELECT w.conv_id, w.i + (e <> 'I')::INT, CASE WHEN e = 'D' THEN w.state WHEN e = 'K' THEN f.initial WHEN w.state = 'u' THEN 'a' ELSE 'u' END,
           w.step + 1, e, CASE WHEN e = 'D' THEN NULL WHEN e = 'K' THEN f.role || ':' || f.text
                               ELSE CASE w.state WHEN 'u' THEN 'assistant:' ELSE 'user:' END || CASE e WHEN 'R' THEN f.text ELSE '' END END
    FROM (
        SELECT w.*, CASE w.state WHEN 'b' THEN c.eb WHEN 's' THEN c.es WHEN 'u' THEN c.eu ELSE c.ea END AS e
        FROM walk w JOIN costs c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND c.i = w.i) w
    LEFT JOIN faults f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i
    WHERE e <> ''),
audits AS (
    SELECT conv_id, string_agg(edit, '' ORDER BY step) AS audit, sha256(coalesce(string_agg(line, chr(10) ORDER BY step) FILTER (step > 0), '')) AS repaired_sha256
    FROM walk GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(c.b, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, coalesce(repaired_sha256, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN costs c ON c.conv_id IS NOT DISTINCT FROM o.conv_id AND c.i = 1
LEFT JOIN audits a ON a.conv_id IS NOT DISTINCT FROM o.conv_id
""",
    "op13_divergence_audit": r"""
WITH docs AS (
    SELECT row_number() OVER () AS r, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
occurring AS (
    SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                      '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term FROM occurring GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
groups AS (SELECT DISTINCT lang, source FROM docs),
sizes AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
counted AS (SELECT lang, source, term, count(*) AS n FROM occurring JOIN kept USING (lang, term) GROUP BY lang, source, term),
grid AS (
    SELECT lang, source, term, coalesce(n, 0)::HUGEINT AS n, sum(coalesce(n, 0)) OVER (PARTITION BY lang, source)::HUGEINT AS n_all, v
    FROM groups JOIN kept USING (lang) JOIN sizes USING (lang) LEFT JOIN counted USING (lang, source, term)),
shares AS (
    SELECT lang, source, term, n, 1 + (1000000000 * (n + 2)) // (n_all + 2 * v) AS p,
           1 + (1000000000 * (sum(n) OVER (PARTITION BY lang, term)::HUGEINT + 2)) // (sum(n) OVER (PARTITION BY lang)::HUGEINT + 2 * v) AS q
    FROM grid),
pairs AS (
    SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
    FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
parts AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
    FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
    UNION ALL
    SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT FROM shares WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, rank FROM (
    SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM parts)
WHERE part = 'pair' OR rank <= 10
""",
}
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
