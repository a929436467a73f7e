"""Registered queries of this folder and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .alignment import link_report
from .common import read
from .contamination import contaminated
from .exact import exact_duplicates
from .jaccard import jaccard_groups
from .language import identify
from .linefreq import line_rules
from .middle import fill_in_middle, restored
from .mixing import mix_sources
from .quality import score_quality
from .quotes import link_quotes
from .secretscan import find_secrets
from .tokenfiles import token_index
from .urlfilter import judge_urls

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Passes over a source that mixing allows at most, whatever entropy it aims at.
MOST_PASSES = 32


def op1_quotation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_quotes(read(spark, sf_dir, "conversations"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(read(spark, sf_dir, "documents"), most_passes=MOST_PASSES)


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(read(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(read(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_index(read(spark, sf_dir, "documents"), tokenizer_file())


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(read(spark, sf_dir, "pages"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(read(spark, sf_dir, "documents"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(read(spark, sf_dir, "documents"))


def op11_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules(read(spark, sf_dir, "documents"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(read(spark, sf_dir, "documents"))
    text = restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(text, 256).alias("restored_sha256"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_report(read(spark, sf_dir, "documents"), tokenizer_file(), tokenizer_file("piece_bpe_32k.model"))


QUERIES: dict[str, Query] = {
    "op1_quotation_links": op1_quotation_links,
    "op2_decontamination": op2_decontamination,
    "op3_source_mixing": op3_source_mixing,
    "op4_secret_scan": op4_secret_scan,
    "op5_language_id": op5_language_id,
    "op6_quality": op6_quality,
    "op7_token_files": op7_token_files,
    "op8_url_filter": op8_url_filter,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_jaccard_join": op10_jaccard_join,
    "op11_line_frequency": op11_line_frequency,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_token_alignment": op13_token_alignment,
}

ORACLES: dict[str, str] = {}

ORACLES["op9_exact_dedup"] = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""

ORACLES["op10_jaccard_join"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents),
g AS (
  SELECT DISTINCT doc_id, CASE WHEN len(words) < 3 THEN list_aggregate(words, 'string_agg', ' ')
    ELSE words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] END AS shingle
  FROM w, LATERAL (SELECT unnest(range(1, greatest(len(words) - 1, 2))) AS i) WHERE len(words) > 0),
n AS (SELECT doc_id, count(*) AS size FROM g GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS met FROM g a JOIN g b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id),
links AS (
  SELECT x, y FROM shared JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y
  WHERE 100 * met >= 90 * (a.size + b.size - met)),
reach(doc_id, id) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, y FROM reach JOIN links ON x = id)
SELECT d.doc_id, coalesce(any_value(n.size), 0)::BIGINT AS n_shingles, min(r.id) AS component_id
FROM documents d JOIN reach r ON r.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id
"""

ORACLES["op11_line_frequency"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END AS host
  FROM documents),
w AS (
  SELECT *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
    list_filter(list_transform(string_split(translate(regexp_replace(lower(text), '[^\p{L}\p{N}\n]+', ' ', 'g'),
      '123456789', '000000000'), chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '') AS plain
  FROM d),
windows AS (
  SELECT r, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g
  FROM w, LATERAL (SELECT unnest(range(1, len(words) - 1)) AS i)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM windows) WHERE n > 1),
covered AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY r),
single AS (SELECT host, min(r) AS r FROM d GROUP BY host, text),
hosts AS (SELECT host, count(*) AS documents FROM single GROUP BY host),
entries AS (SELECT r, host, unnest(plain) AS line FROM w),
frequent AS (
  SELECT host, line FROM (
    SELECT e.host, e.line, count(*) AS n FROM (SELECT DISTINCT r, host, line FROM entries) e JOIN single USING (host, r)
    GROUP BY e.host, e.line) JOIN hosts USING (host) WHERE n >= 10 AND n >= 0.005 * documents),
gone AS (
  SELECT r, sum(len(string_split(line, ' ')))::BIGINT AS n FROM entries JOIN frequent USING (host, line) GROUP BY r),
counted AS (
  SELECT w.doc_id, len(words)::BIGINT AS n_words, len(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    (len(text) - len(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words,
    coalesce(list_sum(list_transform(plain, lambda x: len(string_split(x, ' ')))), 0)::BIGINT AS line_words,
    coalesce(g.n, 0)::BIGINT AS removed_words
  FROM w LEFT JOIN covered c USING (r) LEFT JOIN gone g USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND line_words - removed_words >= 0.5 * line_words AS kept,
  line_words, removed_words
FROM counted
"""

ORACLES["op12_fill_in_middle"] = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS tokens,
    sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
n AS (
  SELECT *, len(tokens) AS n, ('0x' || h[1:8])::BIGINT % (len(tokens) + 1) AS x, ('0x' || h[9:16])::BIGINT % (len(tokens) + 1) AS y,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
      OR ('0x' || h[17:24])::BIGINT % 100 >= 90 THEN 'plain'
      WHEN ('0x' || h[25:32])::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM d),
p AS (
  SELECT *, array_to_string(tokens[1:least(x, y)], '') AS prefix,
    array_to_string(tokens[least(x, y) + 1:greatest(x, y)], '') AS middle, array_to_string(tokens[greatest(x, y) + 1:], '') AS suffix
  FROM n)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN len(prefix) END::BIGINT AS prefix_chars,
  CASE WHEN form <> 'plain' THEN len(middle) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p
"""
