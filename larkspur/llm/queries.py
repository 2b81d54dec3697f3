"""The queries that apply each text operator to its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from larkspur.llm import bpe, fingerprints, jaccard_join, language_id, mixing, periodic, pii, quality_rules, secret_scan, sketch_dedup, spelling, suffix_dedup, token_counts


def vocabulary(name: str) -> str:
    """Where a public tokenizer's vocabulary file lies on the driver's machine; a parameter of the operators."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(documents(spark, sf_dir))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(documents(spark, sf_dir))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(documents(spark, sf_dir))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality(documents(spark, sf_dir)).drop("clean_text")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


def op8_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(documents(spark, sf_dir), vocabulary("word_bpe_49k.json"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedupe(documents(spark, sf_dir), with_kept=False)


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint(documents(spark, sf_dir))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group(spelling.word_counts(documents(spark, sf_dir), drop_one_in=199))


def op12_sketch_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch_dedup.near_duplicates(documents(spark, sf_dir))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digests(periodic.find(periodic.with_planted_runs(documents(spark, sf_dir))))


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_language_id, op3_pii, op4_secret_scan, op5_jaccard_join, op6_quality_rules, op7_mixing, op8_bpe_encoding, op9_suffix_dedup, op10_fingerprints, op11_spelling, op12_sketch_dedup, op13_periodic_runs)}

_SPLIT = r"regexp_split_to_array({}, '[\x20\x09-\x0D]+')"
_WORDS = "list_filter(" + _SPLIT + ", lambda x: x <> '')"
_STALE = " OR ".join(f"contains(lower(l), '{b}')" for b in quality_rules.BOILERPLATE)

#: One row for each different set of shingles; sets that share a shingle are counted, and links followed to their ends.
_NEAR = rf"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
s AS (SELECT doc_id, list_sort(CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
n AS (SELECT s, min(doc_id) AS node, len(s) AS n FROM s WHERE len(s) > 0 GROUP BY s),
x AS (SELECT node, n, unnest(s) AS x FROM n),
p AS (SELECT a.node AS a, b.node AS b FROM x a JOIN x b ON a.x = b.x AND a.node < b.node GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= {{percent}} * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r(node, least) AS (SELECT node, node FROM n UNION SELECT r.node, e.b FROM r JOIN e ON r.least = e.a),
c AS (SELECT node, min(least) AS component_id FROM r GROUP BY node)
SELECT doc_id, len(s.s)::BIGINT AS n_shingles, coalesce(component_id, doc_id) AS component_id{{more}} FROM s LEFT JOIN n ON n.s = s.s LEFT JOIN c USING (node)"""

ORACLES: dict[str, str] = {
    "op5_jaccard_join": _NEAR.format(percent=80, more=""),
    "op12_sketch_dedup": _NEAR.format(percent=85, more=", doc_id = coalesce(component_id, doc_id) AS kept"),
    "op6_quality_rules": rf"""WITH w AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
i AS (SELECT doc_id, i, array_to_string(w[i : i + 4], ' ') AS g FROM w, unnest(range(1, len(w) - 3)) AS t(i)),
r AS (SELECT doc_id, i FROM i QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
c AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM r, (SELECT unnest(range(0, 5)) AS k) GROUP BY doc_id),
l AS (SELECT doc_id, unnest(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) AS l FROM w),
n AS (SELECT doc_id, l, len({_WORDS.format('l')}) AS n FROM l),
p AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n_dup_lines, coalesce(sum(CASE WHEN NOT (3 * len(regexp_extract_all(l, '[#*$%&|<>]')) > n OR 4 * len(regexp_extract_all(l, '[|«»‹›→]')) > n
  OR 3 * (length(l) - length(replace(l, '!!', ''))) / 2 > n OR (n >= 4 AND NOT regexp_matches(l, '\p{{Ll}}') AND regexp_matches(l, '\p{{Lu}}'))
  OR (n < 8 AND NOT regexp_matches(l, '[.!?…:;。！？]["''”’»)\]]*[\x20\x09-\x0D]*$')) OR {_STALE}) THEN length(regexp_replace(l, '[\x20\x09-\x0D]', '', 'g')) END), 0) AS passed FROM n GROUP BY doc_id),
s AS (SELECT w.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(passed, 0) AS passed FROM w LEFT JOIN c USING (doc_id) LEFT JOIN p USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND 100 * passed >= 50 * word_chars AS kept FROM s""",
}
