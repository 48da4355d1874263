"""The registered queries of this subpackage and their DuckDB SQL: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelcat.llm import bpe, classifier, exact_dedup, lexical_search, line_dedup, mixing, ngram_join, periodic_runs, quality_rules, recurrent_lm, secret_scan, sharding, substring_dedup
from reelcat.llm.common import table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.duplicate_spans(table(spark, sf_dir)).drop("spans")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir), keep="largest")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = sharding.histogram_shards(table(spark, sf_dir), n_shards=8)
    return shards.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.element_at("shares", 1)
    return mixing.mix_sources(table(spark, sf_dir)).select(
        "doc_id", "size", own["source_size"].alias("source_size"), own["target"].alias("target"), "taken")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_report(table(spark, sf_dir))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def joined(spans):
        return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))

    kinds = [r.kind for r in secret_scan.BASE]
    base = F.filter("spans", lambda s: s["kind"].isin(kinds))
    return secret_scan.scan_secrets(table(spark, sf_dir)).select(
        "doc_id", *map(count, kinds), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = bpe.encode_documents(table(spark, sf_dir), tokenizer_path(), decode=True)
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
                       F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_digests(table(spark, sf_dir))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir)
    model = classifier.fit(docs, table(spark, sf_dir, "labels"))
    return classifier.score_documents(docs, model).select(
        "doc_id", classifier.held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.ranked_search(table(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op12_recurrent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recurrent_lm.score_documents(table(spark, sf_dir))


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """doc_id and text; where crc32(doc_id) mod 10 is 0, the words from a place on repeat with a period that the id fixes.  A null id plants nothing."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.regexp_extract_all(F.col("text"), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    parts = docs.select("doc_id", "text", F.floor(h / 10).cast("long").alias("_g"), F.when(h % 10 == 0, words).alias("_words"))
    parts = parts.withColumn("_n", F.expr("nullif(greatest(size(_words), 0), 0)")).withColumn("_a", F.expr("_g % _n"))
    parts = parts.withColumn("_p", F.expr("1 + (_n - _a) div (3 + _g % 8)"))
    planted = F.expr("array_join(transform(_words, (w, i) -> if(i >= _a, _words[cast(_a + (i - _a) % _p as int)], w)), ' ')")
    return parts.select("doc_id", F.when(F.col("_n") > 0, planted).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.periodic_runs(with_planted_periods(table(spark, sf_dir)))
    # exact quotients compared by cross products; runs come by start, then period, so the first of equals stays
    best = F.expr("aggregate(slice(runs, 2, greatest(size(runs) - 1, 0)), element_at(runs, 1), (a, x) -> if(x.length * a.period > a.length * x.period, x, a))")
    listed = F.concat_ws("", F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))))
    return (found.withColumn("_best", F.when(F.size("runs") > 0, best))
            .select("doc_id", F.size("runs").cast("long").alias("n_runs"), "_best.start", "_best.length", "_best.period",
                    F.expr("1000 * _best.length div _best.period").alias("exponent_milli"),
                    F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256")))


QUERIES = {f.__name__: f for f in (op1_ngram_jaccard, op2_substring_dedup, op3_exact_dedup, op4_sharding, op5_mixing, op6_quality_rules, op7_secret_scan, op8_bpe, op9_line_dedup, op10_quality_classifier,
                                 op11_lexical_search, op12_recurrent_lm, op13_periodic_runs)}

_SPACE = r"[\x20\x09-\x0D]"

ORACLE = {
    "op3_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER t AS keep_id, count(*) OVER t AS group_size,
               doc_id = max(doc_id) OVER t AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW t AS (PARTITION BY coalesce(text, ''))
    """,
    "op6_quality_rules": rf"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
        w AS (SELECT r, regexp_extract_all(text, '{_SPACE.replace("[", "[^")}+') AS words FROM d),
        win AS (SELECT r, unnest(range(1, len(words) - 1)) AS i, words FROM w WHERE len(words) > 2),
        tri AS (SELECT r, i, count(*) OVER (PARTITION BY r, words[i], words[i + 1], words[i + 2]) AS n FROM win),
        rep AS (SELECT r, count(DISTINCT place) AS n_repeat_words FROM (SELECT r, unnest([i, i + 1, i + 2]) AS place FROM tri WHERE n > 1) GROUP BY r),
        lines AS (SELECT r, count(line) - count(DISTINCT line) AS n_dup_lines, count(line) AS n_lines
                  FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d)
                  WHERE regexp_matches(line, '{_SPACE.replace("[", "[^")}') GROUP BY r),
        m AS (SELECT doc_id, len(words) AS n_words, length(regexp_replace(text, '{_SPACE}+', '', 'g')) AS word_chars,
                     length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
                     coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines,
                     length(regexp_replace(text, '[^A-Z]+', '', 'g')) AS n_capitals, length(regexp_replace(text, '[^!]+', '', 'g')) AS n_marks
              FROM d JOIN w USING (r) LEFT JOIN rep USING (r) LEFT JOIN lines USING (r))
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
               n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
               NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 10 * n_symbols > n_words OR 10 * n_capitals > 3 * word_chars
                    OR 10 * n_marks > n_words OR 2 * n_dup_lines > n_lines OR word_chars < 2 * n_words OR word_chars > 15 * n_words) AS kept
        FROM m
    """,
    "op11_lexical_search": r"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id,
                          unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
                   FROM documents),
        i AS (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
              FROM benchmark),
        lengths AS (SELECT r, count(*) AS n FROM d GROUP BY r),
        totals AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM lengths),
        tf AS (SELECT r, any_value(doc_id) AS doc_id, term, count(*) AS tf FROM d WHERE term IN (SELECT term FROM i) GROUP BY r, term),
        w AS (SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, totals GROUP BY term),
        scored AS (SELECT item_id, any_value(doc_id) AS doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms))))::BIGINT AS score
                   FROM i JOIN tf USING (term) JOIN w USING (term) JOIN lengths USING (r), totals GROUP BY item_id, r)
        SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
        FROM scored WHERE score > 0 QUALIFY rank <= 10
    """,
    "op9_line_dedup": """
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
        l AS (SELECT r, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM d),
        k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
        j AS (SELECT *, length(key) >= 10 AND doc_id > min(doc_id) OVER (PARTITION BY key) AS dropped FROM k)
        SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
        FROM j GROUP BY r
    """,
}
