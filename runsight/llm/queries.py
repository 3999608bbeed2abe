"""Registered queries of this package over the given tables, with their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from runsight.llm import collocate, decontam, langid, lmscore, neardup, packing, pii, quality, resample, rules, simhash, warc, wavelet
from runsight.queries import r, scratch, table
from runsight.session import materialize

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql is not None:
            SQL[function.__name__] = sql
        return function

    return add


@query()
def op1_packing(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents"), public_tokenizers.path("word_bpe_49k.json"), end=1)


@query()
def op2_wavelet(spark: SparkSession, d: str) -> DataFrame:
    shards = wavelet.write_shards(table(spark, d, "documents"), scratch(spark), public_tokenizers.path("byte_bpe_50k.json"), end=2)
    return wavelet.read_shards(materialize(shards))


OP3 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
     d AS (SELECT page_id, strlen(html) AS n, sha1(html) AS hex, max(page_id) OVER (PARTITION BY html) AS original FROM p),
     bits AS (SELECT *, array_to_string(list_transform(range(1, 41), lambda i: substr('0000' || bin(instr('0123456789abcdef', substr(hex, i::INT, 1)) - 1), -4)), '') AS b FROM d)
SELECT page_id, n AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           (1 + list_sum(list_transform(range(1, 6), lambda j: substr(b, (5 * k + j)::INT, 1)::INT * (1 << (5 - j)::INT))))::INT, 1)), '') AS payload_digest,
       CASE WHEN page_id = original THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> original THEN original END AS refers_to
FROM bits
"""


@query(OP3)
def op3_warc(spark: SparkSession, d: str) -> DataFrame:
    written = warc.write_archives(table(spark, d, "pages"), scratch(spark))
    files = written.count()
    return warc.page_rows(warc.records(written.select("path").repartition(max(1, min(files, 20_000)), "path")).drop("payload"))


@query()
def op5_near_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, d, "documents"), n=4, percent=80)


@query()
def op6_quality(spark: SparkSession, d: str) -> DataFrame:
    return quality.quality(table(spark, d, "documents"), table(spark, d, "labels"))


@query()
def op7_language(spark: SparkSession, d: str) -> DataFrame:
    return langid.identify(table(spark, d, "documents"))


@query()
def op8_decontamination(spark: SparkSession, d: str) -> DataFrame:
    return decontam.leaks(table(spark, d, "documents"), table(spark, d, "benchmark"))


OP9 = """
WITH t AS (SELECT doc_id, lang, source, coalesce(text, '') AS text FROM documents),
     x AS (SELECT doc_id, lang, source, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
                  list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS l FROM t),
     g AS (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM x),
     often AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n FROM g),
     spots AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM often WHERE n > 1) GROUP BY 1),
     m AS (SELECT x.doc_id, lang, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines,
                  coalesce(n, 0) AS n_repeat_words, len(l) AS n_lines FROM x LEFT JOIN spots USING (doc_id)),
     v AS (SELECT *, CASE WHEN n_words > 0 THEN word_chars * 100 // n_words ELSE 0 END AS m1, CASE WHEN word_chars > 0 THEN n_symbols * 1000 // word_chars ELSE 0 END AS m2,
                  CASE WHEN n_lines > 0 THEN n_dup_lines * 1000 // n_lines ELSE 0 END AS m3, CASE WHEN n_words > 0 THEN n_repeat_words * 1000 // n_words ELSE 0 END AS m4 FROM m),
     cells AS (SELECT lang, source, unnest([1, 2, 3, 4]) AS metric, unnest([m1, m2, m3, m4]) AS v FROM v),
     buckets AS (SELECT lang, source, metric, v - v % (1 << greatest(length(bin(v)) - 7, 0)::INT) AS b FROM cells),
     levels AS (SELECT 1 AS level, * FROM buckets UNION ALL SELECT 2, lang, NULL, metric, b FROM buckets UNION ALL SELECT 3, NULL, NULL, metric, b FROM buckets),
     q AS (SELECT level, lang, source, metric, count(*) AS docs, quantile_disc(b, 0.25) AS q1, quantile_disc(b, 0.75) AS q3 FROM levels GROUP BY ALL),
     f AS (SELECT *, greatest(q3 - q1, q3 // 16, CASE WHEN metric <= 2 THEN 10 ELSE 100 END) * 3 AS far FROM q),
     own AS (SELECT level, lang, source, any_value(docs) AS docs, any_value(q1 - far) FILTER (metric = 1) AS low1, any_value(q3 + far) FILTER (metric = 1) AS high1,
                    any_value(q3 + far) FILTER (metric = 2) AS high2, any_value(q3 + far) FILTER (metric = 3) AS high3, any_value(q3 + far) FILTER (metric = 4) AS high4 FROM f GROUP BY ALL),
     pick AS (SELECT a.lang, a.source, CASE WHEN a.docs >= 200 THEN 1 WHEN b.docs >= 200 THEN 2 ELSE 3 END AS level
              FROM own a JOIN own b ON a.level = 1 AND b.level = 2 AND a.lang IS NOT DISTINCT FROM b.lang),
     lim AS (SELECT p.lang, p.source, o.* EXCLUDE (level, lang, source) FROM pick p JOIN own o ON o.level = p.level
              AND (p.level = 3 OR o.lang IS NOT DISTINCT FROM p.lang) AND (p.level > 1 OR o.source IS NOT DISTINCT FROM p.source)),
     r AS (SELECT v.*, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM v)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND m1 BETWEEN low1 AND high1 AND m2 <= high2 AND m3 <= high3 AND m4 <= high4 AS kept
FROM r JOIN lim ON r.lang IS NOT DISTINCT FROM lim.lang AND r.source IS NOT DISTINCT FROM lim.source
"""


@query(OP9)
def op9_quality_rules(spark: SparkSession, d: str) -> DataFrame:
    return rules.quality_rules(table(spark, d, "documents"))


@query()
def op4_pii(spark: SparkSession, d: str) -> DataFrame:
    return pii.digest(pii.find_pii(table(spark, d, "documents")))


OP10 = """
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
     x AS (SELECT doc_id, len(w) AS n_words, w, unnest(range(1, len(w) + 1)) AS i FROM d),
     g AS (SELECT doc_id, n_words, i, w[i] AS g1, CASE WHEN i > 1 THEN w[i - 1] || ' ' || w[i] END AS g2, CASE WHEN i > 2 THEN w[i - 2] || ' ' || w[i - 1] || ' ' || w[i] END AS g3 FROM x),
     c AS (SELECT doc_id, n_words, i, sum(n_words / n_words) OVER () - n_words AS others,
                  count(*) OVER (PARTITION BY g1) - count(*) OVER (PARTITION BY doc_id, g1) AS c1,
                  CASE WHEN g2 IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY g2) - count(*) OVER (PARTITION BY doc_id, g2) END AS c2,
                  CASE WHEN g3 IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY g3) - count(*) OVER (PARTITION BY doc_id, g3) END AS c3 FROM g),
     p AS (SELECT *, lag(c1) OVER o AS b1, lag(c2) OVER o AS b2, least(i, 3) AS most FROM c WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
     s AS (SELECT doc_id, most, CASE WHEN c3 > 0 THEN 3 WHEN c2 > 0 THEN 2 WHEN c1 > 0 THEN 1 ELSE 0 END AS used,
                  CASE WHEN c3 > 0 THEN ln(c3 / b2) WHEN c2 > 0 THEN ln(c2 / b1) WHEN c1 > 0 THEN ln(c1 / others) ELSE -ln(others + 1) END AS l FROM p)
SELECT d.doc_id, len(w) AS n_words, round(coalesce(sum(l + (most - used) * ln(0.4)), 0), 4) AS log_score,
       coalesce(sum((used < most)::INT), 0)::BIGINT AS n_backed_off, coalesce(sum((used = 0)::INT), 0)::BIGINT AS n_unseen
FROM d LEFT JOIN s USING (doc_id) GROUP BY d.doc_id, len(w)
"""


@query(OP10)
def op10_lm_scores(spark: SparkSession, d: str) -> DataFrame:
    return lmscore.lm_scores(table(spark, d, "documents")).withColumn("log_score", r("log_score", 4))


OP11 = r"""
WITH p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (
       SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
     total AS (SELECT lang, sum(len(w))::BIGINT AS n FROM p GROUP BY lang),
     x AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM p),
     f AS (SELECT lang, m, phrase, count(*) AS f FROM (SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase FROM x, range(1, 6) t(m) WHERE i + m - 1 <= len(w)) GROUP BY ALL HAVING count(*) >= 100),
     often AS (SELECT lang, m, phrase, string_split(phrase, ' ') AS w, f AS a FROM f WHERE m > 1),
     parts AS (SELECT lang, m, phrase, a, k, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:m], ' ') AS tail FROM (SELECT *, unnest(range(1, m)) AS k FROM often)),
     cuts AS (SELECT c.lang, c.m, c.phrase, c.a, k, h.f AS l, t.f AS r, n, ((1000::HUGEINT * c.a * n) // (h.f::HUGEINT * t.f))::BIGINT AS score
              FROM parts c JOIN f h ON h.lang = c.lang AND h.phrase = c.head JOIN f t ON t.lang = c.lang AND t.phrase = c.tail JOIN total ON total.lang = c.lang),
     worst AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
     inner_of AS (SELECT lang, phrase AS longer, a, unnest(flatten(list_transform(range(2, m), lambda s: list_transform(range(1, m - s + 2), lambda i: array_to_string(w[i:i + s - 1], ' '))))) AS phrase FROM often WHERE m > 2),
     covered AS (SELECT lang, phrase, max(a) AS longer FROM inner_of GROUP BY ALL),
     kept AS (SELECT worst.* FROM worst LEFT JOIN covered USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 100 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM kept
QUALIFY rank <= 2000
"""


@query(OP11)
def op11_collocations(spark: SparkSession, d: str) -> DataFrame:
    return collocate.collocations(table(spark, d, "documents"))


OP12 = r"""
WITH crc AS (SELECT list_transform(range(0, 256), lambda i: list_reduce(list_prepend(i, range(0, 8)), lambda c, k: xor(c >> 1, 3988292384 * (c & 1)))) AS t),
     d AS (SELECT 1 AS side, doc_id AS id, text FROM documents UNION ALL SELECT 2, row_number() OVER (), text FROM benchmark),
     w AS (SELECT side, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM d),
     x AS (SELECT side, id, w, unnest(range(1, len(w) + 1)) AS i FROM w),
     g AS (SELECT side, id, w[i] AS g FROM x UNION ALL SELECT side, id, w[i] || ' ' || w[i + 1] FROM x WHERE i < len(w)),
     bytes AS (SELECT g, list_transform(range(0, strlen(g)), lambda i: ('0x' || substr(hex(g), 2 * i + 1, 2))::BIGINT) AS b FROM (SELECT DISTINCT g FROM g)),
     sums AS (SELECT g, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8)), 4294967295) % 10000 AS bucket FROM bytes, crc),
     placed AS (SELECT side, id, bucket, count(*) AS n FROM g JOIN sums USING (g) GROUP BY ALL),
     n AS (SELECT bucket, coalesce(sum(n) FILTER (side = 1), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (side = 2), 0)::DOUBLE AS t FROM placed GROUP BY bucket),
     gain AS (SELECT bucket, floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM n) + 10000) / ((s + 1) * ((SELECT sum(t) FROM n) + 10000))))::BIGINT AS gain FROM n),
     m AS (SELECT id, sum(n)::BIGINT AS n, sum(n * gain)::BIGINT AS total FROM placed JOIN gain USING (bucket) WHERE side = 1 GROUP BY id),
     v AS (SELECT w.id AS doc_id, len(w) AS words, coalesce(n, 0) AS n_features, coalesce((total - ((total % n + n) % n)) // n, 0) AS weight,
                  ('0x' || sha256('7:' || w.id)[1:8])::BIGINT AS h FROM w LEFT JOIN m USING (id) WHERE side = 1),
     scored AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296)))::BIGINT AS score FROM v),
     ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS able FROM scored WHERE words >= 20)
SELECT s.doc_id, n_features::BIGINT AS n_features, weight::BIGINT AS weight, score, CASE WHEN rank <= 25 * able // 100 THEN rank END AS rank FROM scored s LEFT JOIN ranked USING (doc_id)
"""


@query(OP12)
def op12_resampling(spark: SparkSession, d: str) -> DataFrame:
    return resample.resample(table(spark, d, "documents"), table(spark, d, "benchmark"))


@query()
def op13_simhash(spark: SparkSession, d: str) -> DataFrame:
    return simhash.simhash_groups(table(spark, d, "documents"))
