"""The phrase query with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from llm import phrases
from llm.registry import query

PHRASE_SQL = r"""
    WITH pieces AS (
        SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
        FROM documents
    ), lists AS (
        SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
    ), placed AS (
        SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM lists
    ), grams AS (
        SELECT lang, array_to_string(w[i:i + size - 1], ' ') AS phrase, size, count(*) AS f
        FROM placed, range(1, 5) AS sizes(size) WHERE i + size - 1 <= len(w) GROUP BY ALL
    ), words AS (
        SELECT lang, sum(f)::BIGINT AS n FROM grams WHERE size = 1 GROUP BY lang
    ), candidates AS (
        SELECT lang, phrase, size, f AS a, string_split(phrase, ' ') AS w FROM grams WHERE size > 1 AND f >= 30
    ), cuts AS (
        SELECT *, unnest(range(1, size)) AS k FROM candidates
    ), scored AS (
        SELECT c.lang, c.phrase, c.size, c.a, c.k, x.f AS l, y.f AS r,
            ((2000000::HUGEINT * c.a) // (x.f::HUGEINT + y.f))::BIGINT AS score
        FROM cuts c JOIN grams x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[:k], ' ')
        JOIN grams y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[k + 1:], ' ')
    ), best AS (
        SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
    ), inside AS (
        SELECT c.lang, c.a, array_to_string(c.w[i:j], ' ') AS phrase
        FROM candidates c, range(1, 5) AS x(i), range(1, 5) AS y(j) WHERE i <= j AND j <= c.size AND j - i + 1 < c.size
    ), longest AS (
        SELECT lang, phrase, max(a) AS a FROM inside GROUP BY ALL
    )
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, score
    FROM best JOIN words USING (lang)
    WHERE NOT EXISTS (FROM longest x WHERE x.lang = best.lang AND x.phrase = best.phrase AND 100 * x.a::HUGEINT >= 80 * best.a::HUGEINT)
    QUALIFY rank <= 2000
"""

@query("op12_phrase_stripes", PHRASE_SQL)
def op12_phrase_stripes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.top_phrases(phrases.collocations(spark.read.parquet(f"{sf_dir}/documents.parquet")))
