"""Queries over ``conversations`` with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from llm import chat_format, structure_repair
from llm.registry import query


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/conversations.parquet")


def crc32_sql(key: str) -> str:
    """CRC-32 of an ASCII string, bit by bit."""
    shifted = "list_reduce(list_prepend(xor(c, b), range(8)), lambda d, k: CASE WHEN d & 1 = 1 THEN xor(d >> 1, 3988292384) ELSE d >> 1 END)"
    codes = f"list_transform(string_split({key}, ''), lambda x: ord(x)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda c, b: {shifted}), 4294967295::BIGINT)"


def after(state: str, cost: str, letter: str, text: str = "''", when: str = "true") -> str:
    """A survivor after one more edit: ``k`` has cost and edits, so that the smallest is the best; ``t`` has the turns."""
    total = f"lpad(CAST(CAST(substr({state}.k, 1, 12) AS BIGINT) + {cost} AS VARCHAR), 12, '0')"
    return (
        f"CASE WHEN {state} IS NOT NULL AND ({when}) THEN "
        f"struct_pack(k := {total} || substr({state}.k, 13) || {letter}, t := {state}.t || {text}) END"
    )


def stays(state: str, initial: str, role: str) -> str:
    return after(
        state,
        f"stay + CASE WHEN initial = '{initial}' THEN 0 ELSE 1 END",
        f"CASE WHEN initial = '{initial}' THEN 'K' ELSE 'R' END",
        f"chr(10) || CASE WHEN initial = '{initial}' THEN role ELSE '{role}' END || ':' || text",
        "NOT forced",
    )


def inserted(state: str, role: str) -> str:
    return after(state, "5", "'I'", f"chr(10) || '{role}:'")


def with_insertions(moves: str) -> str:
    """Two more levels that let empty turns in before the next row."""
    user = f"least(u, {inserted('e', 'user')}, {inserted('s', 'user')}, {inserted('a', 'user')})"
    return (
        f"SELECT c, i, e, s, least(u, {inserted('a', 'user')}) AS u, a FROM "
        f"(SELECT c, i, e, s, u, least(a, {inserted('u', 'assistant')}) AS a FROM (SELECT c, i, e, s, {user} AS u, a FROM ({moves})))"
    )


NOTHING = "CAST(NULL AS STRUCT(k VARCHAR, t VARCHAR))"
REPAIR_SQL = f"""
    WITH RECURSIVE keyed AS (
        SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, dense_rank() OVER (ORDER BY conv_id) AS c,
            {crc32_sql("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS damage
        FROM conversations
    ), damaged AS (
        SELECT c, turn, CASE WHEN damage = 4 THEN 'user' ELSE role END AS role,
            CASE damage WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
        FROM (SELECT *, unnest(range(CASE damage WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM keyed)
    ), placed AS (
        SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, text) AS i, left(role, 1) AS initial,
            rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body
        FROM damaged
    ), judged AS (
        SELECT *, CASE WHEN body = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault
        FROM placed
    ), ready AS (
        SELECT *, fault IS NOT DISTINCT FROM 'blank' OR fault IS NOT DISTINCT FROM 'duplicate' AS forced,
            CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END AS stay,
            lag(initial) OVER (PARTITION BY c ORDER BY i) || initial NOT IN ('su', 'ua', 'au') AS illegal
        FROM judged
    ), search AS (
        {with_insertions(f"SELECT DISTINCT c, 0::BIGINT AS i, struct_pack(k := '000000000000', t := '') AS e, {NOTHING} AS s, {NOTHING} AS u, {NOTHING} AS a FROM ready")}
        UNION ALL
        {with_insertions(f'''
            SELECT search.c, search.i + 1 AS i, {after("e", "2", "'D'")} AS e,
                least({after("s", "2", "'D'")}, {after("e", "stay", "'K'", "chr(10) || role || ':' || text", "NOT forced AND initial = 's'")}) AS s,
                least({after("u", "2", "'D'")}, {stays("e", "u", "user")}, {stays("s", "u", "user")}, {stays("a", "u", "user")}) AS u,
                least({after("a", "2", "'D'")}, {stays("u", "a", "assistant")}) AS a
            FROM search JOIN ready ON ready.c = search.c AND ready.i = search.i + 1
        ''')}
    ), best AS (
        SELECT c, arg_max(least(e, a), i) AS won FROM search GROUP BY c
    ), counts AS (
        SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
            count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
            count(*) FILTER (illegal) AS illegal
        FROM ready GROUP BY c
    )
    SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
        coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(substr(won.k, 1, 12)::BIGINT, 0) AS cost,
        coalesce(substr(won.k, 13), '') AS audit, sha256(coalesce(substr(won.t, 2), '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id, c FROM keyed) LEFT JOIN counts USING (c) LEFT JOIN best USING (c)
"""


@query("op11_structure_repair", REPAIR_SQL)
def op11_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure_repair.repair_damaged(conversations(spark, sf_dir))


def escaped_sql(column: str, *more: str) -> str:
    template, out = chat_format.Template(), column
    for mark in (template.escape, *template.controls, *more):
        out = f"replace({out}, '{mark}', '{template.escape}{mark}')"
    return out


FORMAT_SQL = f"""
    WITH turns AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -7, n, role, '\\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) AS v(n, role)
    ), placed AS (
        SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place FROM turns
    ), stated AS (
        SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY place) AS before FROM placed
    )
    SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
        coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
        sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '')) AS loss_sha256,
        sum(length('<turn>' || {escaped_sql("role", chr(10))} || chr(10) || {escaped_sql("text")} || '</turn>' || chr(10)))::BIGINT AS formatted_chars,
        count(*) FILTER (NOT CASE WHEN before = 'system' THEN role = 'user' WHEN before = 'user' THEN role = 'assistant'
            WHEN before = 'assistant' THEN role = 'user' ELSE role IN ('system', 'user') END) AS illegal_turns
    FROM stated GROUP BY conv_id
"""


@query("op13_chat_format", FORMAT_SQL)
def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = chat_format.with_control_case(conversations(spark, sf_dir))
    columns = "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "illegal_turns"
    return chat_format.digests(turns).select(*columns)
