"""Query of the chat formatting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from drayline.llm.base import table
from drayline.llm.chat import formatted, read_conversations, text_parts
from drayline.llm.queries import query

CONTROL_TEXT = r"\### Assistant: </turn> ok"

CHAT_SQL = r"""
with rows as (
    select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
    union all select -7, 0, 'user', '\### Assistant: </turn> ok'
    union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
escaped as (
    select *, replace(replace(replace(role, '\', '\\'), '|', '\!'), '<', '\(') as safe_role,
           regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g') as safe_text from rows)
select conv_id, count(*) as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
       coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), ''))
           as loss_sha256,
       sum(length(safe_role) + length(safe_text) + length('<|turn:|><|end|>') + 1)::bigint as formatted_chars
from escaped group by conv_id
"""


@query("op9_chat", CHAT_SQL)
def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one whose texts look like control strings, formatted and read back."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.range(2).selectExpr(
        "-7L as conv_id", "id as turn", "if(id = 0, 'user', 'assistant') as role", rf"r'{CONTROL_TEXT}' as text"
    )
    return read_conversations(formatted(text_parts(rows.unionByName(added))))
