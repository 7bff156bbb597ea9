"""Query of the benchmark decontamination and its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from drayline.llm.base import table
from drayline.llm.decontamination import contamination
from drayline.llm.queries import query

DECONTAMINATION_SQL = r"""
with doc as (
    select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words from documents),
item as (
    select item_id::varchar as item,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                              '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words from benchmark),
placed as (
    select item, words, least(len(words), 10) as size, unnest(range(1, len(words) - least(len(words), 10) + 2)) as place
    from item where len(words) > 0),
windows as (select distinct item, size, array_to_string(words[place : place + size - 1], ' ') as w from placed),
sizes as (select distinct size from windows),
doc_windows as (
    select doc_id, words, size, unnest(range(1, len(words) - size + 2)) as place from doc, sizes where len(words) >= size),
hit as (
    select doc_id, place, d.size, item
    from (select doc_id, place, size, array_to_string(words[place : place + size - 1], ' ') as w from doc_windows) d
    join windows using (w, size)),
positions as (select distinct doc_id, unnest(range(place, place + size)) as p from hit),
counts as (select doc_id, count(*) as n_hit from positions group by doc_id),
items as (
    select doc_id, count(*) as n_items, sha256(string_agg(item, ',' order by item)) as items_sha256
    from (select distinct doc_id, item from hit) group by doc_id)
select doc.doc_id, len(words)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
       coalesce(items_sha256, sha256('')) as items_sha256, n_hit is not null as contaminated
from doc left join counts on counts.doc_id = doc.doc_id left join items on items.doc_id = doc.doc_id
"""


@query("op13_decontamination", DECONTAMINATION_SQL)
def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents hold ten-word windows of benchmark items, how many words of them, and of which items."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return contamination(documents, table(spark, sf_dir, "benchmark").select("item_id", "text"))
