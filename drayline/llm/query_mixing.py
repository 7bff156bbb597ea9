"""Query of the mixing operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from drayline.llm.base import table
from drayline.llm.mixing import mix
from drayline.llm.queries import query

MIX_SQL = r"""
with sized as (
    select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
           md5('17:' || coalesce(doc_id::varchar, '')) as shuffle_key
    from documents),
ranked as (
    select source, sum(size)::bigint as source_size,
           row_number() over (order by source nulls last) - 1 as rank from sized group by source),
weighed as (
    select *, case rank % 3 when 0 then 5 when 1 then 2 else 1 end as weight, 2 * source_size as cap from ranked),
walked as (
    select *, sum(source_size) over () as total,
           coalesce(sum(cap) over (order by cap / weight, rank rows between unbounded preceding and 1 preceding), 0)
               as cap_before,
           sum(weight) over (order by cap / weight, rank rows between current row and unbounded following)
               as weight_onward
    from weighed),
marked as (select *, cap * weight_onward * 2 <= weight * (total * 3 - cap_before * 2) as capped from walked),
free as (
    select *, sum(case when capped then cap else 0 end) over () as cap_sum,
           sum(case when capped then 0 else weight end) over () as free_weight from marked),
targets as (
    select source, source_size, total,
           case when capped then cap::double
                else weight * ((total::double * 3 / 2 - cap_sum::double) / free_weight::double) end as target
    from free),
queued as (
    select s.*, t.source_size, t.target, t.total, coalesce('s' || s.source, '') as source_key,
           sum(s.size) over (partition by s.source order by shuffle_key, doc_id nulls first, s.size
                             rows between unbounded preceding and current row) as queued
    from sized s join targets t on s.source is not distinct from t.source),
copies as (
    select *, (source_size * epoch + queued)::double / target as finish
    from queued, (values (0), (1)) e(epoch) where size > 0 and target > 0),
ordered as (
    select *, sum(size) over (order by finish, source_key, shuffle_key, doc_id nulls first, size
                              rows between unbounded preceding and current row) as running from copies),
taken as (select doc_id, sum(size)::bigint as taken from ordered where running <= total::double * 3 / 2 group by doc_id)
select q.doc_id, q.size, q.source_size, q.target, coalesce(t.taken, 0)::bigint as taken
from queued q left join taken t on q.doc_id = t.doc_id
"""


@query("op10_mixing", MIX_SQL)
def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed by weights 5, 2, 1 to 150% of all words."""
    mixed = mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")
