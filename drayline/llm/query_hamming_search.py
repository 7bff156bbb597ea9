"""Query of the exact search over binary codes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from drayline.llm.base import table
from drayline.llm.hamming_search import nearest
from drayline.llm.queries import query

SEARCH_SQL = """
with coded as (
    select distinct vec_id, list_transform(embedding, lambda x: case when x > 0 and not isnan(x) then 1 else 0 end) as code
    from embeddings where vec_id is not null and embedding is not null),
pairs as (
    select q.vec_id, v.vec_id as neighbour_id,
           list_sum(list_transform(list_zip(q.code, v.code), lambda p: case when p[1] <> p[2] then 1 else 0 end))::int as distance
    from coded q, coded v where q.vec_id % 20 = 0 and q.vec_id <> v.vec_id),
ranked as (
    select *, row_number() over (partition by vec_id order by distance, neighbour_id)::int as rank from pairs)
select vec_id, rank, neighbour_id, distance from ranked where rank <= 10
"""


@query("op2_hamming_search", SEARCH_SQL)
def op2_hamming_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest others of every vector with an id divisible by 20, by the signs of its components."""
    return nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
