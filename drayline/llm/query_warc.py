"""Query of the WARC archives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from drayline.llm.base import table
from drayline.llm.queries import query
from drayline.llm.warc import archived
from drayline.session import shared_dir

WARC_SQL = """
with p as (
    select page_id, octet_length(encode(coalesce(html, '')))::bigint as payload_bytes,
           sha256(coalesce(html, '')) as payload_digest from pages),
f as (select payload_digest, min(page_id) as first from p where payload_bytes >= 100 group by payload_digest)
select p.page_id, p.payload_bytes, p.payload_digest,
       case when f.first is null or p.page_id is not distinct from f.first then 'response' else 'revisit' end
           as record_type,
       case when p.page_id is distinct from f.first then f.first end as refers_to
from p left join f on p.payload_digest = f.payload_digest and p.payload_bytes >= 100
"""


@query("op3_warc", WARC_SQL)
def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC records and read back through the capture index."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    found = archived(spark, pages, shared_dir(spark, "llm-warc"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
