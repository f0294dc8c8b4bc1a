"""B: content identity."""

from __future__ import annotations

from pyspark.sql import functions as F

from factlake.functions import identity as I
from factlake.queries import query

SEP = "chr(31)"
COLLAPSE = "lower(trim(regexp_replace(line, '\\s+', ' ', 'g')))"


@query("B01_content_sha256", "SELECT doc_id, sha256(text) AS sha FROM documents")
def _(t):
    return t.documents.select("doc_id", I.content_sha256(F.col("text")).alias("sha"))


@query("B02_url_key", "SELECT page_id, sha256(lower(regexp_replace(split_part(url, '#', 1), '/+$', ''))) AS key FROM pages")
def _(t):
    return t.pages.select("page_id", I.url_key(F.col("url")).alias("key"))


@query("B04_canonical_sha256", f"SELECT o_orderkey, sha256(o_orderstatus || {SEP} || o_orderpriority || {SEP} || CAST(CAST(o_totalprice AS DECIMAL(18, 2)) AS VARCHAR)) AS sha FROM orders")
def _(t):
    return t.orders.select("o_orderkey", I.hash_parts(F.col("o_orderstatus"), F.col("o_orderpriority"), F.col("o_totalprice").cast("decimal(18,2)")).alias("sha"))


@query("B03_canonical_payload")
def _(t):
    payload = F.from_json("props", "map<string,string>")
    return t.events.select("event_id", I.canonical_map(payload, ["source_url", "retrieved_at"]).alias("canonical"))


@query("B06_acquisition_hash", "SELECT l_orderkey, sha256(array_to_string(list_sort(list_distinct(list(CAST(l_partkey AS VARCHAR)))), ',')) AS sha FROM lineitem GROUP BY 1")
def _(t):
    return I.set_hash(t.lineitem, "l_orderkey", F.col("l_partkey"), "sha")


@query(
    "B07_evidence_id",
    f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents)
    SELECT doc_id, pos, 'ev_' || substr(sha256(doc_id || {SEP} || 'line' || {SEP} || {COLLAPSE} || {SEP} || (row_number() OVER (PARTITION BY doc_id, {COLLAPSE} ORDER BY pos) - 1)), 1, 24) AS evidence_id FROM l""",
)
def _(t):
    rows = t.documents.select("doc_id", F.lit("line").alias("path"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return I.evidence_id(rows, "doc_id", "path", "line", "pos").select("doc_id", F.col("pos").cast("long").alias("pos"), "evidence_id")


@query("B08_version_id", f"SELECT doc_id, sha256(sha256(text) || {SEP} || sha256(lang) || {SEP} || 'v1') AS version_id FROM documents")
def _(t):
    return t.documents.select("doc_id", I.hash_parts(F.sha2("text", 256), F.sha2("lang", 256), F.lit("v1")).alias("version_id"))


@query("B09_fact_id", f"SELECT l_orderkey, l_linenumber, l_partkey, substr(sha256(l_orderkey || {SEP} || l_returnflag || {SEP} || CAST(CAST(l_extendedprice AS DECIMAL(18, 2)) AS VARCHAR)), 1, 24) AS fact_id FROM lineitem")
def _(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", I.hash_parts(F.col("l_orderkey"), F.col("l_returnflag"), F.col("l_extendedprice").cast("decimal(18,2)"), length=24).alias("fact_id"))


@query("B10_unit_id", "SELECT l_suppkey, sha256(array_to_string(list_sort(list_distinct(list(CAST(l_orderkey AS VARCHAR)))), ',')) AS unit_id FROM lineitem GROUP BY 1")
def _(t):
    return I.set_hash(t.lineitem, "l_suppkey", F.col("l_orderkey"), "unit_id")


@query("B11_fingerprints", f"SELECT doc_id, sha256(text || {SEP} || lang) AS content_fp, sha256(lang || {SEP} || source) AS structural_fp FROM documents")
def _(t):
    return t.documents.select("doc_id", I.hash_parts(F.col("text"), F.col("lang")).alias("content_fp"), I.hash_parts(F.col("lang"), F.col("source")).alias("structural_fp"))


@query("B12_packet_fingerprint", f"SELECT source, sha256(string_agg(h, {SEP} ORDER BY c)) AS fp FROM (SELECT source, b // 1000 AS c, sha256(string_agg(h, {SEP} ORDER BY b)) AS h FROM (SELECT source, place // 1000 AS b, sha256(string_agg(sha, {SEP} ORDER BY place)) AS h FROM (SELECT source, sha256(text) AS sha, row_number() OVER (PARTITION BY source ORDER BY doc_id, sha256(text)) - 1 AS place FROM documents) GROUP BY ALL) GROUP BY ALL) GROUP BY 1")
def _(t):
    rows = t.documents.select("source", "doc_id", F.sha2("text", 256).alias("sha"))
    return I.ordered_hash(rows, "source", "doc_id", "sha", "fp")


@query("B13_result_fingerprint", "SELECT l_orderkey, sha256(array_to_string(list_sort(list_distinct(list(l_returnflag || ':' || l_suppkey))), ',')) AS fp FROM lineitem GROUP BY 1")
def _(t):
    return I.set_hash(t.lineitem, "l_orderkey", F.concat_ws(":", "l_returnflag", F.col("l_suppkey").cast("string")), "fp")


@query("B14_idempotency_key", "SELECT event_id, substr(sha256(user_id || ':' || event_type || ':' || props), 1, 32) AS id FROM events")
def _(t):
    return t.events.select("event_id", I.hash_parts(F.col("user_id"), F.col("event_type"), F.col("props"), length=32, separator=":").alias("id"))


@query("B16_table_digest", f"SELECT count(*) AS rows, md5(string_agg(h, '' ORDER BY h)) AS digest FROM (SELECT md5(n_nationkey || {SEP} || n_name || {SEP} || n_regionkey) AS h FROM nation)")
def _(t):
    return I.exact_table_digest(t.nation)


@query("B16_scalable_digest")
def _(t):
    return I.table_digest(t.lineitem)
