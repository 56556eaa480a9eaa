"""Registered queries of text, identifier and ordering operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from metrosift.functions import text
from metrosift.functions.parsing import canonical_id, tract_key
from metrosift.operators.labels import match_labels
from metrosift.plans.common import big, table


def page_status(spark, folder):
    """Which section of a page names its language: its navigation or its closing part."""
    p = table(spark, folder, "pages")
    plain = text.plain_text(F.col("html"))
    half = F.instr("plain", ". ")
    rows = p.select("page_id", "url", plain.alias("plain")).withColumn("first", F.when(half > 0, F.substr("plain", F.lit(1), half)).otherwise(F.col("plain")))
    rows = rows.withColumn("rest", text.section(F.col("plain"), ". "))
    label = F.element_at(F.split("url", "/"), 4)
    return rows.select("page_id", F.length("plain").cast("long").alias("plain_chars"),
                       text.listed_status(F.col("first"), F.col("rest"), label, strict=False).alias("status"))


def label_resolution(spark, folder):
    """Part names as area names; a label is a first word with a second word as its state."""
    p = table(spark, folder, "part")
    words = F.split("p_name", " ")
    labels = p.select(words[0].alias("city"), words[1].alias("state")).distinct().withColumn("label_id", F.concat_ws("/", "city", "state"))
    areas = p.select(F.col("p_partkey").alias("area_id"), F.col("p_name").alias("name"))
    return match_labels(labels, areas)


def name_search(spark, folder):
    return table(spark, folder, "customer").where(F.contains(F.lower("c_name"), F.lower(F.lit("CUSTOMER#0000007")))).select("c_custkey", "c_name")


def ordered_keys(spark, folder):
    """Priorities in a declared order, unknown ones last; counts per position."""
    order = ["1-URGENT", "2-HIGH", "5-LOW"]
    place = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(x) for x in order]), F.col("o_orderpriority")), F.lit(0)), F.lit(999))
    return table(spark, folder, "orders").groupBy(big(place).alias("position"), "o_orderpriority").agg(F.count(F.lit(1)).alias("orders"))


def numeric_order(spark, folder):
    """Text ids in numeric order: each line number's last order id as text."""
    lines = table(spark, folder, "lineitem").select("l_linenumber", F.col("l_orderkey").cast("string").alias("id"))
    return lines.groupBy("l_linenumber").agg(F.max_by("id", F.col("id").cast("long")).alias("last_id"))


def wording_guard(spark, folder):
    """Which conversation turns would pass as explanation wording."""
    c = table(spark, folder, "conversations")
    cited = F.when(F.col("turn") % 3 == 0, F.array(F.lit("a"), F.lit("a"))).when(F.col("turn") % 3 == 1, F.array(F.lit("a"))).otherwise(F.array(F.lit("z")))
    return c.select("conv_id", "turn", text.acceptable_wording(F.col("text"), cited, F.array(F.lit("a"), F.lit("b"))).alias("accepted"))


def url_parts(spark, folder):
    p = table(spark, folder, "pages")
    return p.select("page_id", text.query_parameter(F.col("url"), "page").alias("page"), text.query_parameter(F.col("url"), "ref").alias("ref"))


def replaced_hosts(spark, folder):
    secure = F.regexp_replace("url", "^http://", "https://")
    host = F.try_parse_url(F.col("url"), F.lit("HOST"))
    d = table(spark, folder, "pages").select("page_id", secure.alias("url"), host.alias("host"))
    return d.select("page_id", text.replace_host(F.col("url"), "ththre.example.com", "new.example.com").alias("url"))


def canonical_ids(spark, folder):
    k = F.lpad(F.pmod("c_custkey", F.lit(99991)).cast("string"), 5, "0")
    raw = F.when(F.col("c_custkey") % 2 == 0, k).otherwise(F.concat(F.lit("cbsa:"), k))
    return table(spark, folder, "customer").select(
        "c_custkey", canonical_id(raw).alias("area_id"),
        tract_key(F.col("c_nationkey").cast("string"), (F.col("c_custkey") % 999).cast("string"), F.col("c_custkey").cast("string")).alias("tract"),
        text.normalized_name(F.col("c_name")).alias("name"), text.replace_suffix(F.concat("c_name", F.lit("__feed-old")), "__feed-", F.lit("new")).alias("version"))


def provenance_ids(spark, folder):
    """Name-based ids of document records (no SQL twin; tested against the standard library)."""
    d = table(spark, folder, "documents")
    return d.select("doc_id", text.provenance_id(F.col("source"), F.col("lang"), F.sha2("text", 256)).alias("id"),
                    text.content_id(F.struct("source", "lang")).alias("content_id"))


QUERIES = {f.__name__: f for f in (
    page_status, label_resolution, name_search, ordered_keys, numeric_order, wording_guard, url_parts, replaced_hosts,
    canonical_ids, provenance_ids,
)}

_BANNED = "|".join(text.BANNED_WORDS)
ORACLES = {
    "page_status": r"""WITH p AS (SELECT page_id, regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '[ \t\n\x0B\f\r]+', ' ', 'g') t, split_part(url, '/', 4) label FROM pages),
        s AS (SELECT *, CASE WHEN instr(t, '. ') > 0 THEN substring(t, 1, instr(t, '. ')) ELSE t END a, CASE WHEN instr(t, '. ') > 0 THEN substring(t, instr(t, '. ') + 2) END b FROM p),
        f AS (SELECT *, coalesce(contains(lower(a), lower(label)), false) x, coalesce(contains(lower(b), lower(label)), false) y FROM s)
        SELECT page_id, length(t) AS plain_chars, CASE WHEN x = y THEN NULL WHEN x THEN 'commercial' ELSE 'announced' END AS status FROM f""",
    "label_resolution": """WITH l AS (SELECT DISTINCT split_part(p_name, ' ', 1) city, split_part(p_name, ' ', 2) state FROM part)
        SELECT city || '/' || state AS label_id, count(p_partkey) AS matches, CASE WHEN count(p_partkey) = 1 THEN min(p_partkey) END AS area_id
        FROM l LEFT JOIN part ON contains(lower(regexp_replace(p_name, '[^a-zA-Z0-9]', '', 'g')), lower(city)) AND contains(upper(p_name), upper(state)) GROUP BY city, state""",
    "name_search": "SELECT c_custkey, c_name FROM customer WHERE contains(lower(c_name), 'customer#0000007')",
    "ordered_keys": """SELECT CAST(coalesce(nullif(list_position(['1-URGENT', '2-HIGH', '5-LOW'], o_orderpriority), 0), 999) AS BIGINT) AS position, o_orderpriority, count(*) AS orders FROM orders GROUP BY 1, 2""",
    "numeric_order": "SELECT l_linenumber, CAST(max(l_orderkey) AS VARCHAR) AS last_id FROM lineitem GROUP BY 1",
    "wording_guard": rf"""SELECT conv_id, turn, turn % 3 = 1 AND length(t) BETWEEN 20 AND 600 AND NOT contains(t, chr(10)) AND NOT regexp_matches(t, '(?i)[0-9]|\b({_BANNED})\b') AS accepted
        FROM (SELECT *, regexp_replace(text, '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$', '', 'g') t FROM conversations)""",
    "url_parts": r"SELECT page_id, nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') AS page, nullif(regexp_extract(url, '[?&]ref=([^&#]*)', 1), '') AS ref FROM pages",
    "replaced_hosts": "SELECT page_id, replace(regexp_replace(url, '^http://', 'https://'), 'https://ththre.example.com/', 'https://new.example.com/') AS url FROM pages",
    "canonical_ids": """SELECT c_custkey, 'cbsa:' || lpad(CAST(c_custkey % 99991 AS VARCHAR), 5, '0') AS area_id,
        lpad(CAST(c_nationkey AS VARCHAR), 2, '0') || lpad(CAST(c_custkey % 999 AS VARCHAR), 3, '0') || lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS tract,
        lower(regexp_replace(c_name, '[^a-zA-Z0-9]', '', 'g')) AS name, c_name || '__feed-new' AS version FROM customer""",
}
