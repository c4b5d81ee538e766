"""Queries of column functions over time, addresses and identities."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuecraft.functions import times, urls
from cuecraft.plans.bindings import table
from cuecraft.plans.registry import query

_TS = """CASE o_orderkey % 6 WHEN 0 THEN lpad(CAST(o_orderkey % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(o_custkey % 60 AS VARCHAR), 2, '0')
  WHEN 1 THEN '01:' || (o_orderkey % 60) || ':' || (o_custkey % 60) WHEN 2 THEN CAST(o_custkey AS VARCHAR) WHEN 3 THEN 'x' || o_custkey
  WHEN 4 THEN '-' || (o_custkey % 9 + 1) ELSE '1:2:3:4' END"""


def _ts_text():
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    two = lambda x: F.lpad((x % 60).cast("string"), 2, "0")
    return (
        F.when(k % 6 == 0, F.concat(two(k), F.lit(":"), two(c)))
        .when(k % 6 == 1, F.concat(F.lit("01:"), (k % 60).cast("string"), F.lit(":"), (c % 60).cast("string")))
        .when(k % 6 == 2, c.cast("string"))
        .when(k % 6 == 3, F.concat(F.lit("x"), c.cast("string")))
        .when(k % 6 == 4, F.concat(F.lit("-"), (c % 9 + 1).cast("string")))
        .otherwise("1:2:3:4")
    )


@query(
    "ts_to_seconds",
    f"""WITH t AS (SELECT o_orderkey, o_orderkey % 6 AS k, string_split({_TS}, ':') AS p FROM orders),
n AS (SELECT o_orderkey, len(p) AS n, TRY_CAST(p[1] AS DOUBLE) AS a, TRY_CAST(p[2] AS DOUBLE) AS b, TRY_CAST(p[3] AS DOUBLE) AS c FROM t)
SELECT o_orderkey, CASE WHEN n = 1 AND a >= 0 THEN a WHEN n = 2 AND a >= 0 AND b >= 0 THEN a * 60 + b
  WHEN n = 3 AND a >= 0 AND b >= 0 AND c >= 0 THEN a * 3600 + b * 60 + c END AS seconds FROM n""",
)
def _ts(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", times.ts_to_seconds(_ts_text()).alias("seconds"))


@query(
    "seconds_to_ts",
    """SELECT o_orderkey, CASE WHEN s >= 3600 THEN printf('%02d:%02d:%02d', s // 3600, s % 3600 // 60, s % 60) ELSE printf('%02d:%02d', s // 60, s % 60) END AS ts
FROM (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) % 9000 AS s FROM orders)""",
)
def _to_ts(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", times.seconds_to_ts(F.floor("o_totalprice").cast("long") % 9000).alias("ts"))


@query(
    "seconds_to_cs_ts",
    """SELECT o_orderkey, printf('%d:%02d:%02d.%02d', c // 360000, c // 6000 % 60, c // 100 % 60, c % 100) AS ts
FROM (SELECT o_orderkey, greatest(0, CAST(floor(o_totalprice) AS BIGINT) - 2000) AS c FROM orders)""",
)
def _to_cs(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", times.seconds_to_cs((F.floor("o_totalprice") - 2000) / 100).alias("ts"))


@query("duration_fmt", "SELECT o_orderkey, CASE WHEN s > 0 THEN printf('%d:%02d', s // 60, s % 60) ELSE 'N/A' END AS duration FROM (SELECT o_orderkey, o_custkey % 700 - 50 AS s FROM orders)")
def _duration(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", times.duration_fmt(F.col("o_custkey") % 700 - 50).alias("duration"))


@query(
    "safe_float",
    """SELECT event_id, least(10.0, greatest(0.0, coalesce(TRY_CAST(CASE event_id % 4 WHEN 0 THEN 'n/a' WHEN 1 THEN NULL ELSE CAST(event_id % 25 AS VARCHAR) END AS DOUBLE), 2.5))) AS v FROM events""",
)
def _safe(spark, sf):
    k = F.col("event_id")
    text = F.when(k % 4 == 0, "n/a").when(k % 4 > 1, (k % 25).cast("string"))
    return table(spark, sf, "events").select("event_id", times.safe_float(text, 2.5, 0.0, 10.0).alias("v"))


@query("hook_seconds_target", "SELECT o_orderkey, CAST(greatest(20, least(70, round(7000 / (50 + o_custkey % 251)))) AS INTEGER) AS seconds FROM orders")
def _hook_seconds(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", times.hook_seconds_target(50 + F.col("o_custkey") % 251).alias("seconds"))


@query(
    "publish_slot",
    """SELECT event_id, CASE WHEN slot < ts + INTERVAL 10 MINUTE THEN slot + INTERVAL 1 DAY ELSE slot END AS slot
FROM (SELECT event_id, ts, date_trunc('day', ts + INTERVAL 330 MINUTE) + INTERVAL 1410 MINUTE - INTERVAL 330 MINUTE AS slot FROM events)""",
)
def _slot(spark, sf):
    return table(spark, sf, "events").select("event_id", times.publish_slot(F.col("ts")).alias("slot"))


_HASH = "substr(md5(CAST(page_id AS VARCHAR)), 1, 11)"


@query(
    "video_id_from_url",
    f"""SELECT page_id, CASE page_id % 7 WHEN 6 THEN url ELSE {_HASH} END AS video_id FROM pages""",
)
def _video(spark, sf):
    k, h = F.col("page_id"), F.substring(F.md5(F.col("page_id").cast("string")), 1, 11)
    forms = ["https://www.youtube.com/watch?t=5&v=", "youtu.be/", "https://www.youtube.com/shorts/", "https://youtube.com/embed/", "https://m.youtube.com/live/"]
    text = h
    for n, form in enumerate(forms):
        text = F.when(k % 7 == n, F.concat(F.lit(form), h, F.lit("?x=1" if n in (1, 2) else ""))).otherwise(text)
    text = F.when(k % 7 == 6, F.col("url")).otherwise(text)
    return table(spark, sf, "pages").select("page_id", urls.video_id_from_url(text).alias("video_id"))


@query("local_id", "SELECT page_id, 'loc_' || substr(md5(url), 1, 7) AS id FROM pages")
def _local(spark, sf):
    return table(spark, sf, "pages").select("page_id", urls.local_id(F.col("url")).alias("id"))


def _channel_text():
    k = F.col("c_custkey")
    name = F.lower(F.regexp_replace("c_name", "[^A-Za-z0-9]", ""))
    return (
        F.when(k % 5 == 0, F.concat(F.lit("@"), name))
        .when(k % 5 == 1, F.concat(F.lit("UC"), F.substring(F.md5("c_name"), 1, 22)))
        .when(k % 5 == 2, F.concat(F.lit("https://www.youtube.com/@"), name, F.lit("/shorts")))
        .when(k % 5 == 3, F.concat(F.lit("youtube.com/c/"), name, F.lit("/")))
        .otherwise(name)
    )


_CHANNEL = """(SELECT c_custkey, c_custkey % 5 AS k, lower(regexp_replace(c_name, '[^A-Za-z0-9]', '', 'g')) AS name, 'UC' || substr(md5(c_name), 1, 22) AS cid FROM customer)"""


@query(
    "channel_url_norm",
    f"""SELECT c_custkey, 'https://www.youtube.com/' || CASE k WHEN 1 THEN 'channel/' || cid WHEN 3 THEN 'c/' || name ELSE '@' || name END || '/videos' AS url FROM {_CHANNEL}""",
)
def _channel_url(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", urls.channel_url_norm(_channel_text()).alias("url"))


@query("channel_tokens", f"SELECT c_custkey, CASE k WHEN 1 THEN [cid] WHEN 3 THEN CAST([] AS VARCHAR[]) ELSE [name] END AS tokens FROM {_CHANNEL}")
def _channel_tokens(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", urls.channel_tokens(_channel_text()).alias("tokens"))


@query("is_identifiable_channel", f"SELECT c_custkey, k < 3 AS ok FROM {_CHANNEL}")
def _identifiable(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", urls.is_identifiable_channel(_channel_text()).alias("ok"))


@query("channel_match", f"SELECT c_custkey, k <> 3 AND (c_custkey % 2 = 0 OR k = 1) AS ok FROM {_CHANNEL}")
def _channel_match(spark, sf):
    k, name = F.col("c_custkey"), F.lower(F.regexp_replace("c_name", "[^A-Za-z0-9]", ""))
    handle = F.when(k % 2 == 0, F.concat(F.lit("@"), F.upper(name)))
    cid = F.concat(F.lit("https://www.youtube.com/channel/UC"), F.substring(F.md5("c_name"), 1, 22))
    return table(spark, sf, "customer").select("c_custkey", urls.channel_match(_channel_text(), handle, cid).alias("ok"))


@query("clip_name", "SELECT o_orderkey, o_custkey || '_clip_' || (o_orderkey % 5 + 1) || '_' || CAST(floor(o_totalprice) AS BIGINT) || 's' AS name FROM orders")
def _clip_name(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", urls.clip_name(F.col("o_custkey"), F.col("o_orderkey") % 5 + 1, F.floor("o_totalprice")).alias("name"))


@query(
    "mask_secret",
    "SELECT c_custkey, CASE WHEN length(c_name) > 8 THEN substr(c_name, 1, 4) || repeat('*', length(c_name) - 8) || right(c_name, 4) ELSE repeat('*', length(c_name)) END AS masked FROM customer",
)
def _mask(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", urls.mask_secret(F.col("c_name")).alias("masked"))
