"""Queries over settings documents, markup, requests and sessions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.fixed_values import SVG_SHAPES, SVG_SKIPPED
from ..operators import events as ev
from ..operators import settings as st
from .fixture_sql import JOBS, with_
from .registry import register
from .tables import jobs, read, requests, sessions

LOG = """req AS (SELECT user_id || ':' || event_type AS key, event_type AS path, ts, event_id, user_id, value FROM events)"""


def settings_documents(spark, sf):
    """Settings as JSON text per job, damaged in one of 24 ways by key, or left valid."""
    j = jobs(spark, sf)
    k = F.col("job_id") % 30
    text = lambda c: F.col(c).cast("string")
    put = lambda name, value: F.concat(F.lit(f'"{name}":'), value)
    pick = lambda n, value: F.when(k == n, F.lit(value))
    angles = F.concat(F.lit("{"), F.array_join(F.array_compact(F.array(
        *[F.when((k == 2) & F.lit(p == "black"), F.lit(None)).otherwise(put(p, F.when(
            (k == 3) & F.lit(p == "magenta"), '"75"').otherwise((F.col(f"angles.{p}") + F.when(k == 29, 360).otherwise(0)).cast("string"))))
          for p in ("cyan", "magenta", "yellow", "black")])), ","), F.lit("}"))
    shown = F.concat(F.lit("{"), F.array_join(F.array(
        *[put(p, F.when((k == 4) & F.lit(p == "yellow"), "1").otherwise(F.col(f"visible.{p}").cast("string")))
          for p in ("cyan", "magenta", "yellow", "black")]), ","), F.lit("}"))
    fields = F.array(
        put("cellSize", F.coalesce(pick(0, "0"), pick(1, "257"), pick(5, '"12"'), pick(6, "null"), text("cell_size"))),
        F.when(k.isin(7, 28), put("frayedXEdge", F.when(k == 7, "101").otherwise("12.5"))),
        F.when(k == 8, put("frayedYEdge", F.lit("null"))),
        F.when(k == 9, put("diffusionIntensity", F.lit("0.75"))),
        F.when(k == 10, put("diffusionLevels", F.lit('"8"'))),
        F.when(k == 11, put("smearVertical", F.lit("1"))),
        F.when(k == 12, put("sliceShift", F.lit("5"))),
        F.when(k == 13, put("diffusionAlgorithm", F.lit('"riemersma"'))),
        F.when(k == 14, put("diffusionModulation", F.lit('"spiral"'))),
        F.when(k != 15, put("opacity", F.lit("4"))),
        put("invert", F.when(k == 16, "0").otherwise(text("invert"))),
        F.when(k != 27, put("grayscale", F.when(k == 17, '"true"').otherwise(text("grayscale")))),
        F.when(k.isin(18, 19, 26), put("strokeWidth", F.when(k == 18, "0.24").when(k == 19, "10.01").otherwise("2.5"))),
        put("dotShape", F.when(k == 20, F.lit('"hexagon"')).when(k == 21, F.lit('"custom"')).otherwise(
            F.concat(F.lit('"'), "dot_shape", F.lit('"')))),
        put("angles", F.when(k == 22, "7").otherwise(angles)),
        put("visible", F.when(k == 23, "null").otherwise(shown)))
    body = F.concat(F.lit("{"), F.array_join(F.array_compact(fields), ","), F.lit("}"))
    return j.select("job_id", F.when(k == 24, "not json").when(k == 25, "[]").otherwise(body).alias("settings"))


BROKEN = ("CASE job_id % 30 WHEN 0 THEN 'cellSize' WHEN 1 THEN 'cellSize' WHEN 2 THEN 'angles.black' WHEN 3 THEN 'angles.magenta' "
          "WHEN 4 THEN 'visible.yellow' WHEN 5 THEN 'cellSize' WHEN 6 THEN 'cellSize' WHEN 7 THEN 'frayedXEdge' WHEN 8 THEN 'frayedYEdge' "
          "WHEN 10 THEN 'diffusionLevels' WHEN 11 THEN 'smearVertical' WHEN 13 THEN 'diffusionAlgorithm' WHEN 14 THEN 'diffusionModulation' "
          "WHEN 15 THEN 'opacity' WHEN 16 THEN 'invert' WHEN 17 THEN 'grayscale' WHEN 18 THEN 'strokeWidth' WHEN 19 THEN 'strokeWidth' "
          "WHEN 20 THEN 'dotShape' WHEN 21 THEN 'customShape' WHEN 22 THEN 'angles' WHEN 23 THEN 'visible' WHEN 24 THEN 'settings' WHEN 25 THEN 'cellSize' END")


@register("validate_settings", with_(JOBS, f"""
SELECT job_id, field IS NULL AS ok, field, CASE WHEN field IS NULL THEN cell_size END AS cell_size, CASE WHEN field IS NULL THEN 1e0 END AS opacity,
  CASE WHEN field IS NULL THEN a3 END AS black_angle, CASE WHEN field IS NULL THEN CASE WHEN k = 26 THEN 2.5e0 ELSE 1e0 END END AS stroke,
  CASE WHEN field IS NULL THEN CASE WHEN k = 28 THEN 12.5e0 ELSE 0e0 END END AS fray, CASE WHEN field IS NULL THEN grayscale AND k <> 27 END AS grayscale,
  CASE WHEN k = 9 THEN 8e0 END AS levels, CASE WHEN k = 9 THEN 0.75e0 END AS intensity, CASE WHEN k = 12 THEN 5e0 END AS slice, CASE WHEN k = 12 THEN 20e0 END AS slice_size
FROM (SELECT *, {BROKEN} AS field, job_id % 30 AS k FROM jobs)"""))
def validate_settings(spark, sf):
    out = st.validate_settings(settings_documents(spark, sf))
    return out.select(
        "job_id", "ok", "field", F.col("value.cellSize").alias("cell_size"), F.col("value.opacity").alias("opacity"),
        F.col("value.angles.black").alias("black_angle"), F.col("value.strokeWidth").alias("stroke"),
        F.col("value.frayedXEdge").alias("fray"), F.col("value.grayscale").alias("grayscale"),
        F.col("diffusion.diffusionLevels").alias("levels"), F.col("diffusion.diffusionIntensity").alias("intensity"),
        F.col("glitch.sliceShift").alias("slice"), F.col("glitch.sliceSize").alias("slice_size"))


TAGS = "list_transform(regexp_extract_all(html, '<([a-zA-Z][a-zA-Z0-9]*)', 1), lambda t: lower(t))"
ALLOWED = ", ".join(f"'{t}'" for t in SVG_SHAPES + SVG_SKIPPED)


@register("markup_audit", f"""
WITH t AS (SELECT page_id, html, {TAGS} AS tags FROM pages)
SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS bytes, octet_length(encode(html)) > 1000000 AS too_big,
  regexp_matches(html, '(?i)<!DOCTYPE|<!ENTITY|<\\?xml-stylesheet') AS declaration, regexp_matches(html, '(?i)url\\s*\\(|href\\s*=') AS reference,
  list_contains(tags, 'text') AS text_element, CAST(len(tags) AS INT) AS elements,
  CAST(len(list_filter(list_distinct(tags), lambda t: t NOT IN ({ALLOWED}))) AS INT) AS unsupported FROM t""")
def markup_audit(spark, sf):
    docs = read(spark, sf, "pages").select("page_id", F.col("html").alias("body"))
    return st.markup_audit(docs).drop("body")


@register("element_census", f"""
WITH t AS (SELECT page_id, unnest({TAGS}) AS tag FROM pages)
SELECT tag, count(*) AS occurrences, count(DISTINCT page_id) AS documents FROM t WHERE tag NOT IN ({ALLOWED}) GROUP BY tag""")
def element_census(spark, sf):
    return st.element_census(read(spark, sf, "pages").select(F.col("html").alias("body")))


@register("rate_limit", with_(LOG, """
SELECT event_id, key, row_number() OVER (PARTITION BY user_id, date_trunc('day', ts) ORDER BY ts, event_id) <= 2 AS admitted
FROM (SELECT event_id, CAST(user_id AS VARCHAR) AS key, user_id, ts FROM req)"""))
def rate_limit(spark, sf):
    log = requests(spark, sf).withColumn("key", F.col("user_id").cast("string"))
    return ev.rate_limit(log, 86_400, 2).select("event_id", "key", "admitted")


@register("rate_windows", with_(LOG, """
SELECT key, CAST(epoch_us(date_trunc('day', ts)) AS BIGINT) AS window_us, count(*) AS requests, least(count(*), 2) AS admitted, greatest(count(*) - 2, 0) AS denied FROM req GROUP BY ALL"""))
def rate_windows(spark, sf):
    return ev.rate_windows(requests(spark, sf), 86_400, 2)


@register("expire_keys", with_(LOG, """
SELECT key, count(*) AS "count", max(ts) AS last_request FROM req GROUP BY key HAVING max(ts) < TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 10 MINUTE ORDER BY last_request, key LIMIT 100"""))
def expire_keys(spark, sf):
    return ev.expire_keys(ev.limiter_rows(requests(spark, sf)), "2024-01-31 00:00:00")


@register("known_paths", with_(LOG, """
SELECT path, count(*) AS requests, TRUE AS known FROM req WHERE path IN (SELECT event_type FROM events WHERE value > 50 AND event_type <> 'error') GROUP BY path
UNION ALL SELECT path, count(*), FALSE FROM req WHERE path NOT IN (SELECT event_type FROM events WHERE value > 50 AND event_type <> 'error') GROUP BY path"""))
def known_paths(spark, sf):
    return ev.path_report(requests(spark, sf), (F.col("value") > 50) & (F.col("path") != "error"))


@register("active_session_at", """
WITH s AS (SELECT user_id, event_id AS session_id, ts AS created, ts + INTERVAL 7 DAY AS expires FROM events WHERE event_type = 'signup')
SELECT e.event_id, e.user_id, s.session_id FROM events e JOIN s ON s.user_id = e.user_id AND e.ts >= created AND e.ts < expires
QUALIFY row_number() OVER (PARTITION BY e.event_id ORDER BY created DESC, s.session_id DESC) = 1""")
def active_session_at(spark, sf):
    return ev.active_session_at(requests(spark, sf), sessions(spark, sf)).drop("ts")


@register("key_audit", """
SELECT 'duplicate line' AS audit, l_orderkey || '-' || l_linenumber AS key, count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1
UNION ALL SELECT 'duplicate customer name', c_name, count(*) FROM customer GROUP BY c_name HAVING count(*) > 1
UNION ALL SELECT 'orphan order', CAST(o_custkey AS VARCHAR), count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer) GROUP BY o_custkey
UNION ALL SELECT 'orphan event', CAST(user_id AS VARCHAR), count(*) FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'signup') GROUP BY user_id""")
def key_audit(spark, sf):
    lines, customers = read(spark, sf, "lineitem"), read(spark, sf, "customer")
    orders, log = read(spark, sf, "orders"), read(spark, sf, "events")
    users = log.where(F.col("event_type") == "signup").select("user_id").distinct()
    named = lambda df, audit, key: df.select(F.lit(audit).alias("audit"), key.cast("string").alias("key"), "n")
    dup = ev.duplicate_keys(lines, "l_orderkey", "l_linenumber")
    parts = [
        named(dup, "duplicate line", F.concat_ws("-", "l_orderkey", "l_linenumber")),
        named(ev.duplicate_keys(customers, "c_name"), "duplicate customer name", F.col("c_name")),
        named(ev.orphans(orders, customers, "o_custkey", "c_custkey"), "orphan order", F.col("o_custkey")),
        named(ev.orphans(log, users, "user_id", "user_id"), "orphan event", F.col("user_id"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@register("debounce", """
WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS t FROM events),
nx AS (SELECT a.user_id, a.event_id, a.t, b.event_id AS next_id FROM (SELECT *, t + 21600000000 AS due FROM e) a ASOF LEFT JOIN e b ON a.user_id = b.user_id AND a.due <= b.t),
kept AS (SELECT user_id, event_id, next_id FROM nx QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) = 1
  UNION ALL SELECT n.user_id, n.event_id, n.next_id FROM kept k JOIN nx n ON n.event_id = k.next_id)
SELECT user_id, event_id FROM kept""")
def debounce(spark, sf):
    return ev.debounce(requests(spark, sf), "user_id", 6 * 3600, 24 * 3600)


@register("latest_wins", with_(LOG, """
SELECT user_id, path, event_id, ts, value FROM req QUALIFY row_number() OVER (PARTITION BY user_id, path ORDER BY ts DESC, event_id DESC) = 1"""))
def latest_wins(spark, sf):
    return ev.latest_wins(requests(spark, sf).drop("key"), "user_id", "path")


@register("origin_check", r"""
WITH o AS (SELECT page_id, url, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS base FROM pages),
c AS (SELECT page_id, unnest([0, 1, 2, 3, 4, 5]) AS kind, unnest([url, base, base || '/', replace(base, 'https:', 'http:') || ':80', 'http://LOCALHOST:' || page_id || '/', 'https://user@' || page_id || '.test']) AS candidate FROM o)
SELECT page_id, kind, candidate, CASE WHEN regexp_matches(candidate, '(?i)^https://[^/?#@\s:]+(:[0-9]+)?/?$') THEN regexp_replace(regexp_replace(lower(candidate), '/$', ''), ':443$', '')
  WHEN regexp_matches(candidate, '(?i)^http://(127\.0\.0\.1|localhost|\[::1\])(:[0-9]+)?/?$') THEN regexp_replace(regexp_replace(lower(candidate), '/$', ''), ':80$', '') END AS origin FROM c""")
def origin_check(spark, sf):
    base = F.regexp_extract("url", r"^(https?://[^/?#]+)", 1)
    page = F.col("page_id").cast("string")
    options = F.array(F.col("url"), base, F.concat(base, F.lit("/")),
                      F.concat(F.replace(base, F.lit("https:"), F.lit("http:")), F.lit(":80")),
                      F.concat(F.lit("http://LOCALHOST:"), page, F.lit("/")),
                      F.concat(F.lit("https://user@"), page, F.lit(".test")))
    rows = read(spark, sf, "pages").select("page_id", F.posexplode(options).alias("kind", "candidate"))
    return rows.withColumn("origin", ev.accepted_origin(F.col("candidate")))
