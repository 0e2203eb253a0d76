"""Queries on the driver's tables and the SQL that says the same.

The tables hold no images, sizes or deployments, so each query derives such inputs from their columns by fixed rules.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import columns as C, fixed, geometry as G
from ..operators import pixels, relational as R

from . import process

_found: dict[str, Callable] = {}
_sql: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        _found[f.__name__] = f
        if sql:
            _sql[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_found)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _case(of: str, values: list[str]) -> str:
    """CASE by number, the same text for both engines."""
    return f"CASE {of} " + " ".join(f"WHEN {k} THEN {v}" for k, v in enumerate(values)) + " END"


def _map_sql(table: dict, of: str) -> str:
    """A lookup as CASE, for the SQL side."""
    say = lambda v: f"'{v}'" if isinstance(v, str) else str(v)
    return f"CASE {of} " + " ".join(f"WHEN {say(k)} THEN {say(v)}" for k, v in table.items()) + " END"


# --- parsers

_SIZE_TEXT = _case("p_partkey % 14", [f"'{x}'" for x in ("ig-post", "IG-Portrait", " x-header ", "8x10", "4x6")] + ["concat(p_size, 'x', p_size + 7)", "concat(' ', p_size, ' , ', p_partkey)", "concat('-', p_size, 'x+', p_partkey)", "concat(p_size, 'x', p_size, 'x', 1)", "concat(p_size, ',1x3')", "p_brand", "''", "concat('0', p_size, 'x', '0007')", "concat(p_size, 'x99999999999999999999')"])
_TRIM = "regexp_replace({0}, '^[\\t-\\r ]+|[\\t-\\r ]+$', '', 'g')"


def _int_sql(x: str) -> str:
    x = _TRIM.format(x)
    return f"CASE WHEN regexp_matches({x}, '^[+-]?[0-9]+$') THEN try_cast({x} AS BIGINT) END"


@_query(f"""
WITH t AS (SELECT p_partkey, {_SIZE_TEXT} AS input FROM part),
u AS (SELECT *, lower({_TRIM.format("input")}) AS s FROM t),
v AS (SELECT *, {_map_sql({k: w for k, (w, _) in fixed.SIZES.items()}, "s")} AS pw, {_map_sql({k: h for k, (_, h) in fixed.SIZES.items()}, "s")} AS ph,
  CASE WHEN len(string_split(s, 'x')) = 2 THEN string_split(s, 'x') WHEN len(string_split(s, ',')) = 2 THEN string_split(s, ',') END AS q FROM u),
w AS (SELECT *, {_int_sql("q[1]")} AS a, {_int_sql("q[2]")} AS b FROM v)
SELECT p_partkey, input, coalesce(pw, CASE WHEN b IS NOT NULL THEN a END)::BIGINT AS width, coalesce(ph, CASE WHEN a IS NOT NULL THEN b END)::BIGINT AS height,
  CASE WHEN pw IS NOT NULL THEN NULL WHEN q IS NULL THEN 'invalid size: ' || s WHEN a IS NULL THEN 'invalid width: ' || q[1] WHEN b IS NULL THEN 'invalid height: ' || q[2] END AS error FROM w""")
def parse_size(spark, sf_dir):
    rows = _table(spark, sf_dir, "part").select("p_partkey", F.expr(_SIZE_TEXT).alias("input"))
    return rows.select("*", C.size(F.col("input")).alias("s")).select("p_partkey", "input", "s.*")


_SPELLINGS = [x for xs in fixed.FILTERS.values() for x in xs]
_FILTER_TEXT = _case("p_partkey % 14", [f"'{x}'" for x in [*_SPELLINGS, "Lanczos", " linear", "box"]][:14])


@_query(f"""WITH t AS (SELECT p_partkey, {_FILTER_TEXT} AS input FROM part)
SELECT p_partkey, input, {_map_sql({x: n for n, xs in fixed.FILTERS.items() for x in xs}, "input")} AS filter, coalesce({_map_sql({x: n for n, xs in fixed.FILTERS.items() for x in xs}, "input")}, 'unknown') AS label FROM t""")
def parse_filter(spark, sf_dir):
    rows = _table(spark, sf_dir, "part").select("p_partkey", F.expr(_FILTER_TEXT).alias("input"))
    return rows.select("p_partkey", "input", C.filter_name(F.col("input")).alias("filter"), C.filter_label(F.col("input")).alias("label"))


_COLOUR_TEXT = _case("c_custkey % 10", ["concat('#', substr(md5(c_name), 1, 3))", "substr(md5(c_name), 1, 6)", "concat('#', substr(md5(c_name), 1, 8))", "concat('#', substr(md5(c_name), 1, 4))", "'Navy'", "' fuchsia '", "c_mktsegment", "upper(substr(md5(c_name), 1, 3))", "concat('##', substr(md5(c_name), 1, 3))", "'grey'"])


def _channel_sql(k: int) -> str:
    named = _map_sql({n: (*c, 255)[k] for n, c in fixed.COLOURS.items()}, "lower(t)")
    return f"coalesce({named}, CASE WHEN h IS NOT NULL THEN ('0x' || substr(h, {2 * k + 1}, 2))::INT END)::INT"


@_query(f"""
WITH i AS (SELECT c_custkey, {_COLOUR_TEXT} AS input FROM customer),
j AS (SELECT *, {_TRIM.format("input")} AS t, regexp_replace({_TRIM.format("input")}, '^#', '') AS d FROM i),
k AS (SELECT *, CASE WHEN regexp_matches(d, '^[0-9a-fA-F]{{3}}$') THEN regexp_replace(d, '(.)', '\\1\\1', 'g') || 'ff' WHEN regexp_matches(d, '^[0-9a-fA-F]{{6}}$') THEN d || 'ff' WHEN regexp_matches(d, '^[0-9a-fA-F]{{8}}$') THEN d END AS h FROM j),
l AS (SELECT c_custkey, input, {", ".join(f"{_channel_sql(k)} AS {c}" for k, c in enumerate("rgba"))}, t FROM k)
SELECT c_custkey, input, r, g, b, a, CASE WHEN a IS NULL THEN 'invalid color: ' || t END AS error FROM l""")
def parse_color(spark, sf_dir):
    rows = _table(spark, sf_dir, "customer").select("c_custkey", F.expr(_COLOUR_TEXT).alias("input"))
    return rows.select("*", C.colour(F.col("input")).alias("c")).select("c_custkey", "input", "c.*")


_LEVEL_TEXT = _case("c_custkey % 8", ["'debug'", "'INFO'", "'Warning'", "'warn'", "'error'", "''", "'verbose'", "NULL"])


@_query(f"""SELECT c_custkey, coalesce({_map_sql(fixed.LOG_LEVELS, f"lower({_LEVEL_TEXT})")}, 'error') AS level FROM customer""")
def log_level(spark, sf_dir):
    return _table(spark, sf_dir, "customer").select("c_custkey", C.log_level(F.expr(_LEVEL_TEXT)).alias("level"))


# --- paths and names

_PATH_TEXT = _case("p_partkey % 12", ["concat(p_name, '_v', p_size, '.png')", "concat('./', p_name, '.jpg')", "concat('/a//b/../', p_name, '_v007.tar.gz')", "concat('../x/./', p_name)", "concat('/../', p_name, '_v', p_size, '_edited.jpg')", "concat('d', p_size, '/.hidden')", "concat('_v', p_size, '.jpg')", "concat('a_v1_v', p_size, '.jpg')", "concat('x/y/../../', p_size, '.jpeg')", "concat('a_v', p_size, '99999999999999999999.jpg')", "concat('p.', p_size, '/q')", "concat('a/../../b', p_size, '.png')"])
_FOLDER_TEXT = "CASE WHEN p_partkey % 5 = 0 THEN '/out/./x' WHEN p_partkey % 5 = 1 THEN 'rel/' ELSE '' END"


@_query(f"""
WITH RECURSIVE i AS (SELECT p_partkey, {_PATH_TEXT} AS input, {_FOLDER_TEXT} AS folder FROM part),
j AS (SELECT *, regexp_extract(input, '([^/]*)$', 1) AS name FROM i),
k AS (SELECT *, regexp_replace(name, '\\.[^./]*$', '') AS base FROM j),
l AS (SELECT *, regexp_matches(base, '^.+_v[0-9]+$') AS ver, try_cast(nullif(regexp_extract(base, '_v([0-9]+)$', 1), '') AS BIGINT) AS n FROM k),
m AS (SELECT *, CASE WHEN ver AND (n IS NULL OR n = 9223372036854775807) THEN NULL ELSE
  CASE WHEN folder = '' THEN regexp_extract(input, '^(.*/)?[^/]*$', 1) ELSE folder || '/' END ||
  CASE WHEN ver THEN regexp_extract(base, '^(.+)_v[0-9]+$', 1) || '_v' || (n + 1) ELSE base || '_v0' END || '.jpg' END AS raw FROM l),
walk AS (SELECT p_partkey, input, folder, base, raw, starts_with(raw, '/') AS root, list_filter(string_split(raw, '/'), lambda x: x NOT IN ('', '.')) AS todo, []::VARCHAR[] AS done FROM m
  UNION ALL
  SELECT p_partkey, input, folder, base, raw, root, todo[2:], CASE WHEN todo[1] <> '..' THEN list_append(done, todo[1]) WHEN len(done) > 0 AND done[-1] <> '..' THEN done[:-2] WHEN root THEN done ELSE list_append(done, '..') END
  FROM walk WHERE len(todo) > 0)
SELECT p_partkey, input, CASE WHEN raw IS NULL THEN NULL WHEN root THEN '/' || array_to_string(done, '/') ELSE array_to_string(done, '/') END AS path,
  CASE WHEN raw IS NULL THEN 'version out of range: ' || base END AS error FROM walk WHERE raw IS NULL OR len(todo) = 0""")
def output_path(spark, sf_dir):
    rows = _table(spark, sf_dir, "part").select("p_partkey", F.expr(_PATH_TEXT).alias("input"), F.expr(_FOLDER_TEXT).alias("folder"))
    return rows.select("p_partkey", "input", C.output_path(F.col("input"), F.col("folder")).alias("o")).select("p_partkey", "input", "o.*")


_NAMES = [f"x{e}" for e in list(fixed.CONTENT_TYPES)[:29]] + ["A.HTML", "none"]
_NAME_TEXT = f"CASE WHEN page_id % 2 = 0 THEN regexp_replace(url, '[?#].*', '') ELSE {_case('page_id % 31', [repr(x) for x in _NAMES])} END"


@_query(f"""WITH t AS (SELECT page_id, {_NAME_TEXT} AS name FROM pages)
SELECT page_id, name, coalesce({_map_sql(fixed.CONTENT_TYPES, "lower(regexp_extract(name, '(\\.[^./]*)$', 1))")}, '{fixed.OCTETS}') AS content_type,
  {_map_sql(fixed.IMAGE_FORMATS, "lower(regexp_extract(name, '(\\.[^./]*)$', 1))")} AS image_format FROM t""")
def mime_type(spark, sf_dir):
    rows = _table(spark, sf_dir, "pages").select("page_id", F.expr(_NAME_TEXT).alias("name"))
    return rows.select("page_id", "name", C.content_type(F.col("name")).alias("content_type"), C.image_format(F.col("name")).alias("image_format"))


@_query("SELECT c_custkey, " + " || ".join(f"substr('{fixed.ID_LETTERS}', ('0x' || substr(md5(c_name), {2 * k + 1}, 2))::INT % 36 + 1, 1)" for k in range(8)) + " AS id FROM customer")
def random_id_map(spark, sf_dir):
    return _table(spark, sf_dir, "customer").select("c_custkey", C.random_id(F.unhex(F.md5("c_name"))).alias("id"))


@_query("""SELECT c_custkey, 'site-' || sub AS stack, 'site-' || sub || '-' || c_nationkey AS bucket, sub || '.' || lower(c_mktsegment) || '.org' AS fqdn, 'https://' || sub || '.' || lower(c_mktsegment) || '.org' AS url, 'sans ' || (c_custkey % 40) AS font
FROM (SELECT *, 's' || c_custkey AS sub FROM customer)""")
def site_names(spark, sf_dir):
    sub, domain = F.concat(F.lit("s"), F.col("c_custkey")), F.concat(F.lower("c_mktsegment"), F.lit(".org"))
    return _table(spark, sf_dir, "customer").select("c_custkey", C.stack_name("site", sub).alias("stack"), C.bucket_name("site", sub, F.col("c_nationkey").cast("string")).alias("bucket"), C.site_name(sub, domain).alias("fqdn"), C.site_url(sub, domain).alias("url"), C.font_name(F.lit("sans"), F.col("c_custkey") % 40).alias("font"))


# --- geometry

_BOX = "l_partkey % 4000 + 1 AS w, l_suppkey % 3000 + 1 AS h, CASE WHEN l_linenumber % 2 = 0 THEN 1080 ELSE 1920 END AS ow, CASE WHEN l_linenumber % 3 = 0 THEN 566 ELSE 1080 END AS oh, CASE WHEN l_linenumber = 7 THEN 60 ELSE l_linenumber END AS pct"
_LINES = f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, w::BIGINT AS w, h::BIGINT AS h, ow::BIGINT AS ow, oh::BIGINT AS oh, trunc(least(ow, oh)::DOUBLE * pct::DOUBLE / 100.0::DOUBLE)::BIGINT AS frame FROM (SELECT *, {_BOX} FROM lineitem)"


def _lines(spark, sf_dir) -> DataFrame:
    rows = _table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *[x.strip() for x in _BOX.replace(", CASE", "|CASE").replace(", l_suppkey", "|l_suppkey").split("|")])
    rows = rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *[F.col(c).cast("bigint").alias(c) for c in ("w", "h", "ow", "oh")], "pct")
    return rows.select("*", G.frame_px(F.col("ow"), F.col("oh"), F.col("pct")).alias("frame")).drop("pct")


def _fit_sql(box_w: str, box_h: str) -> str:
    scale = f"least({box_w}::DOUBLE / w::DOUBLE, {box_h}::DOUBLE / h::DOUBLE)"
    return f"greatest(1, floor(w::DOUBLE * {scale} + 0.5::DOUBLE)::BIGINT) AS rw, greatest(1, floor(h::DOUBLE * {scale} + 0.5::DOUBLE)::BIGINT) AS rh"


_KEYS = "l_orderkey, l_linenumber, l_partkey, l_suppkey, frame"


@_query(f"""WITH a AS ({_LINES}), b AS (SELECT *, ow - 2 * frame > 0 AND oh - 2 * frame > 0 AS ok, {_fit_sql("(ow - 2 * frame)", "(oh - 2 * frame)")} FROM a), c AS (SELECT *, (ow - rw) // 2 AS x, (oh - rh) // 2 AS y FROM b)
SELECT {_KEYS}, {", ".join(f"CASE WHEN ok THEN {e} END::BIGINT AS {n}" for n, e in (("width", "rw"), ("height", "rh"), ("left", "x"), ("top", "y"), ("right", "ow - rw - x"), ("bottom", "oh - rh - y"), ("image_bottom", "y + rh"), ("canvas_width", "ow"), ("canvas_height", "oh"))).replace('AS left', 'AS "left"').replace('AS right', 'AS "right"')},
  CASE WHEN NOT ok THEN 'frame too large for output size' END AS error FROM c""")
def fit_expand(spark, sf_dir):
    rows = _lines(spark, sf_dir)
    return G.expand(rows, "w", "h", "ow", "oh", "frame").drop("w", "h", "ow", "oh")


@_query(f"""WITH a AS ({_LINES}), b AS (SELECT *, {_fit_sql("ow", "oh")} FROM a)
SELECT {_KEYS}, rw AS width, rh AS height, frame AS "left", frame AS top, frame AS "right", frame AS bottom, frame + rh AS image_bottom, rw + 2 * frame AS canvas_width, rh + 2 * frame AS canvas_height, NULL::VARCHAR AS error FROM b""")
def fit_wrap(spark, sf_dir):
    rows = _lines(spark, sf_dir)
    return rows.select(*_KEYS.split(", "), G.wrap(*[F.col(c) for c in ("w", "h", "ow", "oh", "frame")]).alias("e")).select(*_KEYS.split(", "), "e.*")


@_query(f"""WITH a AS ({_LINES}) SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, least(w, h) AS side, frame, w + 40 + 20 AS canvas_width, h + 10 + 30 AS canvas_height FROM a""")
def frame_px(spark, sf_dir):
    n = lambda x: F.lit(x).cast("bigint")
    return _lines(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", G.shorter(F.col("w"), F.col("h")).alias("side"), "frame", G.framed(F.col("w"), F.col("h"), n(10), n(20), n(30), n(40)).alias("f")).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "side", "frame", "f.*")


@_query("""
WITH a AS (SELECT doc_id, text AS t, (doc_id % 900 + 100)::BIGINT AS w, (doc_id % 700 + 90)::BIGINT AS h FROM documents),
b AS (SELECT *, greatest(8, trunc(least(w, h)::DOUBLE * 1.5::DOUBLE / 100.0::DOUBLE)::BIGINT) AS font, trunc(least(w, h)::DOUBLE * 1.0::DOUBLE / 100.0::DOUBLE)::BIGINT AS pad_y FROM a),
c AS (SELECT *, trunc(strlen(t)::DOUBLE * font::DOUBLE * 0.6::DOUBLE)::BIGINT AS tw, trunc(font::DOUBLE * 1.35::DOUBLE)::BIGINT AS th, font // 3 AS pad FROM b),
d AS (SELECT *, greatest(0, h - doc_id % 40 + pad_y) AS top, greatest(0, doc_id % 30 - pad // 2) AS x, tw + 2 * pad AS bw0, th + pad AS bh0 FROM c),
e AS (SELECT *, CASE WHEN x + bw0 > w THEN w - x ELSE bw0 END AS bw, CASE WHEN top + bh0 > h THEN h - top ELSE bh0 END AS bh FROM d)
SELECT doc_id, font, x::BIGINT AS box_left, top::BIGINT AS box_top, bw::BIGINT AS box_width, bh::BIGINT AS box_height, (x + pad // 2)::BIGINT AS text_left, (top + pad // 2)::BIGINT AS text_top, bw > 0 AND bh > 0 AS drawable FROM e""")
def label_box(spark, sf_dir):
    rows = _table(spark, sf_dir, "documents").selectExpr("doc_id", "text AS t", "doc_id % 900 + 100 AS w", "doc_id % 700 + 90 AS h")
    rows = rows.withColumn("font", G.font_px(F.col("w"), F.col("h"), F.lit(1.5))).withColumn("pad_y", G.percent_px(G.shorter(F.col("w"), F.col("h")), F.lit(1.0)))
    box = G.label_box(F.col("t"), F.col("font"), F.col("w"), F.col("h"), F.col("doc_id") % 30, F.col("h") - F.col("doc_id") % 40, F.col("pad_y"))
    return rows.select("doc_id", "font", box.alias("b")).select("doc_id", "font", "b.*")


# --- metadata

_SIDECAR = "CASE WHEN doc_id % 7 = 0 THEN concat('contentHeadline = ', source) WHEN doc_id % 7 = 1 THEN 'contentHeadline = \"\"' WHEN doc_id % 7 = 2 THEN NULL ELSE concat('x = 1, contentHeadline', CASE WHEN doc_id % 2 = 0 THEN '=' ELSE ' = ' END, '\"', replace(substr(text, 1, 30), '\"', ''), '\", contentHeadline = \"later\"') END"


@_query(f"""WITH t AS (SELECT doc_id, {_SIDECAR} AS sidecar, CASE WHEN doc_id % 3 = 0 THEN source ELSE '' END AS iptc FROM documents)
SELECT doc_id, coalesce(nullif(regexp_extract(sidecar, 'contentHeadline[\\t\\n\\f\\r ]*=[\\t\\n\\f\\r ]*"([^"]*)"', 1), ''), nullif(iptc, ''), '') AS headline FROM t""")
def headline(spark, sf_dir):
    rows = _table(spark, sf_dir, "documents").select("doc_id", F.expr(_SIDECAR).alias("sidecar"), F.expr("CASE WHEN doc_id % 3 = 0 THEN source ELSE '' END").alias("iptc"))
    return rows.select("doc_id", F.coalesce(C.headline(F.col("sidecar")), F.nullif(F.col("iptc"), F.lit("")), F.lit("")).alias("headline"))


_TAGS = "SELECT user_id, event_id, CASE WHEN event_type = 'view' THEN 'Headline' ELSE event_type END AS tag, CASE WHEN event_id % 5 = 0 THEN NULL ELSE concat('h', event_id) END AS value FROM events"


@_query(f"""SELECT user_id, count(*) AS tags, coalesce(arg_max(value, event_id) FILTER (WHERE tag = 'Headline' AND value IS NOT NULL), '') AS value FROM ({_TAGS}) GROUP BY user_id""")
def tag_summary(spark, sf_dir):
    _table(spark, sf_dir, "events").createOrReplaceTempView("_lumenary_events")
    return R.tag_summary(spark.sql(_TAGS.replace("FROM events", "FROM _lumenary_events")).withColumnRenamed("event_id", "ordinal"), ["user_id"])


# --- publishing

_LOCAL = "SELECT concat('d', doc_id % 9, '/', doc_id, CASE doc_id % 3 WHEN 0 THEN '.html' WHEN 1 THEN '.TXT' ELSE '' END) AS key, md5(text) AS md5, doc_id FROM documents"
_REMOTE = f"SELECT key, CASE WHEN doc_id % 22 = 0 THEN NULL ELSE concat('\"', CASE WHEN doc_id % 5 = 0 THEN concat(md5, '-2') ELSE md5 END, '\"') END AS etag, doc_id AS ordinal FROM ({_LOCAL}) q WHERE doc_id % 2 = 0 UNION ALL SELECT key, md5(key) AS etag, doc_id - 1 AS ordinal FROM ({_LOCAL}) q WHERE doc_id % 4 = 0 UNION ALL SELECT concat('old/', doc_id) AS key, md5 AS etag, doc_id AS ordinal FROM ({_LOCAL}) q WHERE doc_id % 50 = 0"
_INDEX = f"SELECT key, trim(arg_max(etag, ordinal), '\"') AS md5 FROM ({_REMOTE}) r WHERE etag IS NOT NULL GROUP BY key"
_PLAN = f"""SELECT l.key, l.md5, coalesce({_map_sql(fixed.CONTENT_TYPES, "lower(regexp_extract(l.key, '(\\.[^./]*)$', 1))")}, '{fixed.OCTETS}') AS content_type, CASE WHEN r.md5 IS NULL THEN 'upload' ELSE 'skip' END AS action
FROM ({_LOCAL}) l LEFT JOIN ({_INDEX}) r ON l.key = r.key AND l.md5 = r.md5"""


def _site(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    docs.createOrReplaceTempView("_lumenary_documents")
    say = lambda sql: spark.sql(sql.replace("FROM documents", "FROM _lumenary_documents"))
    return say(_LOCAL), R.remote_index(say(_REMOTE))


@_query(_PLAN)
def sync_diff(spark, sf_dir):
    return R.sync_plan(*_site(spark, sf_dir))


@_query(f"SELECT l.key, l.md5, l.doc_id FROM ({_LOCAL}) l WHERE NOT EXISTS (SELECT 1 FROM ({_INDEX}) r WHERE r.key = l.key AND r.md5 = l.md5)")
def changed_files(spark, sf_dir):
    return R.changed_files(*_site(spark, sf_dir)).select("key", "md5", "doc_id")


@_query(f"SELECT key, md5 AS etag FROM ({_INDEX}) r WHERE key NOT IN (SELECT key FROM ({_LOCAL}) l)")
def stale_objects(spark, sf_dir):
    return R.stale_objects(*_site(spark, sf_dir))


@_query(f"SELECT count(*) FILTER (WHERE action = 'upload') AS uploaded, count(*) FILTER (WHERE action = 'skip') AS skipped FROM ({_PLAN})")
def sync_counts(spark, sf_dir):
    return R.sync_counts(R.sync_plan(*_site(spark, sf_dir)))


@_query(f"SELECT 'E1' AS distribution_id, '/*' AS path FROM (SELECT count(*) FILTER (WHERE action = 'upload') AS uploaded FROM ({_PLAN})) WHERE uploaded > 0")
def invalidation_plan(spark, sf_dir):
    return R.invalidation_plan(R.sync_counts(R.sync_plan(*_site(spark, sf_dir))), F.lit("E1"))


_ZONES = "SELECT n_nationkey AS ordinal, concat(CASE WHEN n_nationkey % 3 = 0 THEN '' ELSE '/hostedzone/' END, 'Z', n_nationkey) AS id, concat(lower(n_name), '.com', CASE WHEN n_nationkey % 4 = 0 THEN '' ELSE '.' END) AS name, CASE WHEN n_nationkey % 5 = 0 THEN NULL ELSE n_nationkey % 3 <> 1 END AS private, n_regionkey AS account FROM nation"
_PUBLIC = f"SELECT ordinal, regexp_replace(id, '^/hostedzone/', '') AS id, regexp_replace(name, '\\.$', '') AS name, account FROM ({_ZONES}) WHERE coalesce(NOT private, true)"


def _zones(spark, sf_dir) -> DataFrame:
    _table(spark, sf_dir, "nation").createOrReplaceTempView("_lumenary_nation")
    return spark.sql(_ZONES.replace("FROM nation", "FROM _lumenary_nation"))


@_query(_PUBLIC)
def zone_list(spark, sf_dir):
    return R.public_zones(_zones(spark, sf_dir)).select("ordinal", "id", "name", "account")


@_query(f"SELECT account, count(*) AS zones, CASE WHEN count(*) = 1 THEN min(id) END AS zone_id, CASE WHEN count(*) = 1 THEN min(name) END AS zone_name, CASE WHEN count(*) > 1 THEN 'several hosted zones' END AS error FROM ({_PUBLIC}) GROUP BY account")
def zone_select(spark, sf_dir):
    return R.select_zone(R.public_zones(_zones(spark, sf_dir)), ["account"])


@_query(f"""WITH p AS (SELECT *, row_number() OVER (PARTITION BY account ORDER BY ordinal, id) AS nth, count(*) OVER (PARTITION BY account) AS zones FROM ({_PUBLIC}))
SELECT account, zones, max(id) FILTER (WHERE nth = 2 OR zones = 1) AS zone_id, max(name) FILTER (WHERE nth = 2 OR zones = 1) AS zone_name, NULL::VARCHAR AS error FROM p GROUP BY account, zones""")
def zone_pick(spark, sf_dir):
    return R.select_zone(R.public_zones(_zones(spark, sf_dir)), ["account"], pick=2)


_OUT = "SELECT s_suppkey, 1 AS ordinal, 'BucketName' AS output_key, s_name AS output_value FROM supplier UNION ALL SELECT s_suppkey, 2, 'SiteURL', concat('https://', s_suppkey) FROM supplier WHERE s_suppkey % 3 > 0 UNION ALL SELECT s_suppkey, 3, 'SiteURL', CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE 'https://later' END FROM supplier WHERE s_suppkey % 2 = 0 UNION ALL SELECT s_suppkey, 4, 'Other', 'x' FROM supplier UNION ALL SELECT s_suppkey, 5, 'DistributionId', concat('E', s_nationkey) FROM supplier UNION ALL SELECT s_suppkey, 6, NULL, 'y' FROM supplier"


@_query(f"SELECT s_suppkey, " + ", ".join(f"coalesce(arg_max(output_value, ordinal) FILTER (WHERE output_key = '{k}' AND output_value IS NOT NULL), '') AS \"{k}\"" for k in fixed.OUTPUTS) + f" FROM ({_OUT}) GROUP BY s_suppkey")
def stack_outputs(spark, sf_dir):
    _table(spark, sf_dir, "supplier").createOrReplaceTempView("_lumenary_supplier")
    return R.stack_outputs(spark.sql(_OUT.replace("FROM supplier", "FROM _lumenary_supplier")), ["s_suppkey"])


_EVENTS = "SELECT user_id, event_id AS ordinal, CASE event_type WHEN 'view' THEN 'CREATE_IN_PROGRESS' WHEN 'signup' THEN 'CREATE_FAILED' WHEN 'purchase' THEN 'UPDATE_COMPLETE' WHEN 'click' THEN 'ROLLBACK_IN_PROGRESS' ELSE 'UPDATE_FAILED' END AS status, CASE WHEN event_id % 3 = 0 THEN NULL ELSE concat('reason ', event_id) END AS reason FROM events"
_POLLS = "SELECT user_id, event_id AS ordinal, CASE event_id % 17 WHEN 0 THEN 'CREATE_COMPLETE' WHEN 1 THEN 'ROLLBACK_COMPLETE' WHEN 2 THEN 'DELETE_FAILED' WHEN 3 THEN 'UPDATE_COMPLETE' ELSE concat(upper(event_type), '_IN_PROGRESS') END AS status FROM events"


def _events(spark, sf_dir, sql: str) -> DataFrame:
    _table(spark, sf_dir, "events").createOrReplaceTempView("_lumenary_events")
    return spark.sql(sql.replace("FROM events", "FROM _lumenary_events"))


@_query(f"SELECT user_id, coalesce(arg_min(reason, ordinal) FILTER (WHERE status IN ('CREATE_FAILED', 'UPDATE_FAILED') AND reason IS NOT NULL), 'unknown reason') AS reason FROM ({_EVENTS}) GROUP BY user_id")
def failure_reason(spark, sf_dir):
    return R.failure_reason(_events(spark, sf_dir, _EVENTS), ["user_id"])


@_query(f"""WITH f AS (SELECT user_id, arg_min(status, ordinal) FILTER (WHERE status IN {(*fixed.DONE, *fixed.FAILED)}) AS status, min(ordinal) FILTER (WHERE status IN {(*fixed.DONE, *fixed.FAILED)}) AS polls FROM ({_POLLS}) GROUP BY user_id)
SELECT user_id, status, polls, CASE WHEN status IS NULL THEN 'waiting' WHEN status IN {fixed.DONE} THEN 'done' ELSE 'failed' END AS result FROM f""")
def stack_wait(spark, sf_dir):
    return R.wait_result(_events(spark, sf_dir, _POLLS), ["user_id"])


@_query(f"""WITH p AS (SELECT user_id, status, row_number() OVER (PARTITION BY user_id ORDER BY ordinal) AS ordinal FROM ({_POLLS})),
f AS (SELECT user_id, arg_min(status, ordinal) FILTER (WHERE ordinal <= 4 AND status IN {(*fixed.DONE, *fixed.FAILED)}) AS status, min(ordinal) FILTER (WHERE ordinal <= 4 AND status IN {(*fixed.DONE, *fixed.FAILED)}) AS polls, max(ordinal) AS most FROM p GROUP BY user_id)
SELECT user_id, status, polls, CASE WHEN status IN {fixed.DONE} THEN 'done' WHEN status IS NOT NULL THEN 'failed' WHEN most >= 4 THEN 'timeout' ELSE 'waiting' END AS result FROM f""")
def stack_deadline(spark, sf_dir):
    """The wait with a deadline of four polls."""
    from pyspark.sql import Window as W

    polls = _events(spark, sf_dir, _POLLS).withColumn("ordinal", F.row_number().over(W.partitionBy("user_id").orderBy("ordinal")))
    return R.wait_result(polls, ["user_id"], 4)


@_query("SELECT event_id, CASE WHEN CASE WHEN event_type = 'click' THEN 'Completed' WHEN event_type = 'view' THEN 'completed' ELSE 'InProgress' END = 'Completed' THEN 'done' ELSE 'waiting' END AS result FROM events")
def invalidation_wait(spark, sf_dir):
    status = F.when(F.col("event_type") == "click", "Completed").when(F.col("event_type") == "view", "completed").otherwise("InProgress")
    return _table(spark, sf_dir, "events").select("event_id", R.invalidation_kind(status).alias("result"))


_ERROR = "CASE o_orderkey % 4 WHEN 0 THEN 'No updates are to be performed.' WHEN 1 THEN 'access denied' ELSE NULL END"


@_query(f"""WITH t AS (SELECT o_orderkey, EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_custkey % 3 = 0) AS there, {_ERROR} AS err FROM orders)
SELECT o_orderkey, CASE WHEN there THEN 'update' ELSE 'create' END AS action, NOT (there AND err IS NOT NULL) AS needs_wait, CASE WHEN there AND err = 'access denied' THEN 'failed to update stack: access denied' END AS error FROM t""")
def upsert_action(spark, sf_dir):
    known = _table(spark, sf_dir, "customer").filter("c_custkey % 3 = 0").select(F.col("c_custkey").alias("o_custkey"), F.lit(True).alias("there"))
    rows = _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.expr(_ERROR).alias("err")).join(known, "o_custkey", "left")
    return rows.select("o_orderkey", R.upsert_action(F.coalesce("there", F.lit(False)), F.col("err")).alias("u")).select("o_orderkey", "u.*")


@_query("SELECT o_orderkey, o_custkey FROM orders WHERE EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal > 0)")
def stack_exists(spark, sf_dir):
    known = _table(spark, sf_dir, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return R.existing(_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), known, "o_custkey").select("o_orderkey", "o_custkey")


@_query("""WITH t AS (SELECT d.doc_id, CASE WHEN d.doc_id % 4 = 0 THEN 'flag' ELSE '' END AS flag, CASE WHEN quality = 1 THEN source WHEN quality = 0 THEN '' END AS cfg, CASE WHEN d.doc_id % 3 = 0 THEN 'Z1' ELSE '' END AS zone, lang AS domain FROM documents d LEFT JOIN (SELECT doc_id, min(quality) AS quality FROM labels GROUP BY doc_id) l ON l.doc_id = d.doc_id),
u AS (SELECT *, coalesce(nullif(flag, ''), nullif(cfg, ''), 'gen' || doc_id) AS subdomain, CASE WHEN zone <> '' AND domain <> '' THEN zone END AS zone_id FROM t)
SELECT doc_id, subdomain, zone_id, coalesce(cfg, '') <> subdomain OR coalesce(zone, '') <> coalesce(zone_id, 'Z9') AS changed FROM u""")
def subdomain_pick(spark, sf_dir):
    labels = _table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    rows = R.join_dimension(_table(spark, sf_dir, "documents").select("doc_id", "source", "lang"), labels, "doc_id")
    rows = rows.selectExpr("doc_id", "CASE WHEN doc_id % 4 = 0 THEN 'flag' ELSE '' END AS flag", "CASE WHEN quality = 1 THEN source WHEN quality = 0 THEN '' END AS cfg", "CASE WHEN doc_id % 3 = 0 THEN 'Z1' ELSE '' END AS zone", "lang AS domain")
    rows = rows.withColumn("subdomain", R.first_of(F.col("flag"), F.col("cfg"), F.concat(F.lit("gen"), F.col("doc_id")))).withColumn("zone_id", R.saved_zone(F.col("zone"), F.col("domain")))
    return rows.select("doc_id", "subdomain", "zone_id", R.config_changed([F.col("cfg"), F.col("zone")], [F.col("subdomain"), F.coalesce("zone_id", F.lit("Z9"))]).alias("changed"))


@_query("""SELECT output, max(p_partkey) AS p_partkey FROM (SELECT p_partkey, p_brand || '_v0.jpg' AS output FROM part) GROUP BY output""")
def last_writer(spark, sf_dir):
    rows = _table(spark, sf_dir, "part").select("p_partkey", C.output_path(F.concat("p_brand", F.lit(".png")))["path"].alias("output"))
    return R.last_writer(rows, "output", "p_partkey")


# --- pixels


def _resample_sql(kernel: str, n: int) -> str:
    """Weights of the 64 -> n resampling as a list of lists; the sum goes in the order of the samples."""
    rows = ", ".join("[" + ", ".join(repr(float(v)) + "::DOUBLE" if v else "0.0::DOUBLE" for v in row) + "]" for row in pixels.weights(64, n, kernel))
    return f"""WITH w AS (SELECT [{rows}] AS m)
SELECT vec_id, {n} AS n, round(list_sum(list_transform(range(1, {n} + 1), lambda k: k * list_dot_product(m[k], embedding::DOUBLE[]))), 5) AS moment,
  round(list_dot_product(m[1], embedding::DOUBLE[]), 6) AS first, round(list_dot_product(m[{n}], embedding::DOUBLE[]), 6) AS last FROM embeddings, w"""


def _resample(kernel: str):
    def run(spark, sf_dir, n: int = 24):
        rows = _table(spark, sf_dir, "embeddings").select("vec_id", F.expr("transform(embedding, x -> cast(x AS double))").alias("v"))
        m = F.array(*[F.array(*[F.lit(float(x)) for x in row]) for row in pixels.weights(64, n, kernel)])
        dot = lambda w: F.aggregate(F.zip_with(w, "v", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
        rows = rows.select("vec_id", F.transform(m, dot).alias("r"))
        moment = F.aggregate(F.transform("r", lambda x, k: x * (k + 1)), F.lit(0.0), lambda s, x: s + x)
        return rows.select("vec_id", F.lit(n).alias("n"), F.round(moment, 5).alias("moment"), F.round(F.col("r")[0], 6).alias("first"), F.round(F.element_at("r", -1), 6).alias("last"))

    run.__name__ = f"resample_1d_{kernel.replace('-', '_')}"
    return run


for _kernel in pixels.RADIUS:
    _query(_resample_sql(_kernel, 24))(_resample(_kernel))


def _tiles(spark, sf_dir) -> DataFrame:
    """Embeddings as 8 x 8 grey tiles."""
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    grey = F.transform("embedding", lambda x: F.greatest(F.lit(0), F.least(F.lit(255), F.round((x + 0.6) * 210).cast("int"))))
    image = F.struct(
        F.lit("").alias("origin"), F.lit(8).alias("height"), F.lit(8).alias("width"), F.lit(1).alias("nChannels"), F.lit(0).alias("mode"),
        F.unhex(F.array_join(F.transform(grey, lambda x: F.lpad(F.hex(x.cast("long")), 2, "0")), "")).alias("data"),
    )
    path = F.concat(F.lit("tiles/"), F.col("vec_id"), F.when(F.col("vec_id") % 3 == 0, F.lit("_v7.png")).otherwise(F.lit(".png")))
    headline = F.concat(F.lit("N"), F.col("label"))
    return rows.select(F.col("vec_id").alias("ordinal"), path.alias("path"), C.output_path(path)["path"].alias("output"), headline.alias("headline"), F.lit(None).cast("string").alias("error"), image.alias("image"))


def _image_process(spark, sf_dir) -> DataFrame:
    """Tiles fitted, framed, captioned with their label and encoded; every fifth has a frame that leaves no room."""
    jobs = [process.check(process.Settings(size="96,64", frame=f, color="navy", label=True)) for f in (5, 60)]
    tiles = _tiles(spark, sf_dir)
    return process.render_rows(tiles.filter("ordinal % 5 <> 0"), jobs[0]).unionByName(process.render_rows(tiles.filter("ordinal % 5 = 0"), jobs[1]))


@_query("""SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN 'tiles/' || vec_id || '_v8.jpg' ELSE 'tiles/' || vec_id || '_v0.jpg' END AS output, 8 AS in_w, 8 AS in_h,
  CASE WHEN vec_id % 5 <> 0 THEN 96 END AS out_w, CASE WHEN vec_id % 5 <> 0 THEN 64 END AS out_h, CASE WHEN vec_id % 5 = 0 THEN 'frame too large for output size' END AS error,
  vec_id % 5 <> 0 AS encoded FROM embeddings""")
def image_process(spark, sf_dir):
    """What becomes of each tile: its path, sizes and error."""
    return _image_process(spark, sf_dir).select(F.col("ordinal").alias("vec_id"), "output", "in_w", "in_h", "out_w", "out_h", "error", F.coalesce(F.hex(F.substring("data", 1, 3)) == "FFD8FF", F.lit(False)).alias("encoded"))


def _resize_sql(kernel: str, width: int, height: int) -> str:
    """Both axes by the matrices of the kernel; pixels rounded and held in a byte, summed by place."""
    matrix = lambda n: "[" + ", ".join("[" + ", ".join(f"{float(v)!r}::DOUBLE" for v in row) + "]" for row in pixels.weights(8, n, kernel)) + "]"
    return f"""WITH w AS (SELECT {matrix(width)} AS mx, {matrix(height)} AS my),
g AS (SELECT vec_id, list_transform(embedding, lambda x: greatest(0, least(255, round((x::FLOAT + 0.6::DOUBLE) * 210)::INTEGER))::DOUBLE) AS v FROM embeddings),
rows AS (SELECT vec_id, list_transform(range(1, {height} + 1), lambda r: list_transform(range(1, 9), lambda c: list_dot_product(my[r], [v[c], v[8 + c], v[16 + c], v[24 + c], v[32 + c], v[40 + c], v[48 + c], v[56 + c]]))) AS q FROM g, w),
px AS (SELECT vec_id, flatten(list_transform(q, lambda line: list_transform(range(1, {width} + 1), lambda c: greatest(0, least(255, round_even(list_dot_product(mx[c], line), 0)))::BIGINT))) AS p FROM rows, w)
SELECT vec_id, len(p)::BIGINT AS n, list_sum(p)::BIGINT AS total, list_sum(list_transform(range(1, {width * height} + 1), lambda k: k * p[k]))::BIGINT AS by_place, list_min(p)::BIGINT AS least, list_max(p)::BIGINT AS most FROM px"""


@_query(_resize_sql("lanczos", 13, 11))
def resize_2d(spark, sf_dir):
    """Tiles resized on both axes by the drawing side, each as sums over its pixels."""
    import numpy as np
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            out = []
            for vec_id, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                p = pixels.resize(np.frombuffer(data, np.uint8).reshape(8, 8, 1), 13, 11, "lanczos").astype(np.int64).ravel()
                out.append((vec_id, len(p), int(p.sum()), int((p * np.arange(1, len(p) + 1)).sum()), int(p.min()), int(p.max())))
            columns = list(zip(*out)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["vec_id", "n", "total", "by_place", "least", "most"])

    return _tiles(spark, sf_dir).select("ordinal", "image.data").mapInArrow(run, "vec_id long, n long, total long, by_place long, least long, most long")
