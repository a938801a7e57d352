"""Registered queries of operators.catalog, each with its DuckDB oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import oracle, table
from ..operators import catalog as c

_DISABLED = "$disabled"


def _t(s, d):
    return table(s, d, "tools")


def _cats(s, d):
    return table(s, d, "categories").withColumns({"hidden": F.col("pos") % 4 == 0, "name": F.upper("id")})


_CATS = "(SELECT *, pos % 4 = 0 AS hidden, upper(id) AS name FROM $categories)"
_EFF = "(SELECT t.slug, t.name, t.ord, t.featured, coalesce(nullif(o.category, ''), nullif(t.category, '')) AS category FROM $tools t LEFT JOIN $overrides o USING (slug))"


def _eff(s, d):
    return c.effective_category(_t(s, d), table(s, d, "overrides"))


def _manifests(s, d):
    part = table(s, d, "part")
    slug = F.when(F.col("p_partkey") % 7 == 0, F.concat(F.lit("-bad "), "p_name")).otherwise(F.concat(F.lit(" m-"), (F.col("p_partkey") % 900).cast("string")))
    prefix = F.when(F.col("p_partkey") % 11 == 0, "/x").when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("/tools/"), F.trim(slug)))
    return part.select(slug.alias("slug"), F.lpad(F.col("p_partkey").cast("string"), 9, "0").alias("name"), prefix.alias("prefix"), F.when(F.col("p_size") % 2 == 0, F.col("p_size")).alias("ord"))


def _flag_docs(s, d):
    part = table(s, d, "part").withColumn("slug", F.concat(F.regexp_replace(F.lower("p_name"), " ", "-"), F.lit("-"), F.col("p_partkey").cast("string")))
    return part.filter("p_partkey % 3 = 0").select(F.concat(F.lit('{"disabled":["'), "slug", F.lit('"],"tools":{"'), "slug", F.lit('":"'), F.when(F.col("p_partkey") % 2 == 0, "true").otherwise("off"), F.lit('"}}')).alias("json"))


_SLUG = "concat(replace(lower(p_name), ' ', '-'), '-', CAST(p_partkey AS STRING))"

QUERIES = {
    "c1_validate_manifests": (
        lambda s, d: c.validate_manifests(_manifests(s, d), s.createDataFrame([("m-5",), ("m-6",)], "slug string")).select("slug", "name", "prefix", "ord", "status", F.coalesce("error", F.lit("")).alias("error")),
        """SELECT slug, name, coalesce(nullif(prefix, ''), concat('/tools/', slug)) AS prefix, coalesce(ord, 999) AS ord, CASE WHEN e = '' THEN 'ok' ELSE 'error' END AS status, e AS error FROM (
        SELECT *, CASE WHEN error = '' AND row_number() OVER (PARTITION BY slug, error = '' ORDER BY name) > 1 THEN 'duplicate' ELSE error END AS e FROM (
        SELECT *, CASE WHEN NOT regexp_matches(slug, '^[a-z0-9][a-z0-9-]*$') THEN 'bad_slug' WHEN slug IN ('m-5', 'm-6') THEN 'reserved' WHEN prefix <> '' AND prefix <> concat('/tools/', slug) THEN 'bad_prefix' ELSE '' END AS error FROM (
        SELECT CASE WHEN p_partkey % 7 = 0 THEN trim(concat('-bad ', p_name)) ELSE concat('m-', CAST(p_partkey % 900 AS STRING)) END AS slug, lpad(CAST(p_partkey AS STRING), 9, '0') AS name,
        CASE WHEN p_partkey % 11 = 0 THEN '/x' WHEN p_partkey % 3 = 0 THEN concat('/tools/', slug) END AS prefix, CASE WHEN p_size % 2 = 0 THEN p_size END AS ord FROM part)))""",
    ),
    "c2_effective_category": (lambda s, d: _eff(s, d).select("slug", "category"), f"SELECT slug, category FROM {_EFF}"),
    "c3_parse_flags": (lambda s, d: c.parse_flags(_flag_docs(s, d), _t(s, d).filter("ord % 5 <> 0")), f"SELECT {_SLUG} AS slug FROM part WHERE p_partkey % 3 = 0 AND p_partkey % 2 <> 0 AND p_size % 5 <> 0"),
    "c4_enabled": (lambda s, d: c.enabled(_t(s, d), table(s, d, "disabled"), False).select("slug"), f"SELECT slug FROM $tools WHERE NOT featured AND slug NOT IN (SELECT slug FROM {_DISABLED})"),
    "c5_flag_table": (lambda s, d: c.flag_table(_t(s, d), table(s, d, "disabled")), f"SELECT slug, slug NOT IN (SELECT slug FROM {_DISABLED}) AS enabled FROM $tools"),
    "c5_flags_status": (lambda s, d: c.flags_status(_t(s, d), table(s, d, "disabled")), f"SELECT count(*) FILTER (WHERE slug NOT IN (SELECT slug FROM {_DISABLED})) AS enabled, count(*) AS total, count(*) FILTER (WHERE slug IN (SELECT slug FROM {_DISABLED})) AS disabled FROM $tools"),
    "c6_by_category": (
        lambda s, d: c.by_category(_eff(s, d), _cats(s, d)),
        f"""SELECT coalesce(k.id, '_other') AS id, coalesce(pos, 1073741824) AS pos, CAST(row_number() OVER (PARTITION BY coalesce(k.id, '_other') ORDER BY ord, slug) - 1 AS INT) AS at, slug
        FROM {_EFF} e LEFT JOIN {_CATS} k ON e.category = k.id WHERE NOT coalesce(hidden, false)""",
    ),
    "c7_nav": (lambda s, d: c.nav(_eff(s, d), _cats(s, d)), f"SELECT k.id, k.pos, count(slug) AS tool_count, count(*) FILTER (WHERE featured) AS featured_count FROM {_CATS} k LEFT JOIN {_EFF} e ON e.category = k.id WHERE NOT hidden GROUP BY 1, 2"),
    "c8_flat_catalog": (
        lambda s, d: c.flat_catalog(_t(s, d).filter("not featured or ord % 2 = 0"), _t(s, d).filter("featured").withColumn("name", F.upper("name"))).select("slug", "name"),
        "SELECT slug, CASE WHEN featured AND ord % 2 <> 0 THEN upper(name) ELSE name END AS name FROM $tools",
    ),
    "c9_admin_rows": (
        lambda s, d: c.admin_rows(_eff(s, d), table(s, d, "disabled"), _cats(s, d), _t(s, d).filter("ord % 3 = 0").select("slug", F.lit("loaded").alias("status"))),
        f"""SELECT e.slug, e.name, e.slug NOT IN (SELECT slug FROM {_DISABLED}) AS enabled, coalesce(k.name, e.category) AS category_name, CASE WHEN ord % 3 = 0 THEN 'plugin' ELSE 'builtin' END AS source, CASE WHEN ord % 3 = 0 THEN 'loaded' ELSE '' END AS plugin_status
        FROM {_EFF} e LEFT JOIN {_CATS} k ON e.category = k.id""",
    ),
    "c10_snapshot_counts": (lambda s, d: c.snapshot_counts(_t(s, d)), "SELECT count(*) FILTER (WHERE NOT featured) AS modules, count(*) FILTER (WHERE featured) AS featured, count(*) AS total FROM $tools"),
    "c11_save_categories": (
        lambda s, d: c.save_categories(_t(s, d).select(F.concat(F.substring("slug", 1, 3), F.lit("!"), (F.col("ord") % 5).cast("string")).alias("id"), F.regexp_extract("slug", "([0-9]+)$", 1).cast("int").alias("pos"), F.when(F.col("ord") % 2 == 0, "rose").otherwise("pink").alias("accent")), s.createDataFrame([("for0",)], "id string")),
        """SELECT id, pos, accent FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pos) AS n FROM (SELECT concat(regexp_replace(substr(slug, 1, 3), '[^A-Za-z0-9_-]', '', 'g'), CAST(ord % 5 AS STRING)) AS id,
        CAST(regexp_extract(slug, '([0-9]+)$', 1) AS INT) AS pos, CASE WHEN ord % 2 = 0 THEN 'rose' ELSE 'indigo' END AS accent FROM $tools)) WHERE n = 1 AND id <> 'for0'""",
    ),
    "c11_clean_overrides": (lambda s, d: c.clean_overrides(table(s, d, "overrides"), _cats(s, d)).select("slug", "category"), f"SELECT slug, category FROM $overrides WHERE category IN (SELECT id FROM {_CATS})"),
    "c12_override_diff": (lambda s, d: c.override_diff(table(s, d, "overrides"), _t(s, d), _cats(s, d)), f"SELECT o.slug, o.category FROM $overrides o JOIN $tools t USING (slug) WHERE o.category IN (SELECT id FROM {_CATS}) AND o.category IS DISTINCT FROM t.category"),
    "c13_tool_from_path": (
        lambda s, d: table(s, d, "requests").groupBy(c.tool_from_path(F.col("path")).alias("tool")).agg(F.count(F.lit(1)).alias("n")),
        "SELECT CASE regexp_extract(path, '^/tools/([^/?#]+)', 1) WHEN '' THEN NULL WHEN 'json' THEN 'code-format' ELSE regexp_extract(path, '^/tools/([^/?#]+)', 1) END AS tool, count(*) AS n FROM $requests GROUP BY 1",
    ),
}
QUERIES = {k: (f, sql and oracle(sql)) for k, (f, sql) in QUERIES.items()}
