"""Catalog conformance: manifests, categories, overrides and switches (C1 to C13). First wins by an explicit order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OTHER = "_other"
# Another name of a tool, and the accents of categories.
ALIASES = {"json": "code-format"}
ACCENTS = ["indigo", "emerald", "violet", "amber", "rose", "sky", "slate", "teal", "orange"]


def canonical_slug(slug: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in ALIASES.items() for x in pair)), slug), slug)


def validate_manifests(manifests: DataFrame, reserved: DataFrame) -> DataFrame:
    """Status and error of each manifest in order of name, with defaults filled in; the first of a slug wins."""
    taken = reserved.select(F.col("slug").alias("r")).distinct()
    slug = F.trim(F.coalesce("slug", F.lit("")))
    each = manifests.withColumn("slug", slug).join(taken, F.col("slug") == F.col("r"), "left")
    shaped = F.col("slug").rlike("^[a-z0-9][a-z0-9-]*$")
    prefixed = F.coalesce(F.col("prefix"), F.lit("")).isin("") | (F.col("prefix") == F.concat(F.lit("/tools/"), F.col("slug")))
    error = F.when(~shaped, "bad_slug").when(F.col("r").isNotNull(), "reserved").when(~prefixed, "bad_prefix")
    each = each.withColumn("error", error)
    nth = F.row_number().over(Window.partitionBy("slug", F.col("error").isNull()).orderBy("name", "slug"))
    each = each.withColumn("error", F.when(F.col("error").isNull() & (nth > 1), "duplicate").otherwise(F.col("error")))
    return each.withColumns({"status": F.when(F.col("error").isNull(), "ok").otherwise("error"), "ord": F.coalesce("ord", F.lit(999)), "prefix": F.coalesce(F.nullif("prefix", F.lit("")), F.concat(F.lit("/tools/"), F.col("slug")))}).drop("r")


def effective_category(tools: DataFrame, overrides: DataFrame) -> DataFrame:
    """A tool's override if it isn't empty, else its own category, else null."""
    given = overrides.select(F.col("slug").alias("_s"), F.col("category").alias("_c"))
    return tools.join(given, F.col("slug") == F.col("_s"), "left").withColumn("category", F.coalesce(F.nullif("_c", F.lit("")), F.nullif("category", F.lit("")))).drop("_s", "_c")


def parse_flags(documents: DataFrame, known: DataFrame) -> DataFrame:
    """Disabled slugs of JSON flag documents in either layout; the map of switches is read after the list."""
    shape = "disabled array<string>, tools map<string,string>"
    read = documents.select(F.from_json("json", shape).alias("j"))
    listed = read.select(F.explode("j.disabled").alias("slug")).select("slug", F.lit(1).alias("prio"), F.lit(True).alias("off"))
    mapped = read.select(F.explode("j.tools").alias("slug", "on"))
    on = F.lower(F.trim("on"))
    mapped = mapped.select("slug", F.lit(2).alias("prio"), (~on.isin("1", "true", "yes", "on")).alias("off"))
    all_flags = listed.unionByName(mapped).withColumn("slug", canonical_slug(F.trim("slug"))).filter("slug <> ''")
    last = all_flags.groupBy("slug").agg(F.max_by("off", F.struct("prio", "off")).alias("off"))
    return last.filter("off").select("slug").join(known.select("slug").distinct(), "slug", "left_semi")


def enabled(tools: DataFrame, disabled: DataFrame, include_featured: bool = True) -> DataFrame:
    """C4: tools that aren't switched off, with or without featured ones."""
    left = tools.join(disabled.select("slug").distinct(), "slug", "left_anti")
    return left if include_featured else left.filter(~F.col("featured"))


def flag_table(tools: DataFrame, disabled: DataFrame) -> DataFrame:
    """Each slug with its switch."""
    off = disabled.select(F.col("slug").alias("_s")).distinct()
    return tools.join(off, F.col("slug") == F.col("_s"), "left").select("slug", F.col("_s").isNull().alias("enabled"))


def flags_status(tools: DataFrame, disabled: DataFrame) -> DataFrame:
    """Counts of the switches."""
    return flag_table(tools, disabled).agg(F.count_if("enabled").alias("enabled"), F.count(F.lit(1)).alias("total"), F.count_if(~F.col("enabled")).alias("disabled"))


def by_category(tools: DataFrame, categories: DataFrame) -> DataFrame:
    """(id, pos, at, slug): shown categories with their tools, `at` the place of a tool in its category.

    Tools of an unknown category stand in `_other`, last; empty categories are left out.
    """
    cats = categories.select(F.col("id").alias("_id"), "pos", F.col("hidden"))
    joined = tools.join(cats, F.col("category") == F.col("_id"), "left").filter(~F.coalesce("hidden", F.lit(False)))
    named = joined.select(F.coalesce("_id", F.lit(OTHER)).alias("id"), F.coalesce("pos", F.lit(1 << 30)).alias("pos"), "ord", "slug")
    return named.select("id", "pos", (F.row_number().over(Window.partitionBy("id").orderBy("ord", "slug")) - 1).alias("at"), "slug")


def nav(tools: DataFrame, categories: DataFrame) -> DataFrame:
    """Every shown category, empty ones too, with its number of tools; featured tools count."""
    numbers = tools.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.count_if("featured").alias("f"))
    joined = categories.filter(~F.col("hidden")).join(numbers, F.col("id") == F.col("category"), "left")
    return joined.select("id", "pos", F.coalesce("n", F.lit(0)).alias("tool_count"), F.coalesce("f", F.lit(0)).alias("featured_count"))


def flat_catalog(plain: DataFrame, featured: DataFrame) -> DataFrame:
    """Plain tools, then featured ones; of one slug the first stays, empty slugs go."""
    both = plain.withColumn("_part", F.lit(0)).unionByName(featured.withColumn("_part", F.lit(1))).filter("slug <> ''")
    nth = F.row_number().over(Window.partitionBy("slug").orderBy("_part", "ord", "name"))
    return both.withColumn("_n", nth).filter("_n = 1").drop("_n", "_part")


def admin_rows(tools: DataFrame, disabled: DataFrame, categories: DataFrame, plugins: DataFrame) -> DataFrame:
    """Each tool with its switch, category name and origin; what is missing gets a default."""
    switch = flag_table(tools, disabled).withColumnRenamed("slug", "_s")
    names = categories.select(F.col("id").alias("_c"), F.col("name").alias("category_name"))
    origin = plugins.select(F.col("slug").alias("_p"), F.col("status").alias("plugin_status"))
    joined = tools.join(switch, F.col("slug") == F.col("_s"), "left").join(names, F.col("category") == F.col("_c"), "left").join(origin, F.col("slug") == F.col("_p"), "left")
    return joined.select("slug", "name", F.coalesce("enabled", F.lit(True)).alias("enabled"), F.coalesce("category_name", "category").alias("category_name"), F.when(F.col("_p").isNull(), "builtin").otherwise("plugin").alias("source"), F.coalesce("plugin_status", F.lit("")).alias("plugin_status"))


def snapshot_counts(tools: DataFrame) -> DataFrame:
    """Modules, featured tools, and all."""
    return tools.agg(F.count_if(~F.col("featured")).alias("modules"), F.count_if("featured").alias("featured"), F.count(F.lit(1)).alias("total"))


def save_categories(rows: DataFrame, removed: DataFrame) -> DataFrame:
    """C11: cleaned categories: ids of at most 40 safe characters, known accents, no removed or repeated ones; the first wins."""
    clean = F.substring(F.regexp_replace(F.coalesce("id", F.lit("")), "[^A-Za-z0-9_-]", ""), 1, 40)
    cleaned = rows.withColumn("id", clean).filter(f"id <> '' and id <> '{OTHER}'").join(removed.select("id").distinct(), "id", "left_anti")
    nth = F.row_number().over(Window.partitionBy("id").orderBy("pos"))
    return cleaned.withColumn("_n", nth).filter("_n = 1").drop("_n").withColumn("accent", F.when(F.col("accent").isin(ACCENTS), F.col("accent")).otherwise(ACCENTS[0]))


def clean_overrides(overrides: DataFrame, categories: DataFrame) -> DataFrame:
    """C11: overrides whose category still exists."""
    return overrides.join(categories.select(F.col("id").alias("category")).distinct(), "category", "left_semi")


def override_diff(form: DataFrame, tools: DataFrame, categories: DataFrame) -> DataFrame:
    """Overrides of a form worth keeping: of a known category that differs from the tool's own."""
    own = tools.select(F.col("slug").alias("_s"), F.col("category").alias("_own"))
    return clean_overrides(form, categories).join(own, F.col("slug") == F.col("_s")).filter(~F.col("category").eqNullSafe(F.col("_own"))).select("slug", "category")


def tool_from_path(path: Column) -> Column:
    """The canonical slug of `/tools/<slug>/...`, null for other paths."""
    slug = F.regexp_extract(F.regexp_replace(path, r"[?#].*$", ""), r"^/tools/([^/]+)", 1)
    return canonical_slug(F.nullif(slug, F.lit("")))
