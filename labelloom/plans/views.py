"""The driver tables seen as the engine's relations.

The driver has no image tables, so each relation is a projection of a whole driver
table, written with integer arithmetic that any SQL engine reproduces. ``SQL`` holds
the same definitions as common table expressions for the oracle.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def dataset_of(image_id: Column) -> Column:
    """Five data sets, the first with nearly half of the images."""
    return F.when(image_id % 3 == 0, "ds0").otherwise(F.concat(F.lit("ds"), (image_id % 5).cast("string")))


def brand_slug(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_")


class Views:
    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark = spark
        self.sf_dir = sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def images(self) -> DataFrame:
        key, cust = F.col("o_orderkey"), F.col("o_custkey")
        fmt = F.element_at(F.array(*map(F.lit, ("jpg", "png", "webp", "bmp"))), (key % 4 + 1).cast("int"))
        return self.table("orders").select(
            key.alias("id"),
            dataset_of(key).alias("dataset"),
            F.concat(
                dataset_of(key), F.lit("/"), F.lower("o_orderstatus"), F.lit("_"), cust.cast("string"), F.lit("."), fmt
            ).alias("file_path"),
            (cust * 37 % 12000).alias("width"),
            (cust * 53 % 12000).alias("height"),
            fmt.alias("format"),
            F.when(key % 10 == 0, "grayscale").otherwise("rgb").alias("color_space"),
            F.floor(F.col("o_totalprice")).cast("long").alias("file_size_bytes"),
            F.concat(F.col("o_orderpriority"), F.lit(":"), cust.cast("string")).alias("content"),
            F.concat(F.lit("1."), (cust % 2).cast("string"), F.lit(".0")).alias("pipeline_version"),
        )

    @cached_property
    def files(self) -> DataFrame:
        """What a file listing would show: some files renamed, some with other content."""
        cust = F.substring_index("content", ":", -1).cast("long")
        return self.images.select(
            F.when((cust % 25 == 0) & (F.col("format") == "bmp"), F.concat("file_path", F.lit(".old")))
            .otherwise(F.col("file_path"))
            .alias("path"),
            F.sha2(F.when(cust % 60 == 7, F.concat("content", F.lit("!"))).otherwise(F.col("content")), 256).alias("actual"),
        ).distinct()

    @cached_property
    def annotations(self) -> DataFrame:
        line, part = self.table("lineitem"), self.table("part")
        order, lineno = F.col("l_orderkey"), F.col("l_linenumber")
        image = order + 20 * lineno
        kinds = F.array(*map(F.lit, ("bbox", "polygon", "obb", "segmentation")))
        return line.join(part, line.l_partkey == part.p_partkey).select(
            (order * 10 + lineno).alias("id"),
            image.alias("image_id"),
            dataset_of(image).alias("dataset"),
            F.col("p_brand").alias("label"),
            F.when(F.col("p_size") <= 40, F.concat(F.lower("p_type"), F.lit("."), brand_slug(F.col("p_brand")))).alias(
                "ontology_class"
            ),
            F.element_at(kinds, lineno % 4 + 1).alias("geometry_type"),
            (F.col("l_partkey") % 900 - 20).cast("double").alias("x"),
            (F.col("l_suppkey") % 90 - 5).cast("double").alias("y"),
            (F.col("l_quantity") - 1).alias("width"),
            (F.col("l_suppkey") % 40).cast("double").alias("height"),
            (F.col("l_discount") * 100).cast("int").cast("double").alias("score_percent"),
            F.col("l_partkey").alias("seq1"),
            F.col("l_suppkey").alias("seq2"),
            F.floor("l_extendedprice").cast("long").alias("seq3"),
        )

    @cached_property
    def mapping_rules(self) -> DataFrame:
        size = F.col("p_size")
        kinds = F.array(*map(F.lit, ("exact", "alias", "synonym", "case_insensitive")))
        root = F.when(size <= 40, F.lower("p_type")).otherwise("unlisted")
        return self.table("part").select(
            F.col("p_partkey").alias("rule_id"),
            F.col("p_type").alias("dataset_name"),
            F.col("p_name").alias("source_label"),
            F.concat(root, F.lit("."), brand_slug(F.col("p_brand"))).alias("canonical_value"),
            F.element_at(kinds, size % 4 + 1).alias("match_type"),
            (F.col("p_partkey") % 100 / 100).alias("confidence"),
            F.col("p_partkey").alias("created_at"),
            F.concat(F.lit("1."), (size % 12).cast("string"), F.lit("."), (size % 25).cast("string")).alias("version"),
        )

    @cached_property
    def ontology_values(self) -> DataFrame:
        """Dotted values of the label ontology: type, then brand."""
        return (
            self.table("part")
            .select(F.concat(F.lower("p_type"), F.lit("."), brand_slug(F.col("p_brand"))).alias("value"))
            .distinct()
        )

    @cached_property
    def raw_labels(self) -> DataFrame:
        """Labels as they come: right, in capitals, plural, misspelt, of a type or a brand."""
        name, size = F.col("p_name"), F.col("p_size")
        forms = F.array(
            name, F.upper(name), F.concat(name, F.lit("s")), F.concat(name, F.lit("x")), F.concat(name, F.lit("q")),
            F.col("p_type"), F.replace("p_brand", F.lit("#"), F.lit(" ")), F.concat(F.lit("zz "), F.col("p_brand")),
        )
        return self.table("part").select(F.element_at(forms, size % 8 + 1).alias("label")).distinct()

    @cached_property
    def alias_table(self) -> DataFrame:
        kind = F.when(F.col("p_size") <= 25, "alias").otherwise("synonym")
        return (
            self.table("part").select(
                F.concat(F.lower("p_type"), F.lit("."), brand_slug(F.col("p_brand"))).alias("canonical_value"),
                F.lower(F.concat("p_name", F.lit("x"))).alias("alias"),
                kind.alias("kind"),
            )
            .distinct()
        )

    @cached_property
    def pattern_table(self) -> DataFrame:
        """One pattern per first word of the names."""
        return (
            self.table("part")
            .groupBy(F.split_part("p_name", F.lit(" "), F.lit(1)).alias("_w"))
            .agg(F.min(F.concat(F.lower("p_type"), F.lit("."), brand_slug(F.col("p_brand")))).alias("canonical_value"))
            .select(F.concat(F.lit("^"), F.col("_w"), F.lit(" .*Q$")).alias("pattern"), "canonical_value", F.lit(0.7).alias("confidence"))
        )

    @cached_property
    def concepts(self) -> DataFrame:
        """Names under their noun, nouns under one top concept."""
        part = self.table("part")
        noun = F.split_part("p_name", F.lit(" "), F.lit(2))
        none = F.array().cast("array<string>")
        names = part.groupBy("p_name").agg(F.min("p_size").alias("s")).select(
            F.replace("p_name", F.lit(" "), F.lit("_")).alias("canonical_name"),
            F.array(F.concat("p_name", F.lit("-x")), F.upper("p_name")).alias("aliases"),
            noun.alias("parent_category"),
            F.array(F.concat(F.split_part("p_name", F.lit(" "), F.lit(1)), F.lit("_thing"))).alias("equivalents"),
            ((F.col("s") % 7 + 4) / 10).alias("confidence_base"),
        )
        nouns = part.select(noun.alias("n")).distinct().select(
            "n", F.array(F.concat("n", F.lit("s"))), F.lit("goods"), none, F.lit(0.5)
        )
        top = part.groupBy().agg(F.lit("goods").alias("n")).select("n", none, F.lit(None).cast("string"), none, F.lit(0.4))
        return names.union(nouns).union(top)

    @cached_property
    def entries(self) -> DataFrame:
        """One catalog entry per part name."""
        kinds = F.array(*map(F.lit, ("cc0", "cc_by_4", "cc_by_sa_4", "cc_nc", "mit", "apache_2", "odbl", "pddl", "proprietary", "unknown")))
        n = F.count(F.lit(1))
        return (
            self.table("part").groupBy(F.col("p_name").alias("entry_id"))
            .agg(
                F.sum("p_size").alias("images"),
                F.count_if(F.col("p_size") > 45).alias("missing"),
                F.count_if(F.col("p_size") % 17 == 0).alias("corrupt"),
                (F.count_if(F.col("p_type") != "ECONOMY") / n).alias("format_consistency"),
                F.element_at(kinds, (n % 10 + 1).cast("int")).alias("license_id"),
                F.when(n % 3 == 0, 0.0).otherwise(0.75).alias("license_score"),
                (F.min("p_partkey") % 10 / 10).alias("source_reliability"),
                (F.sum("p_size") / 4).alias("storage_mb"),
                (F.min("p_partkey") % 15).alias("source_id"),
            )
            .withColumn("domain", F.concat(F.lit("area"), (F.length("entry_id") % 5).cast("string")))
        )

    @cached_property
    def class_profiles(self) -> DataFrame:
        """Classes of each entry with their counts."""
        return self.table("part").groupBy(F.col("p_name").alias("entry_id"), brand_slug(F.col("p_brand")).alias("class_name")).agg(
            F.count(F.lit(1)).alias("n")
        )

    @cached_property
    def actions(self) -> DataFrame:
        """Events as curation actions."""
        kind = F.col("event_type")
        action = (
            F.when(kind == "signup", "create").when(kind == "purchase", "approve").when(kind == "error", "reject").otherwise("submit")
        )
        return self.table("events").select(
            F.col("user_id").alias("entry_id"), "ts", "event_id", F.date_trunc("hour", "ts").alias("hour"), action.alias("action")
        )

    @cached_property
    def taxonomy(self) -> DataFrame:
        """Region, nation and supplier as a three-level tree."""
        region, nation, supplier = self.table("region"), self.table("nation"), self.table("supplier")
        key = F.col("s_suppkey")
        top = region.select(
            F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("node_id"),
            F.col("r_name").alias("name"),
            F.lit(None).cast("string").alias("parent_id"),
            F.col("r_regionkey").cast("long").alias("region_key"),
            F.col("r_regionkey").cast("long").alias("node_key"),
        )
        middle = nation.select(
            F.concat(F.lit("n"), F.col("n_nationkey").cast("string")),
            F.col("n_name"),
            F.concat(F.lit("r"), F.col("n_regionkey").cast("string")),
            F.col("n_regionkey").cast("long"),
            F.col("n_nationkey").cast("long"),
        )
        leaves = supplier.join(nation, supplier.s_nationkey == nation.n_nationkey).select(
            F.concat(F.lit("s"), key.cast("string")),
            F.concat(F.lit("brand_"), (key % 40).cast("string")),
            F.concat(F.lit("n"), F.col("n_nationkey").cast("string")),
            F.col("n_regionkey").cast("long"),
            key,
        )
        return (
            top.union(middle)
            .union(leaves)
            .select(
                "node_id",
                "name",
                "parent_id",
                F.concat(F.lit("domain"), F.col("region_key").cast("string")).alias("domain"),
                ((10 - F.col("node_key") % 10) / 10).alias("priority"),
                F.array(F.lower("name"), F.concat(F.lit("brand_"), (F.col("node_key") % 37).cast("string"))).alias(
                    "keywords"
                ),
                F.array(F.concat(F.lit("Alias-"), F.col("node_key").cast("string"))).alias("aliases"),
            )
        )

    @cached_property
    def metrics(self) -> DataFrame:
        """Events as training metrics; an hour is a bucket for ordered scans."""
        return self.table("events").select(
            F.col("user_id").alias("experiment_id"),
            F.col("ts"),
            F.col("event_id"),
            F.date_trunc("hour", "ts").alias("hour"),
            F.col("value"),
            F.col("event_type"),
        )

    @cached_property
    def documents(self) -> DataFrame:
        return self.table("documents").select(
            "doc_id", F.col("text").alias("body"), F.col("lang").alias("category"), F.col("source").alias("origin"), "n_chars"
        )


_DATASET = "CASE WHEN {0} % 3 = 0 THEN 'ds0' ELSE 'ds' || CAST({0} % 5 AS VARCHAR) END"
_FORMAT = "CASE o_orderkey % 4 WHEN 0 THEN 'jpg' WHEN 1 THEN 'png' WHEN 2 THEN 'webp' ELSE 'bmp' END"
_SLUG = "regexp_replace(lower(p_brand), '[^a-z0-9]+', '_', 'g')"

SQL = {
    "images": f"""images AS (
  SELECT o_orderkey AS id, {_DATASET.format('o_orderkey')} AS dataset,
    {_DATASET.format('o_orderkey')} || '/' || lower(o_orderstatus) || '_' || CAST(o_custkey AS VARCHAR) || '.' || {_FORMAT} AS file_path,
    (o_custkey * 37) % 12000 AS width, (o_custkey * 53) % 12000 AS height, {_FORMAT} AS format,
    CASE WHEN o_orderkey % 10 = 0 THEN 'grayscale' ELSE 'rgb' END AS color_space,
    CAST(floor(o_totalprice) AS BIGINT) AS file_size_bytes,
    o_orderpriority || ':' || CAST(o_custkey AS VARCHAR) AS content,
    '1.' || CAST(o_custkey % 2 AS VARCHAR) || '.0' AS pipeline_version
  FROM orders)""",
    "files": """files AS (
  SELECT DISTINCT CASE WHEN cust % 25 = 0 AND format = 'bmp' THEN file_path || '.old' ELSE file_path END AS path,
    sha256(CASE WHEN cust % 60 = 7 THEN content || '!' ELSE content END) AS actual
  FROM (SELECT *, CAST(split_part(content, ':', 2) AS BIGINT) AS cust FROM images))""",
    "annotations": f"""annotations AS (
  SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey + 20 * l_linenumber AS image_id,
    {_DATASET.format('(l_orderkey + 20 * l_linenumber)')} AS dataset, p_brand AS label,
    CASE WHEN p_size <= 40 THEN lower(p_type) || '.' || {_SLUG} END AS ontology_class,
    CASE l_linenumber % 4 WHEN 0 THEN 'bbox' WHEN 1 THEN 'polygon' WHEN 2 THEN 'obb' ELSE 'segmentation' END AS geometry_type,
    CAST(l_partkey % 900 - 20 AS DOUBLE) AS x, CAST(l_suppkey % 90 - 5 AS DOUBLE) AS y,
    l_quantity - 1 AS width, CAST(l_suppkey % 40 AS DOUBLE) AS height,
    CAST(trunc(l_discount * 100) AS DOUBLE) AS score_percent, l_partkey AS seq1, l_suppkey AS seq2,
    CAST(floor(l_extendedprice) AS BIGINT) AS seq3
  FROM lineitem JOIN part ON l_partkey = p_partkey)""",
    "mapping_rules": f"""mapping_rules AS (
  SELECT p_partkey AS rule_id, p_type AS dataset_name, p_name AS source_label,
    CASE WHEN p_size <= 40 THEN lower(p_type) ELSE 'unlisted' END || '.' || {_SLUG} AS canonical_value,
    CASE p_size % 4 WHEN 0 THEN 'exact' WHEN 1 THEN 'alias' WHEN 2 THEN 'synonym' ELSE 'case_insensitive' END AS match_type,
    (p_partkey % 100) / 100.0 AS confidence, p_partkey AS created_at,
    '1.' || CAST(p_size % 12 AS VARCHAR) || '.' || CAST(p_size % 25 AS VARCHAR) AS version
  FROM part)""",
    "ontology_values": f"""ontology_values AS (
  SELECT DISTINCT lower(p_type) || '.' || {_SLUG} AS value FROM part)""",
    "raw_labels": """raw_labels AS (
  SELECT DISTINCT CASE p_size % 8 WHEN 0 THEN p_name WHEN 1 THEN upper(p_name) WHEN 2 THEN p_name || 's' WHEN 3 THEN p_name || 'x'
    WHEN 4 THEN p_name || 'q' WHEN 5 THEN p_type WHEN 6 THEN replace(p_brand, '#', ' ') ELSE 'zz ' || p_brand END AS label FROM part)""",
    "alias_table": f"""alias_table AS (
  SELECT DISTINCT lower(p_type) || '.' || {_SLUG} AS canonical_value, lower(p_name || 'x') AS alias,
    CASE WHEN p_size <= 25 THEN 'alias' ELSE 'synonym' END AS kind FROM part)""",
    "pattern_table": f"""pattern_table AS (
  SELECT '^' || split_part(p_name, ' ', 1) || ' .*Q$' AS pattern, min(lower(p_type) || '.' || {_SLUG}) AS canonical_value, 0.7 AS confidence
  FROM part GROUP BY split_part(p_name, ' ', 1))""",
    "concepts": """concepts AS (
  SELECT replace(p_name, ' ', '_') AS canonical_name, [p_name || '-x', upper(p_name)] AS aliases, split_part(p_name, ' ', 2) AS parent_category,
    [split_part(p_name, ' ', 1) || '_thing'] AS equivalents, (min(p_size) % 7 + 4) / 10.0 AS confidence_base FROM part GROUP BY p_name
  UNION ALL SELECT DISTINCT split_part(p_name, ' ', 2), [split_part(p_name, ' ', 2) || 's'], 'goods', CAST([] AS VARCHAR[]), 0.5 FROM part
  UNION ALL SELECT 'goods', CAST([] AS VARCHAR[]), NULL, CAST([] AS VARCHAR[]), 0.4)""",
    "nodes": """prefixes AS (
  SELECT value, 2 AS depth, split_part(value, '.', 1) AS parent FROM ontology_values
  UNION ALL SELECT DISTINCT split_part(value, '.', 1), 1, 'root' FROM ontology_values),
nodes AS (
  SELECT value, upper(split_part(value, '.', -1)[1]) || replace(split_part(value, '.', -1)[2:], '_', ' ') AS name,
    split_part(value, '.', 1) AS category, parent, depth, depth = 2 AS is_leaf FROM prefixes
  UNION ALL SELECT 'root', 'Root', 'root', NULL, 0, false)""",
    "entries": """entries AS (
  SELECT p_name AS entry_id, CAST(sum(p_size) AS BIGINT) AS images, count_if(p_size > 45) AS missing, count_if(p_size % 17 = 0) AS corrupt,
    count_if(p_type <> 'ECONOMY') / count(*) AS format_consistency,
    list_extract(['cc0', 'cc_by_4', 'cc_by_sa_4', 'cc_nc', 'mit', 'apache_2', 'odbl', 'pddl', 'proprietary', 'unknown'], CAST(count(*) % 10 + 1 AS INT)) AS license_id,
    CASE WHEN count(*) % 3 = 0 THEN 0.0 ELSE 0.75 END AS license_score, (min(p_partkey) % 10) / 10.0 AS source_reliability,
    sum(p_size) / 4 AS storage_mb, min(p_partkey) % 15 AS source_id, 'area' || CAST(length(p_name) % 5 AS VARCHAR) AS domain
  FROM part GROUP BY p_name)""",
    "class_profiles": f"""class_profiles AS (
  SELECT p_name AS entry_id, {_SLUG} AS class_name, count(*) AS n FROM part GROUP BY 1, 2)""",
    "actions": """actions AS (
  SELECT user_id AS entry_id, ts, event_id, CASE event_type WHEN 'signup' THEN 'create' WHEN 'purchase' THEN 'approve' WHEN 'error' THEN 'reject' ELSE 'submit' END AS action FROM events)""",
    "taxonomy": """taxonomy AS (
  SELECT node_id, name, parent_id, 'domain' || CAST(region_key AS VARCHAR) AS domain,
    (10 - node_key % 10) / 10.0 AS priority,
    [lower(name), 'brand_' || CAST(node_key % 37 AS VARCHAR)] AS keywords,
    ['Alias-' || CAST(node_key AS VARCHAR)] AS aliases
  FROM (
    SELECT 'r' || CAST(r_regionkey AS VARCHAR) AS node_id, r_name AS name, CAST(NULL AS VARCHAR) AS parent_id,
      r_regionkey AS region_key, CAST(r_regionkey AS BIGINT) AS node_key FROM region
    UNION ALL
    SELECT 'n' || CAST(n_nationkey AS VARCHAR), n_name, 'r' || CAST(n_regionkey AS VARCHAR), n_regionkey, n_nationkey FROM nation
    UNION ALL
    SELECT 's' || CAST(s_suppkey AS VARCHAR), 'brand_' || CAST(s_suppkey % 40 AS VARCHAR), 'n' || CAST(n_nationkey AS VARCHAR),
      n_regionkey, s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey))""",
    "metrics": """metrics AS (
  SELECT user_id AS experiment_id, ts, event_id, value, event_type FROM events)""",
    "docs": """docs AS (
  SELECT doc_id, text AS body, lang AS category, source AS origin, n_chars FROM documents)""",
}


def with_views(*names: str, more: str = "") -> str:
    """``WITH`` clause of the named relations, and of further expressions in ``more``."""
    parts = [SQL[n] for n in names]
    if more:
        parts.append(more.strip())
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n"
