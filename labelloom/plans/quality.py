"""Validation, scores and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelloom.operators import checks, dedup, score, stats
from labelloom.plans.aggregates import COUNTS, LABELS, hashed_images
from labelloom.plans.labels import nodes_of
from labelloom.plans.views import brand_slug, with_views

IMAGE_ISSUES = """image_issues AS (
  SELECT dataset, 'tiny' AS rule, 'warning' AS severity, 'image' AS category, CAST(id AS VARCHAR) AS location,
    CAST(width AS VARCHAR) || 'x' || CAST(height AS VARCHAR) || ' is too small' AS message FROM images WHERE width < 32 OR height < 32
  UNION ALL SELECT dataset, 'oversized', 'warning', 'image', CAST(id AS VARCHAR),
    CAST(width AS VARCHAR) || 'x' || CAST(height AS VARCHAR) || ' is very large' FROM images WHERE width > 10000 OR height > 10000
  UNION ALL SELECT dataset, 'wrong_format', 'warning', 'image', CAST(id AS VARCHAR), 'format ' || format FROM images WHERE lower(format) NOT IN ('jpg', 'jpeg', 'png', 'webp')
  UNION ALL SELECT dataset, 'wrong_color_space', 'warning', 'image', CAST(id AS VARCHAR), 'color space ' || color_space FROM images WHERE lower(color_space) NOT IN ('rgb', 'bgr'))"""

_BOX = "CAST(x AS VARCHAR) || ',' || CAST(y AS VARCHAR) || ' ' || CAST(a.width AS VARCHAR) || 'x' || CAST(a.height AS VARCHAR)"
_ANN = "SELECT a.dataset, '{0}' AS rule, '{1}' AS severity, 'annotation' AS category, CAST(a.id AS VARCHAR) AS location, " + _BOX + " AS message FROM annotations a {2}"
ANNOTATION_ISSUES = "annotation_issues AS (\n" + "\nUNION ALL ".join([
    _ANN.format("negative_coordinates", "error", "WHERE x < 0 OR y < 0"),
    _ANN.format("zero_area", "error", "WHERE a.width <= 0 OR a.height <= 0"),
    _ANN.format("out_of_bounds", "warning", "JOIN images i ON i.id = image_id WHERE x + a.width > i.width OR y + a.height > i.height"),
    _ANN.format("invalid_polygon", "warning", "WHERE geometry_type = 'polygon' AND a.width < 1 AND a.height < 1"),
    _ANN.format("broken_obb", "warning", "WHERE geometry_type = 'obb' AND (a.width <= 0 OR a.height <= 0)"),
    "SELECT dataset, 'missing_annotations', 'warning', 'annotation', CAST(id AS VARCHAR), 'image has no annotations' FROM images WHERE id NOT IN (SELECT image_id FROM annotations)",
]) + ")"

_SIZE = "CAST(width AS VARCHAR) || 'x' || CAST(height AS VARCHAR)"
_GEO = "SELECT dataset, '{0}' AS rule, '{1}' AS severity, 'geometry' AS category, CAST(id AS VARCHAR) AS location, {3} AS message FROM annotations WHERE {2}"
GEOMETRY_ISSUES = "geometry_issues AS (\n" + "\nUNION ALL ".join([
    _GEO.format("invalid_bbox", "error", "geometry_type = 'bbox' AND (width <= 0 OR height <= 0)", _SIZE),
    _GEO.format("invalid_polygon", "warning", "geometry_type = 'polygon' AND (width <= 0 OR height <= 0)", _SIZE),
    _GEO.format("invalid_segmentation", "warning", "geometry_type = 'segmentation' AND (width <= 0 OR height <= 0)", _SIZE),
    _GEO.format("invalid_rotated_box", "warning", "geometry_type = 'obb' AND (width <= 0 OR height <= 0)", _SIZE),
    _GEO.format("negative_pixel", "warning", "x < 0 OR y < 0", "CAST(x AS VARCHAR) || ',' || CAST(y AS VARCHAR)"),
]) + ")"

INTEGRITY = """integrity AS (
  SELECT dataset, missing_files, checksum_mismatches, coalesce(b, 0) AS broken_references,
    (checksum_mismatches = 0)::INT + 1 + (missing_files = 0)::INT + (coalesce(b, 0) = 0)::INT + 1 AS integrity_flags,
    checksum_mismatches = 0 AND missing_files = 0 AND coalesce(b, 0) = 0 AS integrity_passed
  FROM (SELECT dataset, count_if(n IS NULL) AS missing_files, count_if(n IS NOT NULL AND NOT ok) AS checksum_mismatches
    FROM (SELECT i.dataset, i.id, any_value(p.path) AS n, bool_or(coalesce(p.actual = sha256(i.content), false)) AS ok
      FROM images i LEFT JOIN (SELECT path, max(actual) AS actual FROM files GROUP BY 1 UNION SELECT path, min(actual) FROM files GROUP BY 1) p ON p.path = i.file_path
      GROUP BY 1, 2) GROUP BY 1)
  LEFT JOIN (SELECT dataset, count(DISTINCT image_id) AS b FROM annotations WHERE image_id NOT IN (SELECT id FROM images) GROUP BY 1) USING (dataset))"""

CONSISTENCY = """lab AS (SELECT DISTINCT dataset, image_id, label FROM annotations),
ref AS (SELECT dataset, label FROM lab SEMI JOIN (SELECT dataset, min(image_id) AS image_id FROM lab GROUP BY 1) f USING (dataset, image_id)),
near AS (SELECT lab.dataset, image_id, count(*) AS own, count(ref.label) AS common FROM lab LEFT JOIN ref ON ref.dataset = lab.dataset AND ref.label = lab.label GROUP BY 1, 2),
consistency AS (
  SELECT dataset, versions, 0 AS other_split, distant_images,
    (versions <= 1)::INT + 1 + 1 + (distant_images = 0)::INT + 1 AS consistency_flags, true AS consistency_passed
  FROM (SELECT dataset, count(DISTINCT pipeline_version) AS versions FROM images GROUP BY 1)
  JOIN (SELECT near.dataset, count_if(common < least(own, s) * 0.5) AS distant_images FROM near JOIN (SELECT dataset, count(*) AS s FROM ref GROUP BY 1) z USING (dataset) GROUP BY 1) USING (dataset))"""

IMPORTS = """imported AS (SELECT id, image_id, dataset, label, x / 500 AS x1, y / 500 AS y1, (x + width) / 500 AS x2, (y + height - 3) / 500 AS y2 FROM annotations),
known AS (SELECT CASE WHEN max(p_size) = 50 THEN p_brand ELSE p_brand || '?' END AS class_name FROM part GROUP BY p_brand),
there AS (SELECT * FROM images WHERE file_path IN (SELECT path FROM files)),
isum AS (SELECT dataset, count(*) AS images, count_if(file_path NOT IN (SELECT path FROM files)) AS missing_images FROM images GROUP BY 1),
tsum AS (SELECT dataset, count(*) - count(DISTINCT id) AS duplicate_ids, count_if(width <= 0 OR height <= 0) AS invalid_dimensions,
  count_if(id NOT IN (SELECT image_id FROM annotations)) AS empty_annotations FROM there GROUP BY 1),
lsum AS (SELECT dataset, count(*) AS annotations, count_if(label NOT IN (SELECT class_name FROM known)) AS class_mismatches,
  count_if(least(x1, y1, x2, y2) < 0) AS negative_boxes,
  count_if(least(x1, y1, x2, y2) >= 0 AND (x1 > x2 OR y1 > y2 OR x2 > 1 OR y2 > 1)) AS invalid_boxes
  FROM imported WHERE image_id IN (SELECT id FROM there) GROUP BY 1),
imports AS (SELECT dataset, images, missing_images, duplicate_ids, invalid_dimensions, 0 AS unsupported_extensions, empty_annotations,
  annotations, class_mismatches, negative_boxes, invalid_boxes, images + 2 * (images - missing_images) + 2 * annotations + 2 AS total_checks,
  missing_images + duplicate_ids + invalid_dimensions + class_mismatches + negative_boxes + invalid_boxes AS failed_checks
  FROM isum JOIN tsum USING (dataset) JOIN lsum USING (dataset))"""

FILES = """listing AS (SELECT source AS dataset, 'd' || CAST(doc_id % 450 AS VARCHAR) ||
    CASE n_chars % 6 WHEN 0 THEN '.jpg' WHEN 1 THEN '.PNG' WHEN 2 THEN '.txt' WHEN 3 THEN '.json' WHEN 4 THEN '.bin' ELSE '.xml' END || CASE WHEN doc_id >= 450 THEN '' ELSE '' END AS path0,
    doc_id, CASE WHEN n_chars % 23 = 0 THEN '' ELSE text END AS content FROM documents),
fl AS (SELECT dataset, CAST(doc_id AS VARCHAR) || '/' || path0 AS path, content, regexp_replace(path0, '[.][^.]+$', '') AS stem,
  CASE WHEN lower(path0) SIMILAR TO '.*[.](jpg|png)' THEN 'image' WHEN lower(path0) LIKE '%.bin' THEN 'other' ELSE 'label' END AS kind FROM listing),
file_issues AS (SELECT dataset, 'missing_labels' AS rule, path FROM fl l WHERE kind = 'label' AND NOT EXISTS (SELECT 1 FROM fl p WHERE p.kind = 'image' AND p.dataset = l.dataset AND p.stem = l.stem)
  UNION ALL SELECT dataset, 'empty_annotations', path FROM fl WHERE kind = 'label' AND trim(regexp_replace(content, '\\s+', ' ', 'g')) = ''
  UNION ALL SELECT dataset, CASE kind WHEN 'image' THEN 'duplicate_images' ELSE 'duplicate_annotations' END, path FROM fl WHERE kind <> 'other'
    QUALIFY row_number() OVER (PARTITION BY dataset, kind, md5(content) ORDER BY path) > 1
  UNION ALL SELECT dataset, 'corrupted_files', path FROM fl WHERE kind = 'image' AND length(content) = 0
  UNION ALL SELECT dataset, 'unsupported_extensions', path FROM fl WHERE kind = 'other')"""


def listing(v):
    """Documents as files of images and labels."""
    exts = F.array(*map(F.lit, (".jpg", ".PNG", ".txt", ".json", ".bin", ".xml")))
    name = F.concat(F.col("doc_id").cast("string"), F.lit("/d"), (F.col("doc_id") % 450).cast("string"), F.element_at(exts, (F.col("n_chars") % 6 + 1).cast("int")))
    return v.table("documents").select(
        F.col("source").alias("dataset"), name.alias("path"),
        F.when(F.col("n_chars") % 23 == 0, "").otherwise(F.col("text")).alias("content"),
    )


def imports(v):
    x, y = F.col("x"), F.col("y")
    boxes = v.annotations.select(
        "id", "image_id", "dataset", "label", (x / 500).alias("x1"), (y / 500).alias("y1"),
        ((x + F.col("width")) / 500).alias("x2"), ((y + F.col("height") - 3) / 500).alias("y2"),
    )
    largest = v.table("part").groupBy("p_brand").agg(F.max("p_size").alias("s"))
    known = largest.select(F.when(F.col("s") == 50, F.col("p_brand")).otherwise(F.concat("p_brand", F.lit("?"))).alias("class_name"))
    return checks.import_validation(v.images, boxes, v.files, known)


def settings(v):
    """A training setting per order line."""
    pick = lambda values, c: F.element_at(F.array(*map(F.lit, values)), (c % len(values) + 1).cast("int"))
    c = F.col
    return v.table("lineitem").select(
        c("l_returnflag").alias("dataset"),
        F.concat_ws("-", *[c(n).cast("string") for n in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]).alias("config_id"),
        F.when(c("l_partkey") % 50 == 0, "").otherwise("m").alias("model_name"),
        (c("l_quantity") * 13 - 20).alias("batch_size"),
        (c("l_partkey") - 5).alias("epochs"),
        (c("l_discount") * 12 - 0.12).alias("learning_rate"),
        pick(("adam", "sgd", "lion"), c("l_suppkey")).alias("optimizer"),
        pick(("cosine", "step", "warmup"), c("l_partkey")).alias("scheduler"),
        pick(("cpu", "cuda", "tpu"), c("l_orderkey")).alias("device"),
        (c("l_linenumber") - 1).alias("validation_interval"),
        c("l_linenumber").alias("save_interval"),
        (c("l_suppkey") * 150).alias("image_width"),
        (c("l_partkey") * 10).alias("image_height"),
        (c("l_tax") - 0.01).alias("weight_decay"),
        (c("l_orderkey") - 3).alias("seed"),
        (c("l_linenumber") - 2).alias("early_stopping_patience"),
    )


def register(r) -> None:
    @r.add("v01_image_checks", with_views("images", more=IMAGE_ISSUES) + "SELECT * FROM image_issues")
    def _(v):
        return checks.image_issues(v.images)

    @r.add("v02_annotation_checks", with_views("images", "annotations", more=ANNOTATION_ISSUES) + "SELECT * FROM annotation_issues")
    def _(v):
        return checks.annotation_issues(v.annotations, v.images)

    @r.add("v03_geometry_checks", with_views("annotations", more=GEOMETRY_ISSUES) + """
SELECT dataset, (SELECT count(*) FROM annotations a WHERE a.dataset = g.dataset) AS geometries,
  count_if(rule = 'invalid_bbox') AS invalid_bbox, count_if(rule = 'invalid_polygon') AS invalid_polygon, count_if(rule = 'invalid_segmentation') AS invalid_segmentation,
  count_if(rule = 'invalid_rotated_box') AS invalid_rotated_box, count_if(rule = 'negative_pixel') AS negative_pixel, count_if(severity = 'error') = 0 AS passed
FROM geometry_issues g GROUP BY 1""")
    def _(v):
        return checks.geometry_summary(v.annotations)

    @r.add("v03_geometry_issues", with_views("annotations", more=GEOMETRY_ISSUES) + "SELECT * FROM geometry_issues")
    def _(v):
        return checks.geometry_issues(v.annotations)

    @r.add("v04_import_validation", with_views("images", "files", "annotations", more=IMPORTS) + "SELECT *, failed_checks = 0 AS passed FROM imports")
    def _(v):
        return imports(v)

    @r.add("v05_conversion_validation", with_views("images", "annotations", "ontology_values", more=COUNTS) + """
, i AS (SELECT dataset, count(*) AS images, 0 AS without_path, count(*) - count(DISTINCT id) AS duplicate_image_ids FROM images GROUP BY 1),
a AS (SELECT dataset, count(*) AS annotations, count_if(width <= 0 OR height <= 0) AS invalid_geometry, count(*) - count(DISTINCT id) AS duplicate_annotation_ids FROM annotations GROUP BY 1),
o AS (SELECT dataset, count(DISTINCT image_id) AS orphan_images FROM annotations WHERE image_id NOT IN (SELECT id FROM images) GROUP BY 1),
u AS (SELECT dataset, count(*) AS unknown_labels FROM counts WHERE class_name NOT IN (SELECT value FROM ontology_values) GROUP BY 1),
j AS (SELECT dataset, images, without_path, duplicate_image_ids, annotations, invalid_geometry, duplicate_annotation_ids, coalesce(orphan_images, 0) AS orphan_images,
  coalesce(unknown_labels, 0) AS unknown_labels FROM i JOIN a USING (dataset) LEFT JOIN o USING (dataset) LEFT JOIN u USING (dataset)),
g AS (SELECT *, 3 + (invalid_geometry = 0)::INT + (duplicate_image_ids = 0)::INT + (duplicate_annotation_ids = 0)::INT + (orphan_images = 0)::INT AS good FROM j)
SELECT * EXCLUDE (good), good + 3 AS passed_checks, 7 - good AS failed_checks, good = 7 AS valid FROM g""")
    def _(v):
        return checks.conversion_validation(v.images, v.annotations, v.ontology_values)

    @r.add("v06_sanity", with_views("images", "annotations") + """
SELECT dataset, images, annotations, true AS has_images, true AS has_annotations, ri AS repeats_image_ids, ra AS repeats_annotation_ids,
  coalesce(b, 0) AS broken_references, coalesce(b, 0) = 0 AS references_valid
FROM (SELECT dataset, count(*) AS images, count(DISTINCT id) < count(*) AS ri FROM images GROUP BY 1)
JOIN (SELECT dataset, count(*) AS annotations, count(DISTINCT id) < count(*) AS ra FROM annotations GROUP BY 1) USING (dataset)
LEFT JOIN (SELECT dataset, count(*) AS b FROM annotations WHERE image_id NOT IN (SELECT id FROM images) GROUP BY 1) USING (dataset)""")
    def _(v):
        return checks.sanity(v.images, v.annotations)

    @r.add("v07_managed_files", with_views(more=FILES) + "SELECT dataset, rule, path FROM file_issues")
    def _(v):
        return checks.managed_file_issues(listing(v))

    @r.add("v08_file_errors", with_views("images", "files") + """
, t AS (SELECT *, file_path IN (SELECT path FROM files) AS there FROM images),
e AS (SELECT dataset, id, 'not_found' AS rule, 'no file ' || file_path AS message FROM t WHERE NOT there
  UNION ALL SELECT dataset, id, 'too_wide', 'width ' || CAST(width AS VARCHAR) FROM t WHERE there AND width > 10000
  UNION ALL SELECT dataset, id, 'too_high', 'height ' || CAST(height AS VARCHAR) FROM t WHERE there AND height > 10000)
SELECT dataset, rule, 'error' AS severity, 'image' AS category, CAST(id AS VARCHAR) AS location, message FROM e""")
    def _(v):
        return checks.file_errors(v.images, v.files)

    fields = """f AS (SELECT doc_id, lang AS doc_type, 'source' AS field, source AS value FROM documents
  UNION ALL SELECT doc_id, lang, 'title', CASE WHEN n_chars % 7 = 0 THEN '  ' WHEN n_chars % 7 = 1 THEN NULL ELSE text END FROM documents)"""

    def doc_fields(v):
        title = F.when(F.col("n_chars") % 7 == 0, "  ").when(F.col("n_chars") % 7 != 1, F.col("text"))
        return checks.long_fields(v.table("documents").withColumn("title", title), "doc_id", F.col("lang"), ["source", "title"])

    @r.add("v09_required_fields", with_views(more=fields) + """
, need AS (SELECT DISTINCT lang AS doc_type, CASE WHEN lang IN ('en', 'fr') THEN 'title' ELSE 'source' END AS field FROM documents)
SELECT DISTINCT f.doc_id, f.doc_type, need.field FROM f JOIN need USING (doc_type)
WHERE NOT EXISTS (SELECT 1 FROM f g WHERE g.doc_id = f.doc_id AND g.field = need.field AND trim(g.value) <> '')""")
    def _(v):
        need = v.table("documents").select(F.col("lang").alias("doc_type"), F.when(F.col("lang").isin("en", "fr"), "title").otherwise("source").alias("field")).distinct()
        return checks.missing_fields(doc_fields(v), need)

    @r.add("v10_field_types", """
WITH e AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '{"k": "' || event_type || '", "n": 1.5}' ELSE props END AS j FROM events),
t AS (SELECT event_id, 'k' AS field, 'str' AS expected, json_type(j, '$.k') AS t FROM e UNION ALL SELECT event_id, 'n', 'int', json_type(j, '$.n') FROM e),
n AS (SELECT event_id, field, expected, CASE t WHEN 'VARCHAR' THEN 'str' WHEN 'UBIGINT' THEN 'int' WHEN 'BIGINT' THEN 'int' WHEN 'DOUBLE' THEN 'float' END AS found FROM t)
SELECT event_id, field, expected, found FROM n WHERE found <> expected""")
    def _(v):
        other = F.concat(F.lit('{"k": "'), F.col("event_type"), F.lit('", "n": 1.5}'))
        rows = v.table("events").select("event_id", F.when(F.col("event_id") % 3 == 0, other).otherwise(F.col("props")).alias("props"))
        return checks.field_types(rows, "event_id", "props", {"k": "str", "n": "int"})

    @r.add("v11_repeated_documents", """
SELECT 'error' AS severity, 'document_id' AS rule, conv_id, turn FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY conv_id, turn) > 1
UNION ALL SELECT 'warning', 'name_category', conv_id, turn FROM conversations WHERE text <> '' AND role <> ''
QUALIFY row_number() OVER (PARTITION BY text, role ORDER BY conv_id, turn) > 1""")
    def _(v):
        return checks.repeated_documents(v.table("conversations"), "conv_id", "text", "role", ["conv_id", "turn"])

    @r.add("v12_long_strings", "SELECT doc_id, 'text' AS field, length(text) AS characters FROM documents WHERE length(text) > 5000")
    def _(v):
        return checks.long_strings(checks.long_fields(v.table("documents"), "doc_id", F.col("lang"), ["text", "source"]))

    @r.add("v13_mixed_versions", with_views("mapping_rules") + """
SELECT match_type AS doc_type, count(DISTINCT version) AS versions FROM mapping_rules GROUP BY 1 HAVING count(DISTINCT version) > 1""")
    def _(v):
        return checks.mixed_versions(v.mapping_rules, "match_type", "version")

    odd_rules = """odd AS (SELECT CASE WHEN rule_id % 40 = 0 THEN NULL ELSE rule_id // 2 END AS rule_id, dataset_name, CASE WHEN rule_id % 9 = 0 THEN ' ' ELSE source_label END AS source_label,
  canonical_value, confidence * 1.02 AS confidence FROM mapping_rules)"""

    @r.add("v14_rule_issues", with_views("mapping_rules", more=odd_rules) + """
SELECT 'empty_rule_id' AS rule, NULL AS location FROM odd WHERE rule_id IS NULL UNION ALL SELECT 'empty_source_label', CAST(rule_id AS VARCHAR) FROM odd WHERE trim(source_label) = ''
UNION ALL SELECT 'confidence_range', CAST(rule_id AS VARCHAR) FROM odd WHERE confidence > 1
UNION ALL SELECT 'duplicate_rule_id', CAST(rule_id AS VARCHAR) FROM odd QUALIFY row_number() OVER (PARTITION BY rule_id) > 1""")
    def _(v):
        rid = F.col("rule_id")
        odd = v.mapping_rules.select(
            F.when(rid % 40 != 0, F.floor(rid / 2)).alias("rule_id"), "dataset_name",
            F.when(rid % 9 == 0, " ").otherwise(F.col("source_label")).alias("source_label"), "canonical_value", (F.col("confidence") * 1.02).alias("confidence"),
        )
        return checks.rule_issues(odd)

    @r.add("v15_mapping_issues", with_views("ontology_values", "nodes", "mapping_rules") + """
SELECT 'unknown_value' AS rule, rule_id, canonical_value AS detail FROM mapping_rules WHERE canonical_value NOT IN (SELECT value FROM nodes)
UNION ALL SELECT * FROM (SELECT 'two_values' AS rule, rule_id, first_value(canonical_value) OVER w AS detail FROM mapping_rules
  WINDOW w AS (PARTITION BY dataset_name, lower(source_label) ORDER BY created_at) QUALIFY canonical_value <> detail)""")
    def _(v):
        return checks.mapping_issues(v.mapping_rules, nodes_of(v))

    tree = """bad AS (SELECT canonical_value AS value, split_part(canonical_value, '.', 1) AS parent, 2 AS depth, true AS is_leaf FROM mapping_rules
  UNION ALL SELECT DISTINCT split_part(value, '.', 1), CASE WHEN value LIKE 'p%' THEN 'top' ELSE 'root' END, 1, false FROM ontology_values)"""

    @r.add("v16_ontology_issues", with_views("ontology_values", "mapping_rules", more=tree) + """
SELECT 'missing_parent' AS rule, value FROM bad WHERE is_leaf AND parent NOT IN (SELECT value FROM bad)
UNION ALL SELECT 'category_not_under_root', value FROM bad WHERE depth = 1 AND parent <> 'root'
UNION ALL SELECT 'duplicate_value', value FROM bad WHERE is_leaf GROUP BY value HAVING count(*) > 1
UNION ALL SELECT 'missing_root', 'root' WHERE NOT EXISTS (SELECT 1 FROM bad WHERE value = 'root')""")
    def _(v):
        first = lambda c: F.split_part(c, F.lit("."), F.lit(1))
        leaf = v.mapping_rules.select(F.col("canonical_value").alias("value"), first("canonical_value").alias("parent"), F.lit(2).alias("depth"), F.lit(True).alias("is_leaf"))
        top = v.ontology_values.select(first("value"), F.when(F.col("value").startswith("p"), "top").otherwise("root"), F.lit(1), F.lit(False)).distinct()
        return checks.ontology_issues(leaf.union(top))

    @r.add("v17_integrity", with_views("images", "files", "annotations", more=INTEGRITY) + "SELECT * FROM integrity")
    def _(v):
        return checks.integrity(hashed_images(v), v.annotations, v.files, "1.0.0", "1.0.0")

    @r.add("v18_consistency", with_views("images", "annotations", more=CONSISTENCY) + "SELECT * FROM consistency")
    def _(v):
        return checks.consistency(v.images, v.annotations, "1.0.0", "1.0.0")

    @r.add("v19_verify_checksums", """
SELECT a.doc_id AS path, b.doc_id IS NULL AS is_missing, coalesce(sha256(b.text) = sha256(CASE WHEN a.n_chars % 9 = 0 THEN a.text || ' ' ELSE a.text END), false) AS matches
FROM documents a LEFT JOIN (SELECT CASE WHEN lang = 'de' THEN -1 - doc_id ELSE doc_id END AS doc_id, text FROM documents) b USING (doc_id)""")
    def _(v):
        docs = v.table("documents")
        changed = F.when(F.col("n_chars") % 9 == 0, F.concat("text", F.lit(" "))).otherwise(F.col("text"))
        manifest = docs.select(F.col("doc_id").alias("path"), F.sha2(changed, 256).alias("expected"))
        moved = F.when(F.col("lang") == "de", -1 - F.col("doc_id")).otherwise(F.col("doc_id"))
        return checks.verify_checksums(manifest, docs.select(moved.alias("path"), F.sha2("text", 256).alias("actual")))

    @r.add("v20_ready_datasets", """
SELECT user_id AS dataset, arg_max(value, (ts, event_id)) AS overall, arg_max(event_type = 'purchase', (ts, event_id)) AS production_ready, count(*) AS reports FROM events GROUP BY 1""")
    def _(v):
        reports = v.table("events").select(
            F.col("user_id").alias("dataset"), "ts", "event_id", F.col("value").alias("overall"), (F.col("event_type") == "purchase").alias("production_ready")
        )
        return checks.ready_datasets(reports, ["ts", "event_id"])

    cfg = """cfg AS (SELECT l_returnflag AS dataset, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS location,
  l_partkey % 50 = 0 AS no_model, l_quantity * 13 - 20 AS batch, l_partkey - 5 AS epochs, l_discount * 12 - 0.12::DOUBLE AS lr, l_suppkey % 3 = 2 AS opt, l_partkey % 3 = 2 AS sch,
  l_orderkey % 3 = 2 AS dev, l_linenumber AS ln, l_suppkey * 150 AS w, l_partkey * 10 AS h, l_tax - 0.01::DOUBLE AS wd, l_orderkey AS seed FROM lineitem)"""
    rule = "SELECT dataset, '{}' AS rule, '{}' AS severity, 'config' AS category, location, '{}' AS message FROM cfg WHERE {}"
    @r.add("v21_config_issues", with_views(more=cfg) + " UNION ALL ".join(rule.format(*x) for x in [
        ("model_name", "error", "required", "no_model"), ("batch_size", "error", "below 1", "batch < 1"), ("batch_size", "warning", "above 512", "batch > 512"),
        ("epochs", "error", "below 1", "epochs < 1"), ("epochs", "warning", "above 1000", "epochs > 1000"),
        ("learning_rate", "error", "not positive", "lr <= 0"), ("learning_rate", "warning", "above 1", "lr > 1"),
        ("optimizer", "warning", "not a standard one", "opt"), ("scheduler", "warning", "not a standard one", "sch"), ("device", "warning", "not recognized", "dev"),
        ("validation_interval", "error", "below 1", "ln < 2"), ("save_interval", "error", "below 1", "ln < 1"),
        ("image_size", "error", "below 32", "w < 32 OR h < 32"), ("image_size", "warning", "above 10000", "NOT (w < 32 OR h < 32) AND (w > 10000 OR h > 10000)"),
        ("weight_decay", "error", "negative", "wd < 0"), ("seed", "error", "negative", "seed < 3"), ("early_stopping_patience", "warning", "disables early stopping", "ln < 3"),
    ]))
    def _(v):
        return checks.config_issues(settings(v))

    @r.add("a23_issue_rollup", with_views("images", "annotations", more=IMAGE_ISSUES + ",\n" + ANNOTATION_ISSUES + ",\n" + GEOMETRY_ISSUES) + """
, al AS (SELECT * FROM image_issues UNION ALL SELECT * FROM annotation_issues UNION ALL SELECT * FROM geometry_issues),
c AS (SELECT dataset, count_if(severity = 'error') AS errors, count_if(severity = 'warning') AS warnings, count_if(severity = 'info') AS infos FROM al GROUP BY 1),
e AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY rule, location, message) AS rank FROM al WHERE severity = 'error'),
f AS (SELECT dataset, string_agg(rule || '@' || location, '; ' ORDER BY rank) AS first_errors FROM e WHERE rank <= 3 GROUP BY 1)
SELECT dataset, errors, warnings, infos, coalesce(first_errors, '') AS first_errors FROM c LEFT JOIN f USING (dataset)""")
    def _(v):
        found = checks.image_issues(v.images).unionByName(checks.annotation_issues(v.annotations, v.images)).unionByName(checks.geometry_issues(v.annotations))
        return checks.rollup(found)

    @r.add("q01_import_score", with_views("images", "files", "annotations", more=COUNTS + ",\n" + IMPORTS) + """
, d AS (SELECT dataset, count(DISTINCT id) AS n FROM (SELECT dataset, id FROM images QUALIFY row_number() OVER (PARTITION BY dataset, sha256(content) ORDER BY id) > 1) GROUP BY 1),
k AS (SELECT dataset, CASE WHEN count(*) > 1 THEN max(n) / min(n) ELSE 0 END AS ratio, count(*) AS classes FROM counts GROUP BY 1),
o AS (SELECT dataset, count(ontology_class) / count(*) AS cov FROM annotations GROUP BY 1),
s AS (SELECT dataset, round(coalesce(n, 0) / images, 6) AS dup, greatest(0, 1 - round(coalesce(n, 0) / images, 6) / 0.15) AS a, greatest(0, 1 - round(ratio, 6) / 10) AS b,
  greatest(0, 1 - (missing_images + empty_annotations) / images) AS c, greatest(0, 1 - (invalid_boxes + negative_boxes) / annotations) AS e,
  least(1, round(cov, 6) / 0.5) AS f, images, annotations, classes FROM imports LEFT JOIN d USING (dataset) JOIN k USING (dataset) JOIN o USING (dataset)),
t AS (SELECT *, (a + b + c + e + f) / 5 AS q, (dup > 0.15)::INT + (images < 10)::INT + (annotations < 10)::INT + (classes < 1)::INT AS errors FROM s)
SELECT dataset, round(a, 6) AS duplicate_score, round(b, 6) AS imbalance_score, round(c, 6) AS missing_score, round(e, 6) AS consistency_score,
  round(f, 6) AS coverage_score, round(q, 6) AS quality_score, errors, q >= 0.6 AND errors = 0 AS passed FROM t""")
    def _(v):
        counts = stats.class_counts(v.annotations)
        totals = v.images.groupBy("dataset").agg(F.count("*").alias("_i"))
        copied = dedup.by_checksum(hashed_images(v)).groupBy("dataset").agg(F.count_distinct("duplicate_id").alias("_d"))
        ratio = totals.join(copied, "dataset", "left").select("dataset", F.round(F.coalesce("_d", F.lit(0)) / F.col("_i"), 6).alias("duplicate_ratio"))
        return score.import_score(
            imports(v), ratio, stats.imbalance(counts).select("dataset", "import_ratio"),
            stats.ontology_coverage(v.annotations).select("dataset", "coverage"),
            counts.groupBy("dataset").agg(F.count("*").alias("classes")),
        )

    card = """, ic AS (SELECT dataset, count(*) AS images, count_if(width < 32 OR height < 32) + count_if(width > 10000 OR height > 10000) + count_if(format = 'bmp') + count_if(color_space = 'grayscale') AS warn FROM images GROUP BY 1),
ac AS (SELECT a.dataset, count(*) AS n, count_if(x < 0 OR y < 0) AS neg, count_if(a.width <= 0 OR a.height <= 0) AS zero, count_if(x + a.width > i.width OR y + a.height > i.height) AS oob,
  count_if(geometry_type = 'polygon' AND a.width < 1 AND a.height < 1) AS poly, count_if(geometry_type = 'obb' AND (a.width <= 0 OR a.height <= 0)) AS obb,
  count_if(geometry_type = 'bbox' AND (a.width <= 0 OR a.height <= 0)) AS bbox, count_if(geometry_type = 'segmentation' AND (a.width <= 0 OR a.height <= 0)) AS seg
  FROM annotations a LEFT JOIN images i ON i.id = image_id GROUP BY 1),
mc AS (SELECT dataset, count(*) AS missing FROM images WHERE id NOT IN (SELECT image_id FROM annotations) GROUP BY 1),
tot AS (SELECT dataset, class_name, n, sum(n) OVER (PARTITION BY dataset) AS t FROM counts),
cc AS (SELECT dataset, count(*) AS classes, count_if(class_name IN (SELECT value FROM ontology_values)) AS known, count_if(n < greatest(t * 0.01, 5)) AS rare,
  CASE WHEN count(*) > 1 THEN max(n) / min(n) ELSE 1 END AS ratio FROM tot GROUP BY 1),
rp AS (SELECT dataset, count(*) AS rep FROM (SELECT dataset, id FROM (SELECT dataset, id FROM images UNION ALL SELECT dataset, id FROM annotations) GROUP BY 1, 2 HAVING count(*) > 1) GROUP BY 1),
al AS (SELECT *, n + greatest(0, coalesce(missing, 0) - 1) AS total FROM ic JOIN ac USING (dataset) LEFT JOIN mc USING (dataset) JOIN cc USING (dataset) LEFT JOIN rp USING (dataset)
  JOIN integrity USING (dataset) JOIN consistency USING (dataset)),
s AS (SELECT dataset, greatest(0, least(100, 100 - warn / images * 25)) AS i, greatest(0, least(100, 100 - (neg + zero + obb) / total * 100 - (oob + poly + coalesce(missing, 0)) / total * 20)) AS a,
  greatest(0, least(100, 100 - (bbox + seg) / n * 100)) AS g, known / (SELECT count(*) FROM ontology_values) * 100 AS c,
  greatest(0, least(100, 100 - CASE WHEN ratio > 1 THEN least(50, (ratio - 1) * 5) ELSE 0 END - rare / classes * 50)) AS b, integrity_flags / 5 * 100 AS t, consistency_flags / 5 * 100 AS k,
  neg + zero = 0 AND bbox = 0 AND known = classes AND coalesce(rep, 0) = 0 AND integrity_passed AND consistency_passed AS clean FROM al),
o AS (SELECT *, i * 0.1 + a * 0.25 + g * 0.15 + c * 0.15 + b * 0.1 + t * 0.15 + k * 0.1 AS overall FROM s)
"""
    @r.add("q02_scorecard", with_views("images", "files", "annotations", "ontology_values", more=COUNTS + ",\n" + INTEGRITY + ",\n" + CONSISTENCY) + card + """
SELECT dataset, round(i, 1) AS image_score, round(a, 1) AS annotation_score, round(g, 1) AS geometry_score, round(c, 1) AS coverage_score, round(b, 1) AS balance_score,
  round(t, 1) AS integrity_score, round(k, 1) AS consistency_score, round(overall, 1) AS overall,
  CASE WHEN overall >= 90 THEN 'A' WHEN overall >= 75 THEN 'B' WHEN overall >= 60 THEN 'C' WHEN overall >= 40 THEN 'D' ELSE 'F' END AS grade,
  overall >= 75 AND clean AS production_ready FROM o""")
    def _(v):
        return score.scorecard(hashed_images(v), v.annotations, v.ontology_values, v.files)

    @r.add("q03_managed_score", with_views(more=FILES) + """
, c AS (SELECT dataset, count(*) AS images, count_if(EXISTS (SELECT 1 FROM fl l WHERE l.kind = 'label' AND l.dataset = p.dataset AND l.stem = p.stem)) / count(*) AS completeness FROM fl p WHERE kind = 'image' GROUP BY 1),
b AS (SELECT dataset, max(n) / min(n) AS ratio FROM (SELECT source AS dataset, lang, count(*) AS n FROM documents GROUP BY 1, 2) GROUP BY 1),
i AS (SELECT dataset, count_if(rule = 'missing_labels') AS missing_labels, count_if(rule LIKE 'duplicate%') AS dup, count(DISTINCT rule) AS failed FROM file_issues GROUP BY 1),
s AS (SELECT dataset, coalesce(dup, 0) / images * 100 AS pct, coalesce(missing_labels, 0) AS missing_labels, (12 - coalesce(failed, 0)) / 12 AS v, images, round(completeness, 6) AS completeness, round(ratio, 6) AS ratio
  FROM c JOIN b USING (dataset) LEFT JOIN i USING (dataset))
SELECT dataset, round(pct, 4) AS duplicate_percentage, missing_labels, round(v, 4) AS validation_score,
  round(greatest(0, least(1, 0.25 * completeness + 0.15 * least(1, 1 / ratio) + 0.1 + 0.15 * greatest(0, 1 - pct / 100) + 0.1 * greatest(0, 1 - missing_labels / images) + 0.25 * v)), 4) AS quality_score FROM s""")
    def _(v):
        files = listing(v)
        stems = files.select("dataset", F.regexp_extract("path", r"/(d\d+)\.", 1).alias("stem"), F.lower(F.regexp_extract("path", r"\.(\w+)$", 1)).alias("ext"))
        labels = stems.where("ext IN ('txt', 'json', 'xml')").select("dataset", "stem", F.lit(1).alias("hit")).distinct()
        pics = stems.where("ext IN ('jpg', 'png')").join(labels, ["dataset", "stem"], "left").groupBy("dataset").agg(
            F.count("*").alias("images"), F.round(F.count("hit") / F.count("*"), 6).alias("completeness")
        )
        langs = v.table("documents").groupBy(F.col("source").alias("dataset"), "lang").agg(F.count("*").alias("n"))
        balance = langs.groupBy("dataset").agg(F.round(F.max("n") / F.min("n"), 6).alias("imbalance_ratio"))
        return score.managed_score(pics.join(balance, "dataset"), checks.managed_file_issues(files))
