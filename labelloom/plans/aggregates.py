"""Statistics, duplicates and outliers over images and annotations."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelloom.operators import dedup, outliers, stats
from labelloom.plans.views import with_views

CLASS_NAME = r"""coalesce(nullif(ontology_class, ''), nullif(trim(regexp_replace(regexp_replace(lower(label), '[^a-z0-9_ ]+', '', 'g'), '[_ ]+', '_', 'g'), '_'), ''), label)"""
LABELS = f"labels_ AS (SELECT *, {CLASS_NAME} AS class_name FROM annotations)"
COUNTS = LABELS + ", counts AS (SELECT dataset, class_name, count(*) AS n FROM labels_ GROUP BY 1, 2)"
META = "sha256(pipeline_version || '|' || format || '|' || color_space)"


def hashed_images(v):
    """Images with a content hash and a metadata map."""
    entries = [F.lit("format"), F.col("format"), F.lit("color_space"), F.col("color_space"), F.lit("version"), F.col("pipeline_version")]
    return v.images.withColumn("sha256", F.sha2("content", 256)).withColumn("metadata", F.create_map(*entries))


def register(r) -> None:
    @r.add("a01_class_distribution", with_views("annotations", more=COUNTS) + """
SELECT dataset, class_name, n, round(n / sum(n) OVER (PARTITION BY dataset), 6) AS share FROM counts""")
    def _(v):
        return stats.class_distribution(v.annotations)

    @r.add("a02_dataset_totals", with_views("images", "annotations", more=COUNTS) + """
, a AS (SELECT dataset, CAST(sum(n) AS BIGINT) AS annotations, count(*) AS classes FROM counts GROUP BY 1),
i AS (SELECT dataset, count(*) AS images, avg(CASE WHEN width > 0 AND height > 0 THEN width END) AS w,
  avg(CASE WHEN width > 0 AND height > 0 THEN height END) AS h FROM images GROUP BY 1)
SELECT dataset, images, annotations, classes, round(annotations / images, 6) AS objects_per_image,
  round(w, 6) AS avg_width, round(h, 6) AS avg_height FROM i FULL JOIN a USING (dataset)""")
    def _(v):
        return stats.dataset_totals(v.images, v.annotations)

    @r.add("a03_resolution_histogram", with_views("images") + """
SELECT dataset, CAST(width AS VARCHAR) || 'x' || CAST(height AS VARCHAR) AS resolution, count(*) AS n FROM images
WHERE width > 0 AND height > 0 GROUP BY 1, 2""")
    def _(v):
        return stats.resolution_histogram(v.images)

    @r.add("a04_box_histograms", with_views("annotations") + """
, m AS (SELECT dataset, 'width' AS measure, width AS value FROM annotations UNION ALL SELECT dataset, 'height', height FROM annotations
  UNION ALL SELECT dataset, 'aspect', CASE WHEN height > 0 THEN width / height ELSE 0 END FROM annotations)
SELECT dataset, measure, round(value, 2) AS value, count(*) AS n FROM m GROUP BY 1, 2, 3""")
    def _(v):
        return stats.box_histograms(v.annotations)

    @r.add("a05_imbalance_ratio", with_views("annotations", more=COUNTS) + """
SELECT dataset, round(CASE WHEN count(*) > 1 THEN max(n) / min(n) ELSE 0 END, 6) AS import_ratio,
  round(CASE WHEN count(*) > 1 THEN max(n) / min(n) ELSE 1 END, 6) AS quality_ratio, round(max(n) / min(n), 6) AS managed_ratio
FROM counts GROUP BY 1""")
    def _(v):
        return stats.imbalance(stats.class_counts(v.annotations))

    @r.add("a06_diversity", with_views("annotations", more=COUNTS) + """
, p AS (SELECT dataset, n / sum(n) OVER (PARTITION BY dataset) AS p FROM counts)
SELECT dataset, round(-sum(p * log2(p)) / log2(count(*)), 6) AS diversity FROM p GROUP BY 1""")
    def _(v):
        return stats.diversity(stats.class_counts(v.annotations))

    @r.add("a07_ontology_coverage", with_views("annotations") + """
SELECT dataset, count(*) AS annotations, count(nullif(ontology_class, '')) AS mapped,
  round(count(nullif(ontology_class, '')) / count(*), 6) AS coverage FROM annotations GROUP BY 1""")
    def _(v):
        return stats.ontology_coverage(v.annotations)

    @r.add("a08_conversion_statistics", with_views("images", "annotations") + """
, per AS (SELECT dataset, image_id, count(*) AS n FROM annotations GROUP BY 1, 2),
p AS (SELECT dataset, count(*) AS images_with, min(n) AS min_per_image, max(n) AS max_per_image FROM per GROUP BY 1),
a AS (SELECT dataset, count(*) AS annotations, avg(width) AS w, avg(height) AS h FROM annotations GROUP BY 1),
i AS (SELECT dataset, count(*) AS images FROM images GROUP BY 1)
SELECT dataset, images, annotations, images_with, images - images_with AS images_without, min_per_image, max_per_image,
  round(annotations / images, 6) AS avg_per_image, round(w, 6) AS avg_box_width, round(h, 6) AS avg_box_height,
  round(images_with / images * 100, 6) AS coverage_percent FROM i JOIN p USING (dataset) JOIN a USING (dataset)""")
    def _(v):
        return stats.conversion_statistics(v.images, v.annotations)

    @r.add("a09_managed_statistics", with_views("images", "annotations", more=COUNTS) + """
, s AS (SELECT dataset, n, n / sum(n) OVER (PARTITION BY dataset) AS share FROM counts),
c AS (SELECT dataset, CAST(sum(n) AS BIGINT) AS annotations, count(*) AS classes, max(n) / min(n) AS ratio, 1 - stddev_samp(share) AS even FROM s GROUP BY 1),
i AS (SELECT dataset, count(*) AS images, count_if(id IN (SELECT image_id FROM annotations)) AS annotated FROM images GROUP BY 1)
SELECT dataset, images, annotations, classes, round(ratio, 6) AS imbalance_ratio, round(annotated / images, 6) AS completeness,
  round(even, 6) AS coverage_score FROM i JOIN c USING (dataset)""")
    def _(v):
        return stats.managed_statistics(v.images, v.annotations)

    @r.add("a10_class_validation", with_views("annotations", "ontology_values", more=LABELS) + """
, c AS (SELECT class_name, count(*) AS n FROM labels_ GROUP BY 1)
SELECT coalesce(class_name, value) AS class_name, coalesce(n, 0) AS n, value IS NULL AS is_unknown, n IS NULL AS is_unused,
  n IS NOT NULL AND n < (SELECT greatest(sum(n) * 0.01, 5) FROM c) AS is_rare FROM c FULL JOIN ontology_values ON class_name = value""")
    def _(v):
        return stats.class_validation(v.annotations, v.ontology_values)

    @r.add("a11_imbalance_classes", with_views("annotations", more=COUNTS) + """
, t AS (SELECT *, sum(n) OVER w AS total, max(n) OVER w AS top, count(*) OVER w AS k FROM counts WINDOW w AS (PARTITION BY dataset)),
f AS (SELECT *, k > 1 AND (n < 5 OR n <= total * 0.01) AS is_minority FROM t)
SELECT dataset, class_name, n, round(n / total, 4) AS proportion, k > 1 AND n >= top * 0.5 AS is_majority, is_minority,
  CASE WHEN is_minority THEN greatest(n * 3, 10) END AS target FROM f""")
    def _(v):
        return stats.imbalance_classes(v.annotations)

    @r.add("a11_long_tail", with_views("annotations", more=COUNTS) + """
, t AS (SELECT dataset, n, row_number() OVER (PARTITION BY dataset ORDER BY n DESC, class_name) AS rn,
  count(*) OVER (PARTITION BY dataset) AS k FROM counts)
SELECT dataset, greatest(1, max(k) // 3) AS top_classes,
  round(sum(CASE WHEN rn <= greatest(1, k // 3) THEN n ELSE 0 END) / sum(n), 6) AS long_tail_ratio FROM t GROUP BY 1""")
    def _(v):
        return stats.long_tail(stats.class_counts(v.annotations))

    @r.add("a12_coverage", with_views("images", "annotations", "ontology_values", more=COUNTS) + """
, c AS (SELECT dataset, count(*) AS classes, sum(n) AS annotations, count_if(class_name IN (SELECT value FROM ontology_values)) AS covered FROM counts GROUP BY 1),
a AS (SELECT dataset, count(DISTINCT image_id) AS annotated FROM annotations GROUP BY 1),
i AS (SELECT dataset, count(*) AS images, count(DISTINCT split_part(split_part(file_path, '/', -1), '_', 1)) AS scenes FROM images GROUP BY 1),
m AS (SELECT dataset, covered AS covered_classes, covered / (SELECT count(*) FROM ontology_values) * 100 AS o, annotated / images * 100 AS p,
  least(1.0, scenes / images) AS s, least(1.0, annotations / classes / 100) AS b FROM i JOIN a USING (dataset) JOIN c USING (dataset))
SELECT dataset, covered_classes, round(o, 6) AS ontology_percent, round(p, 6) AS image_percent, round(s, 6) AS scene_diversity,
  round(b, 6) AS object_diversity, round(o * 0.4 + p * 0.3 + s * 15 + b * 15, 6) AS completeness_percent FROM m""")
    def _(v):
        return stats.coverage(v.images, v.annotations, v.ontology_values)

    @r.add("a12_label_coverage", """
SELECT source, lang, count(*) AS documents, count(l.doc_id) AS labelled, round(count(l.doc_id) / count(*), 6) AS coverage
FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1, 2""")
    def _(v):
        labelled = v.table("labels").select("doc_id", F.lit(1).alias("hit"))
        return (
            v.table("documents").select("doc_id", "source", "lang").join(labelled, "doc_id", "left")
            .groupBy("source", "lang")
            .agg(F.count("*").alias("documents"), F.count("hit").alias("labelled"))
            .withColumn("coverage", F.round(F.col("labelled") / F.col("documents"), 6))
        )

    @r.add("a13_class_profile", with_views("annotations", more=LABELS) + """
SELECT dataset, class_name, count(*) AS annotations, count(DISTINCT image_id) AS images, round(avg(width), 6) AS avg_width,
  round(avg(height), 6) AS avg_height FROM labels_ GROUP BY 1, 2""")
    def _(v):
        return stats.class_profile(v.annotations)

    @r.add("a14_image_profile", with_views("images") + """
SELECT dataset, count(*) AS images, round(avg(width), 6) AS avg_width, round(avg(height), 6) AS avg_height,
  count_if(width >= 1920 AND height >= 1080) AS high_resolution,
  count_if(NOT (width >= 1920 AND height >= 1080) AND width >= 640 AND height >= 480) AS medium_resolution,
  count_if(NOT (width >= 640 AND height >= 480)) AS low_resolution, round(sum(file_size_bytes) / (1024 * 1024), 6) AS size_mb,
  count_if(file_size_bytes = 0) AS corrupt, count_if(file_path LIKE '%.bmp') AS unsupported_files FROM images GROUP BY 1""")
    def _(v):
        return stats.image_profile(v.images)

    @r.add("a22_compare_profiles", with_views("annotations", more=COUNTS) + """
SELECT class_name, count(*) AS datasets, CAST(sum(n) AS BIGINT) AS annotations,
  count(*) = (SELECT count(DISTINCT dataset) FROM annotations) AS is_common FROM counts GROUP BY 1""")
    def _(v):
        return stats.compare_profiles(v.annotations)

    @r.add("a24_provenance_rollup", with_views("annotations", more=LABELS) + """
SELECT dataset, label AS original_class, class_name, count(*) AS annotations FROM labels_ GROUP BY 1, 2, 3""")
    def _(v):
        return stats.provenance_rollup(v.annotations)

    @r.add("a25_stage_summary", """
WITH s AS (SELECT user_id AS run_id, CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'skipped' ELSE 'completed' END AS status,
  value FROM events)
SELECT run_id, count_if(status = 'completed') AS completed, count_if(status = 'failed') AS failed, count_if(status = 'skipped') AS skipped,
  round(sum(value), 4) AS seconds, count_if(status = 'failed') = 0 AS succeeded FROM s GROUP BY 1""")
    def _(v):
        kind = F.col("event_type")
        status = F.when(kind == "error", "failed").when(kind == "signup", "skipped").otherwise("completed")
        return stats.stage_summary(
            v.table("events").select(F.col("user_id").alias("run_id"), status.alias("status"), F.col("value").alias("seconds"))
        )

    @r.add("w11_sorted_distribution", with_views("annotations", more=COUNTS) + """
SELECT dataset, class_name, n FROM counts ORDER BY dataset, n DESC, class_name""")
    def _(v):
        return stats.class_counts(v.annotations).orderBy("dataset", F.desc("n"), "class_name")

    # Duplicates -----------------------------------------------------------------
    def links(kind: str, key: str, id_col: str, order: str, source: str) -> str:
        return f"""SELECT dataset, '{kind}' AS kind, first_value({id_col}) OVER w AS original_id, {id_col} AS duplicate_id FROM {source}
  WINDOW w AS (PARTITION BY {key} ORDER BY {order}) QUALIFY row_number() OVER w > 1"""

    file_sql = links("filename", "dataset, split_part(file_path, '/', -1)", "id", "id", "images")
    hash_sql = links("hash", "dataset, sha256(content)", "id", "id", "images")
    meta_sql = links("metadata", f"dataset, {META}", "id", "id", "images")
    ann_sql = links("annotation", "dataset, image_id, class_name, x, y, width, height", "image_id", "id, seq1, seq2, seq3", "labels_")
    obj_sql = links("object", "dataset, class_name, x, y, width, height", "image_id", "image_id, id, seq1, seq2, seq3", "labels_")

    @r.add("d01_duplicate_file_names", with_views("images") + file_sql)
    def _(v):
        return dedup.by_file_name(v.images)

    @r.add("d02_duplicate_checksums", with_views("images") + hash_sql)
    def _(v):
        return dedup.by_checksum(hashed_images(v))

    @r.add("d03_duplicate_metadata", with_views("images") + meta_sql)
    def _(v):
        return dedup.by_metadata(hashed_images(v))

    # Every fifth annotation stands on its image twice.
    twice_sql = "doubled AS (SELECT * FROM annotations UNION ALL SELECT * REPLACE (seq3 + 1 AS seq3) FROM annotations WHERE id % 5 = 0)"

    def doubled(v):
        return v.annotations.unionByName(v.annotations.where("id % 5 = 0").withColumn("seq3", F.col("seq3") + 1))

    @r.add("d04_duplicate_annotations", with_views("annotations", more=twice_sql + ",\n" + LABELS.replace("FROM annotations", "FROM doubled")) + ann_sql)
    def _(v):
        return dedup.annotations_in_image(doubled(v))

    @r.add("d05_duplicate_objects", with_views("annotations", more=LABELS) + obj_sql)
    def _(v):
        return dedup.objects_across_images(v.annotations)

    @r.add("d06_duplicate_report", with_views("images", "annotations", more=LABELS) + f"""
, l AS ({file_sql} UNION ALL {hash_sql} UNION ALL {meta_sql} UNION ALL {ann_sql} UNION ALL {obj_sql}),
f AS (SELECT dataset, count(*) AS links, count(DISTINCT CASE WHEN kind IN ('filename', 'hash', 'metadata') THEN duplicate_id END) AS di,
  count(DISTINCT CASE WHEN kind IN ('annotation', 'object') THEN duplicate_id END) AS da FROM l GROUP BY 1),
t AS (SELECT dataset, count(*) AS images FROM images GROUP BY 1)
SELECT dataset, coalesce(links, 0) AS links, coalesce(di, 0) AS duplicate_images, coalesce(da, 0) AS duplicate_annotations,
  round(coalesce(di, 0) / images, 6) AS duplicate_ratio FROM t LEFT JOIN f USING (dataset)""")
    def _(v):
        return dedup.report(hashed_images(v), v.annotations)

    @r.add("d07_same_content", """
SELECT first_value(doc_id) OVER w AS original_id, doc_id AS duplicate_id, sha256(text) AS hash FROM documents
WINDOW w AS (PARTITION BY sha256(text) ORDER BY doc_id) QUALIFY row_number() OVER w > 1""")
    def _(v):
        return dedup.same_content(v.table("documents"), F.col("text"), "doc_id")

    @r.add("d08_near_duplicate_images", with_views("images") + """
, g AS (SELECT width, height, format, count(*) AS members, min(id) AS first_id FROM images GROUP BY 1, 2, 3),
p AS (SELECT a.width, a.height, a.format, count(*) AS pairs FROM images a JOIN images b
  ON a.width = b.width AND a.height = b.height AND a.format = b.format AND a.id < b.id AND a.file_path <> b.file_path GROUP BY 1, 2, 3)
SELECT first_id AS group_id, id AS member_id, members, pairs FROM images JOIN g USING (width, height, format) JOIN p USING (width, height, format)
WHERE id <> first_id""")
    def _(v):
        return dedup.near_duplicates(v.images)

    @r.add("j12_same_size_groups", with_views("images") + """
, p AS (SELECT a.width, a.height, a.format, count(*) AS pairs FROM images a JOIN images b
  ON a.width = b.width AND a.height = b.height AND a.format = b.format AND a.id < b.id AND a.file_path <> b.file_path GROUP BY 1, 2, 3)
SELECT width, height, format, count(*) AS members, min(id) AS first_id, any_value(pairs) AS pairs FROM images JOIN p USING (width, height, format) GROUP BY 1, 2, 3""")
    def _(v):
        return dedup.same_size_groups(v.images)

    @r.add("d09_annotation_signatures", with_views("annotations", more=twice_sql) + """
SELECT first_value(id) OVER w AS original_id, id AS duplicate_id, image_id FROM doubled
WINDOW w AS (PARTITION BY image_id, x, y, width, height, label ORDER BY id, seq1, seq2, seq3) QUALIFY row_number() OVER w > 1""")
    def _(v):
        return dedup.annotation_signatures(doubled(v))

    @r.add("d10_repeated_ids", with_views("images", "annotations") + """
SELECT id, count(*) AS uses FROM (SELECT id FROM images UNION ALL SELECT id FROM annotations) GROUP BY id HAVING count(*) > 1""")
    def _(v):
        return dedup.repeated_ids(v.images, v.annotations)

    @r.add("d11_same_bytes", """
SELECT doc_id AS duplicate_path FROM documents QUALIFY row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) > 1""")
    def _(v):
        return dedup.same_bytes(v.table("documents"), F.col("text"), "doc_id")

    # Outliers -------------------------------------------------------------------
    @r.add("u01_resolution_outliers", """
WITH i AS (SELECT o_orderpriority AS dataset, o_orderkey AS id, CAST(exp(o_totalprice / 60000) AS BIGINT) AS width, o_custkey AS height FROM orders),
s AS (SELECT dataset, avg(width) AS mw, stddev_samp(width) AS sw, avg(height) AS mh, stddev_samp(height) AS sh FROM i GROUP BY 1),
z AS (SELECT *, (width - mw) / sw AS zw, (height - mh) / sh AS zh FROM i JOIN s USING (dataset))
SELECT dataset, id, width, height, CASE WHEN abs(zw) > 3 THEN 'width' ELSE 'height' END AS axis,
  round(CASE WHEN abs(zw) > 3 THEN zw ELSE zh END, 6) AS z_score FROM z WHERE abs(zw) > 3 OR abs(zh) > 3""")
    def _(v):
        return outliers.resolution(
            v.table("orders").select(
                F.col("o_orderpriority").alias("dataset"),
                F.col("o_orderkey").alias("id"),
                F.round(F.exp(F.col("o_totalprice") / 60000)).cast("long").alias("width"),
                F.col("o_custkey").alias("height"),
            )
        )

    @r.add("u02_extreme_aspect", with_views("annotations") + """
SELECT dataset, id, seq1, seq2, x, width, height FROM annotations
WHERE width <= 0 OR height <= 0 OR height / width > 20 OR width / height > 20""")
    def _(v):
        return outliers.extreme_aspect(v.annotations)

    @r.add("u03_tiny_objects", with_views("annotations") + """
SELECT dataset, id, seq1, seq2, x, label, width * height AS area FROM annotations WHERE width * height < 4""")
    def _(v):
        return outliers.tiny_objects(v.annotations)

    @r.add("u04_huge_objects", with_views("annotations") + """
, a AS (SELECT dataset, id, seq1, seq2, x, width * height * CASE WHEN seq1 % 100 = 0 THEN 10 ELSE 1 END AS area FROM annotations),
s AS (SELECT dataset, avg(area) + 3 * stddev_samp(area) AS threshold FROM a GROUP BY 1)
SELECT dataset, id, seq1, seq2, x, area, round(threshold, 4) AS threshold FROM a JOIN s USING (dataset) WHERE area > threshold""")
    def _(v):
        grown = v.annotations.withColumn("width", F.col("width") * F.when(F.col("seq1") % 100 == 0, 10).otherwise(1))
        return outliers.huge_objects(grown)
