"""Scalar functions and geometry over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelloom.functions import bins, checksums, confidence, geometry, licenses, text, versions
from labelloom.functions.numbers import nearest
from labelloom.operators import stats
from labelloom.plans.views import with_views

WORDS = r"[^\p{L}\p{N}_]+"

_SOURCE_BOX = """boxes AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
    CASE (l_orderkey + l_linenumber) % 7 WHEN 0 THEN 'xyxy_normalized' WHEN 1 THEN 'xyxy_absolute' WHEN 2 THEN 'xywh_normalized'
      WHEN 3 THEN 'xywh_absolute' WHEN 4 THEN 'cxcywh_normalized' WHEN 5 THEN 'cxcywh_absolute' ELSE 'other' END AS fmt,
    CASE (l_orderkey + l_linenumber) % 5 WHEN 0 THEN 'xyxy' WHEN 1 THEN 'xywh' WHEN 2 THEN 'cxcywh' WHEN 3 THEN 'normalized_xywh' ELSE 'other' END AS src,
    CAST(l_partkey % 97 AS DOUBLE) / 64 AS a, CAST(l_suppkey % 89 AS DOUBLE) / 64 AS b,
    (l_quantity - 3) / 32 AS c, CAST(l_orderkey % 61 AS DOUBLE) / 32 AS d,
    CASE WHEN l_linenumber % 3 = 0 THEN 0 ELSE 64 * l_linenumber END AS w, 128 AS h
  FROM lineitem)"""


def _boxes(v):
    key = F.col("l_orderkey") + F.col("l_linenumber")
    fmt = F.array(*map(F.lit, (*geometry.BOX_FORMATS, "other")))
    src = F.array(*map(F.lit, ("xyxy", "xywh", "cxcywh", "normalized_xywh", "other")))
    return v.table("lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        F.element_at(fmt, (key % 7 + 1).cast("int")).alias("fmt"),
        F.element_at(src, (key % 5 + 1).cast("int")).alias("src"),
        ((F.col("l_partkey") % 97).cast("double") / 64).alias("a"),
        ((F.col("l_suppkey") % 89).cast("double") / 64).alias("b"),
        ((F.col("l_quantity") - 3) / 32).alias("c"),
        ((F.col("l_orderkey") % 61).cast("double") / 32).alias("d"),
        F.when(F.col("l_linenumber") % 3 == 0, 0).otherwise(64 * F.col("l_linenumber")).alias("w"),
        F.lit(128).alias("h"),
    )


def _box() -> geometry.Box:
    return geometry.Box(F.col("a"), F.col("b"), F.col("c"), F.col("d"))


def _rounded(box: geometry.Box, names=("x", "y", "width", "height")):
    values = (box.a, box.b, box.c, box.d)
    return [F.round(c, 6).alias(n) for c, n in zip(values, names)]


def register(r) -> None:
    key = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    keys = ", ".join(key)

    # Geometry -----------------------------------------------------------------
    @r.add(
        "g01_box_to_normalized_corners",
        with_views(more=_SOURCE_BOX) + f"""
SELECT {keys}, fmt,
  round(CASE fmt WHEN 'xyxy_normalized' THEN a WHEN 'xyxy_absolute' THEN a / nullif(w, 0) WHEN 'xywh_normalized' THEN a
    WHEN 'xywh_absolute' THEN a / nullif(w, 0) WHEN 'cxcywh_normalized' THEN a - c / 2 WHEN 'cxcywh_absolute' THEN (a - c / 2) / nullif(w, 0) END, 6) AS x1,
  round(CASE fmt WHEN 'xyxy_normalized' THEN b WHEN 'xyxy_absolute' THEN b / h WHEN 'xywh_normalized' THEN b
    WHEN 'xywh_absolute' THEN b / h WHEN 'cxcywh_normalized' THEN b - d / 2 WHEN 'cxcywh_absolute' THEN (b - d / 2) / h END, 6) AS y1,
  round(CASE fmt WHEN 'xyxy_normalized' THEN c WHEN 'xyxy_absolute' THEN c / nullif(w, 0) WHEN 'xywh_normalized' THEN a + c
    WHEN 'xywh_absolute' THEN (a + c) / nullif(w, 0) WHEN 'cxcywh_normalized' THEN a + c / 2 WHEN 'cxcywh_absolute' THEN (a + c / 2) / nullif(w, 0) END, 6) AS x2,
  round(CASE fmt WHEN 'xyxy_normalized' THEN d WHEN 'xyxy_absolute' THEN d / h WHEN 'xywh_normalized' THEN b + d
    WHEN 'xywh_absolute' THEN (b + d) / h WHEN 'cxcywh_normalized' THEN b + d / 2 WHEN 'cxcywh_absolute' THEN (b + d / 2) / h END, 6) AS y2
FROM boxes""",
    )
    def _(v):
        box = geometry.corners_from(_box(), F.col("fmt"), F.col("w"), F.col("h"))
        return _boxes(v).select(*key, "fmt", *_rounded(box, ("x1", "y1", "x2", "y2")))

    @r.add(
        "g02_box_to_canonical",
        with_views(more=_SOURCE_BOX) + f"""
, checked AS (SELECT *, CASE WHEN src = 'xyxy' AND c < a THEN 'xmax below xmin' WHEN src = 'xyxy' AND d < b THEN 'ymax below ymin'
  WHEN src IN ('xywh', 'cxcywh') AND (c < 0 OR d < 0) THEN 'negative extent'
  WHEN src = 'normalized_xywh' AND w = 0 THEN 'image size required' WHEN src = 'other' THEN 'unknown format' END AS error FROM boxes)
SELECT {keys}, src, error,
  round(CASE WHEN error IS NOT NULL THEN NULL WHEN src = 'cxcywh' AND w > 0 THEN a * w - c * w / 2 WHEN src = 'cxcywh' THEN a - c / 2
    WHEN src = 'normalized_xywh' THEN a * w ELSE a END, 6) AS x,
  round(CASE WHEN error IS NOT NULL THEN NULL WHEN src = 'cxcywh' AND w > 0 THEN b * h - d * h / 2 WHEN src = 'cxcywh' THEN b - d / 2
    WHEN src = 'normalized_xywh' THEN b * h ELSE b END, 6) AS y,
  round(CASE WHEN error IS NOT NULL THEN NULL WHEN src = 'xyxy' THEN c - a WHEN src = 'xywh' THEN c WHEN w > 0 THEN c * w ELSE c END, 6) AS width,
  round(CASE WHEN error IS NOT NULL THEN NULL WHEN src = 'xyxy' THEN d - b WHEN src = 'xywh' THEN d WHEN w > 0 THEN d * h ELSE d END, 6) AS height
FROM checked""",
    )
    def _(v):
        size = (F.col("src"), F.col("w"), F.col("h"))
        return _boxes(v).select(
            *key, "src", geometry.box_error(_box(), *size).alias("error"), *_rounded(geometry.canonical_box(_box(), *size))
        )

    @r.add(
        "g03_normalize_denormalize",
        with_views(more=_SOURCE_BOX) + f"""
SELECT {keys}, round(a / nullif(w, 0), 6) AS nx, round(b / h, 6) AS ny, round(c / nullif(w, 0), 6) AS nw, round(d / h, 6) AS nh,
  round(a * nullif(w, 0), 6) AS px, round(b * h, 6) AS py, round(c * nullif(w, 0), 6) AS pw, round(d * h, 6) AS ph FROM boxes""",
    )
    def _(v):
        size = (F.col("w"), F.col("h"))
        return _boxes(v).select(
            *key,
            *_rounded(geometry.normalize(_box(), *size), ("nx", "ny", "nw", "nh")),
            *_rounded(geometry.denormalize(_box(), *size), ("px", "py", "pw", "ph")),
        )

    @r.add(
        "g04_polygon_to_box",
        with_views(more=_SOURCE_BOX) + f"""
SELECT {keys}, least(a, c, a + c) AS x, least(b, d, b - d) AS y,
  greatest(a, c, a + c) - least(a, c, a + c) AS width, greatest(b, d, b - d) - least(b, d, b - d) AS height FROM boxes""",
    )
    def _(v):
        a, b, c, d = (F.col(n) for n in "abcd")
        ring = F.array(
            *[F.struct(x.alias("x"), y.alias("y")) for x, y in ((a, b), (c, d), (a + c, b - d))]
        )
        return _boxes(v).withColumn("ring", ring).select(
            *key, *geometry.polygon_box(F.col("ring")).named(("x", "y", "width", "height"))
        )

    @r.add(
        "g05_rotated_to_box",
        with_views(more=_SOURCE_BOX) + f"""
, turned AS (SELECT *, abs(cos(radians(l_partkey % 360))) AS co, abs(sin(radians(l_partkey % 360))) AS si FROM boxes)
SELECT {keys}, round(a - (c * co + d * si) / 2, 6) AS x, round(b - (c * si + d * co) / 2, 6) AS y,
  round(c * co + d * si, 6) AS width, round(c * si + d * co, 6) AS height FROM turned""",
    )
    def _(v):
        angle = (F.col("l_partkey") % 360).cast("double")
        return _boxes(v).select(
            *key, *_rounded(geometry.rotated_box(F.col("a"), F.col("b"), F.col("c"), F.col("d"), angle))
        )

    @r.add(
        "g06_centre_form",
        with_views(more=_SOURCE_BOX) + f"SELECT {keys}, a + c / 2 AS cx, b + d / 2 AS cy, c AS width, d AS height FROM boxes",
    )
    def _(v):
        return _boxes(v).select(*key, *geometry.centre_form(_box()).named(("cx", "cy", "width", "height")))

    @r.add(
        "g08_clamp_log",
        with_views(more=_SOURCE_BOX) + f"""
SELECT * FROM (SELECT {keys}, a AS x1_before, b AS y1_before, c AS x2_before, d AS y2_before,
  greatest(0.0, least(a, 1.0)) AS x1, greatest(0.0, least(b, 1.0)) AS y1, greatest(0.0, least(c, 1.0)) AS x2, greatest(0.0, least(d, 1.0)) AS y2
FROM boxes) WHERE x1 <> x1_before OR y1 <> y1_before OR x2 <> x2_before OR y2 <> y2_before""",
    )
    def _(v):
        before = [F.col(c).alias(f"{n}_before") for c, n in zip("abcd", ("x1", "y1", "x2", "y2"))]
        after = geometry.clamp_unit(_box()).named(("x1", "y1", "x2", "y2"))
        changed = F.expr("x1 <> x1_before OR y1 <> y1_before OR x2 <> x2_before OR y2 <> y2_before")
        return _boxes(v).select(*key, *before, *after).where(changed)

    @r.add(
        "g09_derived_measures",
        with_views("annotations") + """
SELECT id, seq1, seq2, x, width * height AS area, round(CASE WHEN height > 0 THEN width / height ELSE 0 END, 6) AS aspect_wh,
  round(CASE WHEN width > 0 THEN height / width ELSE 1e308 END, 6) AS aspect_hw FROM annotations""",
    )
    def _(v):
        w, h = F.col("width"), F.col("height")
        return v.annotations.select(
            "id", "seq1", "seq2", "x",
            geometry.area(w, h).alias("area"),
            nearest(geometry.aspect_w_over_h(w, h)).alias("aspect_wh"),
            # A ratio too large for a double is infinite; 1e308 stands for a missing width alone.
            F.when(w > 0, nearest(geometry.aspect_h_over_w(w, h))).otherwise(1e308).alias("aspect_hw"),
        )

    @r.add(
        "g10_standard_metadata",
        with_views("images") + """
SELECT id, file_path, coalesce(nullif(lower(regexp_extract(file_path, '^.+[.]([^.]+)$', 1)), ''), format, 'jpg') AS format,
  coalesce(nullif(color_space, ''), 'rgb') AS color_space, file_size_bytes FROM images""",
    )
    def _(v):
        return stats.standard_metadata(v.images).select("id", "file_path", "format", "color_space", "file_size_bytes")

    # Strings ------------------------------------------------------------------
    @r.add(
        "f01_class_name",
        r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{N}_\s\p{Z}]+', '', 'g'),
  '[\s\p{Z}_]+', '_', 'g'), '^_+|_+$', '', 'g') AS class_name FROM documents""",
    )
    def _(v):
        return v.table("documents").select("doc_id", text.class_name(F.col("text")).alias("class_name"))

    @r.add(
        "f02_file_name",
        r"""SELECT page_id, regexp_replace(regexp_replace(lower(CASE WHEN name SIMILAR TO '.+\.[^.]+' THEN regexp_replace(name, '\.[^.]+$', '') ELSE name END),
    '[^\p{L}\p{N}_]+', '-', 'g'), '^-+|-+$', '', 'g') ||
  CASE WHEN lower(regexp_extract(name, '^.+(\.[^.]+)$', 1)) IN ('.jpg', '.jpeg', '.png', '.bmp', '.webp')
    THEN lower(regexp_extract(name, '^.+(\.[^.]+)$', 1)) ELSE '.jpg' END AS file_name
FROM (SELECT page_id, regexp_extract(url, '([^/]*)/*$', 1) AS name FROM pages)""",
    )
    def _(v):
        return v.table("pages").select("page_id", text.file_name(F.col("url")).alias("file_name"))

    @r.add(
        "f03_name_tokens",
        r"""SELECT doc_id, trim(regexp_replace(lower(source || '-' || lang || '_' || text), '[_\-]+', ' ', 'g')) AS normalized,
  len(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{2,}'))) AS token_count FROM documents""",
    )
    def _(v):
        name = F.concat(F.col("source"), F.lit("-"), F.col("lang"), F.lit("_"), F.col("text"))
        return v.table("documents").select(
            "doc_id",
            text.spaced(name).alias("normalized"),
            F.size(text.tokens(F.col("text"))).cast("long").alias("token_count"),
        )

    @r.add(
        "f04_singular",
        r"""WITH words AS (SELECT unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS word FROM documents)
SELECT word, count(*) AS uses, CASE WHEN word LIKE '%ies' THEN word[:-4] || 'y'
  WHEN word SIMILAR TO '.*(ses|xes|shes|ches)' THEN word[:-3]
  WHEN word LIKE '%s' AND word NOT LIKE '%ss' THEN word[:-2] ELSE word END AS singular FROM words GROUP BY word""",
    )
    def _(v):
        words = v.table("documents").select(F.explode(text.all_tokens(F.col("text"))).alias("word"))
        return words.groupBy("word").agg(F.count("*").alias("uses")).withColumn("singular", text.singular(F.col("word")))

    @r.add(
        "f05_character_similarity",
        r"""WITH sets AS (SELECT p_partkey, list_distinct(string_split(regexp_replace(lower(p_name), '[_ ]', '', 'g'), '')) AS a,
  list_distinct(string_split(regexp_replace(lower(p_type || '_' || p_brand), '[_ ]', '', 'g'), '')) AS b FROM part)
SELECT p_partkey, round(len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))), 6) AS similarity FROM sets""",
    )
    def _(v):
        other = F.lower(F.concat(F.col("p_type"), F.lit("_"), F.col("p_brand")))
        return v.table("part").select(
            "p_partkey", F.round(text.character_similarity(F.lower("p_name"), other), 6).alias("similarity")
        )

    @r.add(
        "f06_value_names",
        with_views("ontology_values") + r"""
SELECT value, split_part(value, '.', 1) AS category, upper(split_part(value, '.', 2)[1]) ||
  replace(split_part(value, '.', 2)[2:], '_', ' ') AS name FROM ontology_values""",
    )
    def _(v):
        value = F.col("value")
        return v.ontology_values.select(
            "value", text.first_part(value).alias("category"), text.title(text.last_part(value)).alias("name")
        )

    @r.add(
        "f07_checksums",
        """SELECT doc_id, sha256(text) AS text_sha256,
  sha256('{"lang":"' || lang || '","n_chars":' || CAST(n_chars AS VARCHAR) || ',"source":"' || source || '"}') AS record_sha256 FROM documents""",
    )
    def _(v):
        return v.table("documents").select(
            "doc_id",
            checksums.of_text(F.col("text")).alias("text_sha256"),
            checksums.of_record("source", "n_chars", "lang").alias("record_sha256"),
        )

    @r.add(
        "f08_directory_hash",
        with_views("images") + """
, files AS (SELECT dataset, file_path, sha256(content) AS h, substring(md5(file_path), 1, 3) AS bucket FROM images),
parts AS (SELECT dataset, bucket, sha256(string_agg(file_path || h, '' ORDER BY file_path, h)) AS ph FROM files GROUP BY dataset, bucket)
SELECT dataset, sha256(string_agg(bucket || ph, '' ORDER BY bucket)) AS directory_sha256 FROM parts GROUP BY dataset""",
    )
    def _(v):
        files = v.images.select("dataset", "file_path", checksums.of_text(F.col("content")).alias("sha256"))
        return checksums.directory(files, ["dataset"], "file_path", "sha256")

    @r.add(
        "f09_size_bins",
        with_views("annotations") + """
SELECT CASE WHEN width < 32 THEN 'tiny' WHEN width < 64 THEN 'small' WHEN width < 128 THEN 'medium' WHEN width < 256 THEN 'large' ELSE 'xlarge' END AS width_bin,
  CASE WHEN x < 32 THEN 'tiny' WHEN x < 64 THEN 'small' WHEN x < 128 THEN 'medium' WHEN x < 256 THEN 'large' ELSE 'xlarge' END AS offset_bin,
  count(*) AS n FROM annotations GROUP BY 1, 2""",
    )
    def _(v):
        return (
            v.annotations.groupBy(
                bins.size_bin(F.col("width")).alias("width_bin"), bins.size_bin(F.col("x")).alias("offset_bin")
            ).agg(F.count("*").alias("n"))
        )

    @r.add(
        "f10_aspect_bins",
        with_views("annotations") + """
, ratios AS (SELECT dataset, CASE WHEN height > 0 THEN width / height ELSE 1 END AS r FROM annotations)
SELECT dataset, CASE WHEN r < 0.5 THEN 'tall' WHEN r < 1.5 THEN 'square' WHEN r < 3 THEN 'wide' ELSE 'xwide' END AS aspect_bin, count(*) AS n
FROM ratios GROUP BY 1, 2""",
    )
    def _(v):
        ratio = geometry.aspect_w_over_h(F.col("width"), F.col("height"), otherwise=1.0)
        return v.annotations.groupBy("dataset", bins.aspect_bin(ratio).alias("aspect_bin")).agg(F.count("*").alias("n"))

    @r.add(
        "f11_resolution_buckets",
        with_views("images") + """
SELECT dataset, CASE WHEN width >= 1920 AND height >= 1080 THEN 'hd' WHEN width >= 1280 AND height >= 720 THEN '720p'
    WHEN width >= 640 AND height >= 480 THEN 'vga' ELSE 'low' END AS detail,
  CASE WHEN width >= 1920 AND height >= 1080 THEN 'high' WHEN width >= 640 AND height >= 480 THEN 'medium' ELSE 'low' END AS level,
  count(*) AS n FROM images GROUP BY 1, 2, 3""",
    )
    def _(v):
        w, h = F.col("width"), F.col("height")
        return v.images.groupBy(
            "dataset", bins.resolution_detail(w, h).alias("detail"), bins.resolution_level(w, h).alias("level")
        ).agg(F.count("*").alias("n"))

    @r.add(
        "f12_letter_grade",
        """SELECT s_suppkey, CASE WHEN s_acctbal / 100 >= 90 THEN 'A' WHEN s_acctbal / 100 >= 75 THEN 'B' WHEN s_acctbal / 100 >= 60 THEN 'C'
  WHEN s_acctbal / 100 >= 40 THEN 'D' ELSE 'F' END AS grade FROM supplier""",
    )
    def _(v):
        return v.table("supplier").select("s_suppkey", bins.letter_grade(F.col("s_acctbal") / 100).alias("grade"))

    @r.add(
        "f13_semver",
        with_views("mapping_rules") + """
, p AS (SELECT rule_id, version, CAST(split_part(version, '.', 1) AS INT) AS a, CAST(split_part(version, '.', 2) AS INT) AS b,
  CAST(split_part(version, '.', 3) AS INT) AS c FROM mapping_rules)
SELECT rule_id, version, CASE WHEN (a, b, c) < (1, 10, 3) THEN -1 WHEN (a, b, c) > (1, 10, 3) THEN 1 ELSE 0 END AS against_1_10_3,
  CAST(a + 1 AS VARCHAR) || '.0.0' AS next_major, CAST(a AS VARCHAR) || '.' || CAST(b + 1 AS VARCHAR) || '.0' AS next_minor,
  CAST(a AS VARCHAR) || '.' || CAST(b AS VARCHAR) || '.' || CAST(c + 1 AS VARCHAR) AS next_patch, a = 1 AS fits_major FROM p""",
    )
    def _(v):
        ver = F.col("version")
        return v.mapping_rules.select(
            "rule_id", "version",
            versions.compare(ver, F.lit("1.10.3")).alias("against_1_10_3"),
            *[versions.bump(ver, k).alias(f"next_{k}") for k in ("major", "minor", "patch")],
            versions.compatible(ver, F.lit("1.0.0")).alias("fits_major"),
        )

    @r.add(
        "f14_rolling_bump",
        with_views("mapping_rules") + """
, p AS (SELECT rule_id, version, CAST(split_part(version, '.', 1) AS INT) AS a, CAST(split_part(version, '.', 2) AS INT) AS b,
  CAST(split_part(version, '.', 3) AS INT) + 1 AS c FROM mapping_rules),
q AS (SELECT rule_id, version, a, b + CASE WHEN c >= 20 THEN 1 ELSE 0 END AS b, CASE WHEN c >= 20 THEN 0 ELSE c END AS c FROM p)
SELECT rule_id, version, CAST(a + CASE WHEN b >= 10 THEN 1 ELSE 0 END AS VARCHAR) || '.' ||
  CAST(CASE WHEN b >= 10 THEN 0 ELSE b END AS VARCHAR) || '.' || CAST(c AS VARCHAR) AS next_version FROM q""",
    )
    def _(v):
        return v.mapping_rules.select("rule_id", "version", versions.rolling_bump(F.col("version")).alias("next_version"))

    has = "contains(t, '{}')".format
    creative = f"""CASE WHEN {has('noncommercial')} OR {has('nc')} THEN 'cc_nc' WHEN {has('zero')} OR {has('cc0')} THEN 'cc0'"""

    @r.add(
        "f15_license_text",
        f"""WITH d AS (SELECT doc_id, lower(trim(text, ' ')) AS t FROM documents)
SELECT doc_id, CASE WHEN {has('creative commons')} OR {has('cc')} THEN {creative}
    WHEN {has('attribution')} AND ({has('sharealike')} OR {has('sa')}) THEN 'cc_by_sa_4' ELSE 'cc_by_4' END
  WHEN {has('mit')} THEN 'mit' WHEN {has('apache')} THEN 'apache_2' WHEN {has('public domain')} THEN 'cc0'
  WHEN {has('proprietary')} OR {has('all rights reserved')} THEN 'proprietary' ELSE 'unknown' END AS license_id,
  contains(t, 'license') AS names_license FROM d""",
    )
    def _(v):
        t = F.col("text")
        return v.table("documents").select(
            "doc_id", licenses.classify(t).alias("license_id"), F.lower(t).contains("license").alias("names_license")
        )

    @r.add(
        "f16_license_file",
        f"""WITH d AS (SELECT doc_id, lower(text) AS t FROM documents)
SELECT doc_id, CASE WHEN {has('creative commons')} OR {has('cc')} THEN {creative} ELSE 'cc_by_4' END
  WHEN {has('mit')} AND {has('license')} THEN 'mit' ELSE 'unknown' END AS license_id FROM d""",
    )
    def _(v):
        return v.table("documents").select("doc_id", licenses.classify_file(F.col("text")).alias("license_id"))

    @r.add(
        "f17_confidence",
        with_views("annotations") + """
, c AS (SELECT id, seq1, seq2, x, score_percent / 10 AS detector, CAST(seq2 % 11 AS DOUBLE) / 10 AS concept, seq1 % 5 AS depth,
  CASE seq1 % 4 WHEN 0 THEN 'direct' WHEN 1 THEN 'alias' WHEN 2 THEN 'category' ELSE 'other' END AS source FROM annotations)
SELECT id, seq1, seq2, x, round(greatest(0.0, least(1.0, least(concept * pow(0.95, depth), detector))), 3) AS adjusted,
  round(greatest(0.0, least(1.0, least(concept * CASE source WHEN 'alias' THEN 0.92 WHEN 'category' THEN 0.9 ELSE 1.0 END, detector))), 3) AS by_source FROM c""",
    )
    def _(v):
        source = F.element_at(
            F.array(*map(F.lit, ("direct", "alias", "category", "other"))), (F.col("seq1") % 4 + 1).cast("int")
        )
        detector = F.col("score_percent") / 10
        concept = (F.col("seq2") % 11).cast("double") / 10
        return v.annotations.select(
            "id", "seq1", "seq2", "x",
            confidence.adjust(detector, concept, F.col("seq1") % 5).alias("adjusted"),
            confidence.adjust_by_source(detector, concept, source).alias("by_source"),
        )

    @r.add(
        "f18_substring_match",
        r"""WITH n AS (SELECT page_id, trim(regexp_replace(lower(url), '[_\-]+', ' ', 'g')) AS a,
  trim(regexp_replace(lower(html), '[_\-]+', ' ', 'g')) AS b FROM pages)
SELECT page_id, contains(a, b) OR contains(b, a) AS matched FROM n""",
    )
    def _(v):
        return v.table("pages").select("page_id", text.either_contains(F.col("url"), F.col("html")).alias("matched"))

    @r.add(
        "f19_field_ranges",
        with_views("annotations") + """
SELECT id, seq1, seq2, x, width > 0 AND height > 0 AS box_ok, score_percent / 8 BETWEEN 0 AND 1 AS confidence_ok FROM annotations""",
    )
    def _(v):
        return v.annotations.select(
            "id", "seq1", "seq2", "x",
            confidence.box_in_range(F.col("width"), F.col("height")).alias("box_ok"),
            confidence.confidence_in_range(F.col("score_percent") / 8).alias("confidence_ok"),
        )
