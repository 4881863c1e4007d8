"""Joins, label mapping, ontology and taxonomy queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelloom.functions import licenses, text
from labelloom.operators import hierarchy, joins, mapping, stats
from labelloom.plans.aggregates import COUNTS
from labelloom.plans.views import brand_slug, with_views

NODES = ("ontology_values", "nodes")


def nodes_of(v):
    return hierarchy.build_tree(v.ontology_values)


def part_classes(v):
    """Each part name as a data set whose classes are its brands."""
    return v.table("part").select(F.col("p_name").alias("dataset"), brand_slug(F.col("p_brand")).alias("class_name")).distinct()


PART_CLASSES = "classes AS (SELECT DISTINCT p_name AS dataset, regexp_replace(lower(p_brand), '[^a-z0-9]+', '_', 'g') AS class_name FROM part)"
COVERED = PART_CLASSES + """,
terms AS (SELECT DISTINCT dataset, unnest(string_split(replace(class_name, '_', ' '), ' ') || [class_name]) AS term FROM classes),
node_terms AS (SELECT node_id, domain, unnest(list_transform(aliases, lambda a: replace(lower(a), '-', ' ')) || list_transform(keywords, lambda k: lower(k)) || [lower(name)]) AS term FROM taxonomy),
covered AS (SELECT DISTINCT dataset, node_id, domain FROM terms JOIN node_terms USING (term))"""

MAPPED = """singular_ AS (SELECT label, lower(label) AS low, CASE WHEN lower(label) LIKE '%ies' THEN lower(label)[:-4] || 'y'
    WHEN lower(label) SIMILAR TO '.*(ses|xes|shes|ches)' THEN lower(label)[:-3]
    WHEN lower(label) LIKE '%s' AND lower(label) NOT LIKE '%ss' THEN lower(label)[:-2] ELSE lower(label) END AS one FROM raw_labels),
sim AS (SELECT l.label, n.value, list_distinct(string_split(regexp_replace(l.low, '[_ ]', '', 'g'), '')) AS a,
    list_distinct(string_split(regexp_replace(lower(n.name), '[_ ]', '', 'g'), '')) AS b
  FROM singular_ l JOIN nodes n ON n.value <> 'root' AND (contains(lower(n.name), l.low) OR contains(lower(n.value), l.low))),
sims AS (SELECT label, value, len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))) AS s FROM sim),
cand AS (
  SELECT label, 1 AS tier, 0 AS place, canonical_value, CAST(confidence AS DOUBLE) AS confidence, rule_id FROM singular_ JOIN
    (SELECT * FROM mapping_rules QUALIFY row_number() OVER (PARTITION BY source_label ORDER BY created_at) = 1) ON source_label = label
  UNION ALL SELECT label, 2, 0, canonical_value, confidence * 0.95, rule_id FROM singular_ JOIN
    (SELECT * FROM mapping_rules QUALIFY row_number() OVER (PARTITION BY lower(source_label) ORDER BY created_at) = 1) ON lower(source_label) = low
  UNION ALL SELECT label, 3, CASE kind WHEN 'alias' THEN 1 ELSE 2 END, canonical_value, CASE kind WHEN 'alias' THEN 0.9 ELSE 0.7 END, NULL
    FROM singular_ JOIN alias_table ON alias = low WHERE canonical_value IN (SELECT value FROM nodes)
  UNION ALL SELECT label, 3, 3, canonical_value, 0.85, rule_id FROM singular_ JOIN mapping_rules ON lower(source_label) = one
    WHERE one <> low AND canonical_value IN (SELECT value FROM nodes)
  UNION ALL SELECT label, 3, 4, canonical_value, confidence, NULL FROM singular_ JOIN pattern_table ON regexp_matches(label, pattern, 'i')
  UNION ALL SELECT label, 4, 5, value, s, NULL FROM sims WHERE s > 0.3),
ranked AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY tier, confidence DESC, place, canonical_value, CAST(rule_id AS VARCHAR) NULLS FIRST) AS rank,
  min(tier) OVER (PARTITION BY label) AS best_tier FROM cand)"""

RULE_VIEWS = ("ontology_values", "nodes", "mapping_rules", "raw_labels", "alias_table", "pattern_table")


def mapped(v):
    return mapping.map_labels(v.raw_labels, v.mapping_rules, nodes_of(v), v.alias_table, v.pattern_table)


def register(r) -> None:
    # Joins ----------------------------------------------------------------------
    @r.add("j01_annotation_image", with_views("images", "annotations") + """
SELECT a.id, a.seq1, a.seq2, a.image_id, i.width AS image_width, i.height AS image_height, i.id IS NOT NULL AS has_image
FROM annotations a LEFT JOIN images i ON a.image_id = i.id""")
    def _(v):
        return joins.with_image(v.annotations, v.images).select(
            "id", "seq1", "seq2", "image_id", "image_width", "image_height", "has_image"
        )

    @r.add("j02_annotation_category", """
WITH c AS (SELECT CASE WHEN p_type = 'PROMO' THEN -1 - p_partkey ELSE p_partkey END AS id, p_type AS name FROM part)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, coalesce(name, CAST(l_partkey AS VARCHAR)) AS category_name FROM lineitem LEFT JOIN c ON l_partkey = id""")
    def _(v):
        lines = v.table("lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", F.col("l_partkey").alias("category_id"))
        moved = F.when(F.col("p_type") == "PROMO", -1 - F.col("p_partkey")).otherwise(F.col("p_partkey"))
        cats = v.table("part").select(moved.alias("id"), F.col("p_type").alias("name"))
        return joins.with_category(lines, cats).drop("category_id")

    @r.add("j03_images_without_annotations", with_views("images", "annotations") + """
SELECT id, dataset, file_path FROM images WHERE id NOT IN (SELECT image_id FROM annotations)""")
    def _(v):
        return joins.images_without_annotations(v.images, v.annotations).select("id", "dataset", "file_path")

    @r.add("j04_orphan_annotations", with_views("images", "annotations") + """
SELECT id, image_id, seq1, seq2 FROM annotations WHERE image_id NOT IN (SELECT id FROM images)""")
    def _(v):
        return joins.orphan_annotations(v.annotations, v.images).select("id", "image_id", "seq1", "seq2")

    @r.add("j05_images_with_label", with_views("images", "annotations") + """
SELECT id, dataset FROM images WHERE id IN (SELECT image_id FROM annotations WHERE label = 'Brand#12')""")
    def _(v):
        return joins.images_with_label(v.images, v.annotations, F.col("label") == "Brand#12").select("id", "dataset")

    @r.add("j06_label_rules", with_views("raw_labels", "mapping_rules") + """
SELECT label, rule_id, canonical_value FROM raw_labels JOIN mapping_rules ON lower(trim(source_label)) = lower(trim(label))""")
    def _(v):
        return joins.rules_for_labels(v.raw_labels, v.mapping_rules).select("label", "rule_id", "canonical_value")

    @r.add("j08_keyword_sources", with_views("taxonomy") + """
, parts AS (SELECT DISTINCT node_id, unnest(string_split(trim(regexp_replace(lower(kw), '[_-]+', ' ', 'g')), ' ')) AS part
  FROM (SELECT node_id, unnest(keywords) AS kw FROM taxonomy)),
hits AS (SELECT DISTINCT node_id, c_custkey AS source_id FROM parts JOIN customer ON contains(lower(c_name || chr(10) || c_mktsegment), part))
SELECT node_id, source_id, row_number() OVER (PARTITION BY node_id ORDER BY source_id) AS rank FROM hits QUALIFY rank <= 5""")
    def _(v):
        sources = v.table("customer").select(
            F.col("c_custkey").alias("source_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("description")
        )
        return joins.keyword_sources(v.taxonomy, sources, 5)

    @r.add("j09_name_match", """
WITH a AS (SELECT DISTINCT p_name AS name, list_distinct(regexp_extract_all(lower(p_name), '[a-z0-9]{2,}')) AS t FROM part),
b AS (SELECT DISTINCT p_type || '_' || split_part(p_name, ' ', 2) AS other,
  list_distinct(regexp_extract_all(replace(lower(p_type || '_' || split_part(p_name, ' ', 2)), '_', ' '), '[a-z0-9]{2,}')) AS t FROM part),
m AS (SELECT name, other, list_intersect(a.t, b.t) AS i, least(len(a.t), len(b.t)) AS shorter FROM a, b)
SELECT name, other, len(i) AS shared_tokens FROM m WHERE len(list_filter(i, lambda x: length(x) >= 3)) > 0 OR (len(i) = shorter AND shorter > 0)""")
    def _(v):
        part = v.table("part")
        other = F.concat("p_type", F.lit("_"), F.split_part("p_name", F.lit(" "), F.lit(2)))
        return joins.name_matches(part.select(F.col("p_name").alias("name")), part.select(other.alias("other")))

    @r.add("j10_label_in_node", with_views(*NODES, "raw_labels") + """
SELECT DISTINCT label, value, name FROM raw_labels JOIN nodes ON value <> 'root' AND (contains(lower(name), lower(label)) OR contains(lower(value), lower(label)))""")
    def _(v):
        return joins.labels_in_nodes(v.raw_labels, nodes_of(v))

    @r.add("j11_label_pattern", with_views("raw_labels", "pattern_table") + """
SELECT label, pattern, canonical_value, CAST(confidence AS DOUBLE) AS confidence FROM raw_labels JOIN pattern_table ON regexp_matches(label, pattern, 'i')""")
    def _(v):
        return joins.regex_matches(v.raw_labels, v.pattern_table)

    risk = "CASE {0} WHEN 'cc0' THEN 0.0 WHEN 'cc_by_4' THEN 0.1 WHEN 'cc_by_sa_4' THEN 0.2 WHEN 'cc_nc' THEN 0.6 WHEN 'mit' THEN 0.05 WHEN 'apache_2' THEN 0.05 WHEN 'odbl' THEN 0.3 WHEN 'pddl' THEN 0.0 WHEN 'proprietary' THEN 1.0 WHEN 'unknown' THEN 0.8 END"

    @r.add("j13_license_compatibility", f"""
WITH used AS (SELECT DISTINCT source, list_extract(['cc0', 'cc_by_4', 'cc_by_sa_4', 'cc_nc', 'mit', 'apache_2', 'odbl', 'pddl', 'proprietary', 'unknown'], CAST(n_chars % 10 + 1 AS INT)) AS id FROM documents),
p(id, is_open, commercial, share_alike, ok) AS (VALUES ('cc0', true, true, false, ['cc_by_4', 'mit', 'apache_2']), ('cc_by_4', true, true, false, ['cc0']),
  ('cc_by_sa_4', true, true, true, ['cc0', 'cc_by_4']), ('cc_nc', true, false, false, []), ('mit', true, true, false, ['cc0', 'apache_2']),
  ('apache_2', true, true, false, ['cc0', 'mit']), ('odbl', true, true, true, ['cc0']), ('pddl', true, true, false, ['cc0', 'mit', 'apache_2', 'cc_by_4']),
  ('proprietary', false, false, false, []), ('unknown', false, false, false, [])),
u AS (SELECT * FROM used JOIN p USING (id))
SELECT a.source, a.id AS license_a, b.id AS license_b, CAST(CASE WHEN a.id = b.id THEN 1.0 WHEN NOT a.is_open OR NOT b.is_open THEN 0.0
  WHEN list_contains(a.ok, b.id) OR list_contains(b.ok, a.id) THEN 0.9 WHEN a.share_alike <> b.share_alike THEN 0.3
  WHEN a.commercial AND b.commercial THEN 0.7 ELSE 0.2 END AS DOUBLE) AS compatibility FROM u a JOIN u b USING (source)""")
    def _(v):
        ids = F.array(*[F.lit(p[0]) for p in licenses.POLICY])
        used = v.table("documents").select("source", F.element_at(ids, (F.col("n_chars") % 10 + 1).cast("int")).alias("license_id"))
        return joins_licenses(v, used)

    @r.add("q05_license_policy", f"""
SELECT source, id AS license_id, id IN ('cc0', 'cc_by_4', 'cc_by_sa_4', 'mit', 'apache_2', 'odbl', 'pddl') AS allowed,
  id IN ('cc_nc', 'cc_by_nc', 'unknown', 'proprietary') AS restricted, CAST({risk.format('id')} AS DOUBLE) AS risk, count(*) AS documents
FROM (SELECT source, list_extract(['cc0', 'cc_by_4', 'cc_by_sa_4', 'cc_nc', 'mit', 'apache_2', 'odbl', 'pddl', 'proprietary', 'unknown'], CAST(n_chars % 10 + 1 AS INT)) AS id FROM documents)
GROUP BY 1, 2""")
    def _(v):
        ids = F.array(*[F.lit(p[0]) for p in licenses.POLICY])
        lic = F.col("license_id")
        return (
            v.table("documents").groupBy("source", F.element_at(ids, (F.col("n_chars") % 10 + 1).cast("int")).alias("license_id"))
            .agg(F.count("*").alias("documents"))
            .select("source", "license_id", lic.isin(*licenses.ALLOWED).alias("allowed"), lic.isin(*licenses.RESTRICTED).alias("restricted"),
                    licenses.risk(lic).alias("risk"), "documents")
        )

    @r.add("j14_profile_taxonomy", with_views("taxonomy", more=COVERED) + "SELECT dataset, node_id, domain FROM covered")
    def _(v):
        return hierarchy.covered_nodes(part_classes(v), v.taxonomy)

    @r.add("j15_stem_join", with_views("images", "files") + """
SELECT i.id, i.file_path AS path, f.path AS other_path, regexp_replace(split_part(i.file_path, '/', -1), '[.][^.]+$', '') AS stem
FROM images i JOIN files f ON regexp_replace(split_part(i.file_path, '/', -1), '[.][^.]+$', '') = regexp_replace(split_part(f.path, '/', -1), '[.][^.]+$', '')""")
    def _(v):
        return joins.by_stem(v.images.select("id", F.col("file_path").alias("path")), v.files.select("path"))

    # Mapping --------------------------------------------------------------------
    @r.add("o01_map_labels", with_views(*RULE_VIEWS, more=MAPPED) + """
SELECT l.label, coalesce(canonical_value, 'unknown_object') AS canonical_value, round(coalesce(confidence, 0), 6) AS confidence, coalesce(tier, 5) AS tier,
  CASE WHEN tier = 1 THEN 'exact' WHEN tier = 2 THEN 'case_insensitive' WHEN coalesce(confidence, 0) < 0.9 THEN 'synonym' ELSE 'alias' END AS match_type,
  CASE WHEN tier IS NULL THEN 'Unknown Object' ELSE coalesce(n.name, canonical_value) END AS canonical_name,
  CASE WHEN tier <= 2 THEN CAST(rule_id AS VARCHAR) END AS rule_id
FROM raw_labels l LEFT JOIN ranked r ON l.label = r.label AND rank = 1 LEFT JOIN nodes n ON n.value = canonical_value""")
    def _(v):
        return mapped(v).drop("alternatives").withColumn("confidence", F.round("confidence", 6))

    @r.add("w12_alternatives", with_views(*RULE_VIEWS, more=MAPPED) + """
SELECT l.label, coalesce(string_agg(canonical_value, ',' ORDER BY rank), '') AS alternatives FROM raw_labels l
LEFT JOIN ranked r ON l.label = r.label AND rank BETWEEN 2 AND 4 AND tier = best_tier AND tier >= 3 GROUP BY 1""")
    def _(v):
        return mapped(v).select("label", F.array_join("alternatives", ",").alias("alternatives"))

    @r.add("o02_registrations", with_views("alias_table", "pattern_table") + """
SELECT canonical_value, alias AS entry, kind, CASE kind WHEN 'alias' THEN 0.9 ELSE 0.7 END::DOUBLE AS confidence FROM alias_table
UNION ALL SELECT canonical_value, pattern, 'regex', confidence::DOUBLE FROM pattern_table""")
    def _(v):
        value, c = F.col("canonical_value"), F.col
        kinds = [mapping.alias_rows(v.alias_table.where(c("kind") == kind), value, F.upper("alias"), kind).select("canonical_value", c("alias").alias("entry"), "kind", F.lit(weight).alias("confidence")) for kind, weight in (("alias", 0.9), ("synonym", 0.7))]
        patterns = mapping.regex_rows(v.pattern_table, value, c("pattern"), c("confidence"))
        return kinds[0].unionByName(kinds[1]).unionByName(patterns.select("canonical_value", c("pattern").alias("entry"), F.lit("regex").alias("kind"), "confidence"))

    @r.add("o13_apply_mapping", with_views("annotations", "mapping_rules") + """
, t AS (SELECT CASE WHEN CAST(substring(p_brand, 7) AS INT) % 3 = 0 THEN p_brand || '?' ELSE p_brand END AS label, min(lower(p_type)) || '.mapped' AS canonical_value FROM part GROUP BY 1)
SELECT id, seq1, seq2, label, coalesce(t.canonical_value, nullif(ontology_class, '')) AS ontology_class FROM annotations LEFT JOIN t USING (label)""")
    def _(v):
        brand = F.col("p_brand")
        label = F.when(F.substring(brand, 7, 9).cast("int") % 3 == 0, F.concat(brand, F.lit("?"))).otherwise(brand)
        table = v.table("part").groupBy(label.alias("label")).agg(F.concat(F.min(F.lower("p_type")), F.lit(".mapped")).alias("canonical_value"))
        return mapping.apply_mapping(v.annotations, table).select("id", "seq1", "seq2", "label", "ontology_class")

    best = "best AS (SELECT lower(trim(source_label)) AS label, canonical_value FROM mapping_rules QUALIFY row_number() OVER (PARTITION BY lower(trim(source_label)) ORDER BY created_at) = 1)"

    @r.add("o14_harmonize", with_views("mapping_rules", more=best) + r"""
, c AS (SELECT DISTINCT p_type AS dataset, CASE WHEN p_size % 2 = 0 THEN p_name ELSE p_name || ' !' END AS class_name FROM part),
f AS (SELECT dataset, class_name, coalesce(canonical_value, trim(regexp_replace(regexp_replace(lower(class_name), '[^a-z0-9_ ]+', '', 'g'), '[_ ]+', '_', 'g'), '_')) AS final_class
  FROM c LEFT JOIN best ON label = class_name)
SELECT final_class, count(DISTINCT dataset) AS datasets, count(DISTINCT class_name) AS source_classes FROM f GROUP BY 1""")
    def _(v):
        name = F.when(F.col("p_size") % 2 == 0, F.col("p_name")).otherwise(F.concat("p_name", F.lit(" !")))
        classes = v.table("part").select(F.col("p_type").alias("dataset"), name.alias("class_name"))
        return mapping.harmonize(classes, mapping.best_rules(v.mapping_rules))

    @r.add("o15_translate", with_views(*NODES, "mapping_rules", "raw_labels", more=best) + """
SELECT l.label, CASE WHEN n.value IS NOT NULL THEN canonical_value ELSE 'unknown_object' END AS canonical_value
FROM raw_labels l LEFT JOIN best b ON b.label = lower(trim(l.label)) LEFT JOIN nodes n ON n.value = canonical_value""")
    def _(v):
        return mapping.translate(v.raw_labels, v.mapping_rules, nodes_of(v))

    @r.add("o16_conflicts", with_views(*NODES, "mapping_rules") + """
, rr AS (SELECT rule_id // 2 AS rule_id, source_label, canonical_value, match_type FROM mapping_rules
  UNION ALL SELECT -rule_id - 1, canonical_value, 'loop.' || CAST(rule_id % 3 AS VARCHAR), 'alias' FROM mapping_rules
  UNION ALL SELECT -rule_id - 1000000001, 'loop.' || CAST(rule_id % 3 AS VARCHAR), canonical_value, 'alias' FROM mapping_rules),
named AS (SELECT lower(source_label) AS s, canonical_value FROM rr WHERE match_type IN ('alias', 'synonym')),
edges AS (SELECT DISTINCT canonical_value AS a, s AS b FROM named WHERE s IN (SELECT canonical_value FROM named)),
reach AS (SELECT a, b FROM edges UNION SELECT reach.a, edges.b FROM reach JOIN edges ON reach.b = edges.a)
SELECT 'duplicate' AS conflict, CAST(rule_id AS VARCHAR) AS subject, count(*) - 1 AS n FROM rr GROUP BY rule_id HAVING count(*) > 1
UNION ALL SELECT 'conflicting', lower(source_label), count(DISTINCT canonical_value) FROM rr GROUP BY 2 HAVING count(DISTINCT canonical_value) > 1
UNION ALL SELECT 'missing_node', CAST(rule_id AS VARCHAR), 1 FROM rr WHERE canonical_value NOT IN (SELECT value FROM nodes)
UNION ALL SELECT 'circular', a, 1 FROM reach WHERE a = b
UNION ALL SELECT 'ambiguous_alias', s, count(DISTINCT canonical_value) FROM named GROUP BY 2 HAVING count(DISTINCT canonical_value) > 1""")
    def _(v):
        rules, rid = v.mapping_rules, F.col("rule_id")
        loop = F.concat(F.lit("loop."), (rid % 3).cast("string"))
        halved = rules.select(F.floor(rid / 2).alias("rule_id"), "source_label", "canonical_value", "match_type")
        forth = rules.select((-rid - 1).alias("rule_id"), F.col("canonical_value").alias("source_label"), loop.alias("canonical_value"), F.lit("alias").alias("match_type"))
        back = rules.select((-rid - 1000000001).alias("rule_id"), loop.alias("source_label"), "canonical_value", F.lit("alias").alias("match_type"))
        return mapping.conflicts(halved.union(forth).union(back), nodes_of(v))

    picks = {
        "first_wins": "arg_min(rule_id, created_at)",
        "last_wins": "arg_max(rule_id, created_at)",
        "highest_confidence": "first(rule_id ORDER BY confidence DESC, created_at)",
    }
    @r.add("o17_conflict_resolution", with_views("mapping_rules") + " UNION ALL ".join(
        f"SELECT lower(source_label) AS label, count(DISTINCT canonical_value) AS values, {pick} AS chosen_rule, '{name}' AS strategy FROM mapping_rules GROUP BY 1 HAVING count(DISTINCT canonical_value) > 1"
        for name, pick in picks.items()))
    def _(v):
        out = [mapping.resolve_conflicts(v.mapping_rules, s) for s in picks]
        return out[0].unionByName(out[1]).unionByName(out[2])

    @r.add("o18_rule_registry", with_views("mapping_rules") + """
SELECT dataset_name, source_label, rule_id, canonical_value, CAST(confidence AS DOUBLE) AS confidence, revisions FROM (
  SELECT *, count(*) OVER w AS revisions, row_number() OVER (w ORDER BY created_at DESC) AS rn FROM mapping_rules WINDOW w AS (PARTITION BY dataset_name, source_label))
WHERE rn = 1 AND rule_id % 10 <> 3""")
    def _(v):
        return mapping.current_rules(v.mapping_rules.withColumn("removed", F.col("rule_id") % 10 == 3))

    @r.add("o19_map_for_dataset", with_views("ontology_values", "nodes", "raw_labels", "alias_table", "pattern_table",
        more="mapping_rules AS (SELECT p_partkey AS rule_id, p_name AS source_label, CASE WHEN p_size <= 40 THEN lower(p_type) ELSE 'unlisted' END || '.' || regexp_replace(lower(p_brand), '[^a-z0-9]+', '_', 'g') AS canonical_value, (p_partkey % 100) / 100.0 AS confidence, p_partkey AS created_at FROM part WHERE p_type = 'ECONOMY'),\n" + MAPPED) + """
SELECT l.label, coalesce(canonical_value, 'unknown_object') AS canonical_value, coalesce(tier, 5) AS tier FROM raw_labels l LEFT JOIN ranked r ON l.label = r.label AND rank = 1""")
    def _(v):
        return mapping.map_for_dataset(v.raw_labels, v.mapping_rules, "ECONOMY", nodes_of(v), v.alias_table, v.pattern_table).select("label", "canonical_value", "tier")

    stat = """, t AS (SELECT DISTINCT dataset_name, lower(source_label) AS label, canonical_value, canonical_value IN (SELECT value FROM nodes) AS ok FROM mapping_rules),
p AS (SELECT dataset_name, label, count(*) AS n, bool_or(ok) AS ok, bool_or(NOT ok) AS bad FROM t GROUP BY 1, 2),
st AS (SELECT dataset_name, count(*) AS total_labels, count_if(ok) AS mapped_labels, count_if(bad) AS unknown_labels,
  round(count_if(ok) / count(*) * 100, 2) AS coverage_percent, count_if(n > 1) AS conflicts, CAST(sum(n - 1) AS BIGINT) AS duplicate_aliases FROM p GROUP BY 1)"""

    @r.add("a15_mapping_statistics", with_views(*NODES, "mapping_rules") + stat + "SELECT * FROM st")
    def _(v):
        return mapping.statistics(v.mapping_rules, nodes_of(v))

    @r.add("a16_coverage_status", with_views(*NODES, "mapping_rules") + stat + """
SELECT dataset_name, coverage_percent, CASE WHEN coverage_percent >= 95 THEN 'HEALTHY' WHEN coverage_percent >= 80 THEN 'ACCEPTABLE' ELSE 'NEEDS_ATTENTION' END AS status FROM st""")
    def _(v):
        return mapping.status(mapping.statistics(v.mapping_rules, nodes_of(v)))

    @r.add("a16_compatibility", with_views(*NODES, "mapping_rules") + stat + """
, pairs AS (SELECT DISTINCT p_type AS source, list_extract(['ECONOMY', 'STANDARD', 'PROMO'], CAST(p_partkey % 3 + 1 AS INT)) AS target FROM part)
SELECT source, target, round(abs(a.coverage_percent - b.coverage_percent), 2) AS difference, abs(a.coverage_percent - b.coverage_percent) <= 10 AS compatible
FROM pairs JOIN st a ON source = a.dataset_name JOIN st b ON target = b.dataset_name""")
    def _(v):
        pairs = v.table("part").select(
            F.col("p_type").alias("source"),
            F.element_at(F.array(*map(F.lit, ("ECONOMY", "STANDARD", "PROMO"))), (F.col("p_partkey") % 3 + 1).cast("int")).alias("target"),
        ).distinct()
        return mapping.compatibility(mapping.statistics(v.mapping_rules, nodes_of(v)), pairs)

    @r.add("a17_mapping_report", with_views("annotations", "mapping_rules", more=COUNTS) + """
, t AS (SELECT DISTINCT CASE WHEN confidence >= 0.5 THEN canonical_value ELSE canonical_value || '?' END AS label FROM mapping_rules)
SELECT dataset, count(*) AS classes, count(label) AS mapped, count(*) - count(label) AS unmapped, round(count(label) / count(*), 6) AS coverage
FROM counts LEFT JOIN t ON class_name = label GROUP BY 1""")
    def _(v):
        value = F.col("canonical_value")
        table = v.mapping_rules.select(F.when(F.col("confidence") >= 0.5, value).otherwise(F.concat(value, F.lit("?"))).alias("label")).distinct()
        return mapping.mapping_report(stats.class_counts(v.annotations), table)

    # Concepts -------------------------------------------------------------------
    spell = """spell AS (SELECT spelling, max(canonical_name) AS canonical_name FROM (
  SELECT canonical_name, unnest([n, replace(n, '_', ' '), replace(n, '-', ' ')]) AS spelling FROM (
    SELECT canonical_name, lower(unnest(aliases || [canonical_name])) AS n FROM concepts)) GROUP BY 1)"""

    @r.add("o03_synonym_map", with_views("concepts", "raw_labels", more=spell) + """
SELECT label, canonical_name, CASE WHEN canonical_name IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE AS confidence
FROM raw_labels LEFT JOIN spell ON spelling = replace(replace(lower(trim(label)), '_', ' '), '-', ' ')""")
    def _(v):
        return mapping.to_concept(v.raw_labels, v.concepts)

    @r.add("o04_aliases", with_views("concepts") + "SELECT canonical_name, unnest(aliases) AS alias FROM concepts")
    def _(v):
        return mapping.aliases_of(v.concepts)

    up = """, up AS (SELECT canonical_name AS node, parent_category AS ancestor, 1 AS distance FROM concepts WHERE parent_category IS NOT NULL
  UNION ALL SELECT node, parent_category, distance + 1 FROM up JOIN concepts ON ancestor = canonical_name WHERE parent_category IS NOT NULL AND distance < 4)"""

    @r.add("o05_ancestors", with_views("concepts") + up + "SELECT node, ancestor, distance FROM up")
    def _(v):
        return mapping.concept_parents(v.concepts)

    expanded = spell + """, found AS (SELECT p_name AS label, detector, c.* FROM (SELECT p_name, max(p_size % 11) / 10.0 AS detector FROM part GROUP BY 1)
  JOIN spell ON spelling = lower(p_name) JOIN concepts c USING (canonical_name)),
f AS (SELECT *, least(detector, confidence_base)::DOUBLE AS base FROM found)""" + up + """, e AS (
  SELECT label, canonical_name AS concept, round(greatest(0, least(1, least(base, detector))), 3) AS confidence, 0 AS r, 'direct' AS source FROM f
  UNION ALL SELECT label, ancestor, round(greatest(0, least(1, least(round(base * pow(0.9, distance), 3) * 0.9, detector))), 3), 1, 'category' FROM f JOIN up ON node = canonical_name
  UNION ALL SELECT label, unnest(equivalents), round(greatest(0, least(1, least(round(base * 0.88, 3) * 0.92, detector))), 3), 2, 'equivalent' FROM f)"""

    def asked(v):
        return v.table("part").groupBy(F.col("p_name").alias("label")).agg((F.max(F.col("p_size") % 11) / 10).alias("detector"))

    @r.add("o06_expand_concepts", with_views("concepts", more=expanded) + """
SELECT label, concept, max(confidence)::DOUBLE AS confidence, first(source ORDER BY confidence DESC, r) AS source FROM e GROUP BY 1, 2""")
    def _(v):
        return mapping.expand(asked(v), v.concepts)

    @r.add("o07_search_terms", with_views("concepts", more=spell) + up + """
, q AS (SELECT DISTINCT p_name AS query FROM part), f AS (SELECT query, canonical_name FROM q JOIN spell ON spelling = lower(query)),
t AS (SELECT query, query AS term, 0 AS place FROM q UNION ALL SELECT query, canonical_name, 1 FROM f
  UNION ALL SELECT query, ancestor, 2 FROM f JOIN up ON node = canonical_name
  UNION ALL SELECT query, unnest(equivalents), 2 FROM f JOIN concepts USING (canonical_name))
SELECT query, term, min(place) AS place FROM t GROUP BY 1, 2""")
    def _(v):
        return mapping.search_terms(v.table("part").select(F.col("p_name").alias("query")), v.concepts)

    # Trees ----------------------------------------------------------------------
    @r.add("o08_build_tree", with_views(*NODES) + "SELECT value, name, category, parent, depth, is_leaf FROM nodes")
    def _(v):
        return nodes_of(v)

    @r.add("o09_resolve_nodes", with_views(*NODES) + """
, k AS (SELECT parent, count(*) AS n FROM nodes WHERE parent IS NOT NULL GROUP BY 1)
SELECT a.value, a.parent, coalesce(c.n, 0) AS children, coalesce(s.n - 1, 0) AS siblings,
  CASE depth WHEN 0 THEN 'root' WHEN 1 THEN 'root > ' || a.value ELSE 'root > ' || a.category || ' > ' || a.value END AS path
FROM nodes a LEFT JOIN k c ON c.parent = a.value LEFT JOIN k s ON s.parent = a.parent""")
    def _(v):
        return hierarchy.resolve(nodes_of(v))

    @r.add("o10_leaves", with_views(*NODES) + "SELECT value, name FROM nodes WHERE value NOT IN (SELECT parent FROM nodes WHERE parent IS NOT NULL)")
    def _(v):
        return hierarchy.leaves(nodes_of(v)).select("value", "name")

    @r.add("o10_contains", with_views(*NODES, "mapping_rules") + "SELECT rule_id, canonical_value AS value FROM mapping_rules WHERE canonical_value IN (SELECT value FROM nodes)")
    def _(v):
        return hierarchy.contains(v.mapping_rules.select("rule_id", F.col("canonical_value").alias("value")), nodes_of(v))

    @r.add("o11_children", with_views("taxonomy") + "SELECT p.node_id, p.name, c.node_id AS child_id FROM taxonomy p JOIN taxonomy c ON c.parent_id = p.node_id")
    def _(v):
        return hierarchy.children(v.taxonomy)

    @r.add("o11_descendants", with_views("taxonomy") + """
, d AS (SELECT parent_id AS node_id, node_id AS descendant_id, 1 AS distance FROM taxonomy WHERE parent_id IS NOT NULL
  UNION ALL SELECT t.parent_id, descendant_id, distance + 1 FROM d JOIN taxonomy t ON t.node_id = d.node_id WHERE t.parent_id IS NOT NULL)
SELECT node_id, descendant_id, distance FROM d""")
    def _(v):
        return hierarchy.descendants(v.taxonomy)

    @r.add("o11_keyword_nodes", with_views("taxonomy") + """
, kw AS (SELECT DISTINCT p_brand AS k0 FROM part), words AS (SELECT replace(lower(k0), 'brand#', 'alias-') AS keyword FROM kw UNION ALL SELECT DISTINCT lower(r_name)[2:4] FROM region),
t AS (SELECT node_id, unnest(list_transform(aliases, lambda a: replace(lower(a), '-', ' ')) || list_transform(keywords, lambda k: lower(k)) || [lower(name)]) AS hay FROM taxonomy)
SELECT DISTINCT keyword, node_id FROM words JOIN t ON contains(hay, replace(replace(keyword, '_', ' '), '-', ' '))""")
    def _(v):
        brands = v.table("part").select(F.replace(F.lower("p_brand"), F.lit("brand#"), F.lit("alias-")).alias("keyword"))
        names = v.table("region").select(F.substring(F.lower("r_name"), 2, 3))
        return hierarchy.find_by_keyword(v.taxonomy, brands.union(names).distinct())

    @r.add("o12_taxonomy_coverage", with_views("taxonomy", more=COVERED) + """
, n AS (SELECT count(*) AS n FROM taxonomy), f AS (SELECT dataset, count(*) AS c FROM covered GROUP BY 1)
SELECT dataset, coalesce(c, 0) AS covered, n - coalesce(c, 0) AS uncovered, 0 AS partial, round(coalesce(c, 0) / n, 6) AS coverage_ratio
FROM (SELECT DISTINCT dataset FROM classes) LEFT JOIN f USING (dataset), n""")
    def _(v):
        return hierarchy.taxonomy_coverage(part_classes(v), v.taxonomy)

    @r.add("o12_domain_coverage", with_views("taxonomy", more=COVERED) + """
, s AS (SELECT domain, count(*) AS nodes FROM taxonomy GROUP BY 1), f AS (SELECT dataset, domain, count(*) AS c FROM covered GROUP BY 1, 2)
SELECT dataset, domain, nodes, coalesce(c, 0) AS covered, round(coalesce(c, 0) / nodes, 6) AS coverage_ratio
FROM (SELECT DISTINCT dataset FROM classes) CROSS JOIN s LEFT JOIN f USING (dataset, domain)""")
    def _(v):
        return hierarchy.domain_coverage(part_classes(v), v.taxonomy)


def joins_licenses(v, used):
    """Compatibility of the licenses that occur in the same source.

    A source has at most as many distinct licenses as the policy has rows, so the
    self-join of the distinct pairs is bounded per source.
    """
    rows = used.distinct().join(licenses.policy(v.spark), "license_id")
    whole = F.struct("license_id", "is_open", "commercial", "share_alike", "compatible")
    left = rows.select("source", whole.alias("a"))
    right = rows.select("source", whole.alias("b"))
    return left.join(right, "source").select(
        "source", F.col("a.license_id").alias("license_a"), F.col("b.license_id").alias("license_b"),
        licenses.compatibility("a", "b").alias("compatibility"),
    )
