"""Search, metric history, registries and the catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelloom.operators import catalog, history, registry, search
from labelloom.plans.labels import COVERED
from labelloom.plans.views import with_views

INDEX = """idx AS (SELECT DISTINCT doc_id, token FROM (
  SELECT doc_id, unnest(regexp_extract_all(lower(body || ' ' || category || ' ' || origin), '[a-z0-9]+')) AS token FROM docs) WHERE length(token) >= 2)"""
KEYWORD = """kw AS (SELECT query_id, token, len, count(*) AS uses FROM (
  SELECT query_id, len(t) AS len, unnest(t) AS token FROM (SELECT query_id, regexp_extract_all(lower(query), '[a-z0-9]+') AS t FROM queries)) GROUP BY 1, 2, 3),
ks AS (SELECT query_id, doc_id, count(*) AS matched_tokens, sum(uses) * (1 + count(*) / any_value(len) * 1.5) AS score FROM kw JOIN idx USING (token) GROUP BY 1, 2),
kr AS (SELECT query_id, doc_id, matched_tokens, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM ks QUALIFY rank <= 10)"""
CATEGORY = """ck AS (SELECT query_id, doc_id, lower(category) AS key, CASE WHEN lower(category) = lower(trim(query)) THEN 1.0 ELSE 0.5 END::DOUBLE AS score
  FROM queries JOIN docs ON trim(query) <> '' AND contains(lower(category), lower(trim(query)))),
cr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM ck QUALIFY rank <= 10)"""
ATTRIBUTE = """ak AS (SELECT query_id, doc_id, CASE WHEN contains(lower(origin), lower(trim(query))) THEN 'origin:' || lower(origin) ELSE 'category:' || lower(category) END AS key, 1.0::DOUBLE AS score
  FROM queries JOIN docs ON trim(query) <> '' AND (contains(lower(origin), lower(trim(query))) OR contains(lower(category), lower(trim(query))))),
ar AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY doc_id) AS rank FROM ak QUALIFY rank <= 10)"""
SHORT = "queries AS (SELECT DISTINCT lang AS query_id, lang AS query FROM documents UNION SELECT source, source FROM documents UNION SELECT lang[1], lang[1] FROM documents)"
WHOLE = "queries AS (SELECT item_id AS query_id, text AS query FROM benchmark)"


def whole_queries(v):
    return v.table("benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def keyword_hits(v):
    queries = whole_queries(v)
    return search.keyword_search(search.keyword_index(v.documents, FIELDS), queries, parts=search.parts_for(v.documents, queries))


def short_queries(v):
    docs = v.table("documents")
    words = docs.select(F.col("lang").alias("q")).union(docs.select("source")).union(docs.select(F.left("lang", F.lit(1)))).distinct()
    return words.select(F.col("q").alias("query_id"), F.col("q").alias("query"))


FIELDS = ["body", "category", "origin"]

SCORES = COVERED.replace(
    "classes AS (SELECT DISTINCT p_name AS dataset, regexp_replace(lower(p_brand), '[^a-z0-9]+', '_', 'g') AS class_name FROM part)",
    "classes AS (SELECT entry_id AS dataset, class_name FROM class_profiles)",
) + """,
cov AS (SELECT dataset AS entry_id, count(*) AS c FROM covered GROUP BY 1), nn AS (SELECT count(*) AS n FROM taxonomy),
div AS (SELECT entry_id, 1 - (max(n) - min(n)) / max(n) AS d FROM class_profiles GROUP BY 1),
raw AS (SELECT entry_id, domain, format_consistency * (1 - least(missing / greatest(images, 1), 0.5)) * (1 - least(corrupt / greatest(images, 1), 0.5)) AS q,
  coalesce(c, 0) / nn.n AS c, d, CASE WHEN license_score > 0 THEN license_score ELSE 1 - CASE license_id WHEN 'cc0' THEN 0.0 WHEN 'cc_by_4' THEN 0.1 WHEN 'cc_by_sa_4' THEN 0.2 WHEN 'cc_nc' THEN 0.6
    WHEN 'mit' THEN 0.05 WHEN 'apache_2' THEN 0.05 WHEN 'odbl' THEN 0.3 WHEN 'pddl' THEN 0.0 WHEN 'proprietary' THEN 1.0 ELSE 0.8 END END::DOUBLE AS l, source_reliability::DOUBLE AS s
  FROM entries LEFT JOIN cov USING (entry_id) JOIN div USING (entry_id), nn),
scores AS (SELECT entry_id, domain, round(q, 4) AS quality_score, round(c, 4) AS coverage_score, round(d, 4) AS diversity_score, round(l, 4) AS license_score,
  round(0.3 * q + 0.25 * c + 0.15 * d + 0.15 * l + 0.15 * s, 4) AS overall_score,
  concat_ws(', ', CASE WHEN q >= 0.7 THEN 'quality' END, CASE WHEN c >= 0.6 THEN 'coverage' END, CASE WHEN d >= 0.6 THEN 'diversity' END, CASE WHEN l >= 0.8 THEN 'license' END) AS reason FROM raw)"""
MEANS = """dm AS (SELECT domain, nodes, coalesce(h, 0) / nodes / (SELECT count(DISTINCT dataset) FROM classes) AS coverage
  FROM (SELECT domain, count(*) AS nodes FROM taxonomy GROUP BY 1) LEFT JOIN (SELECT domain, count(*) AS h FROM covered GROUP BY 1) USING (domain)),
gap AS (SELECT node_id, name, domain, priority::DOUBLE AS priority, round(least((1 - coverage) * priority * 1.5, 1), 4) AS severity,
  CASE WHEN (1 - coverage) * priority * 1.5 >= 0.8 THEN 'critical' WHEN (1 - coverage) * priority * 1.5 >= 0.6 THEN 'high' WHEN (1 - coverage) * priority * 1.5 >= 0.4 THEN 'medium' ELSE 'low' END AS impact
  FROM taxonomy JOIN dm USING (domain) WHERE node_id NOT IN (SELECT node_id FROM covered))"""
CAT = ("entries", "class_profiles", "taxonomy")


def entry_scores(v):
    return catalog.entry_scores(v.entries, v.class_profiles, v.taxonomy)


def plans_of(v):
    """A plan per part; its entry is the part name, sometimes unknown."""
    size = F.col("p_size")
    entry = F.when(F.col("p_partkey") % 97 == 5, F.concat("p_name", F.lit("?"))).otherwise(F.col("p_name"))
    return v.table("part").select(
        F.col("p_partkey").alias("plan_id"), (F.col("p_partkey") % 31).alias("submitted"), entry.alias("entry_id"), (size % 10 / 10).alias("priority")
    )


def register(r) -> None:
    # Search ---------------------------------------------------------------------
    @r.add("r01_keyword_index", with_views("docs", more=INDEX) + "SELECT token, count(*) AS documents, min(doc_id) AS first_doc, CAST(sum(doc_id) AS BIGINT) AS id_sum FROM idx GROUP BY 1")
    def _(v):
        return search.keyword_index(v.documents, FIELDS).groupBy("token").agg(
            F.count("*").alias("documents"), F.min("doc_id").alias("first_doc"), F.sum("doc_id").alias("id_sum")
        )

    @r.add("r02_keyword_search", with_views("docs", more=INDEX + ",\n" + WHOLE + ",\n" + KEYWORD) + "SELECT * FROM kr")
    def _(v):
        return keyword_hits(v)

    @r.add("r03_category_search", with_views("docs", more=SHORT + ",\n" + CATEGORY) + "SELECT * FROM cr")
    def _(v):
        return search.category_search(v.documents, short_queries(v))

    @r.add("r04_attribute_search", with_views("docs", more=SHORT + ",\n" + ATTRIBUTE) + "SELECT * FROM ar")
    def _(v):
        return search.attribute_search(v.documents, short_queries(v), ["origin", "category"])

    @r.add("r05_hydrate", with_views("docs", more=INDEX + ",\n" + WHOLE + ",\n" + KEYWORD) + "SELECT query_id, doc_id, rank, category, origin FROM kr JOIN docs USING (doc_id)")
    def _(v):
        return search.hydrate(keyword_hits(v), v.documents, ["category", "origin"])

    @r.add("r06_retrieve", with_views("docs", more="""terms AS (SELECT DISTINCT source AS q, 1 AS place, lang AS term FROM documents UNION SELECT DISTINCT source, 0, source FROM documents
  UNION SELECT DISTINCT source, 2, lang[1] FROM documents UNION SELECT DISTINCT source, 3, 'en the ' || lang FROM documents),
queries AS (SELECT q || chr(1) || term AS query_id, term AS query FROM terms),
idx AS (SELECT DISTINCT doc_id, token FROM (SELECT doc_id, unnest(regexp_extract_all(lower(body), '[a-z0-9]+')) AS token FROM docs) WHERE length(token) >= 2)"""
        + ",\n" + KEYWORD + ",\n" + CATEGORY + ",\n" + ATTRIBUTE) + """
, h AS (SELECT query_id, doc_id, rank, 1 AS tier FROM kr UNION ALL SELECT query_id, doc_id, rank, 2 FROM cr UNION ALL SELECT query_id, doc_id, rank, 3 FROM ar),
b AS (SELECT * FROM h WHERE tier = (SELECT min(tier) FROM h g WHERE g.query_id = h.query_id)),
p AS (SELECT q AS query, doc_id, min((place, rank, tier)) AS f FROM b JOIN terms ON b.query_id = q || chr(1) || term GROUP BY 1, 2)
SELECT query, doc_id, f[1] AS place, f[2] AS rank, list_extract(['keyword', 'category', 'attribute'], f[3]) AS method FROM p""")
    def _(v):
        docs = v.table("documents")
        q = F.col("source").alias("query")
        terms = (
            docs.select(q, F.lit(1).alias("place"), F.col("lang").alias("term"))
            .union(docs.select(q, F.lit(0), F.col("source")))
            .union(docs.select(q, F.lit(2), F.left("lang", F.lit(1))))
            .union(docs.select(q, F.lit(3), F.concat(F.lit("en the "), F.col("lang"))))
            .distinct()
        )
        return search.retrieve(v.documents, terms, ["body"], ["origin", "category"])

    @r.add("r07_catalog_search", """SELECT c_custkey AS entry_id, c_name AS name, c_mktsegment AS domain FROM customer
WHERE (contains(lower(c_name), '77') OR contains(lower(c_mktsegment), 'house')) AND CASE WHEN c_acctbal > 0 THEN 'active' ELSE 'draft' END = 'active'""")
    def _(v):
        c = F.col
        entries = v.table("customer").select(
            c("c_custkey").alias("entry_id"), c("c_name").alias("name"), c("c_mktsegment").alias("domain"),
            F.when(c("c_acctbal") > 0, "active").otherwise("draft").alias("status"), F.lit("").alias("notes"), F.array(c("c_name")).alias("tags"),
        )
        hits = search.search_entries(entries, "77", status="active").unionByName(search.search_entries(entries, "House", status="active"))
        return hits.select("entry_id", "name", "domain").distinct()

    # Metrics --------------------------------------------------------------------
    @r.add("w01_best_metric", with_views("metrics") + """
SELECT experiment_id, value, event_id, 'min' AS mode FROM metrics QUALIFY row_number() OVER (PARTITION BY experiment_id ORDER BY value, ts, event_id) = 1
UNION ALL SELECT experiment_id, value, event_id, 'max' FROM metrics QUALIFY row_number() OVER (PARTITION BY experiment_id ORDER BY value DESC, ts, event_id) = 1""")
    def _(v):
        sides = [history.best_metric(v.metrics, m).select("experiment_id", "value", "event_id", F.lit(m).alias("mode")) for m in ("min", "max")]
        return sides[0].unionByName(sides[1])

    @r.add("w02_latest_metric", with_views("metrics") + """
SELECT experiment_id, event_id, value, event_type, count(*) OVER (PARTITION BY experiment_id) AS entries FROM metrics
QUALIFY row_number() OVER (PARTITION BY experiment_id ORDER BY ts DESC, event_id DESC) = 1""")
    def _(v):
        return history.latest_metric(v.metrics).drop("ts")

    @r.add("w03_metrics_of_experiment", with_views("metrics") + "SELECT experiment_id, event_id, value FROM metrics WHERE experiment_id BETWEEN 3 AND 8")
    def _(v):
        return history.metrics_of(v.metrics, F.col("experiment_id").between(3, 8)).select("experiment_id", "event_id", "value")

    epochs = "ep AS (SELECT experiment_id, event_id, value, row_number() OVER (PARTITION BY experiment_id ORDER BY ts, event_id) AS epoch FROM metrics)"

    @r.add("w03_epochs", with_views("metrics", more=epochs) + "SELECT experiment_id, event_id, epoch FROM ep")
    def _(v):
        return history.with_epoch(v.metrics).select("experiment_id", "event_id", "epoch")

    @r.add("w04_early_stopping", with_views("metrics", more=epochs) + """
, fold AS (SELECT experiment_id, epoch, value AS best, epoch AS best_epoch, 0 AS counter, false AS stopped FROM ep WHERE epoch = 1
  UNION ALL SELECT f.experiment_id, e.epoch, CASE WHEN e.value < f.best - 0.001::DOUBLE THEN e.value ELSE f.best END, CASE WHEN e.value < f.best - 0.001::DOUBLE THEN e.epoch ELSE f.best_epoch END,
    CASE WHEN e.value < f.best - 0.001::DOUBLE THEN 0 ELSE f.counter + 1 END, NOT e.value < f.best - 0.001::DOUBLE AND f.counter + 1 >= 10
  FROM fold f JOIN ep e ON e.experiment_id = f.experiment_id AND e.epoch = f.epoch + 1 WHERE NOT f.stopped)
SELECT experiment_id, best AS best_value, best_epoch, CAST(counter AS BIGINT) AS counter, CASE WHEN stopped THEN epoch END AS stopped_epoch FROM fold
QUALIFY row_number() OVER (PARTITION BY experiment_id ORDER BY epoch DESC) = 1""")
    def _(v):
        return history.early_stopping(history.with_epoch(v.metrics), rows_per_part=1000)

    @r.add("w05_checkpoints", with_views("metrics", more=epochs) + """
, b AS (SELECT *, max(value) OVER w AS best_value, max(value) OVER (PARTITION BY experiment_id ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev,
  max(epoch) OVER (PARTITION BY experiment_id) AS last, row_number() OVER (PARTITION BY experiment_id ORDER BY value DESC, epoch) AS r FROM ep WINDOW w AS (PARTITION BY experiment_id ORDER BY epoch))
SELECT experiment_id, epoch, value, best_value, prev IS NULL OR value > prev AS is_new_best, r = 1 AS is_best, epoch = last AS is_latest, epoch > last - 3 AS is_kept FROM b""")
    def _(v):
        return history.checkpoints(history.with_epoch(v.metrics))

    vers = """vl AS (SELECT DISTINCT dataset_name AS dataset, version, CAST(split_part(version, '.', 1) AS INT) AS major, CAST(split_part(version, '.', 2) AS INT) AS minor, CAST(split_part(version, '.', 3) AS INT) AS patch FROM mapping_rules)"""
    log = lambda v: v.mapping_rules.select(F.col("dataset_name").alias("dataset"), "version")

    @r.add("w06_parent_version", with_views("mapping_rules", more=vers) + "SELECT dataset, version, lag(version) OVER (PARTITION BY dataset ORDER BY major, minor, patch) AS parent_version FROM vl")
    def _(v):
        return history.parent_versions(log(v))

    curated = """s AS (SELECT *, sum((action = 'create')::INT) OVER (PARTITION BY entry_id ORDER BY ts, event_id) AS session FROM actions),
t AS (SELECT *, min(CASE WHEN action = 'submit' THEN (ts, event_id) END) OVER (PARTITION BY entry_id, session) AS sub FROM s),
d AS (SELECT *, min(CASE WHEN action IN ('approve', 'reject') AND (ts, event_id) > sub THEN (ts, event_id) END) OVER (PARTITION BY entry_id, session) AS dec FROM t),
e AS (SELECT *, max(CASE WHEN (ts, event_id) = dec THEN action END) OVER (PARTITION BY entry_id, session) AS verdict FROM d),
f AS (SELECT entry_id, ts, event_id, action, action = 'create' OR (session > 0 AND coalesce((ts, event_id) = sub, false)) OR (session > 0 AND coalesce((ts, event_id) = dec, false)) AS legal,
  CASE WHEN session = 0 THEN NULL WHEN (ts, event_id) >= dec THEN CASE verdict WHEN 'approve' THEN 'approved' ELSE 'rejected' END WHEN (ts, event_id) >= sub THEN 'pending_review' ELSE 'draft' END AS status FROM e),
g AS (SELECT *, lag(status) OVER (PARTITION BY entry_id ORDER BY ts, event_id) AS before FROM f),
cur AS (SELECT entry_id, event_id, ts, action, legal, status, CAST(sum(coalesce((status = 'pending_review')::INT, 0) - coalesce((before = 'pending_review')::INT, 0)) OVER (ORDER BY ts, event_id) AS BIGINT) AS pending FROM g)"""

    @r.add("w07_curation", with_views("actions", more=curated) + "SELECT entry_id, event_id, action, legal, status, pending, pending > 100 AS over_limit FROM cur")
    def _(v):
        return history.curation(v.actions).drop("ts")

    @r.add("c04_pending_entries", with_views("actions", more=curated) + """
SELECT entry_id, status FROM cur WHERE status IS NOT NULL QUALIFY row_number() OVER (PARTITION BY entry_id ORDER BY ts DESC, event_id DESC) = 1 AND status = 'pending_review'""")
    def _(v):
        return history.current_status(history.curation(v.actions)).where("status = 'pending_review'")

    # Registries -----------------------------------------------------------------
    @r.add("c01_dataset_registry", """
SELECT user_id, value, event_type, revisions FROM (SELECT *, count(*) OVER (PARTITION BY user_id) AS revisions, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events)
WHERE rn = 1 AND event_type <> 'error'""")
    def _(v):
        log_ = v.table("events").withColumn("deleted", F.col("event_type") == "error")
        return registry.latest(log_, ["user_id"], ["ts", "event_id"], ["value", "event_type"], "deleted")

    @r.add("c02_catalog_entries", """
WITH e AS (SELECT CASE WHEN o_orderstatus = 'P' THEN -1 - o_orderkey ELSE o_orderkey END AS id, 'old' AS origin, o_totalprice AS v FROM orders),
n AS (SELECT o_orderkey AS id, 'new' AS origin, o_totalprice AS v FROM orders), a AS (SELECT * FROM e UNION ALL SELECT * FROM n WHERE id NOT IN (SELECT id FROM e)),
u AS (SELECT CASE WHEN o_orderpriority = '1-URGENT' THEN o_orderkey ELSE o_orderkey + 1000000000000 END AS id, 'changed' AS origin, o_totalprice * 2 AS v FROM orders),
x AS (SELECT * FROM a WHERE id NOT IN (SELECT id FROM u) UNION ALL SELECT * FROM u WHERE id IN (SELECT id FROM a))
SELECT origin, count(*) AS entries FROM x WHERE id NOT IN (SELECT CASE WHEN l_quantity < 3 THEN l_orderkey ELSE l_orderkey + 1000000000000 END FROM lineitem) GROUP BY 1""")
    def _(v):
        orders = v.table("orders")
        row = lambda key, origin, value: orders.select(key.alias("id"), F.lit(origin).alias("origin"), value.alias("v"))
        key, price, away = F.col("o_orderkey"), F.col("o_totalprice"), 1_000_000_000_000
        old = row(F.when(F.col("o_orderstatus") == "P", -1 - key).otherwise(key), "old", price)
        full = registry.insert(old, row(key, "new", price), ["id"])
        changed = registry.update(full, row(F.when(F.col("o_orderpriority") == "1-URGENT", key).otherwise(key + away), "changed", price * 2), ["id"])
        line = F.col("l_orderkey")
        gone = v.table("lineitem").select(F.when(F.col("l_quantity") < 3, line).otherwise(line + away).alias("id")).distinct()
        return registry.count_by(registry.remove(changed, gone, ["id"]), ["origin"])

    @r.add("c03_sources_by_type", "SELECT c_custkey AS source_id, c_name AS name FROM customer WHERE c_mktsegment = 'BUILDING'")
    def _(v):
        return registry.list_by(v.table("customer"), F.col("c_mktsegment") == "BUILDING", ["c_custkey"]).select(
            F.col("c_custkey").alias("source_id"), F.col("c_name").alias("name")
        )

    @r.add("c06_version_list", with_views("mapping_rules", more=vers) + "SELECT dataset, version, major, minor, patch FROM vl ORDER BY dataset, major DESC, minor DESC, patch DESC")
    def _(v):
        return registry.version_list(log(v))

    @r.add("c06_latest_version", with_views("mapping_rules", more=vers) + "SELECT dataset, version FROM vl QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY major DESC, minor DESC, patch DESC) = 1")
    def _(v):
        return registry.latest_version(log(v))

    @r.add("c07_models", """
SELECT p_name AS name, p_brand AS stage, p_retailprice AS map50, revisions FROM (SELECT *, count(*) OVER (PARTITION BY p_name) AS revisions, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey DESC) AS rn FROM part) WHERE rn = 1""")
    def _(v):
        models = v.table("part").select(
            F.col("p_name").alias("name"), "p_partkey", F.col("p_brand").alias("stage"), F.create_map(F.lit("map50"), F.col("p_retailprice")).alias("metrics")
        )
        # A map has no order, so it travels as its sorted entries.
        entries = models.withColumn("metrics", F.array_sort(F.map_entries("metrics")))
        newest = registry.latest(entries, ["name"], ["p_partkey"], ["stage", "metrics"])
        return newest.select("name", "stage", F.map_from_entries("metrics")["map50"].alias("map50"), "revisions")

    # Catalog --------------------------------------------------------------------
    @r.add("a20_source_reliability", """
SELECT user_id AS source_id, count(*) AS fetches, count_if(event_type <> 'error') AS succeeded, count_if(event_type = 'error') AS failed,
  round(greatest(0.1, least(1.0, count_if(event_type <> 'error') / count(*))), 6) AS reliability FROM events GROUP BY 1""")
    def _(v):
        return catalog.source_reliability(v.table("events").select(F.col("user_id").alias("source_id"), (F.col("event_type") != "error").alias("success")))

    @r.add("j07_enriched_entries", with_views(*CAT) + """
, p AS (SELECT CASE WHEN n > 1 THEN entry_id ELSE entry_id || '?' END AS entry_id, count(*) AS classes, CAST(sum(n) AS BIGINT) AS annotations FROM class_profiles GROUP BY 1),
s AS (SELECT user_id AS source_id, round(greatest(0.1, least(1.0, count_if(event_type <> 'error') / count(*))), 6) AS reliability FROM events GROUP BY 1)
SELECT entry_id, source_id, classes, annotations, reliability, CASE license_id WHEN 'cc0' THEN 0.0 WHEN 'cc_by_4' THEN 0.1 WHEN 'cc_by_sa_4' THEN 0.2 WHEN 'cc_nc' THEN 0.6
  WHEN 'mit' THEN 0.05 WHEN 'apache_2' THEN 0.05 WHEN 'odbl' THEN 0.3 WHEN 'pddl' THEN 0.0 WHEN 'proprietary' THEN 1.0 ELSE 0.8 END::DOUBLE AS license_risk
FROM entries LEFT JOIN p USING (entry_id) LEFT JOIN s USING (source_id)""")
    def _(v):
        entry = F.when(F.col("n") > 1, F.col("entry_id")).otherwise(F.concat("entry_id", F.lit("?")))
        profiles = v.class_profiles.groupBy(entry.alias("entry_id")).agg(F.count("*").alias("classes"), F.sum("n").alias("annotations"))
        fetches = v.table("events").select(F.col("user_id").alias("source_id"), (F.col("event_type") != "error").alias("success"))
        sources = catalog.source_reliability(fetches).select("source_id", "reliability")
        return catalog.enriched(v.entries, profiles, sources).select("entry_id", "source_id", "classes", "annotations", "reliability", "license_risk")

    @r.add("q04_entry_scores", with_views(*CAT, more=SCORES) + "SELECT * FROM scores")
    def _(v):
        return entry_scores(v)

    @r.add("w08_recommend", with_views(*CAT, more=SCORES) + "SELECT entry_id, domain, overall_score FROM scores WHERE overall_score >= 0.3 ORDER BY overall_score DESC, entry_id LIMIT 20")
    def _(v):
        return catalog.recommend(entry_scores(v)).select("entry_id", "domain", "overall_score")

    @r.add("w09_recommend_for_nodes", with_views(*CAT, more=SCORES) + """
SELECT node_id, entry_id, overall_score, row_number() OVER (PARTITION BY node_id ORDER BY overall_score DESC, entry_id) AS rank FROM covered JOIN scores ON dataset = entry_id QUALIFY rank <= 10""")
    def _(v):
        return catalog.recommend_for_nodes(entry_scores(v), v.class_profiles, v.taxonomy)

    @r.add("a18_domain_means", with_views(*CAT, more=SCORES + ",\n" + MEANS) + """
SELECT domain, nodes, round(coverage, 6) AS coverage, row_number() OVER (ORDER BY coverage, domain) <= 3 AS is_weakest, row_number() OVER (ORDER BY coverage DESC, domain DESC) <= 3 AS is_strongest FROM dm""")
    def _(v):
        return catalog.domain_means(v.class_profiles, v.taxonomy).withColumn("coverage", F.round("coverage", 6))

    @r.add("a18_catalog_coverage", with_views(*CAT, more=SCORES) + """
SELECT scope, count(*) AS entries, round(avg(c), 6) AS coverage FROM (SELECT domain AS scope, c FROM raw UNION ALL SELECT 'all', c FROM raw) GROUP BY 1""")
    def _(v):
        return catalog.coverage_report(v.entries, v.class_profiles, v.taxonomy)

    @r.add("q06_gap_severity", with_views(*CAT, more=SCORES + ",\n" + MEANS) + "SELECT * FROM gap")
    def _(v):
        return catalog.gaps(v.class_profiles, v.taxonomy)

    @r.add("a19_gap_report", with_views(*CAT, more=SCORES + ",\n" + MEANS) + """
SELECT domain, count(*) AS gaps, count_if(impact = 'critical') AS critical, count_if(impact = 'high') AS high, count_if(impact = 'medium') AS medium, count_if(impact = 'low') AS low,
  round(avg(severity), 6) AS mean_severity FROM gap GROUP BY 1""")
    def _(v):
        return catalog.gap_report(catalog.gaps(v.class_profiles, v.taxonomy))

    @r.add("w10_gap_recommendations", with_views(*CAT, more=SCORES + ",\n" + MEANS) + """
SELECT impact, row_number() OVER (PARTITION BY impact ORDER BY node_id) AS rank, node_id, name, severity,
  CASE impact WHEN 'critical' THEN 'get data now' ELSE 'get data next' END AS action
FROM gap WHERE impact IN ('critical', 'high') QUALIFY rank <= 5""")
    def _(v):
        return catalog.gap_recommendations(catalog.gaps(v.class_profiles, v.taxonomy))

    plan = """, pl AS (SELECT p_partkey AS plan_id, p_partkey % 31 AS submitted, CASE WHEN p_partkey % 97 = 5 THEN p_name || '?' ELSE p_name END AS entry_id, (p_size % 10) / 10.0 AS priority FROM part),
tp AS (SELECT plan_id, submitted, max(priority)::DOUBLE AS priority, count(*) AS entries, count_if(overall_score IS NULL) AS missing_entries, count(DISTINCT s.domain) AS domains,
  round(coalesce(sum(overall_score * 1000), 0), 2) AS budget, round(coalesce(sum(storage_mb), 0), 2) AS storage_mb, round(least(coalesce(avg(overall_score), 0), 1), 4) AS new_priority
  FROM pl LEFT JOIN scores s USING (entry_id) LEFT JOIN entries e USING (entry_id) GROUP BY 1, 2)"""

    def totals(v):
        return catalog.plan_totals(plans_of(v), v.entries, entry_scores(v))

    @r.add("a21_plan_totals", with_views(*CAT, more=SCORES) + plan + "SELECT * FROM tp")
    def _(v):
        return totals(v)

    admitted = plan + """, ok AS (SELECT *, CASE WHEN missing_entries > 0 THEN 'unknown entry' WHEN priority < 0.4 THEN 'low priority' WHEN budget > 10000 THEN 'over budget' END AS fault FROM tp),
rn AS (SELECT *, coalesce(sum((fault IS NULL)::INT) OVER (ORDER BY submitted, plan_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM ok),
adm AS (SELECT plan_id, priority, budget, CASE WHEN before >= 5 THEN 'too many active plans' ELSE coalesce(fault, 'accepted') END AS decision FROM rn)"""

    @r.add("a21_plan_admission", with_views(*CAT, more=SCORES) + admitted + "SELECT * FROM adm")
    def _(v):
        return catalog.admit_plans(totals(v), F.col("submitted")).select("plan_id", "priority", "budget", "decision")

    @r.add("c05_active_plans", with_views(*CAT, more=SCORES) + admitted + "SELECT plan_id, budget FROM adm WHERE decision = 'accepted'")
    def _(v):
        return catalog.admit_plans(totals(v), F.col("submitted")).where("decision = 'accepted'").select("plan_id", "budget")
