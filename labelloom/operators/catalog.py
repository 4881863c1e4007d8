"""Catalog entries: scores, coverage, gaps, recommendations, sources and plans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom import config
from labelloom.functions import bins, confidence, licenses
from labelloom.operators import hierarchy
from labelloom.operators.skew import bucketed_running, top_k
from labelloom.operators.stats import count_if


def enriched(entries: DataFrame, profiles: DataFrame, sources: DataFrame) -> DataFrame:
    """Entry with its profile, license risk and source reliability, each where known."""
    return (
        entries.join(profiles, "entry_id", "left")
        .join(sources, "source_id", "left")
        .withColumn("license_risk", licenses.risk(F.col("license_id")))
    )


def source_reliability(fetches: DataFrame) -> DataFrame:
    """Fetch counters per source and the success share within 0.1..1."""
    done = fetches.groupBy("source_id").agg(
        F.count(F.lit(1)).alias("fetches"), count_if(F.col("success")).alias("succeeded"), count_if(~F.col("success")).alias("failed")
    )
    return done.withColumn("reliability", F.round(confidence.reliability(F.col("succeeded"), F.col("failed")), 6))


def _classes(profiles: DataFrame) -> DataFrame:
    return profiles.select(F.col("entry_id").alias("dataset"), "class_name").distinct()


def entry_scores(entries: DataFrame, class_profiles: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Five weighted scores of each entry.

    ``class_profiles`` has one row per entry and class with its count ``n``.
    """
    coverage = hierarchy.taxonomy_coverage(_classes(class_profiles), taxonomy).select(
        F.col("dataset").alias("entry_id"), "covered"
    )
    nodes = taxonomy.agg(F.count(F.lit(1)).alias("n")).scalar()
    spread = class_profiles.groupBy("entry_id").agg(
        (1 - (F.max("n") - F.min("n")) / F.nullif(F.max("n"), F.lit(0))).alias("_diversity")
    )
    images = F.greatest(F.col("images"), F.lit(1))
    penalty = lambda c: 1 - F.least(F.col(c) / images, F.lit(0.5))
    quality = F.coalesce(F.col("format_consistency") * penalty("missing") * penalty("corrupt"), F.lit(0.0))
    covered = F.coalesce(F.col("covered") / F.nullif(nodes, F.lit(0)), F.lit(0.0))
    diversity = F.coalesce("_diversity", F.lit(0.0))
    licence = F.when(F.col("license_score") > 0, F.col("license_score")).otherwise(F.coalesce(1 - licenses.risk(F.col("license_id")), F.lit(0.5)))
    w = config.CATALOG_WEIGHTS
    scored = entries.join(coverage, "entry_id", "left").join(spread, "entry_id", "left").select(
        "entry_id", "domain", quality.alias("_q"), covered.alias("_c"), diversity.alias("_d"), licence.alias("_l"),
        F.col("source_reliability").alias("_s"),
    )
    overall = (
        w["quality"] * F.col("_q") + w["coverage"] * F.col("_c") + w["diversity"] * F.col("_d") + w["license"] * F.col("_l") + w["source"] * F.col("_s")
    )
    # The scores that speak for the entry.
    strong = {"quality": ("_q", 0.7), "coverage": ("_c", 0.6), "diversity": ("_d", 0.6), "license": ("_l", 0.8)}
    reasons = F.concat_ws(", ", *[F.when(F.col(score) >= least, name) for name, (score, least) in strong.items()])
    return scored.select(
        "entry_id", "domain",
        *[F.round(c, 4).alias(n) for c, n in (("_q", "quality_score"), ("_c", "coverage_score"), ("_d", "diversity_score"), ("_l", "license_score"))],
        F.round(overall, 4).alias("overall_score"),
        reasons.alias("reason"),
    )


def recommend(scores: DataFrame, domain: str | None = None, limit: int = config.RECOMMENDATION_LIMIT, minimum: float = config.RECOMMENDATION_MIN_SCORE) -> DataFrame:
    rows = scores.where(F.col("overall_score") >= minimum)
    if domain is not None:
        rows = rows.where(F.col("domain") == domain)
    return rows.orderBy(F.desc("overall_score"), "entry_id").limit(limit)


def recommend_for_nodes(scores: DataFrame, class_profiles: DataFrame, taxonomy: DataFrame, limit: int = config.GAP_RECOMMENDATION_LIMIT) -> DataFrame:
    """Best entries covering each taxonomy node."""
    covered = hierarchy.covered_nodes(_classes(class_profiles), taxonomy).select(F.col("dataset").alias("entry_id"), "node_id")
    hits = covered.join(scores.select("entry_id", "overall_score"), "entry_id")
    return top_k(hits, ["node_id"], [F.desc("overall_score"), "entry_id"], limit).select("node_id", "entry_id", "overall_score", "rank")


def domain_means(class_profiles: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Mean coverage per taxonomy domain over all entries, with the three weakest and
    strongest. Entries that cover nothing of a domain count as 0."""
    classes = _classes(class_profiles)
    entries = classes.select("dataset").distinct().agg(F.count(F.lit(1)).alias("c")).scalar()
    sizes = taxonomy.groupBy("domain").agg(F.count(F.lit(1)).alias("nodes"))
    hits = hierarchy.covered_nodes(classes, taxonomy).groupBy("domain").agg(F.count(F.lit(1)).alias("hits"))
    means = sizes.join(hits, "domain", "left").select(
        "domain", "nodes",
        F.coalesce(F.coalesce("hits", F.lit(0)) / F.col("nodes") / F.nullif(entries, F.lit(0)), F.lit(0.0)).alias("coverage"),
    )
    low = means.orderBy("coverage", "domain").limit(3).select("domain", F.lit(True).alias("_low"))
    high = means.orderBy(F.desc("coverage"), F.desc("domain")).limit(3).select("domain", F.lit(True).alias("_high"))
    return means.join(low, "domain", "left").join(high, "domain", "left").select(
        "domain", "nodes", "coverage",
        F.coalesce("_low", F.lit(False)).alias("is_weakest"), F.coalesce("_high", F.lit(False)).alias("is_strongest"),
    )


def coverage_report(entries: DataFrame, class_profiles: DataFrame, taxonomy: DataFrame, entry_ids: Sequence[str] | None = None) -> DataFrame:
    """Mean taxonomy coverage of all entries, or of the chosen ones, and per entry domain."""
    per_entry = hierarchy.taxonomy_coverage(_classes(class_profiles), taxonomy).select(F.col("dataset").alias("entry_id"), "covered", "uncovered")
    rows = entries.select("entry_id", "domain").join(per_entry, "entry_id")
    if entry_ids is not None:
        rows = rows.where(F.col("entry_id").isin(*entry_ids))
    ratio = F.col("covered") / F.nullif(F.col("covered") + F.col("uncovered"), F.lit(0))
    mean = [F.count(F.lit(1)).alias("entries"), F.round(F.avg(ratio), 6).alias("coverage")]
    whole = rows.groupBy().agg(*mean).select(F.lit("all").alias("scope"), "entries", F.coalesce("coverage", F.lit(0.0)).alias("coverage"))
    return whole.unionByName(rows.groupBy(F.col("domain").alias("scope")).agg(*mean))


def gaps(class_profiles: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Taxonomy nodes that no entry covers, with severity and impact."""
    covered = hierarchy.covered_nodes(_classes(class_profiles), taxonomy).select("node_id").distinct()
    means = domain_means(class_profiles, taxonomy).select("domain", F.col("coverage").alias("_coverage"))
    severity = F.least((1 - F.col("_coverage")) * F.col("priority") * 1.5, F.lit(1.0))
    return (
        taxonomy.join(covered, "node_id", "left_anti")
        .join(means, "domain")
        .select("node_id", "name", "domain", "priority", F.round(severity, 4).alias("severity"), bins.gap_impact(severity).alias("impact"))
    )


def gap_report(found: DataFrame) -> DataFrame:
    """Gaps per domain by impact, and their mean severity."""
    return found.groupBy("domain").agg(
        F.count(F.lit(1)).alias("gaps"),
        *[count_if(F.col("impact") == k).alias(k) for k in ("critical", "high", "medium", "low")],
        F.round(F.avg("severity"), 6).alias("mean_severity"),
    )


def gap_recommendations(found: DataFrame, per_impact: int = 5) -> DataFrame:
    """First critical and first high gaps, with what to do."""
    urgent = found.where(F.col("impact").isin("critical", "high"))
    action = F.when(F.col("impact") == "critical", "get data now").otherwise("get data next")
    return top_k(urgent, ["impact"], ["node_id"], per_impact).select("impact", "rank", "node_id", "name", "severity", action.alias("action"))


def plan_totals(plans: DataFrame, entries: DataFrame, scores: DataFrame) -> DataFrame:
    """Budget, storage, domains, missing entries and new priority of each plan.

    ``plans`` has plan_id, priority, submitted and one row per entry_id.
    """
    facts = entries.select("entry_id", "storage_mb").join(scores.select("entry_id", "domain", "overall_score"), "entry_id")
    return plans.join(facts, "entry_id", "left").groupBy("plan_id", "submitted").agg(
        F.max("priority").alias("priority"),
        F.count(F.lit(1)).alias("entries"),
        count_if(F.col("overall_score").isNull()).alias("missing_entries"),
        F.count_distinct("domain").alias("domains"),
        F.round(F.coalesce(F.sum(F.col("overall_score") * 1000), F.lit(0.0)), 2).alias("budget"),
        F.round(F.coalesce(F.sum("storage_mb"), F.lit(0.0)), 2).alias("storage_mb"),
        F.round(F.least(F.coalesce(F.avg("overall_score"), F.lit(0.0)), F.lit(1.0)), 4).alias("new_priority"),
    )


def admit_plans(totals: DataFrame, bucket: Column) -> DataFrame:
    """Accept plans in order of submission until the limit of active ones is reached.

    A plan with an unknown entry, a low priority or too large a budget is refused and
    does not count. ``bucket`` must not decrease along (submitted, plan_id).
    """
    fault = (
        F.when(F.col("missing_entries") > 0, "unknown entry")
        .when(F.col("priority") < config.PLAN_MIN_PRIORITY, "low priority")
        .when(F.col("budget") > config.PLAN_BUDGET_LIMIT, "over budget")
    )
    marked = totals.withColumn("_fault", fault).withColumn("_ok", F.col("_fault").isNull().cast("long")).withColumn("_bucket", bucket)
    counted = bucketed_running(marked, [], "_bucket", ["submitted", "plan_id"], "_ok", "_good")
    full = F.col("_good") - F.col("_ok") >= config.MAX_ACTIVE_PLANS
    return counted.withColumn("decision", F.when(full, "too many active plans").otherwise(F.coalesce("_fault", F.lit("accepted")))).select(
        *totals.columns, "decision"
    )
