"""Label mapping: rules, aliases, synonyms, patterns and the ontology itself."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom import config
from labelloom.functions import bins, confidence, text
from labelloom.operators.hierarchy import ancestors, cycles
from labelloom.operators.joins import labels_in_nodes, regex_matches
from labelloom.operators.skew import top_k

UNKNOWN = "unknown_object"
#: So many patterns cost less to try on every label than to index.
FEW_PATTERNS = 64
CANDIDATE = ("label", "tier", "place", "canonical_value", "confidence", "rule_id")


def alias_rows(rows: DataFrame, value: Column, alias: Column, kind: str) -> DataFrame:
    """Registered aliases or synonyms as a table."""
    return rows.select(value.alias("canonical_value"), F.lower(alias).alias("alias"), F.lit(kind).alias("kind")).distinct()


def regex_rows(rows: DataFrame, value: Column, pattern: Column, weight: Column | None = None) -> DataFrame:
    """Registered patterns as a table; the default confidence is 0.7."""
    return rows.select(
        pattern.alias("pattern"), value.alias("canonical_value"), (F.lit(0.7) if weight is None else weight).alias("confidence")
    ).distinct()


def _first_rule(rules: DataFrame, key: Column) -> DataFrame:
    """First rule per key; rules are ordered by creation, then id."""
    first = F.min(F.struct("created_at", "rule_id", "canonical_value", "confidence")).alias("_r")
    return rules.groupBy(key.alias("_key")).agg(first).select("_key", "_r.rule_id", "_r.canonical_value", "_r.confidence")


def candidates(labels: DataFrame, rules: DataFrame, nodes: DataFrame, aliases: DataFrame, patterns: DataFrame) -> DataFrame:
    """All mapping candidates of distinct trimmed labels; a lower tier wins."""
    lab = labels.select(F.trim("label").alias("label")).distinct().withColumn("_low", F.lower("label"))
    known = nodes.select(F.col("value").alias("canonical_value"))
    source = F.trim("source_label")

    def shaped(df: DataFrame, tier: int, place: int, weight: Column) -> DataFrame:
        rule = F.col("rule_id").cast("string") if "rule_id" in df.columns else F.lit(None).cast("string")
        return df.select(
            "label", F.lit(tier).alias("tier"), F.lit(place).alias("place"), "canonical_value", weight.alias("confidence"), rule.alias("rule_id")
        )

    by_text = _first_rule(rules, source)
    by_lower = _first_rule(rules, F.lower(source))
    single = lab.withColumn("_one", text.singular(F.col("_low"))).where("_one <> _low")
    every_rule = rules.select(F.lower(source).alias("_one"), "canonical_value").join(known, "canonical_value", "left_semi")
    named = aliases.join(known, "canonical_value", "left_semi").withColumnRenamed("alias", "_low")
    similar = labels_in_nodes(lab, nodes).withColumn(
        "_s", text.character_similarity(F.lower("label"), F.lower("name"))
    ).withColumnRenamed("value", "canonical_value")
    parts = [
        shaped(lab.join(by_text.withColumnRenamed("_key", "label"), "label"), 1, 0, F.col("confidence")),
        shaped(lab.join(by_lower.withColumnRenamed("_key", "_low"), "_low"), 2, 0, F.col("confidence") * 0.95),
        shaped(lab.join(named.where("kind = 'alias'"), "_low"), 3, 1, F.lit(0.9)),
        shaped(lab.join(named.where("kind = 'synonym'"), "_low"), 3, 2, F.lit(0.7)),
        shaped(single.join(every_rule, "_one"), 3, 3, F.lit(0.85)),
        shaped(regex_matches(lab, patterns, few=FEW_PATTERNS), 3, 4, F.col("confidence")),
        shaped(similar.where("_s > 0.3"), 4, 5, F.col("_s")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def map_labels(labels: DataFrame, rules: DataFrame, nodes: DataFrame, aliases: DataFrame, patterns: DataFrame) -> DataFrame:
    """Best mapping per distinct label and up to three alternatives of the same tier.

    Only the vocabulary is mapped; annotations get the result by a join on the label.
    """
    lab = labels.select(F.trim("label").alias("label")).distinct()
    order = ["tier", F.desc("confidence"), "place", "canonical_value", "rule_id"]
    best = top_k(candidates(labels, rules, nodes, aliases, patterns), ["label"], order, 4)
    ranked = best.groupBy("label").agg(
        F.array_sort(F.collect_list(F.struct("rank", "tier", "canonical_value", "confidence", "rule_id"))).alias("_c")
    )
    first = F.get("_c", 0)
    rest = F.filter(F.slice("_c", 2, 3), lambda c: (c["tier"] >= 3) & (c["tier"] == first["tier"]))
    tier = F.coalesce(first["tier"], F.lit(5))
    score = F.coalesce(first["confidence"], F.lit(0.0))
    value = F.coalesce(first["canonical_value"], F.lit(UNKNOWN))
    names = nodes.select(F.col("value").alias("canonical_value"), F.col("name").alias("_name"))
    return (
        lab.join(ranked, "label", "left")
        .select(
            "label", value.alias("canonical_value"), score.alias("confidence"), tier.alias("tier"),
            F.when(tier == 1, "exact")
            .when(tier == 2, "case_insensitive")
            .when(score < 0.9, "synonym")
            .otherwise("alias")
            .alias("match_type"),
            F.when(tier <= 2, first["rule_id"]).alias("rule_id"),
            F.coalesce(F.transform(rest, lambda c: c["canonical_value"]), F.array().cast("array<string>")).alias("alternatives"),
        )
        .join(names, "canonical_value", "left")
        .withColumn(
            "canonical_name",
            F.when(F.col("tier") == 5, "Unknown Object").otherwise(F.coalesce("_name", "canonical_value")),
        )
        .drop("_name")
    )


def map_for_dataset(labels: DataFrame, rules: DataFrame, dataset: str, nodes: DataFrame, aliases: DataFrame, patterns: DataFrame) -> DataFrame:
    """Map with the rules of one data set only."""
    return map_labels(labels, rules.where(F.col("dataset_name") == dataset), nodes, aliases, patterns)


def best_rules(rules: DataFrame) -> DataFrame:
    """Label to value table: the first rule of each lower-cased label."""
    return _first_rule(rules, F.lower(F.trim("source_label"))).select(F.col("_key").alias("label"), "canonical_value", "confidence")


def translate(labels: DataFrame, rules: DataFrame, nodes: DataFrame) -> DataFrame:
    """Value of each label, ``unknown_object`` when no rule leads to a known node."""
    known = nodes.select(F.col("value").alias("canonical_value"), F.lit(True).alias("_known"))
    table = best_rules(rules).withColumnRenamed("label", "_low")
    return (
        labels.select("label").distinct().withColumn("_low", F.lower(F.trim("label")))
        .join(table, "_low", "left")
        .join(known, "canonical_value", "left")
        .select("label", F.when(F.col("_known"), F.col("canonical_value")).otherwise(UNKNOWN).alias("canonical_value"))
    )


def apply_mapping(annotations: DataFrame, table: DataFrame, label: str = "label") -> DataFrame:
    """Set ``ontology_class`` from a (label, canonical_value) table with one row per label."""
    keyed = table.select(F.col("label").alias(label), F.col("canonical_value").alias("_value"))
    return annotations.join(keyed, label, "left").withColumn(
        "ontology_class", F.coalesce("_value", text.blank_to_null(F.col("ontology_class")))
    ).drop("_value")


def mapping_report(classes: DataFrame, table: DataFrame) -> DataFrame:
    """Mapped and unmapped classes and the covered share per data set."""
    keyed = table.select(F.col("label").alias("class_name"), F.lit(1).alias("_hit"))
    return (
        classes.select("dataset", "class_name").distinct()
        .join(keyed, "class_name", "left")
        .groupBy("dataset")
        .agg(
            F.count(F.lit(1)).alias("classes"),
            F.count("_hit").alias("mapped"),
            (F.count(F.lit(1)) - F.count("_hit")).alias("unmapped"),
            F.round(F.count("_hit") / F.count(F.lit(1)), 6).alias("coverage"),
        )
    )


def harmonize(classes: DataFrame, table: DataFrame) -> DataFrame:
    """Final class of each class of each data set, and in how many data sets it occurs."""
    keyed = table.select(F.col("label").alias("class_name"), F.col("canonical_value").alias("_value"))
    final = classes.select("dataset", "class_name").distinct().join(keyed, "class_name", "left").withColumn(
        "final_class", F.coalesce("_value", text.class_name(F.col("class_name")))
    )
    return final.groupBy("final_class").agg(
        F.count_distinct("dataset").alias("datasets"), F.count_distinct("class_name").alias("source_classes")
    )


# Statistics -------------------------------------------------------------------------


def statistics(rules: DataFrame, nodes: DataFrame) -> DataFrame:
    """Mapped and unknown labels, coverage, conflicts and extra targets per data set.

    A label with one known and one unknown target counts on both sides.
    """
    known = nodes.select(F.col("value").alias("canonical_value"), F.lit(True).alias("_known"))
    targets = (
        rules.select("dataset_name", F.lower("source_label").alias("label"), "canonical_value").distinct()
        .join(known, "canonical_value", "left")
        .withColumn("_ok", F.coalesce("_known", F.lit(False)) & (F.col("canonical_value") != UNKNOWN))
    )
    per_label = targets.groupBy("dataset_name", "label").agg(
        F.count(F.lit(1)).alias("values"), F.max("_ok").alias("ok"), F.max(~F.col("_ok")).alias("bad")
    )
    percent = F.count_if("ok") / F.count(F.lit(1)) * 100
    return per_label.groupBy("dataset_name").agg(
        F.count(F.lit(1)).alias("total_labels"),
        F.count_if("ok").alias("mapped_labels"),
        F.count_if("bad").alias("unknown_labels"),
        F.round(percent, 2).alias("coverage_percent"),
        F.count_if(F.col("values") > 1).alias("conflicts"),
        F.sum(F.col("values") - 1).alias("duplicate_aliases"),
    )


def status(stats: DataFrame) -> DataFrame:
    return stats.select("dataset_name", "coverage_percent", bins.coverage_status(F.col("coverage_percent")).alias("status"))


def compatibility(stats: DataFrame, pairs: DataFrame) -> DataFrame:
    """Coverage difference of the named (source, target) pairs of data sets."""
    one = stats.select(F.col("dataset_name").alias("source"), F.col("coverage_percent").alias("_a"))
    two = stats.select(F.col("dataset_name").alias("target"), F.col("coverage_percent").alias("_b"))
    gap = F.abs(F.col("_a") - F.col("_b"))
    return pairs.join(one, "source").join(two, "target").select(
        "source", "target", F.round(gap, 2).alias("difference"), (F.round(gap, 6) <= 10).alias("compatible")
    )


# Conflicts --------------------------------------------------------------------------


def conflicts(rules: DataFrame, nodes: DataFrame) -> DataFrame:
    """Duplicate rule ids, labels with several values, missing nodes, real alias cycles
    and ambiguous aliases, one row each."""
    low = F.lower("source_label")
    named = rules.where(F.col("match_type").isin("alias", "synonym"))

    def shaped(df: DataFrame, kind: str, subject: Column, n: Column) -> DataFrame:
        return df.select(F.lit(kind).alias("conflict"), subject.cast("string").alias("subject"), n.cast("long").alias("n"))

    repeated = rules.groupBy("rule_id").agg((F.count(F.lit(1)) - 1).alias("n")).where("n > 0")
    several = rules.groupBy(low.alias("s")).agg(F.count_distinct("canonical_value").alias("n")).where("n > 1")
    absent = rules.join(nodes.select(F.col("value").alias("canonical_value")), "canonical_value", "left_anti")
    ambiguous = named.groupBy(low.alias("s")).agg(F.count_distinct("canonical_value").alias("n")).where("n > 1")
    targets = named.select(F.col("canonical_value").alias("parent")).distinct()
    links = named.select(F.col("canonical_value").alias("node"), low.alias("parent")).distinct().join(targets, "parent", "left_semi")
    return (
        shaped(repeated, "duplicate", F.col("rule_id"), F.col("n"))
        .unionByName(shaped(several, "conflicting", F.col("s"), F.col("n")))
        .unionByName(shaped(absent, "missing_node", F.col("rule_id"), F.lit(1)))
        .unionByName(shaped(cycles(links), "circular", F.col("node"), F.lit(1)))
        .unionByName(shaped(ambiguous, "ambiguous_alias", F.col("s"), F.col("n")))
    )


def resolve_conflicts(rules: DataFrame, strategy: str = "highest_confidence") -> DataFrame:
    """One rule per label that has several values.

    Ties fall to the earlier rule. ``manual`` lists the labels without choosing.
    """
    first = F.struct("created_at", "rule_id")
    picked = {
        "first_wins": F.min_by("rule_id", first),
        "last_wins": F.max_by("rule_id", first),
        "highest_confidence": F.min_by("rule_id", F.struct((-F.col("confidence")).alias("c"), "created_at", "rule_id")),
        "manual": F.lit(None).cast("string"),
    }[strategy]
    return (
        rules.groupBy(F.lower("source_label").alias("label"))
        .agg(F.count_distinct("canonical_value").alias("values"), picked.alias("chosen_rule"))
        .where("values > 1")
        .withColumn("strategy", F.lit(strategy))
    )


def current_rules(rules: DataFrame, key: Sequence[str] = ("dataset_name", "source_label")) -> DataFrame:
    """Latest rule of an append-only registry per key; a removed rule is a row with
    ``removed`` true."""
    newest = F.struct("created_at", "rule_id", "canonical_value", "confidence", "removed")
    return (
        rules.groupBy(*key)
        .agg(F.max(newest).alias("_r"), F.count(F.lit(1)).alias("revisions"))
        .where("NOT _r.removed")
        .select(*key, "_r.rule_id", "_r.canonical_value", "_r.confidence", "revisions")
    )


# Concepts ---------------------------------------------------------------------------


def spellings(concepts: DataFrame) -> DataFrame:
    """(spelling, canonical_name): names and aliases with ``_`` and ``-`` also as spaces.

    Where two concepts share a spelling the one later in name order is kept.
    """
    names = F.transform(F.array_append(F.col("aliases"), F.col("canonical_name")), lambda n: F.lower(n))
    forms = F.flatten(
        F.transform(names, lambda n: F.array(n, F.replace(n, F.lit("_"), F.lit(" ")), F.replace(n, F.lit("-"), F.lit(" "))))
    )
    return (
        concepts.select("canonical_name", F.explode(F.array_distinct(forms)).alias("spelling"))
        .groupBy("spelling")
        .agg(F.max("canonical_name").alias("canonical_name"))
    )


def to_concept(labels: DataFrame, concepts: DataFrame) -> DataFrame:
    """Canonical concept of each label by its spelling, with confidence 1 or 0."""
    key = F.translate(F.lower(F.trim("label")), "_-", "  ")
    return (
        labels.select("label").distinct().withColumn("spelling", key)
        .join(spellings(concepts), "spelling", "left")
        .select("label", "canonical_name", F.when(F.col("canonical_name").isNull(), 0.0).otherwise(1.0).alias("confidence"))
    )


def aliases_of(concepts: DataFrame) -> DataFrame:
    return concepts.select("canonical_name", F.explode("aliases").alias("alias"))


def concept_parents(concepts: DataFrame) -> DataFrame:
    """Ancestors of concepts, at most four levels; a parent that is no concept ends the walk."""
    return ancestors(concepts.select(F.col("canonical_name").alias("node"), F.col("parent_category").alias("parent")))


def expand(labels: DataFrame, concepts: DataFrame) -> DataFrame:
    """Concepts a (label, detector) row leads to, each with its best confidence.

    The concept itself, its parents at 0.9 per level, and its equivalents at 0.88, each
    times the factor of its source and never above the detector's confidence.
    """
    key = F.translate(F.lower(F.trim("label")), "_-", "  ")
    base = F.least("detector", "confidence_base")
    facts = concepts.select("canonical_name", "confidence_base", "equivalents")
    found = (
        labels.withColumn("spelling", key)
        .join(spellings(concepts), "spelling")
        .join(facts, "canonical_name")
        .select("label", "detector", "canonical_name", "equivalents", base.alias("base"))
    )
    direct = found.select(
        "label", F.col("canonical_name").alias("concept"),
        confidence.adjust(F.col("detector"), F.col("base"), F.lit(0)).alias("confidence"), F.lit("direct").alias("source"),
    )
    up = concept_parents(concepts).withColumnRenamed("node", "canonical_name")
    raised = F.round(F.col("base") * F.pow(F.lit(config.CATEGORY_DECAY), F.col("distance")), 3)
    category = found.join(up, "canonical_name").select(
        "label", F.col("ancestor").alias("concept"),
        confidence.adjust_by_source(F.col("detector"), raised, F.lit("category")).alias("confidence"), F.lit("category").alias("source"),
    )
    same = F.round(F.col("base") * config.EQUIVALENT_DECAY, 3)
    equivalent = found.withColumn("concept", F.explode("equivalents")).select(
        "label", "concept",
        confidence.adjust_by_source(F.col("detector"), same, F.lit("equivalent")).alias("confidence"), F.lit("equivalent").alias("source"),
    )
    # On equal confidence the direct concept comes before parents, parents before equivalents.
    rank = F.when(F.col("source") == "direct", 0).when(F.col("source") == "category", 1).otherwise(2)
    return (
        direct.unionByName(category).unionByName(equivalent)
        .groupBy("label", "concept")
        .agg(F.max("confidence").alias("confidence"), F.min_by("source", F.struct((-F.col("confidence")).alias("c"), rank.alias("r"))).alias("source"))
    )


def search_terms(queries: DataFrame, concepts: DataFrame) -> DataFrame:
    """(query, place, term): the query, its concept, then the expanded concepts."""
    asked = queries.select(F.col("query").alias("label"), F.lit(1.0).alias("detector")).distinct()
    own = asked.select(F.col("label").alias("query"), F.lit(0).alias("place"), F.col("label").alias("term"), F.lit(2.0).alias("w"))
    more = expand(asked, concepts).select(
        F.col("label").alias("query"),
        F.when(F.col("source") == "direct", 1).otherwise(2).alias("place"),
        F.col("concept").alias("term"),
        F.col("confidence").alias("w"),
    )
    return own.unionByName(more).groupBy("query", "term").agg(F.min("place").alias("place"))
