"""Generated against approved field values: classes of revision, distances, acceptance, burden."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions.columns import EDITS, REVISION_LIMITS, REVISION_WEIGHTS, REWRITES, edit_distance, is_empty_value, let, rate, revision_weight, set_distance, token_set
from folioscope.functions.variants import canonical, json_text, measures, rendered
from folioscope.operators.ordered import exact_medians
from folioscope.storage import shared_table

CATEGORIES = ("abstention", "unsupported_schema", *REVISION_WEIGHTS)
#: Classes of pairs that are not compared.
UNCOMPARED = ("abstention", "unsupported_schema")
ACCURACY_TARGET = 0.75


def counts_toward_acceptance(origin: Column, has_origin: Column, disposition: Column) -> Column:
    """Whether an output is fresh: by its origin where the record carries one, else by its disposition."""
    return F.when(has_origin, origin.isin("generated", "regenerated") & origin.isNotNull()).otherwise(disposition.isNull() | (disposition == "fresh"))


def _judged(distance: Column, empty_left: Column, empty_right: Column, same: Column, skewed: Column) -> Column:
    """(category, distance) of a pair of values; nothing is compared across schema versions."""
    edited = F.lit("complete_replacement")
    for most, name in reversed(REVISION_LIMITS):
        edited = F.when(distance <= most, name).otherwise(edited)
    category = F.when(skewed, "unsupported_schema").when(empty_left & empty_right, "abstention").when(empty_left, "added").when(empty_right, "removed").when(same, "accepted_unchanged").otherwise(edited)
    moved = F.when(skewed | (empty_left & empty_right), F.lit(None).cast("double")).when(empty_left | empty_right, 1.0).when(same, 0.0).otherwise(distance)
    return F.struct(category.alias("category"), moved.alias("distance"))


def _skewed(pairs: DataFrame) -> Column:
    return F.coalesce(F.col("status") == "schema_mismatch", F.lit(False)) if "status" in pairs.columns else F.lit(False)


def classify(pairs: DataFrame) -> DataFrame:
    """Adds category, distance and weight to rows with ``generated`` and ``approved`` texts (null is empty).

    Distance and weight are null where nothing is compared: both sides empty, or a ``status`` of ``schema_mismatch``. The edit distance
    is taken once for each row that needs one.
    """
    g, a, skewed = F.coalesce("generated", F.lit("")), F.coalesce("approved", F.lit("")), _skewed(pairs)
    needed = ~skewed & (g != "") & (a != "") & (g != a)
    judged = let(F.struct(g.alias("g"), a.alias("a"), F.when(needed, edit_distance(g, a)).alias("d"), skewed.alias("s")), lambda t: _judged(t["d"], t["g"] == "", t["a"] == "", t["g"] == t["a"], t["s"]))
    out = pairs.withColumn("_judged", judged)
    empty = [(g == "").alias("generated_empty"), (a == "").alias("approved_empty")]
    return out.select(*pairs.columns, "_judged.category", "_judged.distance", *empty).withColumn("weight", revision_weight(F.col("category")))


def classify_values(pairs: DataFrame) -> DataFrame:
    """The same for VARIANT values ``generated_value`` and ``approved_value`` of any shape, with their texts and all ``measures``.

    A pair is accepted only if the values are the same in structure: two that render alike but differ are an edit. Emptiness is
    that of the value (null, an empty text, list or object), not of its text. Measures are null where nothing is compared.
    """
    g, a, skewed = F.col("generated_value"), F.col("approved_value"), _skewed(pairs)
    left, right = is_empty_value(g), is_empty_value(a)
    out = pairs.withColumns({"generated": canonical(g), "approved": canonical(a), "measures": F.when(~skewed & ~(left & right), measures(g, a))})
    judged = _judged(F.col("measures.distance"), left, right, F.coalesce(F.col("measures.same"), F.lit(False)), skewed)
    out = out.withColumn("_judged", judged)
    kept = [c for c in out.columns if c != "_judged"]
    return out.select(*kept, "_judged.category", "_judged.distance", left.alias("generated_empty"), right.alias("approved_empty")).withColumn("weight", revision_weight(F.col("category")))


#: What ``judge_values`` tells.
JUDGED = ("category", "distance", "generated_empty", "approved_empty")


def judge_values(generated: Column, approved: Column, skewed: Column) -> Column:
    """What ``classify_values`` says of one pair, as a struct of ``JUDGED``, for pairs that stand in a list: values that are the same are neither rendered nor measured."""
    pair = F.struct(generated.alias("g"), approved.alias("a"), json_text(generated).alias("gj"), json_text(approved).alias("aj"), skewed.alias("s"))

    def told(t: Column) -> Column:
        empty = lambda j: F.coalesce(j.isin("null", '""', "[]", "{}"), F.lit(True))
        left, right, same = empty(t["gj"]), empty(t["aj"]), F.coalesce(t["gj"], F.lit("null")) == F.coalesce(t["aj"], F.lit("null"))
        apart = F.when(~t["s"] & ~left & ~right & ~same, F.bround(edit_distance(rendered(t["g"], t["gj"]), rendered(t["a"], t["aj"])), 6))
        judged = let(apart, lambda d: _judged(d, left, right, same, t["s"]))
        return let(judged, lambda x: F.struct(x["category"].alias("category"), x["distance"].alias("distance"), left.alias("generated_empty"), right.alias("approved_empty")))

    return let(pair, told)


def pair_fields(generated: DataFrame, approved: DataFrame) -> DataFrame:
    """Field values side by side, with the artifact's status: common, generated_only, approved_only or schema_mismatch.

    Both sides are long: (review_id, artifact_id, schema_version, field, value). A field that stands on
    one side only of a common artifact is left out.
    """
    keys = ["review_id", "artifact_id"]
    g = generated.select(*keys, F.col("schema_version").alias("g_schema")).distinct()
    a = approved.select(*keys, F.col("schema_version").alias("a_schema")).distinct()
    status = F.when(F.col("a_schema").isNull(), "generated_only").when(F.col("g_schema").isNull(), "approved_only").when(F.col("g_schema") != F.col("a_schema"), "schema_mismatch").otherwise("common")
    artifacts = g.join(a, keys, "full_outer").select(*keys, status.alias("status"))
    fields = generated.select(*keys, "field", F.col("value").alias("generated")).join(approved.select(*keys, "field", F.col("value").alias("approved")), [*keys, "field"])
    return artifacts.join(fields, keys, "left").where("status <> 'common' or field is not null")


def artifact_set_diff(generated: DataFrame, approved: DataFrame) -> DataFrame:
    """Per review: artifacts on both sides and on one side only, in one shuffle."""
    sides = generated.select("review_id", "artifact_id", F.lit(1).alias("side")).unionByName(approved.select("review_id", "artifact_id", F.lit(2).alias("side")))
    one = sides.groupBy("review_id", "artifact_id").agg(F.bit_or("side").alias("sides"))
    return one.groupBy("review_id").agg(F.count_if(F.col("sides") == 3).alias("common"), F.count_if(F.col("sides") == 1).alias("generated_only"), F.count_if(F.col("sides") == 2).alias("approved_only"))


def metadata_delta(classed: DataFrame) -> DataFrame:
    """Per review: accepted, edited, deleted and added fields, and rates over what was generated or approved."""
    c = F.col("category")
    counted = classed.groupBy("review_id").agg(
        F.count_if(F.col("generated") != "").alias("generated_populated"), F.count_if(F.col("approved") != "").alias("approved_populated"), F.count("*").alias("expected"),
        F.count_if(c == "accepted_unchanged").alias("accepted"), F.count_if(c.isin(*REWRITES)).alias("edited"),
        F.count_if(c == "removed").alias("deleted"), F.count_if(c == "added").alias("added"),
    )
    g, a = F.col("generated_populated"), F.col("approved_populated")
    return counted.select(
        "*", rate(F.col("accepted"), g).alias("acceptance_rate"), rate(F.col("edited"), g).alias("edit_rate"), rate(F.col("deleted"), g).alias("deletion_rate"),
        rate(F.col("edited") + F.col("deleted"), g).alias("hallucination_proxy"), rate(F.col("added"), a).alias("addition_rate"), rate(a, F.col("expected")).alias("completeness"),
    )


#: On which rows a benchmark rests: all common outputs, or those that a model has made in this revision.
BASES = ("all_common", "fresh")


def revision_benchmark(classed: DataFrame) -> DataFrame:
    """Per review and basis, and per field of them: rows of each class, weighted intervention, distances, populated sides.

    ``field`` is ``*`` on the rows for a whole review; ``basis`` is ``all_common`` or, for the rows that are ``fresh``, ``fresh``. Counts stay beside
    the ratios. Corrections are over the review's artifacts whose schema versions agree, on every row. Fields are summed first and
    reviews made of their sums; medians are taken from counts of values, so that no task holds a review's rows.
    """
    bases = F.when(F.col("fresh"), F.array(*map(F.lit, BASES))).otherwise(F.array(F.lit(BASES[0])))
    rows = classed.select("review_id", "artifact_id", "field", "category", "distance", "weight", "generated_empty", "approved_empty", F.explode(bases).alias("basis"))
    rows = shared_table(rows, "classed")
    keys = ["review_id", "basis"]
    counts = ("comparable", "generated_populated", "approved_populated", *CATEGORIES)
    fields = rows.groupBy(*keys, "field").agg(
        F.count_if(~F.col("category").isin(*UNCOMPARED)).alias("comparable"), F.count_if(~F.col("generated_empty")).alias("generated_populated"), F.count_if(~F.col("approved_empty")).alias("approved_populated"),
        *[F.count_if(F.col("category") == k).alias(k) for k in CATEGORIES], F.sum("weight").alias("weight_sum"), F.sum("distance").alias("distance_sum"),
    )
    fields = shared_table(fields, "fields")
    whole = fields.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in (*counts, "weight_sum", "distance_sum")]).withColumn("field", F.lit("*"))
    artifacts = rows.where("category <> 'unsupported_schema'").select(*keys, "artifact_id").distinct().groupBy(*keys).agg(F.count("*").alias("artifacts"))
    levels = rows.select(*keys, F.explode(F.array("field", F.lit("*"))).alias("field"), "distance")
    medians = exact_medians(levels, [*keys, "field"], "distance").select(*keys, "field", F.bround("median", 6).alias("distance_median"))
    # all three grow with the reviews; of sums, whose files are small, Spark would take some for small
    out = fields.unionByName(whole).join(artifacts.hint("merge"), keys, "left").join(medians.hint("merge"), [*keys, "field"], "left").fillna(0, ["artifacts"])
    out = out.withColumns({"weight_sum": F.bround("weight_sum", 6), "distance_sum": F.bround("distance_sum", 6)})
    corrections = sum((F.col(k) for k in EDITS), F.lit(0))
    return out.select(
        *keys, "field", "comparable", "artifacts", "generated_populated", "approved_populated", *CATEGORIES, "distance_sum", "distance_median",
        rate(F.col("accepted_unchanged"), F.col("comparable")).alias("accepted_rate"), rate(F.col("weight_sum"), F.col("comparable")).alias("weighted_intervention"),
        rate(F.col("distance_sum"), F.col("comparable")).alias("distance_mean"), rate(corrections, F.col("artifacts")).alias("corrections_per_artifact"),
    )


def paired_values(metadata: DataFrame) -> DataFrame:
    """The adapted leaves of both sides (``adapters.metadata_long``) side by side, as ``classify_values`` takes them.

    Only outputs on both sides are compared. Where their schema versions agree, a leaf must be editorial on both sides; where they
    differ, every leaf that is editorial on the generated side is a row of its own, which is not compared. Provenance is the generated side's.
    """
    keys = ["review_key", "artifact_id"]
    g, a = (metadata.where(F.col("side") == s) for s in ("generated", "approved"))
    versions = a.select(*keys, F.col("schema_version").alias("_other")).distinct()
    left = g.where("editorial").select(*keys, "field", "schema_version", F.col("value").alias("generated_value"), "generation_disposition", "origin", "has_origin").join(versions, keys)
    right = a.where("editorial").select(*keys, "field", F.col("value").alias("approved_value"), F.lit(True).alias("_there"))
    same = F.col("schema_version").eqNullSafe(F.col("_other"))
    both = left.join(right, [*keys, "field"], "left").where(~same | F.col("_there"))
    status = F.when(same, "common").otherwise("schema_mismatch")
    return both.select(F.col("review_key").alias("review_id"), "artifact_id", "field", status.alias("status"), "generated_value", "approved_value", F.col("generation_disposition").alias("disposition"), "origin", "has_origin")


def with_freshness(classed: DataFrame) -> DataFrame:
    """Adds ``fresh`` from a record's ``origin``, ``has_origin`` and ``disposition``."""
    return classed.withColumn("fresh", counts_toward_acceptance(F.col("origin"), F.col("has_origin"), F.col("disposition")))


def metadata_accuracy(classed: DataFrame) -> DataFrame:
    """Per review: acceptance over the fresh outputs, and whether the target is met.

    ``coverage`` tells whether the disposition flag stands on none, some or all of the outputs that carry no origin.
    If on some only, fresh and preserved outputs cannot be told apart: the result is provisional
    and the target is withheld, as it is where nothing fresh can be compared. ``excluded_fields`` counts what could be
    compared but was taken over from before. Acceptance of everything without one edit looks like approval without inspection
    (``no_inspection``), which is said and changes nothing else.
    """
    c, own, fresh = F.col("category"), ~F.col("has_origin"), F.col("fresh")
    scored = ~c.isin(*UNCOMPARED)
    out = classed.groupBy("review_id").agg(
        F.count_if(fresh & (c == "accepted_unchanged")).alias("accepted"), F.count_if(fresh & scored).alias("comparable"), F.count_if(fresh & c.isin(*EDITS)).alias("edited"),
        F.count_if(~fresh & scored).alias("excluded_fields"), F.count_if(own).alias("generation_path"), F.count_if(own & F.col("disposition").isNotNull()).alias("flagged"),
    )
    coverage = F.when(F.col("flagged") == 0, "none").when(F.col("flagged") == F.col("generation_path"), "all").otherwise("partial")
    value = rate(F.col("accepted"), F.col("comparable"))
    able = (coverage != "partial") & (F.col("comparable") > 0)
    return out.select(
        "review_id", "accepted", "comparable", "edited", "excluded_fields", coverage.alias("coverage"), value.alias("accuracy"), (coverage == "partial").alias("provisional"),
        F.when(able, value >= ACCURACY_TARGET).alias("meets_target"), ((F.col("comparable") > 0) & (value == 1.0) & (F.col("edited") == 0)).alias("no_inspection"),
    )


def editorial_burden(classed: DataFrame) -> DataFrame:
    """Per field, over fresh comparable rows: acceptance, edits, their share of all edits, mean effort of an edit, rank.

    Effort is the Jaccard distance of the values' elements where both sides have ``generated_elements`` and
    ``approved_elements`` (lists, objects), else that of their words. Ranked by edits, effort and name; the
    windows run over the fields.
    """
    edited = F.col("category").isin(*EDITS)
    words = set_distance(token_set(F.col("generated")), token_set(F.col("approved")))
    if "generated_elements" in classed.columns:
        words = F.when(F.col("generated_elements").isNotNull() & F.col("approved_elements").isNotNull(), set_distance(F.col("generated_elements"), F.col("approved_elements"))).otherwise(words)
    fresh = classed.where(F.col("fresh") & ~F.col("category").isin(*UNCOMPARED))
    fields = fresh.groupBy("field").agg(
        F.count("*").alias("comparable"), F.count_if(F.col("category") == "accepted_unchanged").alias("accepted"), F.count_if(edited).alias("edited"),
        F.coalesce(F.bround(F.avg(F.when(edited, F.bround(words, 6))), 6), F.lit(0.0)).alias("effort"),
    )
    fields = fields.withColumn("acceptance_rate", rate(F.col("accepted"), F.col("comparable"))).withColumn("share", rate(F.col("edited"), F.sum("edited").over(Window.partitionBy())))
    return fields.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("edited"), F.desc("effort"), "field")))


def edit_class_totals(classed: DataFrame) -> DataFrame:
    """Rows of each category over everything."""
    return classed.groupBy("category").agg(F.count("*").alias("rows"), F.countDistinct("review_id").alias("reviews"))


def weak_fields(classed: DataFrame) -> DataFrame:
    """Per field: acceptance and edit rates over comparable rows, the most edited first."""
    c = F.col("category")
    out = classed.where(~c.isin(*UNCOMPARED)).groupBy("field").agg(F.count("*").alias("comparable"), F.count_if(c == "accepted_unchanged").alias("accepted"), F.count_if(c.isin(*EDITS)).alias("edited"))
    out = out.withColumn("acceptance_rate", rate(F.col("accepted"), F.col("comparable"))).withColumn("edit_rate", rate(F.col("edited"), F.col("comparable")))
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("edit_rate"), "field")))


def calls_per_panel(outputs: DataFrame) -> DataFrame:
    """Per review: how often outputs were generated (``generation_count``): number, sum, mean, most, more than once."""
    n = F.col("generation_count")
    return outputs.groupBy("review_id").agg(F.count(n).alias("outputs"), F.sum(n).alias("calls"), F.bround(F.avg(n), 6).alias("mean_calls"), F.max(n).alias("most_calls"), F.count_if(n > 1).alias("recalled"))


def field_corrections(classed: DataFrame) -> DataFrame:
    """One row per artifact with corrected fields, and how many."""
    edited = classed.where(F.col("category").isin(*EDITS))
    return edited.groupBy("review_id", "artifact_id").agg(F.lit("fields_corrected").alias("operation"), F.count("*").alias("fields"))


def metadata_corrections(classed: DataFrame, sides: DataFrame) -> DataFrame:
    """One row per correction of an output's metadata.

    ``sides`` has (review_id, artifact_id, status) as ``pair_fields`` gives it: outputs removed or added at approval and those whose
    schema versions differ are corrections of their own; of the others, those with edited fields.
    """
    kinds = {"generated_only": "artifact_removed_at_approval", "approved_only": "artifact_added_at_approval", "schema_mismatch": "schema_version_mismatch"}
    operation = F.try_element_at(F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair]), F.col("status"))
    whole = sides.select("review_id", "artifact_id", operation.alias("operation"), F.lit(0).cast("long").alias("fields")).where("operation is not null").distinct()
    return whole.unionByName(field_corrections(classed).select("review_id", "artifact_id", "operation", "fields"))
