"""Reference materials inherited down the scopes: resolution, cross-check, findings, lineage, grounding."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions.columns import GROUNDING_CLASSES, GROUNDING_EDITS, classify_grounding, rate
from folioscope.functions.columns import lookup as table_lookup
from folioscope.storage import shared_table

#: Scope levels from specific to general.
LEVEL_RANK = {"issue": 0, "series": 1, "title_group": 2, "publisher": 3}
OTHER_RANK = 99
#: Versions of the resolution contract that are understood.
CONTRACT_VERSIONS = ("1",)
MAX_ROUNDS = 60


def ranked(materials: DataFrame) -> DataFrame:
    return materials.withColumn("rank", F.coalesce(table_lookup(F.col("level"), LEVEL_RANK), F.lit(OTHER_RANK)))


def effective(materials: DataFrame, edges: DataFrame, edition: str | None = None) -> DataFrame:
    """The materials that hold for each target.

    Retired records and those of another edition drop out; of an id the most specific record stays (ties:
    greatest revision). Then records suppress what their bound edges name at strictly less specific
    levels, provided they are themselves left; as a suppressor always ranks before the suppressed, one
    anti-join per rank, from specific to general, settles it. What is publisher-approved is kept at the end.
    """
    able = ranked(materials).where((F.col("status") != "retired") & (F.col("edition_id").isNull() | F.col("edition_id").eqNullSafe(F.lit(edition))))
    order = Window.partitionBy("target_id", "material_id").orderBy("rank", F.desc("revision"))
    left = able.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
    bound = ranked(edges.where("binding_status = 'bound'")).select(
        "target_id", F.col("material_id").alias("by_id"), F.col("rank").alias("by_rank"), F.col("supersedes_id").alias("material_id")
    ).distinct()
    for rank in sorted({*LEVEL_RANK.values(), OTHER_RANK})[:-1]:
        acting = left.where(F.col("rank") == rank).select("target_id", F.col("material_id").alias("by_id"), F.col("rank").alias("by_rank"))
        named = bound.join(acting, ["target_id", "by_id", "by_rank"]).select("target_id", "material_id").distinct().withColumn("_by", F.lit(rank))
        left = left.join(named, ["target_id", "material_id"], "left").where(F.col("_by").isNull() | (F.col("rank") <= F.col("_by"))).drop("_by")
    return left.where("status = 'publisher_approved'").drop("rank")


def material_key(files: Column) -> Column:
    """Files of a material as one text: (file_id, revision) pairs in order, missing values last."""
    pairs = F.transform(files, lambda f: F.struct(f["file_id"].isNull().alias("a"), f["file_id"].cast("string").alias("b"), f["revision"].isNull().alias("c"), f["revision"].cast("string").alias("d")))
    return F.to_json(F.transform(F.array_sort(pairs), lambda p: F.struct(p["b"].alias("file_id"), p["d"].alias("revision"))))


def cross_check(computed: DataFrame, published: DataFrame, versions: DataFrame, supported: Sequence[str] = CONTRACT_VERSIONS) -> DataFrame:
    """Per target and material: agree, computed_only, published_only, file_mismatch or duplicate.

    Both sides have (target_id, material_id, files); ``files`` is an array of (file_id, revision), of which the sorted set
    counts. ``versions`` has (target_id, contract_version, published_version). A target of an unsupported contract is not
    judged, nor one whose published snapshot is of another version: such a target is one row without a material.
    """
    keys = ["target_id", "material_id"]
    key = material_key(F.col("files")).alias("k")
    a = computed.select(*keys, key).groupBy(*keys).agg(F.max("k").alias("ours"))
    b = published.select(*keys, key).groupBy(*keys).agg(F.max("k").alias("theirs"), F.count("*").alias("times"))
    skew = F.when(~F.coalesce(F.col("contract_version").isin(*supported), F.lit(False)), "unsupported_resolution_contract_version").when(F.col("published_version") != F.col("contract_version"), "version_skew")
    judged = versions.select("target_id", skew.alias("skew"))
    status = (
        F.when(F.col("times") > 1, "duplicate").when(F.col("times").isNull(), "computed_only").when(F.col("ours").isNull(), "published_only")
        .when(F.col("ours") == F.col("theirs"), "agree").otherwise("file_mismatch")
    )
    able = judged.where("skew is null").select("target_id")
    rows = a.join(b, keys, "full_outer").join(able, "target_id").select(*keys, status.alias("status"))
    return rows.unionByName(judged.where("skew is not null").select("target_id", F.lit(None).cast(rows.schema["material_id"].dataType).alias("material_id"), F.col("skew").alias("status")))


def authoring_findings(materials: DataFrame, edges: DataFrame) -> DataFrame:
    """Ids used at several levels, edges to unknown ids, and superseded records that are still approved."""
    keys = ["target_id", "material_id"]
    crossed = materials.groupBy(*keys).agg(F.countDistinct("level").alias("n")).where("n > 1").select(*keys, F.lit("cross_scope_collision").alias("code"))
    named = edges.select("target_id", F.col("supersedes_id").alias("material_id")).distinct()
    dangling = named.join(materials, keys, "left_anti").select(*keys, F.lit("dangling_supersedes").alias("code"))
    live = edges.where("binding_status = 'bound'").select("target_id", F.col("supersedes_id").alias("material_id")).distinct()
    still = materials.where("status = 'publisher_approved'").select(*keys).distinct().join(live, keys, "left_semi").select(*keys, F.lit("superseded_still_approved").alias("code"))
    return crossed.unionByName(dangling).unionByName(still).withColumn("severity", F.lit("WARNING"))


def lineage_conflicts(materials: DataFrame, edges: DataFrame) -> DataFrame:
    """Lineages (ids linked by supersession, either way) of a target with more than one approved material.

    Labels spread along the edges until none changes; each round halves what is left at least by following
    the label's own label. Each round's labels are a table in the cluster's shared folder.
    """
    links = edges.where("material_id <> supersedes_id").select("target_id", F.col("material_id").alias("a"), F.col("supersedes_id").alias("b")).distinct()
    both = links.unionByName(links.select("target_id", F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    labels = both.groupBy("target_id", "a").agg(F.least(F.col("a"), F.min("b")).alias("label"))
    for _ in range(MAX_ROUNDS):
        near = both.join(labels.withColumnRenamed("a", "b"), ["target_id", "b"]).groupBy("target_id", "a").agg(F.min("label").alias("near"))
        stepped = labels.join(near, ["target_id", "a"]).select("target_id", "a", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        roots = labels.select("target_id", F.col("a").alias("label"), F.col("label").alias("root"))
        after = stepped.join(roots, ["target_id", "label"]).select("target_id", "a", F.least("label", "root").alias("label"), "old")
        labels = shared_table(after, "lineage")
        if labels.where("label <> old").isEmpty():
            break
        labels = labels.drop("old")
    else:
        raise RuntimeError(f"no fixed point after {MAX_ROUNDS} rounds")
    approved = materials.where("status = 'publisher_approved'").select("target_id", F.col("material_id").alias("a")).distinct()
    held = labels.join(approved, ["target_id", "a"]).groupBy("target_id", F.col("label").alias("lineage"))
    return held.agg(F.count("*").alias("approved")).where("approved > 1").withColumn("code", F.lit("multiple_active_approved")).withColumn("severity", F.lit("FAIL"))


def grounding_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Per artifact: materials added, removed and revised between two sets, and the change's class.

    Both sides have (artifact_id, material_id, revision).
    """
    keys = ["artifact_id", "material_id"]
    b = before.groupBy(*keys).agg(F.max("revision").alias("b"))
    a = after.groupBy(*keys).agg(F.max("revision").alias("a"))
    out = b.join(a, keys, "full_outer").groupBy("artifact_id").agg(
        F.count("b").alias("before"), F.count("a").alias("after"), F.count_if(F.col("b").isNull()).alias("added"), F.count_if(F.col("a").isNull()).alias("removed"), F.count_if(F.col("a") != F.col("b")).alias("revised")
    )
    return out.withColumn("category", classify_grounding(*[F.col(c) for c in ("before", "after", "added", "removed", "revised")]))


def grounding_benchmark(outputs: DataFrame, group: str) -> DataFrame:
    """Per group: outputs of each class, acceptance over fresh ones, version pins and whether they differ.

    ``outputs`` has (category, disposition, generated_pin, approved_pin), a pin being null where the side is not grounded.
    An output whose sides carry different pins is of no supported version, whatever changed. Preserved outputs,
    abstentions and unsupported ones are no part of the acceptance.
    """
    pins = F.array("generated_pin", "approved_pin")
    kind = F.when(F.col("generated_pin") != F.col("approved_pin"), "unsupported_version").otherwise(F.col("category"))
    marked = outputs.withColumn("kind", kind).withColumn("fresh", F.col("disposition").isNull() | (F.col("disposition") == "fresh"))
    k = F.col("kind")
    out = marked.groupBy(group).agg(
        F.count("*").alias("artifacts"), *[F.count_if(k == c).alias(f"n_{c}") for c in GROUNDING_CLASSES], F.count_if(k.isin(*GROUNDING_EDITS)).alias("grounding_edits"),
        F.count_if(F.col("fresh") & (k == "accepted_unchanged")).alias("fresh_accepted"), F.count_if(F.col("fresh") & ~k.isin("abstention", "unsupported_version")).alias("fresh_comparable"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.filter(pins, lambda p: p.isNotNull()))))).alias("pins"),
    )
    return out.select(
        *[c for c in out.columns if c != "pins"], F.array_join("pins", ",").alias("version_pins"), rate(F.col("fresh_accepted"), F.col("fresh_comparable")).alias("acceptance"),
        ((F.col("n_unsupported_version") > 0) | (F.size("pins") > 1)).alias("version_skew"),
    )


def grounding_applicability(outputs: DataFrame, manual: DataFrame) -> DataFrame:
    """Per review: whether its grounding can be compared, why not, and the artifacts that are grounded on one side alone.

    ``outputs`` has (review_key, side, artifact_id, materials): both sides' outputs with the number of supporting materials;
    ``manual`` the review keys of manual publications. Grounding on an output of one side counts as grounding of the review, though there
    is nothing to compare it with. The ids are counted, and listed in ``grounded_on_one_side``.
    """
    one = outputs.groupBy("review_key", "artifact_id").agg(
        F.max(F.when(F.col("side") == "generated", F.col("materials"))).alias("g"), F.max(F.when(F.col("side") == "approved", F.col("materials"))).alias("a")
    )
    rows = one.groupBy("review_key").agg(
        F.count_if((F.coalesce("g", F.lit(0)) > 0) | (F.coalesce("a", F.lit(0)) > 0)).alias("grounded"), F.count_if(F.col("a").isNull() & (F.col("g") > 0)).alias("grounded_only_generated"),
        F.count_if(F.col("g").isNull() & (F.col("a") > 0)).alias("grounded_only_approved"),
    )
    marked = rows.join(manual.select("review_key", F.lit(True).alias("_manual")), "review_key", "left")
    reason = F.when(F.col("_manual"), "manual_publication").when(F.col("grounded") == 0, "no_materials_grounding")
    return marked.select("review_key", reason.isNull().alias("applicable"), reason.alias("reason"), "grounded_only_generated", "grounded_only_approved")


def grounded_on_one_side(outputs: DataFrame) -> DataFrame:
    """(review_key, side, artifact_id) of the grounded outputs that the other side does not have."""
    seen = outputs.groupBy("review_key", "artifact_id").agg(F.count("*").alias("sides"), F.max("side").alias("side"), F.max("materials").alias("materials"))
    return seen.where("sides = 1 and materials > 0").select("review_key", "side", "artifact_id")
