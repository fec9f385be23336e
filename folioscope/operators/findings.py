"""What an audit of a review amounts to: findings, a summary of the deltas, both views of its state, and the report's row."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions.columns import axes_key
from folioscope.operators.reports import FINDING_ORDER, run_id, worst_finding

#: Roles without which the evidence counts as not loaded.
REQUIRED_ROLES = ("approved_pointer", "processing_snapshot", "review_report")


def roles_of(manifest: DataFrame, key: str = "issue_prefix") -> DataFrame:
    """(key, roles): each role's read status as a map, from ``ingest.evidence_manifest``; a manifest has a handful of roles."""
    return manifest.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("role", "status")))).alias("roles"))


def _finding(code: str, severity: Column | str, detail: Column) -> Column:
    return F.struct(F.lit(code).alias("code"), (F.lit(severity) if isinstance(severity, str) else severity).alias("severity"), detail.alias("detail"))


def project_findings(reviews: DataFrame, keys: tuple[str, ...] = ("review_id",)) -> DataFrame:
    """One row per finding of a review: code, severity (PASS, WARNING, FAIL, INFO) and detail.

    ``reviews`` has ``roles`` (a map of each role's read status), ``adapter_error`` (null if the record could be read), the certified
    state and integrity, and the columns of both deltas (``meta_*``, ``geo_*``). A record that could not be read has no findings
    about its deltas. The approval by the platform is an authority of its own: its absence is a warning, an unreadable one a failure.
    """
    c = F.col
    role = lambda r: F.try_element_at("roles", F.lit(r))
    lacking = F.filter(F.array(*map(F.lit, REQUIRED_ROLES)), lambda r: ~F.coalesce(F.try_element_at("roles", r) == "read", F.lit(False)))
    loaded = F.size(F.filter(F.map_values("roles"), lambda s: s == "read"))
    required = F.when(F.size(lacking) > 0, F.concat(F.lit("; required not read: "), F.array_join(lacking, ", "))).otherwise("")
    approval = role("platform_approval")
    always = [
        _finding("evidence.loaded", F.when(F.size(lacking) == 0, "PASS").otherwise("FAIL"), F.concat(loaded.cast("string"), F.lit("/"), F.size("roles").cast("string"), F.lit(" objects read"), required)),
        _finding("platform.approval", F.when(approval == "read", "PASS").when(approval == "missing", "WARNING").otherwise("FAIL"), F.coalesce(approval, F.lit("none"))),
        _finding("publisher.mutation", "PASS", F.lit("read only")),
        _finding("contract.adapted", F.when(c("adapter_error").isNull(), "PASS").otherwise("FAIL"), F.coalesce("adapter_error", F.lit("supported versions"))),
    ]
    meta = (
        F.when(c("meta_applicable") & (c("meta_compared") > 0), _finding("metadata.comparability", "PASS", F.concat(F.lit("compared "), c("meta_compared").cast("string"))))
        .when(c("meta_applicable"), _finding("metadata.comparability", "WARNING", F.concat(F.lit("schema versions differ for "), c("meta_mismatched").cast("string"))))
        .otherwise(_finding("metadata.comparability", "INFO", F.concat(F.lit("not applicable: "), F.coalesce("meta_reason", F.lit("none")))))
    )
    numbers = F.concat_ws(" ", *[F.concat(F.lit(f"{n}="), c(f"geo_{n}").cast("string")) for n in ("missing", "spread_missing", "false")])
    geometry = F.when(c("geo_applicable"), _finding("geometry.delta", "INFO", numbers)).otherwise(_finding("geometry.delta", "INFO", F.concat(F.lit("not applicable: "), F.coalesce("geo_reason", F.lit("none")))))
    adapted = [
        _finding("publisher.certified_state", F.when(c("passes_integrity"), "INFO").otherwise("WARNING"), F.coalesce("certified_state", F.lit("none"))),
        meta,
        geometry,
        F.when(c("geo_applicable") & (c("geo_false") > 0), _finding("geometry.false_panels", "WARNING", c("geo_false").cast("string"))),
        _finding("delta.deterministic", "PASS", F.substring("delta_sha256", 1, 12)),
    ]
    none = F.array().cast("array<struct<code:string,severity:string,detail:string>>")
    found = F.concat(F.array(*always), F.when(c("adapter_error").isNull(), F.filter(F.array(*adapted), lambda f: f.isNotNull())).otherwise(none))
    return reviews.select(*keys, F.inline(found))


def delta_summary(reviews: DataFrame, keys: tuple[str, ...] = ("review_id",)) -> DataFrame:
    """Per review the status of either delta (computed, abstained, not_applicable), why, and its main figures."""
    c = F.col
    meta = F.when(~c("meta_applicable"), "not_applicable").when(c("meta_compared") > 0, "computed").otherwise("abstained")
    figure = lambda status, name: F.when(status == "computed", c(name))
    geometry = F.when(c("geo_applicable"), "computed").otherwise("not_applicable")
    return reviews.select(
        *keys, meta.alias("metadata_status"), F.when(meta == "abstained", "schema_version_mismatch").when(meta == "not_applicable", c("meta_reason")).alias("metadata_reason"),
        *[figure(meta, f"meta_{n}").alias(f"metadata_{n}") for n in ("compared", "acceptance_rate", "edit_rate", "addition_rate")], F.when(meta == "abstained", c("meta_mismatched")).alias("mismatched_artifacts"),
        geometry.alias("geometry_status"), F.when(geometry == "not_applicable", c("geo_reason")).alias("geometry_reason"),
        *[figure(geometry, f"geo_{n}").alias(f"geometry_{n}") for n in ("precision", "recall", "split_rate", "merge_rate", "missing", "spread_missing", "false")], "correction_ledger_entries",
    )


def state_comparison(reviews: DataFrame, keys: tuple[str, ...] = ("review_id",)) -> DataFrame:
    """What was certified, word for word, beside what the audit measured; neither is derived from the other."""
    certified = F.struct(F.col("certified_state").alias("canonical_dataset_state"), "passes_integrity")
    ready = F.forall(F.array(*map(F.lit, REQUIRED_ROLES)), lambda r: F.coalesce(F.try_element_at("roles", r) == "read", F.lit(False)))
    measured = F.struct(F.col("geo_approved").alias("approved_panel_count"), F.col("geo_applicable").alias("geometry_applicable"), F.col("meta_applicable").alias("metadata_applicable"), F.col("meta_compared").alias("metadata_compared_artifacts"), ready.alias("audit_ready"))
    return reviews.select(*keys, certified.alias("certified"), measured.alias("measured"))


def report_rows(reviews: DataFrame, findings: DataFrame, geometry_axes: Mapping[str, Column], metadata_axes: Mapping[str, Column]) -> DataFrame:
    """One report per review that could be read: metrics, findings by severity, the worst of them, comparability keys, run id, both times.

    The run id depends on both revisions and both keys only, so the same publication measured the same way is the same run.
    """
    counted = findings.groupBy("review_id").agg(*[F.count_if(F.col("severity") == s).alias(f"n_{s.lower()}") for s in FINDING_ORDER], F.array_sort(F.collect_set("code")).alias("codes"), F.collect_set("severity").alias("seen"))
    rows = reviews.where("adapter_error is null").join(counted, "review_id")
    keyed = rows.withColumn("geometry_comparability_key", axes_key("cmp", geometry_axes)).withColumn("metadata_comparability_key", axes_key("cmp", metadata_axes))
    metric = lambda n: F.when(F.col("geo_applicable"), F.col(f"geo_{n}"))
    ids = ("published_revision_id", "generated_revision_id", "geometry_comparability_key", "metadata_comparability_key")
    return keyed.select(
        "review_id", *[metric(n).alias(n) for n in ("precision", "recall", "split_rate", "merge_rate")], *[metric(n).alias(f"{n}_count") for n in ("missing", "spread_missing", "false")],
        *[f"n_{s.lower()}" for s in FINDING_ORDER], F.array_join("codes", ",").alias("finding_codes"), worst_finding(F.col("seen")).alias("worst_severity"),
        "geometry_comparability_key", "metadata_comparability_key", run_id(*[F.col(i) for i in ids]).alias("run_id"), "event_time", "certified_at",
    )


def index_details(index: DataFrame, details: DataFrame) -> DataFrame:
    """Per-field details of the comparable index entries; an entry whose report is missing drops out."""
    able = index.where(F.col("applicable") & (F.col("comparable_fields") > 0)).select("report_id", "comparability_key")
    return able.join(details, "report_id")
