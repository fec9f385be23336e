"""Completeness of enriched artifacts: weak reasons, scores, failures, blockers, readiness."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions.columns import impact_band, percent, readiness_band, severity_name, severity_rank
from folioscope.operators.ordered import Down, ranked

#: Conditions over an artifact row. Each list may be extended or replaced by callers.
#: The reasons for which an artifact is weak, in order, with their severities.
WEAK_REASONS: Sequence[tuple[str, str, str]] = (
    ("status_incomplete", "high", "status <> 'complete'"),
    ("not_approved", "high", "not approved"),
    ("missing_metadata", "high", "meta_present < meta_total"),
    ("not_reviewed", "medium", "not reviewed"),
    ("no_characters", "medium", "not has_characters"),
    ("no_dialogue", "medium", "not has_dialogue"),
    ("not_locked", "low", "not locked"),
)
#: Failure type, domain, category, severity, predicate.
FAILURES: Sequence[tuple[str, str, str, str, str]] = (
    ("status_incomplete", "enrichment_pipeline", "content", "high", "status <> 'complete'"),
    ("not_approved", "approval_workflow", "workflow", "high", "not approved"),
    ("missing_metadata", "enrichment", "content", "high", "meta_present < meta_total"),
    ("unreviewed", "approval_workflow", "workflow", "medium", "not reviewed"),
    ("missing_characters", "enrichment", "content", "medium", "not has_characters"),
    ("missing_dialogue", "enrichment", "content", "medium", "not has_dialogue"),
    ("unpaged", "ingestion", "content", "low", "page is null"),
    ("not_locked", "approval_workflow", "workflow", "low", "not locked"),
)
#: What keeps an artifact from being retrieved.
BLOCKERS: Sequence[tuple[str, str, str]] = (
    ("no_grounding", "high", "summary_length = 0"),
    ("thin_description", "medium", "summary_length > 0 and summary_length < 40"),
    ("missing_characters", "medium", "not has_characters"),
    ("missing_dialogue", "medium", "not has_dialogue"),
    ("missing_page_linkage", "medium", "page is null"),
    ("thin_metadata", "low", "not has_tags"),
)
ISSUE_WIDE, PAGE_SHARE, PAGE_LEAST = 80, 50, 2
DIGEST_ITEMS, SAMPLE_IDS = 5, 200


def signals(artifacts: DataFrame) -> DataFrame:
    """Adds how many of the metadata checks (id, tags, summary) hold."""
    present = F.lit(1) + F.col("has_tags").cast("int") + (F.col("summary_length") > 0).cast("int")
    return artifacts.withColumn("meta_present", present).withColumn("meta_total", F.lit(3))


def _flags(rows: Sequence[tuple], build) -> Column:
    """Array of the structs whose predicate holds."""
    return F.filter(F.array(*[F.when(F.expr(r[-1]), build(r)) for r in rows]), lambda x: x.isNotNull())


def assess(artifacts: DataFrame, reasons: Sequence[tuple[str, str, str]] = WEAK_REASONS) -> DataFrame:
    """Adds the artifact's weak reasons, its severity (null if it is sound), main weakness, effort and score."""
    order = {s: 4 - k for k, s in enumerate(("critical", "high", "medium", "low", "info"))}
    found = signals(artifacts).withColumn(
        "reasons", _flags(reasons, lambda r: F.struct(F.lit(order[r[1]]).alias("rank"), F.lit(r[0]).alias("reason")))
    )
    rank = F.array_max(F.transform("reasons", lambda r: r["rank"]))
    main = F.get(F.filter("reasons", lambda r: r["rank"] == rank), F.lit(0))["reason"]
    parts = sum((F.col(c).cast("int").cast("double") for c in ("has_characters", "has_dialogue", "reviewed", "approved")), F.col("meta_present") / F.col("meta_total"))
    return found.select(
        "*", rank.alias("severity_rank"), severity_name(rank).alias("severity"), main.alias("primary_weakness"),
        F.size("reasons").alias("effort"), F.bround(parts * 100 / 5, 0).cast("int").alias("score"),
    )


def dataset_scores(artifacts: DataFrame, packets: DataFrame) -> DataFrame:
    """Per dataset: shares of metadata, characters, dialogue, mean packet score, and their weighted quality."""
    own = signals(artifacts).groupBy("dataset").agg(
        F.count("*").alias("artifacts"), percent(F.sum("meta_present"), F.sum("meta_total")).alias("metadata"),
        percent(F.count_if("has_characters"), F.count("*")).alias("characters"), percent(F.count_if("has_dialogue"), F.count("*")).alias("dialogue"),
    )
    theirs = packets.groupBy("dataset").agg(percent(F.sum("checks_passed"), F.lit(4) * F.count("*")).alias("retrieval"))
    both = own.join(theirs, "dataset", "left").withColumn("retrieval", F.coalesce("retrieval", F.lit(0)))
    weighted = (F.col("metadata") * 30 + F.col("characters") * 25 + F.col("dialogue") * 25 + F.col("retrieval") * 20) / 100.0
    return both.withColumn("quality", F.bround(weighted, 0).cast("int"))


def packet_checks(refs: DataFrame, approved_ids: DataFrame) -> DataFrame:
    """Per packet: confidence, matched fields, scope, and whether all its artifacts are approved; how many hold.

    ``refs`` has one row per reference; ``approved_ids`` distinct approved artifact ids.
    """
    marked = refs.join(approved_ids.select("artifact_id", F.lit(True).alias("ok")), "artifact_id", "left")
    packets = marked.groupBy("dataset", "packet_id").agg(
        F.bool_and("has_confidence").alias("has_confidence"), F.bool_and("has_matched").alias("has_matched"), F.bool_and("has_scope").alias("has_scope"),
        F.bool_and(F.coalesce("ok", F.lit(False))).alias("all_approved"), F.count("*").alias("n_artifacts"),
    )
    checks = ("has_confidence", "has_matched", "has_scope", "all_approved")
    passed = packets.withColumn("checks_passed", sum((F.col(c).cast("int") for c in checks), F.lit(0)))
    return passed.withColumn("packet_score", F.bround(F.col("checks_passed") * 25.0, 0).cast("int"))


def priority_rank(assessed: DataFrame) -> DataFrame:
    """Weak artifacts of a dataset ranked by severity, page (unpaged last), effort and id."""
    weak = assessed.where("severity is not null")
    return ranked(weak, ["dataset"], [Down(F.col("severity_rank")), F.col("page").isNull(), F.col("page"), F.col("effort"), F.col("artifact_id")], "priority")


def weak_queue(assessed: DataFrame, most: int | None = None) -> DataFrame:
    """Weak artifacts by severity, score and id, with their place in the queue."""
    weak = assessed.where("severity is not null")
    queue = ranked(weak, ["dataset"], [Down(F.col("severity_rank")), F.col("score"), F.col("artifact_id")], "place")
    return queue if most is None else queue.where(F.col("place") <= most)


def weak_summary(assessed: DataFrame) -> DataFrame:
    """Per dataset: weak artifacts by severity."""
    return assessed.groupBy("dataset").agg(
        F.count_if(F.col("severity").isNotNull()).alias("flagged"), *[F.count_if(F.col("severity") == s).alias(s) for s in ("critical", "high", "medium", "low")]
    )


#: Ranks of a page's impact, which is its worst severity.
IMPACT_RANK = {"critical": 4, "high": 3, "medium": 2, "low": 1}


def page_heatmap(assessed: DataFrame) -> DataFrame:
    """Per page (null: unpaged): artifacts, weak ones by severity, the worst severity, and its place in the dataset's order.

    Pages come by impact, then by number of weak artifacts, then by page, the unpaged last. The window runs over
    the pages of a dataset, which are already summed.
    """
    out = assessed.groupBy("dataset", "page").agg(
        F.count("*").alias("artifacts"), F.count_if(F.col("severity").isNotNull()).alias("weak"), *[F.count_if(F.col("severity") == s).alias(s) for s in ("high", "medium", "low")],
        F.max("severity_rank").alias("worst_rank"),
    )
    out = out.withColumn("page_label", F.coalesce(F.col("page").cast("string"), F.lit("unpaged"))).withColumn("impact", F.coalesce(severity_name(F.col("worst_rank")), F.lit("none")))
    order = Window.partitionBy("dataset").orderBy(F.desc_nulls_last("worst_rank"), F.desc("weak"), F.asc_nulls_last("page"))
    return out.withColumn("place", F.row_number().over(order))


def page_lookup(artifacts: DataFrame, packets: DataFrame, approved: DataFrame) -> DataFrame:
    """``artifacts`` with ``page_range``: the packets' first one of the artifact, else the approved side's.

    Both sides have (artifact_id, page_range, place), ``place`` being a row's position in its source; rows without a range say nothing.
    """
    side = lambda df, rank: df.where("page_range is not null and artifact_id is not null").select("artifact_id", F.struct(F.lit(rank).alias("source"), "place", "page_range").alias("r"))
    first = side(packets, 0).unionByName(side(approved, 1)).groupBy("artifact_id").agg(F.min_by(F.col("r.page_range"), F.struct("r.source", "r.place")).alias("page_range"))
    return artifacts.join(first, "artifact_id", "left")


def failure_rows(artifacts: DataFrame, failures=FAILURES) -> DataFrame:
    """One row per failure of an artifact."""
    flags = _flags(failures, lambda f: F.struct(F.lit(f[0]).alias("failure"), F.lit(f[1]).alias("domain"), F.lit(f[2]).alias("category"), F.lit(f[3]).alias("severity")))
    return signals(artifacts).select("dataset", "artifact_id", "page", F.inline(flags))


def root_causes(failed: DataFrame, totals: DataFrame, sample: int = SAMPLE_IDS) -> DataFrame:
    """Per failure type: count, share, impact, pages, and how many ids lie beyond the first ``sample``.

    The ids themselves come from ``sampled_ids``; pages are few, so they are joined to a list.
    """
    kinds = failed.groupBy("dataset", "failure", "domain", "category", "severity").agg(
        F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_set("page")), lambda p: p.cast("string")), ",").alias("pages")
    )
    share = percent(F.col("n"), F.col("total"))
    return kinds.join(totals.select("dataset", F.col("artifacts").alias("total")), "dataset").select(
        "dataset", "failure", "domain", "category", "severity", "n", share.alias("share"), impact_band(share).alias("impact"), "pages",
        F.greatest(F.col("n") - sample, F.lit(0)).alias("truncated"),
    )


def sampled_ids(failed: DataFrame, sample: int = SAMPLE_IDS) -> DataFrame:
    """The first ids of each failure type, as rows."""
    order = Window.partitionBy("dataset", "failure").orderBy("artifact_id")
    return failed.withColumn("place", F.row_number().over(order)).where(F.col("place") <= sample).select("dataset", "failure", "artifact_id", "place")


def highest_leverage(causes: DataFrame) -> DataFrame:
    """Content failures ranked by count, severity and name; workflow failures are the backlog (rank null)."""
    order = Window.partitionBy("dataset", "category").orderBy(F.desc("n"), F.desc(severity_rank(F.col("severity"))), "failure")
    return causes.withColumn("leverage_rank", F.when(F.col("category") == "content", F.row_number().over(order)))


def failure_clusters(failed: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Failures that spread over a whole dataset, over a page, or over what has no page.

    A failure whose whole-number percentage reaches 80 is one issue-wide cluster and forms no page
    clusters; on a page it takes two artifacts and half of the page. Among the unpaged, every failure
    counts that two artifacts have, the issue-wide ones and ``unpaged`` itself too. ``percent`` is the share of the
    dataset or page, and ``impact`` its band; the unpaged have neither.
    """
    kind = ["dataset", "failure", "domain", "category", "severity"]
    nothing = F.lit(None)
    columns = [*kind, "scope", "page", "n", "of", "percent", "impact"]

    def rows(df: DataFrame, scope: str, page: Column, share: Column | None) -> DataFrame:
        out = df.withColumn("scope", F.lit(scope)).withColumn("page", page.cast("int")).withColumn("percent", (nothing if share is None else share).cast("int"))
        return out.withColumn("impact", nothing.cast("string") if share is None else impact_band(F.col("percent"))).select(*columns)

    share = percent(F.col("n"), F.col("of"))
    totals = artifacts.groupBy("dataset").agg(F.count("*").alias("of"))
    counted = failed.groupBy(*kind).agg(F.count("*").alias("n")).join(totals, "dataset")
    wide = counted.where(share >= ISSUE_WIDE)
    rest = failed.join(wide.select("dataset", "failure"), ["dataset", "failure"], "left_anti")
    pages = artifacts.groupBy("dataset", "page").agg(F.count("*").alias("of"))
    by_page = rest.where("page is not null").groupBy(*kind, "page").agg(F.count("*").alias("n")).join(pages, ["dataset", "page"])
    by_page = by_page.where((F.col("n") >= PAGE_LEAST) & (F.col("n") * 100 >= F.col("of") * PAGE_SHARE))
    unpaged = failed.where("page is null").groupBy(*kind).agg(F.count("*").alias("n")).where(F.col("n") >= PAGE_LEAST)
    unpaged = unpaged.join(pages.where("page is null").drop("page"), "dataset")
    return rows(wide, "issue_wide", nothing, share).unionByName(rows(by_page, "page", F.col("page"), share)).unionByName(rows(unpaged, "unpaged", nothing, None))


def packet_coverage(refs: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Per dataset: distinct artifacts that packets refer to against all, ids unknown to it, and the blocker's severity."""
    totals = artifacts.groupBy("dataset").agg(F.count("*").alias("artifacts"))
    known = artifacts.select("dataset", "artifact_id", F.lit(True).alias("known"))
    used = refs.select("dataset", "artifact_id").distinct().join(known, ["dataset", "artifact_id"], "left")
    used = used.groupBy("dataset").agg(F.count("*").alias("referenced"), F.count_if(F.col("known").isNull()).alias("unknown_refs"))
    covered = percent(F.col("referenced"), F.col("artifacts"))
    return totals.join(used, "dataset", "left").fillna(0, ["referenced", "unknown_refs"]).select(
        "dataset", "artifacts", "referenced", "unknown_refs", covered.alias("coverage"), F.when(covered < 50, "high").when(covered < 100, "medium").alias("blocker")
    )


# What a failed check of a packet is, and how severe.
PACKET_GAPS = (
    ("has_confidence", "confidence_not_scored", "high", "score_confidence"), ("has_matched", "no_matched_fields", "high", "record_matched_fields"),
    ("has_scope", "empty_scope", "medium", "define_scope"), ("all_approved", "unapproved_artifacts", "high", "approve_artifacts"),
)


def packet_findings(packets: DataFrame) -> DataFrame:
    """One row per check that a packet fails (dataset, packet_id, gap, severity, recommendation); ``packets`` are those of ``packet_checks``."""
    failed = _flags([(gap, severity, advice, f"not {check}") for check, gap, severity, advice in PACKET_GAPS], lambda g: F.struct(F.lit(g[0]).alias("gap"), F.lit(g[1]).alias("severity"), F.lit(g[2]).alias("recommendation")))
    return packets.select("dataset", "packet_id", F.inline(failed))


def packet_blockers(findings: DataFrame, coverage: DataFrame, packets: DataFrame) -> DataFrame:
    """Per dataset and gap the packets that have it; too low a coverage is a blocker that concerns all packets."""
    by_gap = findings.groupBy("dataset", F.col("gap").alias("blocker"), "severity").agg(F.count("*").alias("packets"))
    totals = packets.groupBy("dataset").agg(F.count("*").alias("packets"))
    low = coverage.where("blocker is not null").select("dataset", F.lit("low_packet_coverage").alias("blocker"), F.col("blocker").alias("severity"))
    return by_gap.unionByName(low.join(totals, "dataset", "left").fillna(0, ["packets"]))


def artifact_blockers(artifacts: DataFrame, blockers=BLOCKERS) -> DataFrame:
    """Per dataset and blocker: count, share, band; blockers that nobody has are left out."""
    flags = _flags(blockers, lambda b: F.struct(F.lit(b[0]).alias("blocker"), F.lit(b[1]).alias("severity")))
    totals = artifacts.groupBy("dataset").agg(F.count("*").alias("total"))
    found = artifacts.select("dataset", F.inline(flags)).groupBy("dataset", "blocker", "severity").agg(F.count("*").alias("n")).join(totals, "dataset")
    share = percent(F.col("n"), F.col("total"))
    return found.select("dataset", "blocker", "severity", "n", share.alias("share"), impact_band(share).alias("impact"))


def retrieval_readiness(coverage: DataFrame, packets: DataFrame, blockers: DataFrame) -> DataFrame:
    """Four dimensions of readiness per dataset, their bands, and the verdict."""
    per = packets.groupBy("dataset").agg(
        percent(F.count_if("has_confidence"), F.count("*")).alias("grounding_quality"),
        percent(F.count_if(F.col("has_matched") & F.col("has_scope") & F.col("all_approved")), F.count("*")).alias("traceability"),
    )
    gaps = blockers.where("blocker = 'no_grounding'").select("dataset", F.col("share").alias("gap"))
    dims = ("coverage", "grounding_quality", "traceability", "confidence_boundaries")
    wide = coverage.select("dataset", "coverage").join(per, "dataset", "left").join(gaps, "dataset", "left").select(
        "dataset", "coverage", *[F.coalesce(c, F.lit(0)).alias(c) for c in dims[1:3]], (F.lit(100) - F.coalesce("gap", F.lit(0))).alias("confidence_boundaries")
    )
    bands = {d: readiness_band(F.col(d)) for d in dims}
    weak = F.concat_ws(",", *[F.when(b == "weak", F.lit(d)) for d, b in bands.items()])
    strong = F.concat_ws(",", *[F.when(b == "strong", F.lit(d)) for d, b in bands.items()])
    verdict = F.when(bands["grounding_quality"] == "weak", "not_ready").when(weak != "", "partially_ready").otherwise("ready")
    return wide.select("*", strong.alias("strengths"), weak.alias("weaknesses"), verdict.alias("verdict"))


def approval_backlog(artifacts: DataFrame, approved_ids: DataFrame) -> DataFrame:
    """Artifacts outside the approved set."""
    return artifacts.join(approved_ids, "artifact_id", "left_anti")


def dataset_findings(artifacts: DataFrame) -> DataFrame:
    """Findings of a dataset: each missing metadata field of each artifact, and what whole datasets lack.

    A row has the artifact (null for the dataset as a whole), a code, its severity, and how many of how many
    artifacts it concerns.
    """
    missing = F.filter(F.array(F.when(~F.col("has_tags"), "classification.tags"), F.when(F.col("summary_length") == 0, "narrative.summary")), lambda f: f.isNotNull())
    each = artifacts.select("dataset", "artifact_id", F.explode(missing).alias("field"))
    each = each.select("dataset", "artifact_id", F.lit("missing_field").alias("finding"), "field", F.lit("high").alias("severity"), F.lit(1).cast("long").alias("n"), F.lit(1).cast("long").alias("of"))
    counts = artifacts.groupBy("dataset").agg(F.count("*").alias("of"), *[F.count_if(F.col(c)).alias(c) for c in ("approved", "reviewed", "has_characters", "has_dialogue")])
    kinds = (("approval_backlog", "high", "approved"), ("review_backlog", "medium", "reviewed"), ("character_coverage", "medium", "has_characters"), ("dialogue_coverage", "medium", "has_dialogue"))
    rows = F.array(*[F.struct(F.lit(f).alias("finding"), F.lit(s).alias("severity"), (F.col("of") - F.col(c)).alias("n")) for f, s, c in kinds])
    whole = counts.select("dataset", "of", F.inline(rows)).where("n > 0")
    return each.unionByName(whole.select("dataset", F.lit(None).cast("long").alias("artifact_id"), "finding", F.lit(None).cast("string").alias("field"), "severity", "n", "of"))
