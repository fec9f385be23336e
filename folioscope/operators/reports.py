"""The report store: numbered history, idempotent publishing, index and archive searches, the attempts ledger."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.operators.ordered import Down, placed, ranked, settled, with_previous

#: Worst first.
FINDING_ORDER = ("FAIL", "WARNING", "INFO", "PASS")


def run_id(*parts: Column) -> Column:
    """run_ and sixteen hex digits over the given values: the same run has the same id wherever it is made."""
    return F.concat(F.lit("run_"), F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256), 1, 16))


def numbered_id(run_seq: Column) -> Column:
    """run and the number in six digits, or in as many as it has."""
    digits = run_seq.cast("string")
    return F.concat(F.lit("run"), F.lpad(digits, F.greatest(F.lit(6), F.length(digits)), F.lit("0")))


def number_runs(fresh: DataFrame, stored: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Continues each scope's run numbers behind the greatest stored one, in order of ``at`` and run id.

    Null scopes are scopes. Runs are numbered by range, so a first load of one scope need not fit a task.
    """
    last = stored.groupBy(*[F.col(c).alias(f"_s{k}") for k, c in enumerate(scope)]).agg(F.max("run_seq").alias("_last"))
    numbered = ranked(fresh, scope, [F.col("at"), F.col("run_id")], "_n")
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_s{k}")) for k, c in enumerate(scope)])
    out = numbered.join(last, same, "left").withColumn("run_seq", (F.coalesce("_last", F.lit(0)) + F.col("_n")).cast("long"))
    return out.drop("_last", "_n", *[f"_s{k}" for k in range(len(scope))]).withColumn("report_id", numbered_id(F.col("run_seq")))


def publish(fresh: DataFrame, stored: DataFrame, scope: Sequence[str]) -> DataFrame:
    """What is to be appended: runs whose id is not stored yet, each once, numbered. Publishing twice adds nothing."""
    new = fresh.dropDuplicates(["run_id"]).join(stored.select("run_id"), "run_id", "left_anti")
    return number_runs(new, stored, scope)


def latest(reports: DataFrame, scope: Sequence[str]) -> DataFrame:
    """The newest report of each scope."""
    order = Window.partitionBy(*scope).orderBy(F.desc("run_seq"))
    return reports.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def verify_written(produced: DataFrame, read_back: DataFrame, key: str) -> DataFrame:
    """Keys whose rows differ between what was produced and what is stored, with the reason; empty if all is well.

    A key may stand on several rows, equal ones too: both sides must hold each row as often. Null is a key like any other.
    """
    digest = lambda df, made: df.select(key, F.unhex(F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256)).alias("digest"), F.lit(made).alias("made"))
    both = digest(produced, 1).unionByName(digest(read_back, 0))
    rows = both.groupBy(key, "digest").agg(F.sum("made").alias("made"), F.count("*").alias("all"))
    keys = rows.groupBy(key).agg(F.sum("made").alias("made"), F.sum(F.col("all") - F.col("made")).alias("kept"), F.bool_or(F.col("all") != 2 * F.col("made")).alias("differs"))
    why = F.when(F.col("kept") == 0, "missing").when(F.col("made") == 0, "unexpected").when(F.col("differs"), "differs")
    return keys.select(key, why.alias("why")).where("why is not null")


def upsert(entries: DataFrame, fresh: DataFrame, key: Sequence[str], order: str) -> DataFrame:
    """Entries replaced by fresh ones of the same key; of several the one whose ``order`` (run or load number) is greatest.

    A fresh entry wins over a stored one of equal order; what is still tied is settled by the rows' digests.
    """
    both = entries.withColumn("_fresh", F.lit(0)).unionByName(fresh.withColumn("_fresh", F.lit(1)), allowMissingColumns=True)
    last = Window.partitionBy(*key).orderBy(F.desc_nulls_last(order), F.desc("_fresh"), F.xxhash64(*[c for c in both.columns if c != "_fresh"]))
    return both.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n", "_fresh")


def ledger_state(attempts: DataFrame) -> DataFrame:
    """Per revision and fingerprint: attempts, when first seen and last tried, the last status; success clears the failure."""
    out = attempts.groupBy("revision", "fingerprint").agg(
        F.count("*").alias("attempts"), F.min("at").alias("first_seen"), F.max("at").alias("updated_at"), F.max_by(F.struct("status", "failure_stage"), F.struct("at", "attempt")).alias("last"),
    )
    return out.select("revision", "fingerprint", "attempts", "first_seen", "updated_at", "last.status", F.when(F.col("last.status") != "processed", F.col("last.failure_stage")).alias("failure_stage"))


def unprocessed(current: DataFrame, attempts: DataFrame, fingerprint: str, force: bool = False) -> DataFrame:
    """Current revisions that were not yet processed under this fingerprint; all of them if forced."""
    if force:
        return current
    done = attempts.where((F.col("fingerprint") == fingerprint) & (F.col("status") == "processed")).select("revision")
    return current.join(done, "revision", "left_anti")


def search_index(
    index: DataFrame, equal: Mapping[str, object] | None = None, within: Mapping[str, tuple[float | None, float | None]] | None = None, contains: Mapping[str, str] | None = None, dates: tuple[str, str, str] | None = None,
    revision: str | None = None, finding: str | None = None, severity: str | None = None, commit: str | None = None,
) -> DataFrame:
    """Index entries by equality, ranges of metrics (a null never matches), parts of texts, and a range of dates.

    ``revision`` is that of either side, ``finding`` a code among ``finding_codes``, ``severity`` one of which ``finding_counts`` has any,
    ``commit`` a part of the publisher's or the audit's commit.
    """
    out = index
    if revision is not None:
        out = out.where(F.lit(revision).eqNullSafe(F.col("published_revision_id")) | F.lit(revision).eqNullSafe(F.col("generated_snapshot_revision_id")))
    if finding is not None:
        out = out.where(F.coalesce(F.array_contains("finding_codes", finding), F.lit(False)))
    if severity is not None:
        out = out.where(F.coalesce(F.try_element_at("finding_counts", F.lit(severity)), F.lit(0)) > 0)
    if commit is not None:
        out = out.where(F.contains(F.coalesce("publisher_commit", F.lit("")), F.lit(commit)) | F.contains(F.coalesce("audit_commit", F.lit("")), F.lit(commit)))
    for column, value in (equal or {}).items():
        out = out.where(F.col(column) == value)
    for column, (low, high) in (within or {}).items():
        out = out.where(F.col(column).isNotNull() & (F.lit(True) if low is None else F.col(column) >= low) & (F.lit(True) if high is None else F.col(column) <= high))
    for column, part in (contains or {}).items():
        out = out.where(F.lower(column).contains(part.lower()))
    if dates:
        out = out.where(F.col(dates[0]).between(dates[1], dates[2]))
    return out


def archive(reports: DataFrame, failed_runs: DataFrame) -> DataFrame:
    """Reports and failed runs in one table; ``place`` numbers a scope's from the newest, by time and then run number."""
    both = reports.withColumn("kind", F.lit("report")).unionByName(failed_runs.withColumn("kind", F.lit("failed_run")), allowMissingColumns=True)
    return ranked(both, ["scope"], [Down(F.col("at")), Down(F.col("run_seq"))], "place")


#: Other names of metrics.
METRIC_ALIASES = {"metadata_unchanged_rate": "unchanged_metadata_rate", "editorial_intervention": "weighted_editorial_intervention_score"}
_COMPARE: Mapping[str, Callable[[Column, object], Column]] = {
    "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "=": lambda a, b: a == b, "==": lambda a, b: a == b,
}


def search_archive(
    records: DataFrame, ranges: Sequence[tuple[str, str, float]] = (), fields: Mapping[str, object] | None = None, findings: Sequence[str] = (), severities: Sequence[str] = (), kinds: Sequence[str] = (), texts: Sequence[str] = ()
) -> DataFrame:
    """Archive records that meet all filters: metric ranges, fields, finding codes, severities with a count, kinds, parts of the advice.

    Of the fields, ``date_from`` and ``date_to`` bound ``at``, ``revision`` may be either side's or the review's id, and
    ``commit`` is a part of either commit; any other is a column. A missing value, or column, matches nothing.
    """

    def has(name: str) -> Column:
        return F.col(name) if name in records.columns else F.lit(None).cast("string")

    tests = []
    for name, value in (fields or {}).items():
        if name == "date_from":
            tests.append(F.coalesce(has("at"), F.lit("")) >= value)
        elif name == "date_to":
            tests.append(F.coalesce(has("at"), F.lit("")) <= value)
        elif name == "revision":
            tests.append(F.lit(value).isin(*[has(c) for c in ("published_revision_id", "generated_snapshot_revision_id", "review_id")]))
        elif name == "commit":
            tests.append(F.contains(F.coalesce(has("publisher_commit"), F.lit("")), F.lit(value)) | F.contains(F.coalesce(has("audit_commit"), F.lit("")), F.lit(value)))
        else:
            tests.append(has(name) == value)
    tests += [has("kind") == k for k in kinds]
    tests += [F.array_contains("finding_codes", c) for c in findings]
    tests += [F.coalesce(F.try_element_at("finding_counts", F.lit(s)), F.lit(0)) > 0 for s in severities]
    tests += [_COMPARE[op](has(METRIC_ALIASES.get(m, m)).cast("double"), float(v)) for m, op, v in ranges]
    tests += [F.contains(F.lower(F.coalesce(has("recommendation_text"), F.lit(""))), F.lit(t.lower())) for t in texts]
    out = records
    for test in tests:
        out = out.where(test)
    return out


def archive_boundaries(reports: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Each report against the next newer one: whether the method changes there."""
    rows = settled(with_previous(placed(reports, scope, [Down(F.col("run_seq"))]), scope, {"newer_key": "comparability_key"}))
    newer = F.col("newer_key")
    return rows.withColumn("boundary", newer.isNotNull() & (newer != F.col("comparability_key")))


def worst_finding(severities: Column) -> Column:
    """The worst of an array of severities."""
    return F.get(F.filter(F.array(*map(F.lit, FINDING_ORDER)), lambda s: F.array_contains(severities, s)), F.lit(0))


def consolidated(blocks: Mapping[str, DataFrame]) -> DataFrame:
    """Findings of several blocks with their source; ``first`` marks a recommendation's first occurrence.

    Blocks rank in the order given.
    """
    out = None
    for place, (source, df) in enumerate(blocks.items()):
        part = df.select("dataset", "severity", "finding", "recommendation").withColumn("source", F.lit(source)).withColumn("source_rank", F.lit(place))
        out = part if out is None else out.unionByName(part)
    order = Window.partitionBy("dataset", "recommendation").orderBy("source_rank", "finding")
    return out.withColumn("first", F.row_number().over(order) == 1)


def correction_ledger(boxes: DataFrame, metadata: DataFrame) -> DataFrame:
    """All corrections of a review in one numbered ledger: boxes first, then metadata, each by operation and artifact.

    ``boxes`` are the geometry's (review_id, operation, page_scope, box_id, hits), ``metadata`` the revisions' (review_id, operation,
    artifact_id, fields); ``amount`` is the number of matches or of fields. The number is the row's place within its review.
    """
    review, none = F.col("review_id").cast("string").alias("review_id"), F.lit(None).cast("string")
    first = boxes.select(review, F.lit(0).alias("part"), F.lit("geometry").alias("task"), "operation", F.col("box_id").cast("string").alias("artifact_id"), F.col("page_scope").cast("string").alias("page_scope"), F.col("hits").cast("long").alias("amount"))
    second = metadata.select(review, F.lit(1).alias("part"), F.lit("metadata").alias("task"), "operation", F.col("artifact_id").cast("string").alias("artifact_id"), none.alias("page_scope"), F.col("fields").cast("long").alias("amount"))
    order = [F.col(c) for c in ("part", "operation", "artifact_id", "page_scope", "amount")]
    return ranked(first.unionByName(second), ["review_id"], order, "number").drop("part")


def status_counts(rows: DataFrame, by: Sequence[str], status: str = "status") -> DataFrame:
    """Rows of each status."""
    return rows.groupBy(*by, status).agg(F.count("*").alias("rows"))
