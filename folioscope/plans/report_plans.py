"""Queries of indexes, series, ledgers and trees that join what several operators give."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.operators import benchmarks as B
from folioscope.operators import history as H
from folioscope.operators import materials as M
from folioscope.operators import registry as G
from folioscope.operators import reports as S
from folioscope.operators import revisions as E
from folioscope.plans import benchmark_plans, geometry_plans, review_plans, revision_plans, store_plans
from folioscope.plans import views as V
from folioscope.sources import adapters as A

c = F.col
SERIES = ("publisher", "title_group", "series")


def failure_deltas(spark, d):
    """Shares of failure types in the last two daily audits of each event type."""
    scores, failures = V.snapshots(spark, d)
    return H.failure_deltas(failures, scores)


def registry_members(spark, d):
    return G.members(V.registry(spark, d))


def registry_tree(spark, d):
    return G.tree(V.registry(spark, d))


def _index(spark, d):
    """Reports as index entries: revisions of both sides, the codes and severities of what was found, commits."""
    rows = V.reports(spark, d)
    found = {"geometry.false_panels": c("false_rate") > 0, "platform.approval": c("missing_rate") > 0}
    codes = F.filter(F.array(*[F.when(there, code) for code, there in found.items()]), lambda x: x.isNotNull())
    counts = F.create_map(F.lit("WARNING"), F.size(codes), F.lit("FAIL"), F.when(c("split_rate") > 1, c("split_rate")).otherwise(0).cast("int"))
    name = lambda start, value: F.concat(F.lit(start), value.cast("string"))
    return rows.select(
        "report_id", "series", "measured", name("rev_", c("issue")).alias("published_revision_id"), F.when(c("report_id") % 2 == 0, name("gen_", c("issue"))).alias("generated_snapshot_revision_id"),
        codes.alias("finding_codes"), counts.alias("finding_counts"), name("pub", F.sha2(c("issue").cast("string"), 256)).alias("publisher_commit"), F.when(c("report_id") % 3 == 0, "a1b2").alias("audit_commit"),
    )


def index_by_finding(spark, d):
    """Reports with a finding and a severity, those of one revision on either side, and those of a commit."""
    index = _index(spark, d)
    sets = {
        "finding": S.search_index(index, finding="geometry.false_panels", severity="FAIL"), "revision": S.search_index(index, revision="gen_1").unionByName(S.search_index(index, revision="rev_2")), "commit": S.search_index(index, commit="a1b2", severity="WARNING"),
    }
    out = None
    for name, rows in sets.items():
        part = rows.select(F.lit(name).alias("search"), "report_id")
        out = part if out is None else out.unionByName(part)
    return out


def series_tasks(spark, d):
    """Series by the current methods of geometry and of metadata, which are keyed by different axes, and their health."""
    geometry = benchmark_plans._points(spark, d)
    metadata = B.points(B.keyed(V.reports(spark, d).withColumnRenamed("merge_rate", "acceptance"), ["iou_threshold"]), {"acceptance": ("acceptance", "den")})
    health = G.series_health(store_plans._health(spark, d)).select(*SERIES, "health")
    return B.compare_series({"geometry": (geometry, ["precision", "recall"]), "metadata": (metadata, ["acceptance"])}, health)


def correction_ledger(spark, d):
    return S.correction_ledger(geometry_plans.box_corrections(spark, d), revision_plans.metadata_corrections(spark, d))


def acceptance_by_generator(spark, d):
    """Acceptance of fresh outputs by prompt, model and schema versions of published records."""
    made = A.adapt(review_plans.reports(spark, d))
    accepted = E.metadata_accuracy(review_plans.judged_pairs(made)).select(c("review_id").alias("review_key"), c("accepted").alias("num"), c("comparable").alias("den"))
    schemas = made.reviews.select("review_key", c("generated_metadata_version").alias("schema_version"))
    # all three have a row for each review; of a table without its parts, Spark would take what is left for small
    return B.correlation(made.generators.hint("merge").join(accepted.hint("merge"), "review_key").join(schemas.hint("merge"), "review_key"), ["prompt_version", "model", "schema_version"])


def prompt_refinements(spark, d):
    return B.prompt_refinements(revision_plans.weak_fields(spark, d))


def review_axes(spark, d):
    """The comparability keys and the axes of published records."""
    made = A.adapt(review_plans.reports(spark, d))
    rows = B.comparability(made.reviews, made.generators)
    return rows.select("review_key", "geometry_comparability_key", "metadata_comparability_key", c("metadata_axes.metadata_model").alias("metadata_model"), c("metadata_axes.metadata_schema_version").alias("metadata_schema_version"))


def _materials(made):
    """Outputs of adapted records with their number of supporting materials; half of the generated ones are gone."""
    every = made.supported.where("side = 'approved' or artifact_id not like '12%'")
    return every.select("review_key", "side", "artifact_id", F.size("materials").alias("materials"))


def grounding_applicability(spark, d):
    made = A.adapt(review_plans.reports(spark, d))
    return M.grounding_applicability(_materials(made), made.reviews.where("applicability = 'manual'"))


def grounded_on_one_side(spark, d):
    return M.grounded_on_one_side(_materials(A.adapt(review_plans.reports(spark, d))))


QUERIES = [
    failure_deltas, registry_members, registry_tree, index_by_finding, series_tasks, correction_ledger, acceptance_by_generator, prompt_refinements, review_axes, grounding_applicability, grounded_on_one_side,
]

_R = revision_plans._R
_PATH = "concat_ws('/', publisher, title_group, series, issue::varchar)"
_V = lambda n, d: f"case when {d} <> 0 then round_even(cast({n} as double) / {d}, 6) end"
_AXES = lambda model: {
    **{a: f"'{B.METHODS[a]}'" for a in B.METADATA_AXES if a in B.METHODS}, "task": "'metadata'", "metadata_prompt_version": "coalesce(prompt_version, '')", "metadata_prompt_sha256": "''", "metadata_model": f"coalesce({model}, '')", "metadata_schema_version": "sv",
}
_KEY = lambda axes: "'cmp_' || substr(sha256(" + " || '|' || ".join(f"'{a}=' || {axes[a]}" for a in sorted(axes)) + "), 1, 12)"
_GEOMETRY = {**{a: f"'{B.METHODS[a]}'" for a in B.GEOMETRY_AXES if a in B.METHODS}, "task": "'geometry'"}
_GROUNDED = f"""{review_plans._W}, mats as (select k, side, id, rf <> 'R' and q % 5 <> 0 mat from mo where side = 'approved' or id not like '12%'),
one as (select k, id, bool_or(mat) filter (where side = 'generated') g, bool_or(mat) filter (where side = 'approved') a from mats group by 1, 2)"""

ORACLES = {
    "failure_deltas": f"""with {V.SNAPSHOTS}, days as (select distinct dataset, "day" from failures), ln as (select *, row_number() over (partition by dataset order by "day" desc) n from days qualify n <= 2),
b as (select dataset, failure, n, cast(round_even(100.0 * failures / artifacts, 0) as integer) p from failures join ln using (dataset, "day") join scores using (dataset, "day") where failures > 0 and dataset in (select dataset from ln where n = 2)),
g as (select dataset, failure, coalesce(max(p) filter (where n = 2), 0) "before", coalesce(max(p) filter (where n = 1), 0) "now", count(*) filter (where n = 2) kb, count(*) filter (where n = 1) ka from b group by 1, 2)
select dataset, failure, "before", "now", "now" - "before" delta, case when kb = 0 then 'new' when ka = 0 then 'resolved' else 'known' end status from g""",
    "registry_members": f"with {V.REGISTRY} select unnest(['publisher', 'title_group', 'series']) \"level\", unnest([publisher, title_group, series]) \"value\", {_PATH} issue_path from registry",
    "registry_tree": f"""with {V.REGISTRY} select {_PATH} path, concat_ws('/', publisher, title_group, series) parent, 'issue' "level", issue::varchar "name", 0 children, 1 issues from registry
union all select concat_ws('/', publisher, title_group, series), concat_ws('/', publisher, title_group), 'series', series, count(*), count(*) from registry group by publisher, title_group, series
union all select concat_ws('/', publisher, title_group), publisher, 'title_group', title_group, count(distinct series), count(*) from registry group by publisher, title_group
union all select publisher, null, 'publisher', publisher, count(distinct title_group), count(*) from registry group by publisher""",
    "index_by_finding": f"""with {V.REPORTS} select 'finding' "search", report_id from reports where false_rate > 0 and split_rate > 1 union all select 'revision', report_id from reports where issue = 1 and report_id % 2 = 0 or issue = 2
union all select 'commit', report_id from reports where (report_id % 3 = 0 or contains('pub' || sha256(issue::varchar), 'a1b2')) and (false_rate > 0 or missing_rate > 0)""",
    "series_tasks": f"""with {V.POINTS}, {store_plans.HEALTH.replace(V.REGISTRY, V.REGISTRY.strip(), 1)},
gn as (select publisher, title_group, series, arg_max(comparability_key, run_seq) k, count(distinct comparability_key) n from points group by 1, 2, 3),
gs as (select publisher, title_group, series, gn.k, gn.n, count(*) filter (where metric = 'precision') reports, {_V("sum(num) filter (where metric = 'precision')", "sum(den) filter (where metric = 'precision')")} "precision", {_V("sum(num) filter (where metric = 'recall')", "sum(den) filter (where metric = 'recall')")} recall
       from points join gn using (publisher, title_group, series) where comparability_key = gn.k group by all),
mk as (select *, 'cmp_' || substr(sha256('iou_threshold=' || iou_threshold), 1, 12) mkey from reports), mn as (select publisher, title_group, series, arg_max(mkey, run_seq) k, count(distinct mkey) n from mk group by 1, 2, 3),
ms as (select publisher, title_group, series, mn.k, mn.n, count(*) reports, {_V("sum(merge_rate)", "sum(den)")} acceptance from mk join mn using (publisher, title_group, series) where mkey = mn.k group by all)
select publisher, title_group, series, h.health, gs.k geometry_comparability_key, gs.n geometry_methods, "precision", recall, gs.reports geometry_reports, gs.n > 1 geometry_several_methods,
 ms.k metadata_comparability_key, ms.n metadata_methods, acceptance, ms.reports metadata_reports, ms.n > 1 metadata_several_methods
from per_series h left join gs using (publisher, title_group, series) left join ms using (publisher, title_group, series)""",
    "correction_ledger": f"""with b as ({geometry_plans.ORACLES["box_corrections"]}), m as ({revision_plans.ORACLES["metadata_corrections"]}),
u as (select review_id::varchar review_id, 'geometry' task, operation, box_id::varchar artifact_id, page_scope::varchar page_scope, cast(hits as bigint) amount, 0 part from b union all select review_id::varchar, 'metadata', operation, artifact_id::varchar, null, cast(fields as bigint), 1 from m)
select * exclude (part), row_number() over (partition by review_id order by part, operation, artifact_id, page_scope nulls first, amount) "number" from u""",
    "acceptance_by_generator": f"""with g as ({review_plans.ORACLES["generator_models"]}), b as ({review_plans.ORACLES["review_benchmark"]}), v as ({review_plans.ORACLES["version_gate"]}),
a as (select review_id review_key, max(accepted_unchanged) filter (where basis = 'fresh') num, max(comparable) filter (where basis = 'fresh') den from b where field = '*' group by 1)
select prompt_version, model, generated_metadata_version schema_version, count(*) reports, cast(sum(coalesce(num, 0)) as bigint) accepted, cast(sum(coalesce(den, 0)) as bigint) comparable, {_V('sum(coalesce(num, 0))', 'sum(coalesce(den, 0))')} acceptance
from a join g using (review_key) join v using (review_key) where v.reason is null group by 1, 2, 3""",
    "prompt_refinements": f"with w as ({revision_plans.ORACLES['weak_fields']}) select field, edit_rate, 'high editorial rework' reason, 'metadata.prompt_refinement' code from w where edit_rate > {B.REWORK} and comparable > 0",
    "review_axes": f"""with g as ({review_plans.ORACLES["generator_models"]}), v as (select *, coalesce(generated_metadata_version, 'None') || '/' || coalesce(approved_metadata_version, 'None') sv from ({review_plans.ORACLES["version_gate"]}) where reason is null)
select review_key, {_KEY(_GEOMETRY)} geometry_comparability_key, {_KEY(_AXES('model'))} metadata_comparability_key, model metadata_model, sv metadata_schema_version from v join g using (review_key)""",
    "grounding_applicability": f"""{_GROUNDED}, r as (select k, count(*) filter (where coalesce(g, false) or coalesce(a, false)) n, count(*) filter (where a is null and g) gg, count(*) filter (where g is null and a) ga from one group by 1)
select k::varchar review_key, not (st = 'P' or n = 0) applicable, case when st = 'P' then 'manual_publication' when n = 0 then 'no_materials_grounding' end reason, gg grounded_only_generated, ga grounded_only_approved from r join ok using (k)""",
    "grounded_on_one_side": f"{_GROUNDED} select k::varchar review_key, case when a is null then 'generated' else 'approved' end side, id artifact_id from one where (a is null and g) or (g is null and a)",
}
