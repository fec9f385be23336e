"""Scalar functions on Columns: ratios, bands, boxes, text distances, classifications, keys."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Severities and the impact of each, strongest first.
SEVERITIES = ("critical", "high", "medium", "low", "info")


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)``, with the value computed once for each row however often ``then`` uses it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def rate(n: Column, d: Column, empty: float | None = 0.0) -> Column:
    """n / d to six decimals, half to even; ``empty`` where d is 0 (deltas: 0.0, benchmarks: null)."""
    return F.when(d != 0, F.bround(n.cast("double") / d, 6)).otherwise(F.lit(empty).cast("double"))


def percent(n: Column, d: Column) -> Column:
    """100 n / d as a whole number, half to even; 0 where d is 0."""
    return F.when(d != 0, F.bround(F.lit(100.0) * n / d, 0).cast("int")).otherwise(F.lit(0))


def severity_rank(severity: Column) -> Column:
    """critical 4 down to info 0; null for anything else."""
    out = F.when(severity == SEVERITIES[0], 4)
    for k, name in enumerate(SEVERITIES[1:], 1):
        out = out.when(severity == name, 4 - k)
    return out


def severity_name(rank: Column) -> Column:
    out = F.when(rank == 4, SEVERITIES[0])
    for k, name in enumerate(SEVERITIES[1:], 1):
        out = out.when(rank == 4 - k, name)
    return out


def band(value: Column, steps: Sequence[tuple[float, str]], below: str) -> Column:
    """The name of the first step that ``value`` reaches; steps go from high to low."""
    out = F.when(value >= steps[0][0], steps[0][1])
    for least, name in steps[1:]:
        out = out.when(value >= least, name)
    return out.otherwise(below)


def impact_band(share: Column) -> Column:
    return band(share, ((50, "high"), (20, "medium")), "low")


def readiness_band(share: Column) -> Column:
    return band(share, ((80, "strong"), (40, "adequate")), "weak")


def area_band(area: Column) -> Column:
    """Panel sizes as shares of the page."""
    return band(area, ((0.12, "large"), (0.03, "medium")), "small")


def page_of(page_range: Column, artifact_id: Column) -> Column:
    """First element of the range if it is a whole number, else the page within a panel id, else null."""
    digits = F.regexp_extract(artifact_id, r"page_(\d+)_panel_\d+", 1)
    first = F.try_element_at(page_range, F.lit(1))
    return F.coalesce(F.when(first.rlike(r"^\d+$"), first.try_cast("int")), F.when(digits != "", digits.try_cast("int")))


def page_scope(artifact_id: Column, carried: Column) -> Column:
    """A carried page number, else the id's head if it is a number, else its last number between underscores, else the head."""
    head = F.split_part(artifact_id, F.lit("::"), F.lit(1))
    leading = F.regexp_extract(head, r"^(\d+)$", 1)
    inner = F.element_at(F.filter(F.split(head, "_"), lambda p: p.rlike(r"^\d+$")), -1)
    inner = F.when(F.exists(F.split(head, "_"), lambda p: p.rlike(r"^\d+$")), inner)
    return F.coalesce(carried.cast("string"), F.when(leading != "", leading), inner, head)


def iou(ax: Column, ay: Column, aw: Column, ah: Column, bx: Column, by: Column, bw: Column, bh: Column) -> Column:
    """Intersection over union of two boxes; 0 if they have no area in all."""
    wide = F.greatest(F.least(ax + aw, bx + bw) - F.greatest(ax, bx), F.lit(0.0))
    high = F.greatest(F.least(ay + ah, by + bh) - F.greatest(ay, by), F.lit(0.0))
    inter = wide * high
    union = aw * ah + bw * bh - inter
    return F.when(union > 0, inter / union).otherwise(0.0)


def resize_diag(gx: Column, gy: Column, gw: Column, gh: Column, ax: Column, ay: Column, aw: Column, ah: Column) -> dict[str, Column]:
    """How a generated box differs from its approved one: area ratio, offsets, relative errors of width and height.

    Positive errors mean that the generated box is too large. Six decimals; null where the approved extent is 0.
    """
    relative = lambda g, a: F.when(a != 0, F.bround((g - a) / a, 6))
    area = aw * ah
    return {
        "area_ratio": F.when(area != 0, F.bround(gw * gh / area, 6)), "dx": F.bround(gx - ax, 6), "dy": F.bround(gy - ay, 6),
        "dw_pct": relative(gw, aw), "dh_pct": relative(gh, ah),
    }


def _shared(a: Column, b: Column, start: Callable[[Column, Column], Column]) -> Column:
    """Length of the longest start that two texts share, by halving steps; ``start`` takes so many characters of a text."""
    most = F.least(F.length(a), F.length(b))
    steps = F.array(*[F.lit(1 << k) for k in range(30, -1, -1)])
    longer = lambda n, k: F.when((n + k <= most) & (start(a, n + k) == start(b, n + k)), n + k).otherwise(n)
    return F.aggregate(F.filter(steps, lambda k: k <= most), F.lit(0), longer)


def _changed(a: Column, b: Column) -> Column:
    """The middles of two texts without what both begin and end with."""
    ends = let(_shared(a, b, F.left), lambda n: F.struct(F.substr(a, n + 1).alias("a"), F.substr(b, n + 1).alias("b")))
    cut = lambda t, n: F.left(t, F.length(t) - n)
    return let(ends, lambda e: let(_shared(e["a"], e["b"], F.right), lambda n: F.struct(cut(e["a"], n).alias("a"), cut(e["b"], n).alias("b"))))


def edit_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance over the longer length; 0 for two empty strings.

    What both texts begin and end with never changes the distance and is cut off first, so the quadratic work is that of
    the changed part; equal texts cost nothing.
    """
    longer = F.greatest(F.length(a), F.length(b))
    far = let(_changed(a, b), lambda m: F.levenshtein(m["a"], m["b"]))
    return F.when(a == b, 0.0).when(longer > 0, far.cast("double") / longer).otherwise(0.0)


def token_set(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[ \t\r\n\f\u000B]+"), lambda w: w != ""))


def set_distance(a: Column, b: Column) -> Column:
    """One minus the Jaccard similarity of two arrays taken as sets; 0 for two empty ones."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, 1.0 - F.size(F.array_intersect(a, b)).cast("double") / union).otherwise(0.0)


# The limits of the revision classes and the weight of an intervention of each class.
REVISION_LIMITS = ((0.10, "minor_wording_edit"), (0.35, "moderate_rewrite"), (0.70, "major_rewrite"))
REVISION_WEIGHTS = {
    "accepted_unchanged": 0.0, "minor_wording_edit": 0.25, "moderate_rewrite": 0.5, "major_rewrite": 0.75, "complete_replacement": 1.0, "added": 0.5, "removed": 1.0,
}
# Classes of a changed text, and those of any edit.
REWRITES = ("minor_wording_edit", "moderate_rewrite", "major_rewrite", "complete_replacement")
EDITS = (*REWRITES, "added", "removed")
# Classes of a change of grounding.
GROUNDING_EDITS = ("grounding_added", "grounding_removed", "revision_changed", "grounding_replaced")
GROUNDING_CLASSES = ("accepted_unchanged", *GROUNDING_EDITS, "abstention", "unsupported_version")


def revision_weight(category: Column) -> Column:
    """Weight of a class; null for abstentions and unsupported schemas."""
    return lookup(category, REVISION_WEIGHTS)


def lookup(key: Column, table: Mapping[str, object]) -> Column:
    """The table's value for a key, null if it has none."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def classify_grounding(before: Column, after: Column, added: Column, removed: Column, revised: Column) -> Column:
    """Change of an artifact's set of supporting materials, from the sizes of both sets and of the differences."""
    return (
        F.when((before == 0) & (after == 0), "abstention")
        .when((added == 0) & (removed == 0) & (revised == 0), "accepted_unchanged")
        .when((added > 0) & (removed > 0), "grounding_replaced")
        .when(added > 0, "grounding_added")
        .when(removed > 0, "grounding_removed")
        .otherwise("revision_changed")
    )


def axes_key(prefix: str, axes: Mapping[str, Column]) -> Column:
    """prefix_ and twelve hex digits of the SHA-256 of the sorted ``name=value`` pairs; null values print as empty."""
    pairs = [F.concat(F.lit(f"{name}="), F.coalesce(axes[name].cast("string"), F.lit(""))) for name in sorted(axes)]
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha2(F.concat_ws("|", *pairs), 256), 1, 12))


def fingerprint(versions: Mapping[str, Column]) -> Column:
    """fp_ and twelve hex digits over the versions of a method: the key under which work counts as done."""
    return axes_key("fp", versions)


def value_sha256(value: Column) -> Column:
    """SHA-256 of a VARIANT's JSON with sorted keys: equal values, equal digests; null for an absent value."""
    return F.sha2(F.to_json(value), 256)


def changed_axes(now: Mapping[str, Column], before: Mapping[str, Column]) -> Column:
    """Names of the axes whose value differs, in order, joined by commas."""
    return F.concat_ws(",", *[F.when(~now[n].eqNullSafe(before[n]), F.lit(n)) for n in sorted(now)])


def review_id(revision_id: Column) -> Column:
    """rev_ and the first twelve characters of the revision's digest."""
    return F.concat(F.lit("rev_"), F.substring(F.split_part(revision_id, F.lit("_"), F.lit(2)), 1, 12))


def is_empty_value(value: Column) -> Column:
    """Whether a VARIANT is absent, JSON null, an empty string, list or object."""
    return F.coalesce(F.to_json(value).isin("null", '""', "[]", "{}"), F.lit(True))
