"""Scoring and ranking of entities against reference markets."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metrosift.functions.registry import DEFAULT_WEIGHTS, PILLARS, FeatureSpec, normal_sql
from metrosift.operators import features as fx
from metrosift.operators.checks import CheckFailed, require_none
from metrosift.operators.joins import join_lookup, spread
from metrosift.operators.matching import MATCH, REFERENCES_IN_PLAN, add_matches, group_references
from metrosift.operators.ordered import add_position
from metrosift.session import stage

REFERENCE_REASON = "Reference metro excluded from expansion shortlist"
NO_MATCH_REASON = "No non-self reference available"


@dataclass(frozen=True)
class RankingRequest:
    """Parameters of a ranking: pillar weights and which references to compare with."""

    weights: Mapping[str, float] = field(default_factory=lambda: dict(DEFAULT_WEIGHTS))
    reference_ids: tuple[str, ...] | None = None
    reference_categories: tuple[str, ...] | None = None

    def __post_init__(self):
        if self.weights.keys() != set(PILLARS):
            raise CheckFailed(f"Weights must name {PILLARS}")
        values = list(self.weights.values())
        if any(not math.isfinite(w) or w < 0 for w in values) or sum(values) <= 0:
            raise CheckFailed("Weights must be finite, nonnegative and not all zero")
        if self.reference_ids is not None and self.reference_categories is not None:
            raise CheckFailed("Choose references by id or by category, not both")

    def shares(self) -> dict[str, float]:
        total = sum(self.weights.values())
        return {p: self.weights[p] / total for p in PILLARS}


def select_references(references: DataFrame, request: RankingRequest) -> DataFrame:
    """Enabled references asked for by id, or by category (commercial by default)."""
    enabled = references.where("enabled")
    if request.reference_ids is None:
        categories = list(request.reference_categories or ("commercial",))
        return enabled.where(F.col("category").isin(categories))
    ids = list(request.reference_ids)
    chosen = enabled.where(F.col("id").isin(ids))
    if not ids or len(set(ids)) != len(ids) or chosen.count() != len(ids):
        raise CheckFailed("The chosen references must exist, be enabled and be named once each")
    return chosen


def _by_pillar(specs: Sequence[FeatureSpec], bounds) -> dict[str, list[tuple[FeatureSpec, float]]]:
    """Active features per pillar with weights renormalized inside the pillar."""
    out = {}
    for pillar in PILLARS:
        active = [s for s in specs if s.pillar == pillar and bounds[s.key][1] > bounds[s.key][0]]
        total = sum(s.weight for s in active)
        out[pillar] = [(s, s.weight / total) for s in active]
    return out


def score(
    wide: DataFrame, references: DataFrame, specs: Sequence[FeatureSpec],
    bounds: Mapping[str, tuple[float, float]], request: RankingRequest = RankingRequest(),
    include_references: bool = False,
) -> DataFrame:
    """Score every row of ``wide`` (entity_id + one column per registered key).

    Adds pillars, expansion_score, coverage, exclusion_reasons, matches, factors,
    strongest and weakest. ``references`` has id, entity_id, category, enabled. One
    shuffle marks reference entities (none when they are few); the rest is row-local.
    """
    grouped = _by_pillar(specs, bounds)
    familiarity = grouped["familiarity"]
    active = [(s, w) for p in PILLARS for s, w in grouped[p]]
    chosen = select_references(references, request).select(F.col("id").alias("reference_id"), "entity_id")
    ref_rows, few = _reference_rows(chosen, wide, specs)

    def with_normals(df: DataFrame, which) -> DataFrame:
        return df.withColumns({f"_n_{s.key}": F.expr(normal_sql(s, *bounds[s.key])) for s, _ in which})

    members = references.select("entity_id").distinct().withColumn("_is_reference", F.lit(True))
    marked = with_normals(join_lookup(spread(wide, "entity_id"), members, ["entity_id"], "left"), active)
    reasons = [f"CASE WHEN `{s.key}` IS NULL THEN 'Missing feature: {s.key}' END" for s in specs]
    reasons += [f"'No discriminating features in {p}'" for p in PILLARS if not grouped[p]]
    if not include_references:
        reasons.append(f"CASE WHEN _is_reference THEN '{REFERENCE_REASON}' END")
    scored = marked.withColumn("_reasons", F.expr(f"array_compact(array({', '.join(reasons)}))"))

    none = F.expr(f"cast(array() AS {MATCH})")
    if not familiarity:
        scored = scored.withColumn("matches", none)
    else:
        vector = F.array(*[f"_n_{s.key}" for s, _ in familiarity])
        groups = group_references(with_normals(ref_rows, familiarity), vector)
        scored = add_matches(scored, groups, vector, [w for _, w in familiarity])
        scored = scored.withColumn("matches", F.when(F.size("_reasons") == 0, F.col("matches")).otherwise(none))
    scored = scored.withColumn("exclusion_reasons", F.expr(
        f"CASE WHEN size(_reasons) = 0 AND size(matches) = 0 THEN array('{NO_MATCH_REASON}') ELSE _reasons END"))

    shares = request.shares()
    pillars = {"familiarity": "get(matches, 0).similarity"}
    for pillar in PILLARS[1:]:
        terms = [f"`_n_{s.key}` * {100 * w!r}D" for s, w in grouped[pillar]]
        pillars[pillar] = " + ".join(terms) or "0D"
    ranked = "size(exclusion_reasons) = 0"
    scored = scored.withColumns({p: F.expr(f"CASE WHEN {ranked} THEN {e} END") for p, e in pillars.items()})

    scored = _with_nearest(scored, ref_rows, few, [s for s, _ in familiarity], with_normals, familiarity)
    factors = ", ".join(_factor(s, w) for s, w in active)
    performance = (
        "sort_array(transform(factors, f -> named_struct('p', CASE WHEN f.pillar = 'familiarity' "
        "THEN 1 - sqrt(f.distance_component) ELSE f.normalized_value END, 'key', f.key)))"
    )
    total = " + ".join(f"{p} * {shares[p]!r}D" for p in PILLARS)
    return (
        scored.withColumn("factors", F.expr(
            f"cast(CASE WHEN {ranked} THEN array({factors}) ELSE array() END AS {FACTOR})"))
        .withColumn("_order", F.expr(f"transform({performance}, f -> f.key)"))
        .withColumns({
            "expansion_score": F.expr(total),
            "coverage": F.expr(f"({len(specs)} - size(filter(_reasons, r -> r LIKE 'Missing feature: %'))) / {len(specs)}"),
            "strongest": F.expr("slice(reverse(_order), 1, 2)"),
            "weakest": F.expr("slice(_order, 1, 2)"),
        })
        .drop("_reasons", "_nearest", "_is_reference", "_order", *[f"_n_{s.key}" for s, _ in active])
    )


FACTOR = (
    "array<struct<key: string, pillar: string, raw_value: double, normalized_value: double, "
    "reference_value: double, distance_component: double, score_points: double>>"
)


def _factor(s: FeatureSpec, w: float) -> str:
    """One row of the factor table; a reference value and component only for familiarity."""
    n = f"`_n_{s.key}`"
    if s.pillar == "familiarity":
        near = f"_nearest.`{s.key}`"
        gap = f"({n} - _nearest.`_n_{s.key}`)"
        reference, component, points = near, f"{gap} * {gap} * {w!r}D", "cast(NULL AS DOUBLE)"
    else:
        reference, component, points = "cast(NULL AS DOUBLE)", "cast(NULL AS DOUBLE)", f"{n} * {100 * w!r}D"
    return (
        f"named_struct('key', '{s.key}', 'pillar', '{s.pillar}', 'raw_value', cast(`{s.key}` AS DOUBLE), "
        f"'normalized_value', {n}, 'reference_value', {reference}, 'distance_component', {component}, "
        f"'score_points', {points})"
    )


def _reference_rows(chosen: DataFrame, wide: DataFrame, specs) -> tuple[DataFrame, bool]:
    """Chosen references with their feature values; all must exist and be complete.

    Read once: kept as a local table when few, written to scratch otherwise.
    """
    rows = chosen.join(wide, "entity_id", "left")
    head = rows.limit(REFERENCES_IN_PLAN + 1).collect()
    few = len(head) <= REFERENCES_IN_PLAN
    kept = wide.sparkSession.createDataFrame(head, rows.schema) if few else stage(rows, "references")
    incomplete = (
        [r["reference_id"] for r in head if any(r[s.key] is None for s in specs)] if few
        else [r["reference_id"] for r in kept.where(~fx.is_complete(specs)).limit(5).collect()]
    )
    if not head:
        raise CheckFailed("The chosen references must exist, be enabled and be named once each")
    if incomplete:
        raise CheckFailed(f"Incomplete reference: {incomplete[:5]}")
    return kept, few


def _with_nearest(scored: DataFrame, ref_rows: DataFrame, few: bool, specs, with_normals, pairs) -> DataFrame:
    """Raw and normalized familiarity values of the nearest reference as ``_nearest``."""
    fields = [f"'{s.key}', cast(`{s.key}` AS DOUBLE), '_n_{s.key}', `_n_{s.key}`" for s in specs]
    near = with_normals(ref_rows, pairs).select(
        F.col("reference_id").alias("_near_id"),
        F.expr(f"named_struct({', '.join([*fields, repr('_'), '1'])})").alias("_nearest"),
    )
    keyed = scored.withColumn("_near_id", F.get(F.col("matches"), F.lit(0))["reference_id"])
    # A popular reference makes this key hot: broadcast, or split the hot keys.
    joined = (
        keyed.join(F.broadcast(near), "_near_id", "left") if few
        else join_lookup(keyed, near, ["_near_id"], "left")
    )
    return joined.drop("_near_id")


def rank(scored: DataFrame) -> DataFrame:
    """Rank the scored rows by full-precision score, ties by id; the rest get null.

    The scores are computed once into a scratch table. Only (id, score) pairs are sorted,
    range-partitioned so no task sees all of them, and the positions are joined back.
    """
    rows = stage(scored.drop("rank"), "scored")
    pairs = rows.where("expansion_score IS NOT NULL").select("entity_id", "expansion_score")
    placed = add_position(pairs, [F.col("expansion_score").desc(), F.col("entity_id")], "rank")
    return rows.join(placed.select("entity_id", "rank"), "entity_id", "left")


def rank_entities(wide, references, specs, bounds, request=RankingRequest(), entity_ids=None,
                  include_references=False) -> DataFrame:
    """Score and rank candidates, or exactly ``entity_ids`` (known and unique)."""
    rows = wide
    if entity_ids is not None:
        require_none(entity_ids.groupBy("entity_id").count().where("count > 1"), "Repeated entity ids")
        require_none(entity_ids.join(wide, "entity_id", "left_anti"), "Unknown entity ids")
        rows = wide.join(entity_ids, "entity_id", "left_semi")
        refs_wide = wide.join(references.select("entity_id"), "entity_id", "left_semi")
        rows = rows.unionByName(refs_wide).dropDuplicates(["entity_id"])
    scored = score(rows, references, specs, bounds, request, include_references)
    if entity_ids is not None:
        scored = scored.join(entity_ids, "entity_id", "left_semi")
    return rank(scored)


def rank_references(wide, references, specs, bounds, request=RankingRequest()) -> DataFrame:
    """Rank the enabled reference entities among themselves, self never its own match."""
    members = references.where("enabled").select("entity_id").distinct()
    return rank_entities(wide, references, specs, bounds, request, members, include_references=True)


def ranks_by_weights(scored: DataFrame, requests: Mapping[str, RankingRequest]) -> DataFrame:
    """(weights, entity_id, expansion_score, rank) for every named set of weights, from one scoring.

    The pillars do not depend on the weights, so rows are scored once and each is weighed as
    often as there are sets. Every set ranks the same entities, so one global order by
    (set, score, id) holds all rankings one after another, in slices of bounded size.
    """
    kept = stage(scored.where("expansion_score IS NOT NULL").select("entity_id", *PILLARS), "pillars")
    n = kept.count()
    sets = F.array(*[F.struct(F.lit(name).alias("weights"), *[F.lit(request.shares()[p]).alias(f"_{p}") for p in PILLARS])
                     for name, request in requests.items()])
    weighed = kept.withColumn("_w", F.explode(sets)).select("entity_id", "_w.weights", F.expr(
        " + ".join(f"{p} * _w._{p}" for p in PILLARS)).alias("expansion_score"))
    placed = add_position(weighed, [F.col("weights"), F.col("expansion_score").desc(), F.col("entity_id")], "rank")
    return placed.withColumn("rank", ((F.col("rank") - 1) % F.lit(max(n, 1)) + 1).cast("long")).select(
        "weights", "entity_id", "expansion_score", "rank")


def weight_sensitivity(ranks: DataFrame, baseline: str) -> DataFrame:
    """Rank and score change of every entity under each other set of ``ranks`` against the ``baseline`` set."""
    base = ranks.where(F.col("weights") == baseline).select(
        "entity_id", F.col("rank").alias("baseline_rank"),
        F.col("expansion_score").alias("baseline_score"),
    )
    return (
        join_lookup(ranks.where(F.col("weights") != baseline), base, ["entity_id"])
        .withColumn("rank_change", F.col("baseline_rank") - F.col("rank"))
        .withColumn("score_change", F.col("expansion_score") - F.col("baseline_score"))
    )


def require_rankable(ranked: DataFrame, minimum: int = 8) -> DataFrame:
    n = ranked.where("rank IS NOT NULL").limit(minimum).count()
    if n < minimum:
        raise CheckFailed(f"{n} ranked candidates; at least {minimum} are required")
    return ranked


def explain_rows(
    ranked: DataFrame, names: DataFrame, specs: Sequence[FeatureSpec],
    request: RankingRequest = RankingRequest(), prefix: str = "",
) -> DataFrame:
    """One explanation row per entity: summary, advantages, tradeoffs.

    ``names`` has entity_id and display_name for candidates and references.
    """
    label = F.create_map(*[F.lit(x) for s in specs for x in (s.key, s.label)])
    unit = F.create_map(*[F.lit(x) for s in specs for x in (s.key, s.unit)])
    shares = request.shares()
    near = F.get(F.col("matches"), F.lit(0))["entity_id"]
    named = ranked.join(names, "entity_id", "left").withColumn("_near_entity", near)
    other = names.select(
        F.col("entity_id").alias("_near_entity"), F.col("display_name").alias("_near_name")
    )
    # Many entities share one nearest reference, so this key runs hot by nature.
    named = join_lookup(named, other, ["_near_entity"], "left")

    def advantage(key):
        f = F.get(F.filter(F.col("factors"), lambda x: x["key"] == key), F.lit(0))
        return F.when(
            f["pillar"] == "familiarity",
            F.concat(label[key], F.lit(": "), F.format_number(f["raw_value"], 2), F.lit(" "), unit[key],
                     F.lit("; comparison reference "), F.format_number(f["reference_value"], 2), F.lit(".")),
        ).otherwise(
            F.concat(label[key], F.lit(" contributes "), F.format_string("%.1f", f["score_points"]),
                     F.lit(" points to "), f["pillar"], F.lit("."))
        )

    applied = ", ".join(f"{p} {shares[p]:.0%}" for p in PILLARS)
    is_ranked = F.col("rank").isNotNull()
    summary = F.when(
        is_ranked,
        F.concat(
            F.lit(prefix), F.col("display_name"), F.lit(" ranks #"), F.col("rank").cast("string"),
            F.lit(" with a screening score of "), F.format_string("%.1f", F.col("expansion_score")),
            F.lit(". "), F.col("_near_name"),
            F.lit(" is the nearest selected reference across climate and commuting proxies. "
                  f"Applied weights: {applied}."),
        ),
    ).otherwise(F.concat(F.lit(prefix), F.col("display_name"), F.lit(" is unranked.")))
    lower = F.concat(
        F.lit("Lower relative factors: "),
        F.array_join(F.transform("weakest", lambda k: F.lower(label[k])), ", "), F.lit("."),
    )
    return named.select(
        "entity_id", "rank", summary.alias("summary"),
        F.transform("strongest", advantage).alias("advantages"),
        F.when(is_ranked, F.array(lower, F.lit(CAVEAT))).otherwise(F.col("exclusion_reasons"))
        .alias("tradeoffs"),
    )


# Fixed value: the sentence every ranked explanation ends with.
CAVEAT = (
    "Public charging does not establish secured fleet capacity. Regulatory review remains "
    "separate; this is not a safety or approval assessment."
)
