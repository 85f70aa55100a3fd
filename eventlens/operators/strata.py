"""Channel stratification: evidence, two-axis classification, pinned snapshots, overrides."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventlens.config import CHANNEL_TYPES, FOCUS_VALUES, StratificationRules, approved
from eventlens.errors import DeduplicationRuleMissingError, SnapshotMutationError
from eventlens.functions.keys import md5_uuid, multiset_hash
from eventlens.functions.text import matched_terms, mentions_any, title_and_description
from eventlens.functions.times import micros_between, ntz
from eventlens.operators.joins import require_all
from eventlens.operators.ordered import bounded, latest_per_key, lookup
from eventlens.operators.windows import join_on_day
from eventlens.session import durable

DeduplicationRule = Callable[[DataFrame], DataFrame]
_RULES: dict[str, DeduplicationRule] = {}

_DAY_MICROS = 86_400_000_000


def register_deduplication_rule(version: str) -> Callable[[DeduplicationRule], DeduplicationRule]:
    """Register a cross-item rule: evidence DataFrame in, evidence DataFrame out.

    A rule may only set is_duplicate, duplicate_cluster_id and included_in_prevalence.
    """

    def add(rule: DeduplicationRule) -> DeduplicationRule:
        _RULES[version] = rule
        return rule

    return add


def deduplication_rule(rules: StratificationRules) -> DeduplicationRule:
    """The approved rule, the identity for an approved explicit none, or an error."""
    version, status = rules.deduplication_rule_version, rules.deduplication_rule_status
    if status == "APPROVED_EXPLICIT_NONE" or (version == "EXPLICIT_NONE" and status == "APPROVED"):
        return lambda evidence: evidence
    if status != "APPROVED" or version in (None, "", "HUMAN_APPROVAL_REQUIRED"):
        raise DeduplicationRuleMissingError(f"rule '{version}' has status '{status}'")
    if version not in _RULES:
        raise DeduplicationRuleMissingError(f"approved rule '{version}' is not registered")
    return _RULES[version]


def strata_seed(facts: DataFrame, channel_types=CHANNEL_TYPES, focus_values=FOCUS_VALUES) -> DataFrame:
    """All channel type x focus combinations, from two literal arrays."""
    one = facts.sparkSession.range(1)
    return (
        one.select(F.explode(F.array(*map(F.lit, channel_types))).alias("channel_type_value"))
        .select("channel_type_value", F.explode(F.array(*map(F.lit, focus_values))).alias("focus_value"))
        .select(
            md5_uuid(F.col("channel_type_value"), F.col("focus_value")).alias("stratum_key"),
            "channel_type_value",
            "focus_value",
            F.concat_ws(" x ", "channel_type_value", "focus_value").alias("stratum_name"),
            ((F.col("channel_type_value") != "UNCLASSIFIED") & (F.col("focus_value") != "UNCLASSIFIED")).alias(
                "analytical_eligibility"
            ),
        )
    )


def channel_evidence(
    videos: DataFrame,
    periods: DataFrame,
    aliases_a: Sequence[str],
    aliases_b: Sequence[str],
    rules: StratificationRules,
) -> DataFrame:
    """Evidence items of every channel and event: videos of the fallback window before the cutoff.

    `videos` has channel_key, video_key, source_id, published_at, is_short, title, description;
    `periods` has event_version_key and reference_period_end. Descriptions are matched and
    then left behind. Later rows of the same source
    id are flagged as exact duplicates, unresolved shorts stay visible but do not count.
    """
    low = F.col("_text")
    clubs = [F.when(mentions_any(low, names, lowered=True), F.lit(club)) for club, names in rules.clubs]
    tagged = videos.withColumn("_text", title_and_description(F.col("title"), F.col("description"))).select(
        *[c for c in videos.columns if c != "description"],
        matched_terms(low, aliases_a, lowered=True).alias("matched_a"),
        matched_terms(low, aliases_b, lowered=True).alias("matched_b"),
        F.array_compact(F.array(*clubs)).cast("array<string>").alias("matched_clubs"),
        mentions_any(low, rules.analysis_keywords, lowered=True).alias("mentions_analysis"),
    )
    # the evidence days per event; their span becomes a range filter the scan can push down
    cutoffs = periods.select(
        "event_version_key",
        "reference_period_end",
        (F.col("reference_period_end") - F.make_dt_interval(F.lit(rules.fallback_days))).alias("_start"),
    )
    span = cutoffs.agg(
        F.min("_start").cast("string").alias("lo"),
        F.max("reference_period_end").cast("string").alias("hi"),
        F.count(F.lit(1)).alias("periods"),
    ).first()
    days = cutoffs.withColumn(
        "_day",
        F.explode(F.sequence(F.to_date("_start"), F.to_date("reference_period_end"), F.expr("interval 1 day"))),
    ).drop("_start")
    published = F.col("published_at")
    near = (published >= ntz(span["lo"])) & (published < ntz(span["hi"])) if span["periods"] else F.lit(False)
    usable = F.col("is_short").isNull() | ~F.col("is_short")
    items = (
        join_on_day(tagged.filter(near & usable), days, "published_at", span["periods"] * (rules.fallback_days + 2))
        .withColumn("_age", micros_between(published, F.col("reference_period_end")))
        .filter((F.col("_age") > 0) & (F.col("_age") <= rules.fallback_days * _DAY_MICROS))
    )
    # evidence items are a stored table: texts are matched once, all later passes read narrow rows
    items = durable(items)
    scope = ["event_version_key", "channel_key"]
    first = items.groupBy(*scope, "source_id").agg(F.min(F.struct("published_at", "video_key")).alias("_first"))
    # the first row joins on its own unique key, so a source id with many copies is no hot key
    firsts = first.select(
        *scope,
        "source_id",
        F.col("_first.published_at").alias("published_at"),
        F.col("_first.video_key").alias("video_key"),
        F.lit(True).alias("_is_first"),
    )
    duplicate = F.col("_is_first").isNull()
    flagged = (
        items.join(firsts, [*scope, "source_id", "published_at", "video_key"], "left")
        .withColumn("is_duplicate", duplicate)
        .withColumn("duplicate_cluster_id", F.when(duplicate, F.col("source_id")))
        .withColumn("included_in_prevalence", ~duplicate & F.col("is_short").eqNullSafe(F.lit(False)))
        .withColumn("mentions_a", F.size("matched_a") > 0)
        .withColumn("mentions_b", F.size("matched_b") > 0)
        .drop("_is_first")
    )
    return deduplication_rule(rules)(flagged)


def same_title_rule(evidence: DataFrame, hot: int | None = None) -> DataFrame:
    """Example cross-item rule: equal normalised titles cluster to the earliest included video."""
    scope = ["event_version_key", "channel_key", "_title"]
    titled = evidence.withColumn("_title", F.lower(F.trim("title")))
    first = (
        titled.filter("included_in_prevalence")
        .groupBy(*scope)
        .agg(F.min(F.struct("published_at", "source_id", "video_key")).alias("_f"), F.count(F.lit(1)).alias("_n"))
        .filter("_n > 1")
        .select(*scope, F.col("_f.source_id").alias("_cluster"), F.col("_f.video_key").alias("_keep"))
    )
    repeat = F.col("included_in_prevalence") & F.col("_keep").isNotNull() & (F.col("video_key") != F.col("_keep"))
    return (
        lookup(titled, first, scope, "left", hot)
        .withColumn("_repeat", F.coalesce(repeat, F.lit(False)))
        .withColumn("is_duplicate", F.col("is_duplicate") | F.col("_repeat"))
        .withColumn(
            "duplicate_cluster_id", F.when(F.col("_repeat"), F.col("_cluster")).otherwise(F.col("duplicate_cluster_id"))
        )
        .withColumn("included_in_prevalence", F.col("included_in_prevalence") & ~F.col("_repeat"))
        .drop("_title", "_cluster", "_keep", "_repeat")
    )


register_deduplication_rule("same_title_v1")(same_title_rule)


_SPANS = ("primary", "fallback")


def channel_statistics(evidence: DataFrame, rules: StratificationRules) -> DataFrame:
    """Everything the classifiers need per event and channel, from one pass over the evidence.

    Counts are taken for both window lengths at once and chosen afterwards, so the evidence is
    neither joined back to its window nor aggregated again. The window is the primary one;
    the fallback if only that reaches the minimum; else the primary one below minimum.
    """
    counted = F.col("included_in_prevalence")
    aggs = []
    for span, days in zip(_SPANS, (rules.primary_days, rules.fallback_days)):
        inside = counted & (F.col("_age") <= days * _DAY_MICROS)
        aggs += [
            F.count_if(inside).alias(f"videos_{span}"),
            F.count_if(inside & F.col("mentions_a")).alias(f"_a_{span}"),
            F.count_if(inside & F.col("mentions_b")).alias(f"_b_{span}"),
            F.count_if(inside & F.col("mentions_analysis")).alias(f"_analysis_{span}"),
        ]
    sub = F.floor((F.col("_age") - 1) / F.lit(rules.subwindow_days * _DAY_MICROS))
    for i in range(3):
        here = counted & (sub == i)
        aggs += [
            F.count_if(here).alias(f"_n{i}"),
            F.count_if(here & F.col("mentions_a")).alias(f"_a{i}"),
            F.count_if(here & F.col("mentions_b")).alias(f"_b{i}"),
        ]
    use_fallback = (F.col("videos_primary") < rules.min_videos) & (F.col("videos_fallback") >= rules.min_videos)

    def chosen(prefix: str) -> Column:
        return F.when(F.col("fallback_used"), F.col(f"{prefix}_fallback")).otherwise(F.col(f"{prefix}_primary"))

    return (
        evidence.groupBy("event_version_key", "channel_key", "reference_period_end")
        .agg(*aggs, multiset_hash(_manifest_item()).alias("evidence_manifest_hash"))
        .withColumn("fallback_used", use_fallback)
        .withColumns(
            {
                "effective_window_days": F.when(F.col("fallback_used"), rules.fallback_days)
                .otherwise(rules.primary_days)
                .cast("bigint"),
                "eligible_video_count": chosen("videos"),
                "a_video_count": chosen("_a"),
                "b_video_count": chosen("_b"),
                "analysis_video_count": chosen("_analysis"),
            }
        )
        .withColumn(
            "reference_period_start",
            F.col("reference_period_end") - F.make_dt_interval(F.col("effective_window_days").cast("int")),
        )
    )


def evidence_window(statistics: DataFrame) -> DataFrame:
    """Effective window per event and channel."""
    return statistics.select(
        "event_version_key",
        "channel_key",
        "reference_period_start",
        "reference_period_end",
        "videos_primary",
        "videos_fallback",
        "fallback_used",
        "effective_window_days",
    )


def _focus(n: Column, a: Column, b: Column, rules: StratificationRules, combined: float | None) -> Column:
    """Focus label from counts; without `combined` dual prevalence alone gives the mixed label."""
    alpha = rules.smoothing_alpha
    ratio_a, ratio_b = (a + alpha) / (b + alpha), (b + alpha) / (a + alpha)
    prev_a, prev_b = a / n, b / n
    both = (prev_a > rules.prevalence_floor) & (prev_b > rules.prevalence_floor)
    mixed = both if combined is None else both & (prev_a + prev_b >= combined)
    return (
        F.when((ratio_a > rules.focus_ratio_threshold) & (prev_a > rules.prevalence_floor), F.lit("A_FOCUSED"))
        .when((ratio_b > rules.focus_ratio_threshold) & (prev_b > rules.prevalence_floor), F.lit("B_FOCUSED"))
        .when(mixed, F.lit("MIXED_FOCUS"))
        .otherwise(F.lit("NO_STRONG_DOMINANT_FOCUS"))
    )


def classify_focus(stats: DataFrame, rules: StratificationRules, keep: Sequence[str] = ()) -> DataFrame:
    """Focus axis from the channel statistics.

    Dual prevalence without an approved combined threshold stops the job.
    """
    n, a, b = F.col("eligible_video_count"), F.col("a_video_count"), F.col("b_video_count")
    alpha = rules.smoothing_alpha
    prev_a, prev_b = F.coalesce(F.try_divide(a, n), F.lit(0.0)), F.coalesce(F.try_divide(b, n), F.lit(0.0))
    ratio = F.when(a >= b, (a + alpha) / (b + alpha)).otherwise((b + alpha) / (a + alpha))
    enough = n >= rules.min_videos
    assigned = F.when(~enough, F.lit("UNCLASSIFIED")).otherwise(
        _focus(F.greatest(n, F.lit(1)), a, b, rules, rules.combined_focus_threshold)
    )
    if rules.combined_focus_threshold is None:
        message = F.concat(
            F.lit("combined_focus_threshold is not approved but needed for channel "), F.col("channel_key").cast("string")
        )
        assigned = F.when(assigned == "MIXED_FOCUS", F.raise_error(message).cast("string")).otherwise(assigned)
    stats = stats.withColumn("focus_value", assigned)
    agreeing, evaluated = F.lit(0), F.lit(0)
    for i in range(3):
        valid = F.col(f"_n{i}") >= rules.subwindow_min_videos
        label = _focus(F.greatest(F.col(f"_n{i}"), F.lit(1)), F.col(f"_a{i}"), F.col(f"_b{i}"), rules, None)
        evaluated = evaluated + F.when(valid, 1).otherwise(0)
        agreeing = agreeing + F.when(valid & (label == F.col("focus_value")), 1).otherwise(0)
    stats = stats.withColumn("subwindows_evaluated", evaluated.cast("bigint")).withColumn(
        "subwindows_agreeing", agreeing.cast("bigint")
    )
    confidence = F.when(
        enough & ~F.col("fallback_used") & (F.col("subwindows_agreeing") >= 2), F.lit("MEDIUM")
    ).otherwise(F.lit("LOW"))
    return stats.select(
        "event_version_key",
        "channel_key",
        *keep,
        "reference_period_start",
        "reference_period_end",
        "effective_window_days",
        "fallback_used",
        "eligible_video_count",
        "a_video_count",
        "b_video_count",
        prev_a.alias("a_prevalence"),
        prev_b.alias("b_prevalence"),
        ratio.alias("focus_ratio"),
        "focus_value",
        confidence.alias("focus_confidence"),
        "subwindows_evaluated",
        "subwindows_agreeing",
    )


def documented_focus_confidence(focus: DataFrame, rules: StratificationRules, large_margin: float) -> DataFrame:
    """Confidence as the protocol text words it, next to the implemented rule.

    HIGH needs more than 30 videos, three agreeing subwindows and a ratio at least
    `large_margin` times the threshold; within 10 % of the ratio threshold is LOW.
    """
    threshold = rules.focus_ratio_threshold
    near = F.abs(F.col("focus_ratio") - threshold) <= 0.1 * threshold
    high = (
        (F.col("eligible_video_count") > 30)
        & (F.col("subwindows_agreeing") == 3)
        & (F.col("focus_ratio") >= large_margin * threshold)
    )
    return focus.withColumn(
        "focus_confidence",
        F.when(F.col("fallback_used") | near | (F.col("focus_value") == "UNCLASSIFIED"), F.lit("LOW"))
        .when(high, F.lit("HIGH"))
        .otherwise(F.col("focus_confidence")),
    )


def club_counts(evidence: DataFrame, rules: StratificationRules) -> DataFrame:
    """The two most mentioned clubs per event and channel, for both window lengths.

    Each video counts once per club. The last step sorts at most one entry per configured
    club, so its arrays are as short as the registry.
    """
    keys = ["event_version_key", "channel_key"]
    per_club = (
        evidence.filter("included_in_prevalence")
        .select(*keys, "_age", F.explode("matched_clubs").alias("club"))
        .groupBy(*keys, "club")
        .agg(
            *[
                F.count_if(F.col("_age") <= days * _DAY_MICROS).alias(span)
                for span, days in zip(_SPANS, (rules.primary_days, rules.fallback_days))
            ]
        )
    )
    return per_club.groupBy(*keys).agg(
        *[
            F.slice(F.sort_array(F.collect_list(F.struct(F.col(span).alias("n"), "club")), asc=False), 1, 2).alias(span)
            for span in _SPANS
        ]
    )


def classify_type(
    stats: DataFrame, evidence: DataFrame, channels: DataFrame, rules: StratificationRules
) -> DataFrame:
    """Channel-type axis: evidence gate, registries, club share, analysis share, fallback.

    `channels` has channel_key, source_channel_id, about_description.
    """
    keys = ["event_version_key", "channel_key"]
    base = stats.join(
        channels.select("channel_key", "source_channel_id", "about_description"), "channel_key", "left"
    )
    if rules.clubs:
        base = base.join(club_counts(evidence, rules), keys, "left")
        best = F.when(F.col("fallback_used"), F.col("fallback")).otherwise(F.col("primary"))
        top_n, second_n = (F.coalesce(F.get(best, F.lit(i))["n"], F.lit(0)) for i in (0, 1))
    else:
        top_n = second_n = F.lit(0)
    n = F.col("eligible_video_count")
    top, second = F.coalesce(F.try_divide(top_n, n), F.lit(0.0)), F.coalesce(F.try_divide(second_n, n), F.lit(0.0))
    identity = (F.trim(F.coalesce("about_description", F.lit(""))) != "") | F.col("source_channel_id").isin(
        *rules.third_party_channels
    )
    enough = identity & (n >= rules.min_videos)
    broadcaster = F.col("source_channel_id").isin(*rules.broadcasters) & F.lit(bool(rules.broadcaster_registry_version))
    analyst = F.col("source_channel_id").isin(*rules.analysis_publishers) & F.lit(bool(rules.analysis_registry_version))
    dominant = top > rules.club_dominance_threshold
    if rules.club_winning_margin is None:
        club = F.when(
            dominant,
            F.raise_error(F.lit("club_winning_margin is not approved but needed")).cast("boolean"),
        ).otherwise(F.lit(False))
    else:
        club = dominant & (top - second >= rules.club_winning_margin)
    share = F.coalesce(F.try_divide(F.col("analysis_video_count"), n), F.lit(0.0))
    by_share = (
        F.lit(False)
        if rules.analysis_share_threshold is None or not rules.analysis_keywords
        else share >= rules.analysis_share_threshold
    )
    decided = (
        F.when(~enough, F.struct(F.lit("UNCLASSIFIED"), F.lit("LOW")))
        .when(broadcaster, F.struct(F.lit("BROAD_REACH_PUBLISHER"), F.lit("HIGH")))
        .when(
            club,
            F.struct(
                F.lit("CLUB_MEDIA"),
                F.when(top > rules.club_high_confidence_share, F.lit("HIGH")).otherwise(F.lit("MEDIUM")),
            ),
        )
        .when(analyst, F.struct(F.lit("ANALYSIS_PUBLISHER"), F.lit("HIGH")))
        .when(by_share, F.struct(F.lit("ANALYSIS_PUBLISHER"), F.lit("MEDIUM")))
        .otherwise(F.struct(F.lit("INDEPENDENT_CREATOR"), F.lit("LOW")))
    )
    return base.withColumn("_d", decided).select(
        *stats.columns,
        F.col("_d").getField("col1").alias("channel_type_value"),
        F.col("_d").getField("col2").alias("channel_type_confidence"),
        top.alias("club_share"),
        second.alias("runner_up_share"),
        share.alias("analysis_share"),
    )


def _manifest_item() -> Column:
    return F.concat_ws(
        "|",
        "source_id",
        F.col("published_at").cast("string"),
        F.coalesce(F.col("is_short").cast("string"), F.lit("null")),
        F.array_join("matched_a", ","),
        F.array_join("matched_b", ","),
        F.col("is_duplicate").cast("string"),
        F.col("included_in_prevalence").cast("string"),
    )


def manifest_hash(evidence: DataFrame) -> DataFrame:
    """Fingerprint of the evidence per event and channel, independent of scan order."""
    return evidence.groupBy("event_version_key", "channel_key").agg(
        multiset_hash(_manifest_item()).alias("evidence_manifest_hash")
    )


def assess_channels(
    evidence: DataFrame, channels: DataFrame, rules: StratificationRules, assessed_at: Column
) -> DataFrame:
    """Assessment record for every event and channel, both axes and the evidence fingerprint."""
    keys = ["event_version_key", "channel_key"]
    stats = channel_statistics(evidence, rules)
    kind = classify_type(stats, evidence, channels, rules)
    focus = classify_focus(kind, rules, keep=("channel_type_value", "channel_type_confidence", "evidence_manifest_hash"))
    eligible = (
        (F.col("channel_type_value") != "UNCLASSIFIED")
        & (F.col("focus_value") != "UNCLASSIFIED")
        & ~F.col("fallback_used")
    )
    return (
        focus.withColumn("headline_decomposition_eligible", eligible)
        .withColumn("classification_protocol_version", F.lit(rules.protocol_version))
        .withColumn("rule_config_hash", F.sha2(F.lit(rules.digest_text()), 256))
        .withColumn("stratum_key", md5_uuid(F.col("channel_type_value"), F.col("focus_value")))
        .withColumn("assessed_at", assessed_at)
        .withColumn("assessment_id", md5_uuid(*[F.col(k) for k in keys], F.col("rule_config_hash"), F.col("assessed_at")))
    )


SNAPSHOT_KEYS = ("event_version_key", "channel_key", "classification_protocol_version")
SNAPSHOT_FIELDS = (
    "channel_type_value",
    "focus_value",
    "channel_type_confidence",
    "focus_confidence",
    "reference_period_start",
    "reference_period_end",
    "effective_window_days",
    "eligible_video_count",
    "a_video_count",
    "b_video_count",
    "a_prevalence",
    "b_prevalence",
    "focus_ratio",
    "fallback_used",
    "headline_decomposition_eligible",
    "override_id",
)


def snapshot_payload(assessments: DataFrame) -> DataFrame:
    """The sixteen pinned fields, statistics rounded to five places."""
    rounded = ("a_prevalence", "b_prevalence", "focus_ratio")
    frame = assessments if "override_id" in assessments.columns else assessments.withColumn(
        "override_id", F.lit(None).cast("string")
    )
    return frame.select(
        *SNAPSHOT_KEYS, *[F.round(c, 5).alias(c) if c in rounded else F.col(c) for c in SNAPSHOT_FIELDS]
    )


def compare_snapshots(existing: DataFrame, candidates: DataFrame) -> DataFrame:
    """INSERTED, IDEMPOTENT_NOOP or VIOLATION per candidate."""
    old = snapshot_payload(existing).select(*SNAPSHOT_KEYS, F.struct(*SNAPSHOT_FIELDS).alias("_old"))
    new = snapshot_payload(candidates).select(*SNAPSHOT_KEYS, F.struct(*SNAPSHOT_FIELDS).alias("_new"))
    status = (
        F.when(F.col("_old").isNull(), F.lit("INSERTED"))
        .when(F.col("_old").eqNullSafe(F.col("_new")), F.lit("IDEMPOTENT_NOOP"))
        .otherwise(F.lit("VIOLATION"))
    )
    return new.join(old, list(SNAPSHOT_KEYS), "left").select(*SNAPSHOT_KEYS, status.alias("status"), "_new.*")


def pin_snapshots(existing: DataFrame, candidates: DataFrame) -> DataFrame:
    """Rows to append; a candidate that differs from its pinned snapshot stops the run."""
    compared = compare_snapshots(existing, candidates)
    broken = compared.filter("status = 'VIOLATION'").orderBy(*SNAPSHOT_KEYS).limit(5).collect()
    if broken:
        raise SnapshotMutationError(f"pinned snapshots would change: {[tuple(r)[:3] for r in broken]}")
    return compared.filter("status = 'INSERTED'").drop("status")


def apply_overrides(versions: DataFrame, strata: DataFrame, overrides: DataFrame) -> DataFrame:
    """A new audited assignment per approved override; the other axis and all history stay.

    `overrides`: channel_key, axis (CHANNEL_TYPE / FOCUS), proposed_axis_value, approved_by,
    approved_at. One without an approver is PENDING and changes nothing. Several overrides
    of one channel take effect one after the other, each closing the version before it.
    """
    ok = overrides.filter("approved_by IS NOT NULL")
    require_all(ok, versions.filter("is_current"), ["channel_key"], "current stratum version")
    in_order = Window.partitionBy("channel_key").orderBy("approved_at", "axis")
    so_far = in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def proposed(axis: str) -> Column:
        value = F.when(F.col("axis") == axis, F.col("proposed_axis_value"))
        return F.last(value, ignorenulls=True).over(so_far)

    steps = ok.select(
        "channel_key",
        proposed("CHANNEL_TYPE").alias("_type"),
        proposed("FOCUS").alias("_focus"),
        F.col("approved_at").alias("valid_from"),
        F.lead("approved_at").over(in_order).alias("valid_to"),
        (F.row_number().over(in_order) == 1).alias("_first"),
    )
    axes = strata.select("stratum_key", "channel_type_value", "focus_value")
    live = versions.filter("is_current").join(bounded(axes), "stratum_key")
    fresh = (
        steps.join(live.select("channel_key", "channel_type_value", "focus_value"), "channel_key")
        .withColumn("channel_type_value", F.coalesce("_type", "channel_type_value"))
        .withColumn("focus_value", F.coalesce("_focus", "focus_value"))
        .join(bounded(axes), ["channel_type_value", "focus_value"], "left")
        .select(
            "channel_key",
            F.coalesce("stratum_key", F.raise_error(F.lit("stratum combination does not exist"))).alias("stratum_key"),
            "valid_from",
            "valid_to",
            F.col("valid_to").isNull().alias("is_current"),
        )
    )
    closing = steps.filter("_first").select("channel_key", F.col("valid_from").alias("_closed"))
    closes = F.col("is_current") & F.col("_closed").isNotNull()
    kept = versions.join(closing, "channel_key", "left").select(
        "channel_key",
        "stratum_key",
        "valid_from",
        F.when(closes, F.col("_closed")).otherwise(F.col("valid_to")).alias("valid_to"),
        (F.col("is_current") & ~closes).alias("is_current"),
    )
    return kept.unionByName(fresh)


def stratum_distribution(candidates: DataFrame) -> DataFrame:
    """Channels, total and the spread of per-channel candidate counts per stratum and cohort.

    Input has one row per candidate: video_key, channel_key, stratum_name, cohort_type.
    Channel counts are first folded to a histogram, so a stratum with millions of channels
    reaches the percentile as few distinct counts with frequencies.
    """
    keys = ["stratum_name", "cohort_type"]
    per_channel = channel_breakdown(candidates)
    histogram = per_channel.groupBy(*keys, "candidate_count").agg(F.count(F.lit(1)).alias("f"))
    return histogram.groupBy(*keys).agg(
        F.sum("f").cast("bigint").alias("participating_channel_count"),
        F.sum(F.col("candidate_count") * F.col("f")).cast("bigint").alias("aggregate_candidate_count"),
        F.min("candidate_count").alias("min"),
        F.percentile("candidate_count", F.lit(0.25), F.col("f")).alias("p25"),
        F.percentile("candidate_count", F.lit(0.5), F.col("f")).alias("median"),
        F.percentile("candidate_count", F.lit(0.75), F.col("f")).alias("p75"),
        F.max("candidate_count").alias("max"),
    )


def channel_breakdown(candidates: DataFrame) -> DataFrame:
    """Distinct candidate videos per stratum, cohort and channel."""
    return candidates.withColumn("cohort_type", F.coalesce("cohort_type", F.lit("UNASSIGNED"))).groupBy(
        "stratum_name", "cohort_type", "channel_key"
    ).agg(F.count_distinct("video_key").alias("candidate_count"))


def window_sensitivity(
    evidence: DataFrame, rules: StratificationRules, days: Sequence[int] = (60, 90, 180)
) -> DataFrame:
    """Focus label under other trailing window lengths; one conditional count per length."""
    counted = evidence.filter("included_in_prevalence")
    keys = ["event_version_key", "channel_key"]
    aggs = []
    for d in days:
        inside = F.col("_age") <= d * _DAY_MICROS
        aggs += [
            F.count_if(inside).alias(f"_n{d}"),
            F.count_if(inside & F.col("mentions_a")).alias(f"_a{d}"),
            F.count_if(inside & F.col("mentions_b")).alias(f"_b{d}"),
        ]
    combined = approved("combined_focus_threshold", rules.combined_focus_threshold)
    per_length = F.array(
        *[
            F.struct(
                F.lit(d).cast("bigint").alias("window_days"),
                F.col(f"_n{d}").alias("video_count"),
                F.when(F.col(f"_n{d}") < rules.min_videos, F.lit("UNCLASSIFIED"))
                .otherwise(
                    _focus(F.greatest(F.col(f"_n{d}"), F.lit(1)), F.col(f"_a{d}"), F.col(f"_b{d}"), rules, combined)
                )
                .alias("focus_value"),
            )
            for d in days
        ]
    )
    return counted.groupBy(*keys).agg(*aggs).select(*keys, F.explode(per_length).alias("_w")).select(*keys, "_w.*")


def eligible_in_window(videos: DataFrame, resolution: DataFrame, scans: DataFrame) -> DataFrame:
    """Eligible videos per acquisition scan: in its window, not short, resolved or without state.

    `scans` has channel_key, scan_scope, window_start_at, window_end_at, status.
    """
    state = resolution.select("source_id", "resolution_status")
    usable = (
        videos.filter("is_short = false")
        .join(state, "source_id", "left")
        .filter("resolution_status = 'RESOLVED' OR resolution_status IS NULL")
        .select("channel_key", "video_key", "published_at")
    )
    s = scans.alias("s")
    inside = (
        (F.col("u.channel_key") == F.col("s.channel_key"))
        & (F.col("published_at") >= F.col("window_start_at"))
        & (F.col("published_at") < F.col("window_end_at"))
    )
    counts = (
        usable.alias("u")
        .join(bounded(scans).alias("s"), inside)
        .groupBy("s.channel_key", "scan_scope")
        .agg(F.count_distinct("video_key").alias("eligible_videos_observed"))
    )
    return s.join(counts, ["channel_key", "scan_scope"], "left").fillna(0, ["eligible_videos_observed"])


def fallback_scans(scans: DataFrame, rules: StratificationRules) -> DataFrame:
    """New fallback scans for completed primary scans that found too few videos."""
    due = (
        (F.col("scan_scope") == "90D_PRIMARY")
        & (F.col("status") == "COMPLETED")
        & (F.col("eligible_videos_observed") < rules.min_videos)
    )
    existing = scans.filter("scan_scope = '180D_FALLBACK'").select("channel_key")
    return (
        scans.filter(due)
        .join(existing, "channel_key", "left_anti")
        .select(
            "channel_key",
            F.lit("180D_FALLBACK").alias("scan_scope"),
            (F.col("window_end_at") - F.make_dt_interval(F.lit(rules.fallback_days))).alias("window_start_at"),
            "window_end_at",
            F.lit("PENDING").alias("status"),
        )
    )


def latest_about(pages: DataFrame) -> DataFrame:
    """Channel description from the newest channels page of each channel."""
    newest = latest_per_key(
        pages.filter("endpoint = 'channels.list'"),
        ["resource_scope_id"],
        [F.col("retrieved_at").desc(), F.col("raw_response_id").desc()],
    )
    payload = F.from_json("raw_json_payload", "items array<struct<snippet:struct<description:string>>>")
    return newest.select(
        F.col("resource_scope_id").alias("source_channel_id"),
        F.coalesce(F.get(payload["items"], 0)["snippet"]["description"], F.lit("")).alias("about_description"),
        F.col("raw_response_id").alias("about_raw_response_id"),
    )


