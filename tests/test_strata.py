"""Classification, pinning, overrides and their gates on small channels."""

import datetime as dt
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from eventlens.config import MinimumCohort, SamplingPolicy, StratificationRules
from eventlens.errors import DeduplicationRuleMissingError, GateError, SnapshotMutationError, UnapprovedParameterError
from eventlens.functions.times import ntz
from eventlens.operators import cohort, strata
from eventlens.operators.joins import require_all

END = dt.datetime(2022, 12, 17, 15)
NONE = StratificationRules(deduplication_rule_version="EXPLICIT_NONE", deduplication_rule_status="APPROVED")
SCHEMA = "channel_key string, video_key int, source_id string, published_at timestamp_ntz, is_short boolean, title string, description string"


def videos(spark, specs):
    """specs: (title, days before the end) or a full override dict."""
    rows = []
    for i, s in enumerate(specs):
        title, days = s[:2]
        extra = s[2] if len(s) > 2 else {}
        row = dict(channel_key="c", video_key=i, source_id=f"v{i}", published_at=END - dt.timedelta(days=days), is_short=False, title=title, description="")
        row.update(extra)
        rows.append(tuple(row.values()))
    return spark.createDataFrame(rows, SCHEMA)


def evidence(spark, specs, rules=NONE):
    periods = spark.createDataFrame([("E", END)], "event_version_key string, reference_period_end timestamp_ntz")
    return strata.channel_evidence(videos(spark, specs), periods, ["alpha"], ["beta"], rules)


def stats(spark, specs, rules=NONE):
    return strata.channel_statistics(evidence(spark, specs, rules), rules)


def focus(spark, specs, rules=NONE):
    return strata.classify_focus(stats(spark, specs, rules), rules).first()


def plain(n):
    return [("nothing", 5 + i) for i in range(n)]


def test_focus_counts_and_ratio(spark):
    r = focus(spark, [("alpha", 5 + i) for i in range(9)] + plain(1))
    assert (r.focus_value, r.focus_ratio, r.a_prevalence) == ("A_FOCUSED", 10.0, 0.9)
    assert focus(spark, [("beta", 5 + i) for i in range(9)] + plain(1)).focus_value == "B_FOCUSED"
    r = focus(spark, [("alpha", 5 + i) for i in range(9)])
    assert (r.focus_value, r.eligible_video_count, r.focus_ratio) == ("UNCLASSIFIED", 9, 10.0)
    assert focus(spark, [("alpha", 5 + i) for i in range(10)]).focus_ratio == 11.0


def test_mixed_focus_needs_an_approved_threshold(spark):
    specs = [("alpha", 5 + i) for i in range(5)] + [("beta", 5 + i) for i in range(5)]
    with pytest.raises(Exception, match="combined_focus_threshold"):
        focus(spark, specs)
    assert focus(spark, specs, replace(NONE, combined_focus_threshold=0.4)).focus_value == "MIXED_FOCUS"
    assert focus(spark, specs, replace(NONE, combined_focus_threshold=1.1)).focus_value == "NO_STRONG_DOMINANT_FOCUS"


def test_ratio_threshold_is_strict(spark):
    rules = replace(NONE, combined_focus_threshold=0.4)
    # (7 + 1) / (1 + 1) is exactly four
    assert focus(spark, [("alpha", 5)] * 7 + [("beta", 5)] + plain(4), rules).focus_value == "NO_STRONG_DOMINANT_FOCUS"


def test_subwindow_stability(spark):
    specs = [("alpha", d) for d in (5, 35, 65) for _ in range(4)]
    r = focus(spark, specs)
    assert (r.subwindows_evaluated, r.subwindows_agreeing, r.focus_confidence) == (3, 3, "MEDIUM")
    r = focus(spark, [("alpha", 100 + i) for i in range(12)])
    assert (r.fallback_used, r.effective_window_days, r.focus_confidence) == (True, 180, "LOW")


def test_documented_confidence(spark):
    rules = NONE
    many = strata.classify_focus(stats(spark, [("alpha", d) for d in (5, 35, 65) for _ in range(11)]), rules)
    assert strata.documented_focus_confidence(many, rules, 1.5).first().focus_confidence == "HIGH"
    near = strata.classify_focus(stats(spark, [("alpha", d) for d in (5, 35, 65)] * 3 + [("alpha beta", 5)] + plain(2)), replace(rules, combined_focus_threshold=0.4))
    assert strata.documented_focus_confidence(near, rules, 1.5).first().focus_confidence in ("LOW", "MEDIUM")


def test_window_edges(spark):
    inside = [("alpha", 90)] + [("alpha", 10 + i) for i in range(9)]
    assert stats(spark, inside).first().videos_primary == 10
    micro = dt.timedelta(microseconds=1)
    older = [("alpha", 0, {"published_at": END - dt.timedelta(days=90) - micro})] + inside[1:]
    r = stats(spark, older).first()
    assert (r.videos_primary, r.videos_fallback, r.fallback_used) == (9, 10, True)
    leaked = [("alpha", 0)] + plain(3)
    assert stats(spark, leaked).first().videos_fallback == 3


def test_unresolved_shorts_are_kept_but_not_counted(spark):
    rows = evidence(spark, [("alpha", 5, {"is_short": None}), ("alpha", 6, {"is_short": True}), ("alpha", 7)])
    assert {r.video_key: r.included_in_prevalence for r in rows.collect()} == {0: False, 2: True}


def test_exact_duplicates(spark):
    rows = evidence(spark, [("alpha", 5 + i) for i in range(9)] + [("alpha", 4, {"source_id": "v0"})]).collect()
    flagged = [(r.video_key, r.duplicate_cluster_id) for r in rows if r.is_duplicate]
    assert flagged == [(9, "v0")]
    assert sum(r.included_in_prevalence for r in rows) == 9


def test_registered_rule(spark):
    rules = replace(NONE, deduplication_rule_version="same_title_v1", deduplication_rule_status="APPROVED")
    specs = [(f"alpha {i}", 20 - i) for i in range(11)] + [(" ALPHA 0", 3)]
    rows = evidence(spark, specs, rules).collect()
    assert sum(r.included_in_prevalence for r in rows) == 11
    assert [(r.video_key, r.duplicate_cluster_id) for r in rows if r.is_duplicate] == [(11, "v0")]


@pytest.mark.parametrize("version, status", [(None, None), ("draft", "DRAFT"), ("HUMAN_APPROVAL_REQUIRED", "APPROVED"), ("unknown_v9", "APPROVED")])
def test_missing_rule_fails_closed(version, status):
    rules = replace(NONE, deduplication_rule_version=version, deduplication_rule_status=status)
    with pytest.raises(DeduplicationRuleMissingError):
        strata.deduplication_rule(rules)


def kind(spark, specs, about="About us", rules=NONE):
    items = evidence(spark, specs, rules)
    channels = spark.createDataFrame([("c", "src", about)], "channel_key string, source_channel_id string, about_description string")
    r = strata.classify_type(strata.channel_statistics(items, rules), items, channels, rules).first()
    return r.channel_type_value, r.channel_type_confidence


def test_channel_types(spark):
    assert kind(spark, plain(12), about="") == ("UNCLASSIFIED", "LOW")
    assert kind(spark, plain(8)) == ("UNCLASSIFIED", "LOW")
    assert kind(spark, plain(12)) == ("INDEPENDENT_CREATOR", "LOW")
    registry = replace(NONE, broadcaster_registry_version="v1", broadcasters=("src",))
    assert kind(spark, plain(12), rules=registry) == ("BROAD_REACH_PUBLISHER", "HIGH")
    assert kind(spark, plain(12), rules=replace(registry, broadcaster_registry_version=None))[0] == "INDEPENDENT_CREATOR"
    third_party = replace(NONE, third_party_channels=("src",))
    assert kind(spark, plain(12), about="", rules=third_party)[0] == "INDEPENDENT_CREATOR"


def test_club_share_and_margin(spark):
    clubs = replace(NONE, clubs=(("North", ("north fc",)), ("South", ("south fc",))))
    specs = [("north fc wins", 5)] * 11 + [("south fc", 5)]
    with pytest.raises(Exception, match="club_winning_margin"):
        kind(spark, specs, rules=clubs)
    assert kind(spark, specs, rules=replace(clubs, club_winning_margin=0.1)) == ("CLUB_MEDIA", "HIGH")
    both = [("north fc v south fc", 5)] * 10 + plain(2)
    assert kind(spark, both, rules=replace(clubs, club_winning_margin=0.1))[0] == "INDEPENDENT_CREATOR"


def test_analysis_share(spark):
    rules = replace(NONE, analysis_keywords=("tactics",), analysis_share_threshold=0.5)
    assert kind(spark, [("tactics", 5)] * 6 + plain(6), rules=rules) == ("ANALYSIS_PUBLISHER", "MEDIUM")
    assert kind(spark, [("tactics", 5)] * 5 + plain(7), rules=rules)[0] == "INDEPENDENT_CREATOR"


def assessed(spark, specs):
    items = evidence(spark, specs)
    channels = spark.createDataFrame([("c", "src", "About")], "channel_key string, source_channel_id string, about_description string")
    return strata.assess_channels(items, channels, NONE, ntz("2022-12-17 16:00:00"))


def test_headline_eligibility_excludes_fallback(spark):
    assert assessed(spark, [("alpha", 5 + i) for i in range(12)]).first().headline_decomposition_eligible
    assert not assessed(spark, [("alpha", 100 + i) for i in range(12)]).first().headline_decomposition_eligible


def test_manifest_hash_ignores_scan_order_and_sees_changes(spark):
    specs = [("alpha", 5 + i) for i in range(12)]
    items = evidence(spark, specs)
    base = strata.manifest_hash(items).first()[2]
    assert strata.manifest_hash(items.orderBy(F.col("video_key").desc()).repartition(5)).first()[2] == base
    assert strata.manifest_hash(evidence(spark, specs[:-1] + [("beta", 16)])).first()[2] != base


def test_pinned_snapshot_is_immutable(spark):
    now = assessed(spark, [("alpha", 5 + i) for i in range(12)])
    empty = now.limit(0)
    assert strata.pin_snapshots(empty, now).count() == 1
    assert strata.pin_snapshots(now, now).count() == 0
    half = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(0.5).cast("decimal(18,6)"))
    for changed in (
        now.withColumn("eligible_video_count", F.col("eligible_video_count") + 1),
        now.withColumn("reference_period_end", F.col("reference_period_end") + half),
        now.withColumn("a_prevalence", F.col("a_prevalence") - 0.001),
    ):
        with pytest.raises(SnapshotMutationError):
            strata.pin_snapshots(now, changed)
    # below the fifth decimal nothing changed
    assert strata.pin_snapshots(now, now.withColumn("a_prevalence", F.col("a_prevalence") + 1e-7)).count() == 0


def test_overrides_chain(spark):
    seed = strata.strata_seed(spark.range(1))
    key = {(r.channel_type_value, r.focus_value): r.stratum_key for r in seed.collect()}
    assert len(key) == 30 and seed.filter("analytical_eligibility").count() == 20
    t = [dt.datetime(2022, 1, d) for d in (1, 2, 3)]
    start = key[("CLUB_MEDIA", "A_FOCUSED")]
    versions = spark.createDataFrame([("c", start, t[0], None, True)], "channel_key string, stratum_key string, valid_from timestamp_ntz, valid_to timestamp_ntz, is_current boolean")
    schema = "channel_key string, axis string, proposed_axis_value string, approved_by string, approved_at timestamp_ntz"
    overrides = spark.createDataFrame(
        [("c", "FOCUS", "B_FOCUSED", "r", t[1]), ("c", "CHANNEL_TYPE", "OTHER", "r", t[2]), ("c", "FOCUS", "MIXED_FOCUS", None, None)], schema
    )
    got = [tuple(r) for r in strata.apply_overrides(versions, seed, overrides).orderBy("valid_from").collect()]
    assert got == [
        ("c", start, t[0], t[1], False),
        ("c", key[("CLUB_MEDIA", "B_FOCUSED")], t[1], t[2], False),
        ("c", key[("OTHER", "B_FOCUSED")], t[2], None, True),
    ]
    bad = spark.createDataFrame([("c", "FOCUS", "NOWHERE", "r", t[1])], schema)
    with pytest.raises(Exception, match="stratum combination"):
        strata.apply_overrides(versions, seed, bad).collect()
    orphan = spark.createDataFrame([("zz", "FOCUS", "B_FOCUSED", "r", t[1])], schema)
    with pytest.raises(GateError):
        strata.apply_overrides(versions, seed, orphan)


def test_selection_gates(spark):
    with pytest.raises(UnapprovedParameterError):
        SamplingPolicy("p", 3, "UNAPPROVED_PENDING_STRATA_INSPECTION", "stratum").approved_k()
    with pytest.raises(UnapprovedParameterError):
        SamplingPolicy("p", None, "APPROVED", "stratum").approved_k()
    with pytest.raises(UnapprovedParameterError):
        SamplingPolicy("p", 3, "APPROVED").bucket_columns()
    with pytest.raises(UnapprovedParameterError):
        cohort.cohort_gate(spark.range(1), MinimumCohort())
    with pytest.raises(GateError):
        cohort.check_run("RESEARCH", "PIPELINE_PILOT", False)
    with pytest.raises(GateError):
        cohort.check_run("INTEGRATION_TEST", "PIPELINE_PILOT", False)
    with pytest.raises(GateError):
        cohort.check_run("OTHER", "RESEARCH_PANEL", True)
    cohort.check_run("RESEARCH", "RESEARCH_PANEL", False)
    have = spark.createDataFrame([(1,)], "channel_key int")
    need = spark.createDataFrame([(1,), (2,)], "channel_key int")
    with pytest.raises(GateError, match="2"):
        require_all(need, have, ["channel_key"], "snapshot")


def test_ranking_criteria(spark):
    def row(sid, event, player, proximity):
        return ("s", "EVENT", event, player, proximity, dt.datetime(2022, 1, 1), sid)

    data = [row("d", True, True, 0.0), row("c", True, True, 5.0), row("a", True, False, 1.0), row("b", False, True, 0.5), row("e", True, True, 5.0)]
    df = spark.createDataFrame(data, "stratum_name string, cohort_type string, event_matched boolean, player_matched boolean, proximity_seconds double, published_at timestamp_ntz, source_id string")
    policy = SamplingPolicy("p", 2, "APPROVED", "stratum")
    for hot in (None, 1):
        got = {r.source_id: (r.selection_rank, r.inclusion_status) for r in cohort.rank_cohorts(df, policy, hot).collect()}
        assert got == {
            "d": (1, "SELECTED"),
            "c": (2, "SELECTED"),
            "e": (3, "ELIGIBLE_UNSELECTED"),
            "a": (4, "ELIGIBLE_UNSELECTED"),
            "b": (5, "ELIGIBLE_UNSELECTED"),
        }


def test_distribution_percentiles(spark):
    data = [(i, "x" if i < 10 else "y") for i in range(30)]
    df = spark.createDataFrame(data, "video_key int, channel_key string").withColumns({"stratum_name": F.lit("s"), "cohort_type": F.lit("EVENT")})
    r = strata.stratum_distribution(df).first()
    assert (r.participating_channel_count, r.aggregate_candidate_count, r.min, r.p25, r.median, r.p75, r.max) == (2, 30, 10, 12.5, 15.0, 17.5, 20)


def test_fallback_progression(spark):
    rows = [("a", "COMPLETED", 15), ("b", "COMPLETED", 6), ("c", "PARTIAL", 3)]
    scans = spark.createDataFrame(rows, "channel_key string, status string, eligible_videos_observed int").withColumns(
        {"scan_scope": F.lit("90D_PRIMARY"), "window_start_at": ntz("2022-09-18 15:00:00"), "window_end_at": ntz("2022-12-17 15:00:00")}
    )
    got = strata.fallback_scans(scans, NONE).collect()
    assert [(r.channel_key, r.status, r.window_start_at) for r in got] == [("b", "PENDING", END - dt.timedelta(days=180))]
    again = scans.unionByName(strata.fallback_scans(scans, NONE).withColumn("eligible_videos_observed", F.lit(0)))
    assert strata.fallback_scans(again, NONE).count() == 0


def test_lineage_tells_runs_apart(spark):
    columns = "stratum_name string, cohort_type string, selection_rank bigint, source_id string, published_at timestamp_ntz, proximity_seconds double, stratum_snapshot_key string"
    rows = [("s", "c", i + 1, f"v{i}", END, float(i), "k") for i in range(4)]

    def print_of(rows=rows, event="E1", frame="f0", policy=None):
        policy = policy or SamplingPolicy("sp1", 3, "APPROVED", "stratum")
        return cohort.candidate_lineage(spark.createDataFrame(rows, columns), policy, event, frame).first().candidate_list_lineage

    one = print_of()
    assert print_of(rows[::-1]) == one
    others = [
        print_of(event="E2"),
        print_of(frame="f1"),
        print_of(policy=SamplingPolicy("sp1", 4, "APPROVED", "stratum")),
        print_of(policy=SamplingPolicy("sp2", 3, "APPROVED", "stratum")),
        print_of([(*r[:5], r[5] + 0.000001, r[6]) for r in rows]),
        print_of([(*r[:6], "other") for r in rows]),
        print_of([(r[0], "d", *r[2:]) for r in rows]),
        print_of([(*r[:3], f"w{i}", *r[4:]) for i, r in enumerate(rows)]),
    ]
    assert len({one, *others}) == len(others) + 1
