"""Versions, snapshots, watermarks, landing: idempotency and boundary cases."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from eventlens.config import Event, approved
from eventlens.errors import GateError, UnapprovedParameterError
from eventlens.functions.times import ntz
from eventlens.operators import cohort, completeness, history, joins, quality
from eventlens.plans import authors, bootstrap, decomposition, narrative, reaction
from eventlens.sources import landing, reference_data
from eventlens.streaming import incremental

DAY = dt.timedelta(days=1)
T0 = dt.datetime(2024, 1, 1)


def merge(spark, current, event, at):
    incoming = reference_data.event_rows(spark, [event])
    tracked = ["event_name", "occurred_at", "inclusion_rationale", "event_terms", "baseline_terms"]
    if current is None:
        current = reference_data.first_versions(incoming, ["event_key"], T0).limit(0)
    out = history.scd2_merge(current, incoming, ["event_key"], tracked, ntz(str(at)), ["event_terms", "baseline_terms"])
    return spark.createDataFrame(out.collect(), out.schema)


def test_event_versions(spark):
    first = Event("E", "Final", T0, ("world cup", "final"), ("fifa",))
    v1 = merge(spark, None, first, T0)
    same = merge(spark, v1, Event("E", "Final", T0, (" FINAL", "World Cup"), ("fifa",)), T0 + DAY)
    assert same.collect() == v1.collect()
    v2 = merge(spark, same, Event("E", "Final", T0, ("world cup", "final"), ("fifa", "qatar")), T0 + 2 * DAY)
    v3 = merge(spark, v2, Event("E", "Renamed", T0, ("world cup", "final"), ("fifa", "qatar")), T0 + 3 * DAY)
    got = [(r.event_name, r.valid_from, r.valid_to, r.is_current) for r in v3.orderBy("valid_from").collect()]
    assert got == [
        ("Final", T0, T0 + 2 * DAY, False),
        ("Final", T0 + 2 * DAY, T0 + 3 * DAY, False),
        ("Renamed", T0 + 3 * DAY, None, True),
    ]
    assert quality.not_exactly_one(v3, ["event_key"], F.col("is_current")).count() == 0


def test_history_of_classifications(spark):
    rows = [("c", "A", T0, 1), ("c", "A", T0 + DAY, 2), ("c", "B", T0 + 2 * DAY, 3), ("d", None, T0, 4), ("d", None, T0 + DAY, 5)]
    df = spark.createDataFrame(rows, "channel_key string, stratum string, at timestamp_ntz, id int")
    got = sorted(map(tuple, history.scd2_from_history(df, "channel_key", "stratum", "at", "id").collect()), key=repr)
    assert got == [
        ("c", "A", T0, T0 + 2 * DAY, False),
        ("c", "B", T0 + 2 * DAY, None, True),
        ("d", None, T0, None, True),
    ]


def test_text_reverting_to_an_earlier_state(spark):
    rows = [("c", "one", T0), ("c", "two", T0 + DAY), ("c", "one", T0 + 2 * DAY)]
    df = spark.createDataFrame(rows, "source_comment_id string, text_content string, observed_at timestamp_ntz")
    got = {r.observed_at: r.is_latest_version for r in history.text_versions(df).collect()}
    assert got == {T0: True, T0 + DAY: False}


def test_change_only_with_nulls(spark):
    rows = [("c", T0 + i * DAY, v) for i, v in enumerate([None, None, 1, 1, None, 2])]
    df = spark.createDataFrame(rows, "k string, at timestamp_ntz, likes int")
    got = [r.likes for r in history.change_only(df, "k", ["at"], ["likes"]).orderBy("at").collect()]
    assert got == [None, 1, None, 2]


def test_freeze_once(spark):
    schema = "source_id string, published_at timestamp_ntz, duration_seconds int, is_short boolean, short_classification_rule_version string, primary_language_code string"
    stored = spark.createDataFrame([("v", T0, 300, False, "v1.0", "en")], schema)
    refresh = spark.createDataFrame([("v", T0 + DAY, 0, None, "v1.2", "UNKNOWN"), ("w", T0, 5, None, "v1.2", "UNKNOWN")], schema)
    got = {r.source_id: tuple(r)[1:] for r in history.freeze_once(stored, refresh, ["source_id"]).collect()}
    assert got["v"] == (T0, 300, False, "v1.0", "en")
    assert got["w"] == (T0, 5, None, None, "UNKNOWN")


def scan(spark, ids, more=False, mark=True):
    items = spark.createDataFrame(
        [("s", 0, i, c, t) for i, (c, t) in enumerate(ids)],
        "scope string, page_number int, item_position int, source_comment_id string, published_at timestamp_ntz",
    )
    scans = spark.createDataFrame([("s", more)], "scope string, more_pages boolean")
    rows = [("s", T0)] if mark else []
    checkpoints = spark.createDataFrame(rows, "scope string, committed_watermark_at timestamp_ntz")
    boundary = spark.createDataFrame([("s", c) for c in "ABC"] if mark else [], "scope string, source_comment_id string")
    return completeness.advance_watermark(completeness.continuity(items, scans, checkpoints, boundary)).first()


def test_composite_watermark(spark):
    older = T0 - dt.timedelta(seconds=1)
    r = scan(spark, [("A", T0), ("B", T0), ("D", older)])
    assert (r.continuity_status, r.watermark_reached, r.remaining_boundary_ids, r.watermark_advanced) == ("POTENTIAL_GAP", False, 1, False)
    assert r.next_watermark_at == T0
    r = scan(spark, [("N", T0 + DAY), ("A", T0), ("B", T0), ("C", T0), ("D", older)])
    assert (r.continuity_status, r.records_observed, r.next_watermark_at) == ("COMPLETE_TO_WATERMARK", 4, T0 + DAY)
    # a boundary id behind the crossing does not count
    r = scan(spark, [("A", T0), ("B", T0), ("D", older), ("C", T0)])
    assert r.continuity_status == "POTENTIAL_GAP"
    assert scan(spark, [("N", T0 + DAY)], more=True).continuity_status == "CAPPED_BEFORE_WATERMARK"
    assert scan(spark, [("N", T0 + DAY)], more=True, mark=False).continuity_status == "INITIAL_LOAD_CAPPED"
    r = scan(spark, [("N", T0 + DAY)], mark=False)
    assert (r.continuity_status, r.watermark_reached, r.next_watermark_at) == ("COMPLETE_TO_WATERMARK", None, T0 + DAY)
    r = scan(spark, [])
    assert (r.watermark_advanced, r.next_watermark_at) == (False, T0)


def video_page(spark, run="run1"):
    items = [{"id": "A", "snippet": {"title": "a", "channelId": "c"}}, {"id": "B", "snippet": {"title": "b"}, "statistics": {"viewCount": "x"}}]
    payload = json.dumps({"items": items})
    request = json.dumps({"part": "snippet", "requested_video_ids": ["A", "B", "C"], "id_count": 3})
    rows = [("batch", None, None, request, 200, T0, payload)]
    return landing.land_raw(spark.createDataFrame(rows, incremental.PAGE_FILE), "VIDEO", "VIDEO_BATCH", "videos.list", run)


def test_replay_and_missing_ids(spark):
    raw = video_page(spark)
    assert raw.columns[0] == "raw_response_id" and len(raw.columns) == 16
    items = landing.video_items(landing.replay(raw, run_id="run1"))
    assert {(r.source_id, r.views) for r in items.collect()} == {("A", None), ("B", None)}
    assert [r.source_id for r in landing.unavailable_ids(raw).collect()] == ["C"]
    assert landing.new_snapshots(items, items).count() == 0
    assert landing.video_items(landing.replay(raw, run_id="other")).count() == 0
    assert video_page(spark).first() == raw.first()


def test_malformed_page_is_quarantined_with_its_reference(spark):
    good = {"id": "c1", "snippet": {"topLevelComment": {"snippet": {"publishedAt": "2024-01-01T00:00:00Z"}}}}
    bad = {"id": None, "snippet": {"topLevelComment": {"snippet": {"publishedAt": "2024-01-01T00:00:00Z"}}}}
    rows = [("v", None, None, None, 200, T0, json.dumps({"items": [good, bad]})), ("w", None, None, None, 200, T0, "{broken")]
    raw = landing.land_raw(spark.createDataFrame(rows, incremental.PAGE_FILE), "VIDEO", "VIDEO", "commentThreads.list", "r")
    valid, dead = landing.split_dead_letters(landing.comment_items(raw), {"MISSING_ID": F.col("source_comment_id").isNotNull()})
    r = valid.first()
    assert (r.source_comment_id, r.text_content, r.likes, r.reply_count, r.author_channel_id) == ("c1", "", 0, 0, None)
    assert dead.first().error_code == "MISSING_ID" and dead.first().raw_response_id is not None


def test_streaming_landing_is_incremental_and_idempotent(spark, tmp_path):
    pages, table, state = (str(tmp_path / n) for n in ("pages", "table", "state"))
    (tmp_path / "pages").mkdir()

    def arrive(name, scopes):
        lines = [json.dumps({"resource_scope_id": s, "http_status": 200, "retrieved_at": "2024-01-01T00:00:00", "raw_json_payload": "{}"}) for s in scopes]
        (tmp_path / "pages" / name).write_text("\n".join(lines))

    def land():
        incremental.land_pages(spark, pages, table, state, "VIDEO", "VIDEO", "commentThreads.list", "run1")
        return sorted(r.resource_scope_id for r in spark.read.parquet(table).collect())

    arrive("a.json", "ab")
    assert land() == ["a", "b"]
    assert land() == ["a", "b"]
    arrive("b.json", "c")
    assert land() == ["a", "b", "c"]


def test_upsert_and_insert_if_absent_are_idempotent(spark):
    now = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    new = spark.createDataFrame([(2, "b"), (3, None)], "k int, v string")
    once = joins.upsert(now, new, ["k"], ["v"])
    twice = joins.upsert(once, new, ["k"], ["v"])
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect())) == [(1, "a"), (2, "b"), (3, None)]
    added = joins.insert_if_absent(now, new, ["k"])
    assert joins.insert_if_absent(added, new, ["k"]).count() == added.count() == 3
    several = spark.createDataFrame([(3, "y"), (3, "x"), (4, "z"), (None, "n")], "k int, v string")
    for rows in (several, several.orderBy("v")):
        got = joins.insert_if_absent(now.select("v", "k"), rows, ["k"]).collect()
        assert {(r.k, r.v) for r in got} == {(1, "a"), (2, None), (3, "x"), (4, "z"), (None, "n")}


def test_provenance_is_recorded_once(spark):
    columns = ["video_event_key", *cohort.PROVENANCE_KEYS, "unit_status"]
    old = spark.createDataFrame([("ve", "f", "c", "w", "1", "q", "PARTIAL")], columns)
    new = spark.createDataFrame([("ve", "f", "c", "w", "1", "q", "COMPLETED"), ("ve", "f", "c", "w", "1", "q2", "COMPLETED")], columns)
    got = {r.query_hash: r.unit_status for r in cohort.append_provenance(old, new).collect()}
    assert got == {"q": "PARTIAL", "q2": "COMPLETED"}


def test_units_of_other_policies_do_not_count(spark):
    channels = spark.createDataFrame([("c1",), ("c2",)], "channel_key string")
    expected = completeness.expected_units(channels, [("w", "query")], "f", "1.0")
    done = expected.filter("channel_key = 'c1'").withColumn("status", F.lit("COMPLETED"))
    r = completeness.unit_counts(expected, done).first()
    assert (r.total_expected_units, r.completed_units_count, r.remaining_units_count, r.run_outcome) == (2, 1, 1, "PARTIAL")
    other = done.withColumn("discovery_policy_version", F.lit("2.0"))
    assert completeness.unit_counts(expected, other).first().completed_units_count == 0
    assert completeness.remaining_units(expected, expected.withColumn("status", F.lit("COMPLETED"))).count() == 0


def test_publication_order(spark):
    times = [dt.datetime(2022, 6, 1), dt.datetime(2022, 7, 1), dt.datetime(2021, 1, 1)]
    df = spark.createDataFrame([("s", 0, i, t) for i, t in enumerate(times)], "scope string, page_number int, item_position int, published_at timestamp_ntz")
    assert completeness.publication_order(df).first().is_monotonic is False


def test_frame_uniqueness_and_isolation(spark):
    frame = spark.createDataFrame([("f", "c"), ("f", "c"), ("f", "d")], "frame string, channel string")
    with pytest.raises(GateError):
        quality.assert_empty(quality.duplicate_keys(frame, ["frame", "channel"]), "frame channels")
    with pytest.raises(UnapprovedParameterError):
        approved("n_min", None)


def random_opinions(spark, seed, n=600):
    rng = random.Random(seed)
    rows = [
        ("E", rng.choice("AB"), rng.choice("pqrst"), rng.choice(["PRE", "POST"]), rng.uniform(-1, 1), rng.randrange(40), "s1", i, rng.randrange(9))
        for i in range(n)
    ]
    return spark.createDataFrame(
        rows,
        "event_version_key string, target string, stratum_name string, window_type string, valence double, author_key int, salt_version_id string, comment_key int, video_key int",
    )


@pytest.mark.parametrize("seed", range(3))
def test_decomposition_adds_up(spark, seed):
    """Composition and tone add up to the shared shift, computed apart from them."""
    df = random_opinions(spark, seed)
    terms = decomposition.shift_contributions(df, "PRE", ["POST"], 2, excluded=("t",))
    rows = decomposition.decompose_shift(terms, 2).collect()
    pdf = df.toPandas().query("stratum_name != 't'")
    for r in rows:
        means = pdf[pdf.target == r.target].groupby("window_type").valence.mean()
        assert r.m019_composition_effect + r.m020_tone_effect == pytest.approx(means["POST"] - means["PRE"], abs=1e-12)
    assert quality.additivity_residuals(decomposition.decompose_shift(terms, 2)).count() == 0
    assert decomposition.decompose_shift(terms, 9).filter("m019_composition_effect IS NULL").count() == len(rows)
    with pytest.raises(UnapprovedParameterError):
        decomposition.shift_contributions(df, "PRE", ["POST"], None)


def test_metrics_do_not_depend_on_row_order(spark):
    df = random_opinions(spark, 7)
    shuffled = df.orderBy(F.md5(F.col("comment_key").cast("string"))).repartition(7)
    for metric in (
        lambda x: authors.author_overlap(x, "PRE", ["POST"]),
        lambda x: authors.new_author_contribution(x, "PRE", ["POST"]),
        lambda x: reaction.valence_shares(x, -0.1, 0.1),
    ):
        assert sorted(metric(df).collect()) == sorted(metric(shuffled).collect())


def test_empty_denominators_are_null(spark):
    only_pre = random_opinions(spark, 1).filter("window_type = 'PRE'")
    r = authors.new_author_contribution(only_pre, "PRE", ["POST"]).first()
    assert r.identifiable_comment_count == 0 and r.m017_new_author_contribution is None
    assert authors.returning_author_shift(only_pre, "PRE", ["POST"]).count() == 0


def test_bootstrap_is_reproducible_and_covers_the_estimate(spark):
    df = random_opinions(spark, 3)
    sums = bootstrap.clusters(df, ["target"], "video_key", "valence")
    runs = [bootstrap.bootstrap_ratio(sums.repartition(n), ["target"], "video_key", 100, 11, 0.95).orderBy("target").collect() for n in (1, 5)]
    for a, b in zip(*runs):
        assert a.estimate == pytest.approx(b.estimate) and a.ci_low == pytest.approx(b.ci_low) and a.ci_high == pytest.approx(b.ci_high)
        assert a.ci_low <= a.estimate <= a.ci_high


def test_alias_join_matches_literal_matching(spark):
    """Equi-join on the first word against the literal matcher, on awkward texts."""
    from eventlens.functions import text

    aliases = ["ballon d'or", "CR7", "la pulga", "étoile", "a.b", "#goat"]
    bodies = ["Ballon d'Or night", "ballon  d'or", "xcr7 cr7", "LA PULGA!", "la-pulga", "l'étoile", "a.b a+b", "axb", "the#goat is", "#goat", "", None]
    df = spark.createDataFrame(list(enumerate(bodies)), "i int, text string")
    table = spark.createDataFrame([("E", a) for a in aliases], "target_entity_key string, alias_text string")
    got = {(r.i, r.alias_text) for r in joins.alias_matches(df, table, "i").collect()}
    want = {(r.i, a) for r in df.select("i", text.matched_terms(F.col("text"), aliases).alias("m")).collect() for a in r.m}
    assert got == want and len(want) >= 6
    with pytest.raises(GateError):
        joins.alias_matches(df, spark.createDataFrame([("E", "!!")], table.schema), "i")


def test_cross_stratum_lookback_against_brute_force(spark):
    rng = random.Random(5)
    # the same three pseudonyms under two salts are six authors
    rows = [(rng.randrange(6), rng.choice(["O1", "O2", "X", "Y"]), T0 + dt.timedelta(minutes=rng.randrange(6000))) for _ in range(150)]
    salted = [(f"salt{a % 2}", a // 2, s, t) for a, s, t in rows]
    df = spark.createDataFrame(salted, "salt_version_id string, author_key int, stratum_name string, published_at timestamp_ntz")
    since = T0 + DAY
    got = {r.stratum_name: (r.newly_observed_author_count, r.cross_participating_author_count) for r in authors.cross_stratum_participation(df, ["O1", "O2"], 5, str(since)).collect()}
    want = {}
    for s in {r[1] for r in rows}:
        firsts = {a: min(t for x, y, t in rows if x == a and y == s) for a in {r[0] for r in rows if r[1] == s}}
        new = {a: t for a, t in firsts.items() if t >= since}
        crossed = [a for a, t0 in new.items() if any(x == a and y in ("O1", "O2") and y != s and t0 - dt.timedelta(hours=5) <= t < t0 for x, y, t in rows)]
        if new:
            want[s] = (len(new), len(crossed))
    assert got == want


def test_authors_of_two_salts_stay_apart(spark):
    rows = [(s, 1, w, v, c) for s, w, v, c in [("a", "PRE", 0.0, 1), ("a", "POST", 1.0, 2), ("b", "PRE", 1.0, 3), ("b", "POST", 0.0, 4), ("c", "PRE", 0.5, 5)]]
    df = spark.createDataFrame(rows, "salt_version_id string, author_key int, window_type string, valence double, comment_key int").selectExpr(
        "*", "'e' AS event_version_key", "'t' AS target", "'ch' AS channel_key", "timestamp_ntz '2024-01-01 00:00:00' AS published_at"
    )
    deltas = authors.returning_author_deltas(df, "PRE", ["POST"])
    assert {(r.salt_version_id, r.delta) for r in deltas.collect()} == {("a", 1.0), ("b", -1.0)}
    assert authors.returning_author_shift(df, "PRE", ["POST"]).first().shared_author_count == 2
    assert authors.author_window_activity(df).count() == 5
    interval = bootstrap.paired_bootstrap(deltas, ["target"], "author_key", 50, 1, 0.9).first()
    assert interval.cluster_count == 2 and interval.ci_low < interval.ci_high


def test_window_pairs_are_the_windows_taken_one_by_one(spark):
    df = random_opinions(spark, 4).withColumn("window_type", F.when(F.col("comment_key") % 3 == 0, "PRE").when(F.col("comment_key") % 3 == 1, "POST").otherwise("LATER"))
    pairs = decomposition.pair_contributions(df, "PRE", ["POST", "LATER"], 2, excluded=())
    effects = decomposition.decompose_shift(pairs, 2, (*decomposition.TARGET, *decomposition.PAIR))
    shifts = authors.returning_author_pairs(df, "PRE", ["POST", "LATER"])
    for window in ("POST", "LATER"):
        only = df.filter(F.col("window_type").isin("PRE", window))
        terms = decomposition.shift_contributions(only, "PRE", [window], 2, excluded=())
        plain = lambda x: sorted(repr([round(v, 12) if isinstance(v, float) else v for v in r]) for r in x.collect())
        one = lambda x: plain(x.filter(F.col("post_window") == window).drop("pre_window", "post_window"))  # noqa: E731, B023
        assert one(pairs) == plain(terms)
        assert one(effects) == plain(decomposition.decompose_shift(terms, 2))
        assert one(shifts) == plain(authors.returning_author_shift(only, "PRE", [window]))


def test_a_stance_counts_for_eligible_assignments_only(spark):
    rows = [(1, "SUPPORTS", True), (2, "OPPOSES", False), (3, None, True), (4, None, None)]
    df = spark.createDataFrame(rows, "comment_key int, stance string, stance_eligible boolean").selectExpr(
        "*", "'e' AS event_version_key", "'t' AS target", "'w' AS window_type", "'n' AS narrative", "true AS is_primary", "'X' AS channel_type_value"
    )
    r = narrative.narrative_window(df, df).first()
    assert (r.narrative_assignment_count, r.eligible_stance_assignment_count, r.accepted_stance_assignment_count) == (4, 2, 1)
    assert (r.m025_support_rate, r.m026_opposition_rate, r.m027_stance_coverage) == (1.0, 0.0, 0.5)


def test_a_second_replay_changes_nothing(spark, tmp_path):
    import json
    import uuid

    from eventlens.sources import landing, replay

    def page(number, ids, asked, views):
        items = [{"id": i, "snippet": {"title": i, "publishedAt": "2024-01-01T00:00:00Z"}, "contentDetails": {"duration": "PT1M"}, "statistics": {"viewCount": views}} for i in ids]
        request = json.dumps({"part": "snippet", "requested_video_ids": asked})
        return ("batch", None, None, request, 200, T0 + dt.timedelta(hours=number), json.dumps({"items": items}))

    columns = "resource_scope_id string, page_token_used string, next_page_token_returned string, request_parameters string, http_status int, retrieved_at timestamp_ntz, raw_json_payload string"
    pages = spark.createDataFrame([page(1, ["a", "b"], ["a", "b", "x"], "1"), page(2, ["a"], ["a", "b"], "2")], columns)
    raw = landing.land_raw(pages, "VIDEO", "VIDEO_BATCH", "videos.list", "run1")
    tables = replay.video_tables(spark, str(tmp_path / "t"), f"t{uuid.uuid4().hex}", buckets=4)
    links = spark.createDataFrame([("x", "E", "ELIGIBLE", None), ("a", "E", "ELIGIBLE", None)], tables.layouts["link"].columns)
    with tables.batch(0) as batch:
        batch.load("link", links)

    def content():
        return {name: sorted(map(str, tables.live(name).collect())) for name in tables.layouts}

    replay.replay_videos(tables, raw, 1)
    first = content()
    assert len(first["snapshot"]) == 3
    state = {r.source_id: (r.resolution_status, r.updated_at, r.first_discovered_at) for r in tables.live("resolution").collect()}
    hour = dt.timedelta(hours=1)
    assert state == {"a": ("RESOLVED", T0 + 2 * hour, T0 + hour), "b": ("UNAVAILABLE", T0 + 2 * hour, T0 + hour), "x": ("UNAVAILABLE", T0 + hour, T0 + hour)}
    assert {r.source_id: r.inclusion_status for r in tables.live("link").collect()} == {"a": "ELIGIBLE", "x": "INELIGIBLE"}
    replay.replay_videos(tables, raw, 2)
    assert content() == first


def test_runs_reconcile_with_empty_and_repeated_inputs(spark):
    from eventlens.operators import completeness

    make = spark.createDataFrame
    runs = make([("a", 1, 2), ("b", 1, 1), ("c", 0, 0)], "ingestion_run_id string, pages_requested int, records_observed int")
    requests = make([("a", 1, 500), ("a", 1, 200), ("b", 1, 500)], "ingestion_run_id string, page_number int, http_status int")
    pages = make([("a", 2), ("b", 1), ("z", 5)], "ingestion_run_id string, item_count int")
    observed = make([("a", "x"), ("a", "y"), ("b", "x")], "ingestion_run_id string, source_comment_id string")
    dead = make([], "ingestion_run_id string")
    out = {r.ingestion_run_id: r for r in completeness.reconcile_runs(runs, requests, pages, observed, dead, observed.filter("source_comment_id = 'x'")).collect()}
    assert set(out) == {"a", "b", "c"}
    assert (out["a"].pages_persisted, out["a"].counts_reconcile, out["a"].writes_complete, out["a"].no_failed_required_page) == (True, True, False, True)
    assert (out["b"].pages_persisted, out["b"].writes_complete, out["b"].no_failed_required_page) == (False, True, False)
    assert out["c"].reconciled


def test_items_of_any_form_stand_beside_their_siblings(spark):
    good = {"id": "a", "snippet": {"totalReplyCount": 2, "topLevelComment": {"snippet": {"publishedAt": "2024-01-01T00:00:00Z", "likeCount": "7"}}}}
    payloads = [json.dumps({"items": [good, 5, "x", None, {"id": 7}, ["a"], good]}), json.dumps({"items": "none"}), "no json", json.dumps([1]), None]
    columns = "resource_scope_id string, page_token_used string, next_page_token_returned string, request_parameters string, http_status int, retrieved_at timestamp_ntz, raw_json_payload string"
    pages = spark.createDataFrame([(str(i), None, None, None, 200, T0, p) for i, p in enumerate(payloads)], columns)
    items = landing.comment_items(landing.land_raw(pages, "VIDEO", "VIDEO", "commentThreads.list", "run1"))
    got = [(r.item_position, r.source_comment_id, r.likes, r.reply_count) for r in sorted(items.collect(), key=lambda r: r.item_position)]
    assert got == [(0, "a", 7, 2), (1, None, 0, 0), (2, None, 0, 0), (3, None, 0, 0), (4, "7", 0, 0), (5, None, 0, 0), (6, "a", 7, 2)]
    plan = items._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parse_json") <= 1 and "from_json" not in plan


def test_a_mart_against_its_rules_is_not_published(spark, tmp_path):
    import os

    from pyspark.sql import Window

    from eventlens.config import Lineage
    from eventlens.sources.mart_sink import publish_mart

    lineage = Lineage("a", "b", "c", "d", T0)
    mart = spark.createDataFrame([("E1", 0.25), ("E1", 0.75), ("E2", 1.0)], "event_version_key string, share double")
    rules = {
        "bounds": F.col("share").between(0, 1),
        "sums to one": F.abs(F.sum("share").over(Window.partitionBy("event_version_key")) - 1) < 1e-6,
    }
    path = str(tmp_path / "mart")
    wrong = mart.filter("share <> 0.25")
    with pytest.raises(GateError, match="sums to one 1$"):
        publish_mart(wrong, path, lineage, rules)
    assert not os.path.exists(path)
    with pytest.raises(GateError, match="bounds 1, sums to one 1"):
        publish_mart(mart.filter("event_version_key = 'E2'").withColumn("share", F.lit(None).cast("double")), path, lineage, rules)
    assert publish_mart(mart, path, lineage, rules) == 3
    assert spark.read.parquet(path).filter("sampling_policy_version = 'a'").count() == 3
    with pytest.raises(GateError):
        publish_mart(wrong, path, lineage, rules)
    assert spark.read.parquet(path).count() == 3
