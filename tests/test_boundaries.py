"""Boundary instants, statuses and texts of the scalar and decision operators."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from eventlens.config import Event, Window
from eventlens.functions import keys, text, times
from eventlens.operators import cohort
from eventlens.operators.windows import assign_windows, window_table

T = dt.datetime(2022, 12, 18, 15)
FINAL = Event("FINAL", "Final", T, ("final",), ("world cup",))
ALIASES = ("Alpha", "CR7")


def one(spark, value, schema, column):
    return spark.createDataFrame([(value,)], f"x {schema}").select(column(F.col("x")).alias("y")).first()[0]


@pytest.mark.parametrize(
    "written, seconds",
    [("PT58S", 58), ("PT1M15S", 75), ("PT1H2M10S", 3730), ("P1D", 86400), ("P1DT1S", 86401), ("", 0), (None, 0), ("INVALID", 0), ("P1W", 0), ("PT1.5S", 0)],
)
def test_duration(spark, written, seconds):
    assert one(spark, written, "string", times.duration_seconds) == seconds


@pytest.mark.parametrize(
    "written", ["2022-12-18T15:00:00Z", "2022-12-18T15:00:00+00:00", "2022-12-18T18:00:00+03:00", "2022-12-18T10:00:00-05:00", "2022-12-18T15:00:00", "2022-12-18 15:00:00"]
)
@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_same_instant(spark, written, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        assert one(spark, written, "string", times.utc_ntz) == T
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_fraction_is_kept(spark):
    assert one(spark, "2022-12-18T15:00:00.500Z", "string", times.utc_ntz) == T + dt.timedelta(milliseconds=500)


@pytest.mark.parametrize(
    "body, term, hit",
    [
        ("a shirt with xk9, signed", "xk9", True),
        ("order xk9000 today", "xk9", False),
        ("zorbaé wins", "zorba", False),
        ("l'étion reste", "étion", True),
        ("a.b matters", "a.b", True),
        ("axb matters", "a.b", False),
        (r"weird \E quote", r"\e quote", False),
        ("", "xk9", False),
        (None, "xk9", False),
    ],
)
def test_phrase(spark, body, term, hit):
    assert one(spark, body, "string", lambda c: text.mentions(c, term)) is hit
    assert one(spark, body, "string", lambda c: text.mentions_any(c, [term, "zzz"])) is hit


def test_canonical_terms_keep_duplicates(spark):
    got = one(spark, [" World Cup", None, "final", "FINAL"], "array<string>", text.canonical_terms)
    assert got == ["final", "final", "world cup"]


def test_all_white_space_is_stripped_and_empty_terms_stay(spark):
    assert one(spark, ["b\t", "\n", "\u00a0A "], "array<string>", text.canonical_terms) == ["", "a", "b"]
    assert one(spark, " \n\t", "string", lambda c: text.exclusion_reason(c, 2)) == "EMPTY_TEXT"


def test_hmac_matches_standard_library(spark):
    import hashlib
    import hmac

    secrets = {"short": b"k", "long": b"x" * 100}
    df = spark.createDataFrame([("a1", "short"), ("ü2", "long"), (None, "short"), ("a1", "long")], "author string, salt_version_id string")
    out = keys.pseudonymise(df, "author", secrets)
    assert "x" * 10 not in out._jdf.queryExecution().toString()
    for r in out.collect():
        want = r.author and hmac.new(secrets[r.salt_version_id], r.author.encode(), hashlib.sha256).hexdigest()
        assert r.author_hash == want


def judge(spark, **overrides):
    video = dict(
        resolution_status="RESOLVED",
        is_short=False,
        primary_language_code="en",
        published_at=T,
        title="Alpha in the final",
        description="",
    )
    video.update(overrides)
    schema = "resolution_status string, is_short boolean, primary_language_code string, published_at timestamp_ntz, title string, description string"
    df = spark.createDataFrame([tuple(video.values())], schema)
    r = cohort.video_eligibility(df, FINAL, ALIASES).first()
    return r.is_eligible, r.cohort_type, r.reason


OUT = (False, None, "OUT_OF_WINDOW")
D, H, S, US = dt.timedelta(days=1), dt.timedelta(hours=1), dt.timedelta(seconds=1), dt.timedelta(microseconds=1)


@pytest.mark.parametrize(
    "offset, with_event, alias_only, neither",
    [
        (-14 * D, (True, "BASELINE", None), (True, "BASELINE", None), (False, "BASELINE", "NO_TARGET_RELEVANCE")),
        (-14 * D - S, OUT, OUT, OUT),
        (-14 * D - US, OUT, OUT, OUT),
        (-24 * H - US, (True, "BASELINE", None), (True, "BASELINE", None), (False, "BASELINE", "NO_TARGET_RELEVANCE")),
        (-24 * H, (True, "EVENT", None), (True, "BASELINE", None), (False, None, "NO_TARGET_RELEVANCE")),
        (-1 * H, (True, "EVENT", None), (True, "BASELINE", None), (False, None, "NO_TARGET_RELEVANCE")),
        (-1 * H + US, (True, "EVENT", None), (False, "EVENT", "NO_TARGET_RELEVANCE"), (False, "EVENT", "NO_TARGET_RELEVANCE")),
        (0 * H, (True, "EVENT", None), (False, "EVENT", "NO_TARGET_RELEVANCE"), (False, "EVENT", "NO_TARGET_RELEVANCE")),
        (72 * H, (True, "EVENT", None), (False, "EVENT", "NO_TARGET_RELEVANCE"), (False, "EVENT", "NO_TARGET_RELEVANCE")),
        (72 * H + S, OUT, OUT, OUT),
    ],
)
def test_interval_boundaries(spark, offset, with_event, alias_only, neither):
    at = T + offset
    assert judge(spark, published_at=at) == with_event
    assert judge(spark, published_at=at, title="only alpha here") == alias_only
    assert judge(spark, published_at=at, title="cooking show") == neither


def test_baseline_term_and_phrase_across_the_join(spark):
    assert judge(spark, published_at=T - 2 * D, title="the world", description="cup is near") == (True, "BASELINE", None)


@pytest.mark.parametrize(
    "status, reason",
    [("UNAVAILABLE", "VIDEO_UNAVAILABLE")]
    + [(s, "METADATA_UNRESOLVED") for s in ("PARSE_ERROR", "RETRYABLE_ERROR", "PENDING", None, "FATAL_ERROR")],
)
def test_resolution_comes_first(spark, status, reason):
    assert judge(spark, resolution_status=status, is_short=True) == (False, None, reason)


@pytest.mark.parametrize(
    "short, language, want",
    [
        (True, "es", "YOUTUBE_SHORT"),
        (None, "es", "SHORTS_UNRESOLVED"),
        (False, "es", "NON_ENGLISH_METADATA"),
        (False, "en-GB", None),
        (False, "UNKNOWN", None),
        (False, "", None),
        (False, None, None),
    ],
)
def test_short_then_language(spark, short, language, want):
    assert judge(spark, is_short=short, primary_language_code=language)[2] == want


def test_missing_time(spark):
    assert judge(spark, published_at=None) == OUT


def test_discovery_results(spark):
    event = Event("E", "E", dt.datetime(2022, 12, 10), ("final",), windows=(Window("W", -24, 24),))
    start, end = dt.datetime(2022, 12, 9), dt.datetime(2022, 12, 11)
    data = [
        (1, start, "CR7!", ""),
        (2, end, "x", "the final"),
        (3, event.occurred_at, "CR700", None),
        (4, end + US, "CR7", ""),
    ]
    df = spark.createDataFrame(data, "k int, published_at timestamp_ntz, title string, description string")
    got = {r.k: (r.inclusion_status, r.primary_exclusion_reason) for r in cohort.discovery_eligibility(df, [event], ALIASES).collect()}
    assert got == {
        1: ("ELIGIBLE", None),
        2: ("ELIGIBLE", None),
        3: ("INELIGIBLE", "NO_TARGET_RELEVANCE"),
        4: ("INELIGIBLE", "OUT_OF_WINDOW"),
    }


def test_windows_partition_time(spark):
    windows = window_table(spark, [FINAL])
    instants = [T + h * H for h in (-336, -1, 6, 24, 72)] + [T + 336 * H, T - 336 * H - US, T + 6 * H - US]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(instants)], "i int, published_at timestamp_ntz")
    got = {r.i: r.window_type for r in assign_windows(df, windows).collect()}
    assert got == {0: "PRE_EVENT", 1: "EVENT", 2: "EARLY_POST_EVENT", 3: "LATE_POST_EVENT", 4: "RECOVERY_WINDOW", 7: "EVENT"}


def test_windows_beyond_the_broadcast_bound(spark, monkeypatch):
    """Overlapping windows of many events, joined through salted days."""
    from eventlens.operators import windows

    events = [Event(f"E{i}", "e", T + i * D, windows=(Window("A", -30, 30), Window("B", 0, 100))) for i in range(20)]
    df = spark.range(500).select(
        F.col("id"), (F.lit(str(T)).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.col("id").cast("int"))).alias("published_at")
    )

    def run():
        out = assign_windows(df, window_table(spark, events)).select("id", "event_version_key", "window_type")
        return sorted(map(tuple, out.collect()))

    few = run()
    monkeypatch.setattr(windows, "MAX_BROADCAST_ROWS", 0)
    assert run() == few and len(few) > 1000
    want = sorted(
        (i, e.event_key, w.window_type)
        for i in range(500)
        for e in events
        for w in e.windows
        if e.occurred_at + w.start_hours * H <= T + i * H < e.occurred_at + w.end_hours * H
    )
    assert few == want
