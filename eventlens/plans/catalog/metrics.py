"""Metric and mart queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventlens.config import Lineage, MinimumCohort
from eventlens.errors import GateError
from eventlens.operators.cohort import attribute_engagement, cohort_gate
from eventlens.plans import authors, bootstrap, coverage, decomposition, marts, narrative, reaction
from eventlens.plans.catalog.base import (
    EVENT_1,
    EVENT_2,
    LANGUAGE_THRESHOLD,
    N_MIN,
    NEGATIVE_BELOW,
    ORACLES,
    POSITIVE_ABOVE,
    POST,
    PRE,
    QUERIES,
    assignments,
    comments,
    comments_in_window,
    cte,
    opinions,
    query,
    rounded,
    table,
    targeted,
    with_toxicity,
)
from eventlens.session import scratch
from eventlens.sources.mart_sink import publish_mart, with_lineage, write_mart

TW = "event_version_key, target, window_type"

LINEAGE = Lineage("sp1", "mb1", "tx1", "th1", EVENT_1.occurred_at)
_LINEAGE_SQL = """'sp1' AS sampling_policy_version, 'mb1' AS model_bundle_version_key, 'tx1' AS taxonomy_version_key,
  'th1' AS threshold_config_version_key, timestamp '2024-01-15 12:00:00' AS data_as_of_at"""


def mart_query(name: str, sql: str, needs: str = ""):
    """Register a mart: its rows with the lineage that every mart row carries."""

    def add(fn):
        query(name, f"SELECT m.*, {_LINEAGE_SQL} FROM ({sql}) m", needs)(lambda spark, sf: with_lineage(fn(spark, sf), LINEAGE))
        return fn

    return add


@query(
    "m008_mean_valence",
    f"SELECT {TW}, count(*) AS opinion_count, round(avg(valence), 10) AS m008_mean_valence FROM opinions GROUP BY ALL",
    "opinions",
)
def _m008(spark, sf):
    return rounded(reaction.mean_valence(opinions(spark, sf)), "m008_mean_valence")


@query(
    "m009_video_balanced_valence",
    f"""SELECT {TW}, count(*) AS video_count, round(avg(m), 10) AS m009_video_balanced_valence
    FROM (SELECT {TW}, video_key, avg(valence) AS m FROM opinions GROUP BY ALL) GROUP BY ALL""",
    "opinions",
)
def _m009(spark, sf):
    return rounded(marts.mart_video_balanced_reaction(opinions(spark, sf)), "m009_video_balanced_valence")


@query(
    "m010_valence_shares",
    f"""SELECT {TW}, round(avg((valence > {POSITIVE_ABOVE})::INT), 10) AS positive_share,
      round(avg((valence BETWEEN {NEGATIVE_BELOW} AND {POSITIVE_ABOVE})::INT), 10) AS neutral_share,
      round(avg((valence < {NEGATIVE_BELOW})::INT), 10) AS negative_share FROM opinions GROUP BY ALL""",
    "opinions",
)
def _m010(spark, sf):
    out = reaction.valence_shares(opinions(spark, sf), NEGATIVE_BELOW, POSITIVE_ABOVE)
    return rounded(out, "positive_share", "neutral_share", "negative_share")


def toxic_opinions(spark, sf):
    return with_toxicity(spark, sf, opinions(spark, sf))


def _rate_sql(construct: str, name: str) -> str:
    return f"""SELECT {TW}, count(*) FILTER ({construct}_status = 'ACCEPTED') AS accepted_{construct}_output_count,
      round(count(*) FILTER ({construct}_status = 'ACCEPTED' AND {construct}_label)::DOUBLE
        / nullif(count(*) FILTER ({construct}_status = 'ACCEPTED'), 0), 10) AS {name}
      FROM {"opinions_tox" if construct == "toxicity" else "opinions"} GROUP BY ALL"""


@query("m011_derision_rate", _rate_sql("derision", "m011_derision_rate"), "opinions")
def _m011(spark, sf):
    return rounded(reaction.construct_rate(opinions(spark, sf), "derision", "m011_derision_rate"), "m011_derision_rate")


@query("m012_toxicity_rate", _rate_sql("toxicity", "m012_toxicity_rate"), "opinions_tox")
def _m012(spark, sf):
    return rounded(reaction.construct_rate(toxic_opinions(spark, sf), "toxicity", "m012_toxicity_rate"), "m012_toxicity_rate")


@query("m013_sarcasm_rate", _rate_sql("sarcasm", "m013_sarcasm_rate"), "opinions")
def _m013(spark, sf):
    return rounded(reaction.construct_rate(opinions(spark, sf), "sarcasm", "m013_sarcasm_rate"), "m013_sarcasm_rate")


_REACTION = f"""SELECT {TW}, count(*) AS eligible_target_opinion_count, count(valence) AS accepted_valence_output_count,
    round(avg(valence), 10) AS m008_mean_valence,
    round(avg((valence > {POSITIVE_ABOVE})::INT), 10) AS m010_positive_share,
    round(avg((valence BETWEEN {NEGATIVE_BELOW} AND {POSITIVE_ABOVE})::INT), 10) AS m010_neutral_share,
    round(avg((valence < {NEGATIVE_BELOW})::INT), 10) AS m010_negative_share, """ + ", ".join(
    f"""count(*) FILTER ({c}_status = 'ACCEPTED') AS accepted_{c}_output_count,
    round(count(*) FILTER ({c}_status = 'ACCEPTED' AND {c}_label)::DOUBLE
      / nullif(count(*) FILTER ({c}_status = 'ACCEPTED'), 0), 10) AS {n}"""
    for c, n in (("derision", "m011_derision_rate"), ("toxicity", "m012_toxicity_rate"), ("sarcasm", "m013_sarcasm_rate"))
) + " FROM opinions_tox GROUP BY ALL"
_REACTION_VALUES = (
    "m008_mean_valence",
    "m010_positive_share",
    "m010_neutral_share",
    "m010_negative_share",
    "m011_derision_rate",
    "m012_toxicity_rate",
    "m013_sarcasm_rate",
)


@mart_query("mart_target_reaction_window", _REACTION, "opinions_tox")
def _mart_reaction(spark, sf):
    out = marts.mart_target_reaction_window(toxic_opinions(spark, sf), NEGATIVE_BELOW, POSITIVE_ABOVE)
    return rounded(out, *_REACTION_VALUES)


# two models per opinion: the domain model flags above 80, the generic one above 70
def _inferences(spark, sf):
    rows = opinions(spark, sf)
    e, v = F.col("comment_key"), F.col("value")

    def output(model, label, status):
        return F.struct(
            F.lit(model).alias("model_key"), label.alias("predicted_label"), status.alias("classification_status")
        )

    def accepted_unless(divisor):
        return F.when(e % divisor == 0, F.lit("LOW_CONFIDENCE")).otherwise(F.lit("ACCEPTED"))

    both = F.array(
        output("domain", F.when(v > 80, F.lit("DERISIVE")).otherwise(F.lit("NONE")), accepted_unless(9)),
        output("generic", F.when(v > 70, F.lit("MOCKING")).otherwise(F.lit("NONE")), accepted_unless(6)),
    )
    return rows.select(
        "event_version_key",
        "window_type",
        F.lit("derision").alias("construct_key"),
        F.concat_ws("|", e.cast("string"), "target").alias("subject_key"),
        F.explode(both).alias("_o"),
    ).select("event_version_key", "window_type", "construct_key", "subject_key", "_o.*")


_M014 = """count(*) AS both_accepted_count, round(avg(((value > 80) <> (value > 70))::INT), 10) AS m014_disagreement_rate
    FROM opinions WHERE comment_key % 9 <> 0 AND comment_key % 6 <> 0 GROUP BY ALL"""


@query("m014_model_disagreement", f"SELECT window_type, 'derision' AS construct_key, {_M014}", "opinions")
def _m014(spark, sf):
    out = reaction.model_disagreement(_inferences(spark, sf), "domain", "generic", {"MOCKING": "DERISIVE"})
    return rounded(out, "m014_disagreement_rate")


@mart_query(
    "mart_model_comparison",
    f"""SELECT event_version_key, window_type, 'derision' AS construct_key, 'domain' AS first_model,
    'generic' AS second_model, {_M014}""",
    "opinions",
)
def _mart_models(spark, sf):
    out = marts.mart_model_comparison(_inferences(spark, sf), "domain", "generic", {"MOCKING": "DERISIVE"})
    return rounded(out, "m014_disagreement_rate")


# ------------------------------------------------------------------ coverage

_COVERAGE_SQL = """
  SELECT b.event_version_key, b.window_type, retrieved_canonical_count, chronological_count, english_count,
    coalesce(opinion_count, 0) AS opinion_count,
    round(chronological_count::DOUBLE / nullif(retrieved_canonical_count, 0), 10) AS m001_corpus_retention,
    round(coalesce(analytical_count, 0)::DOUBLE / nullif(chronological_count, 0), 10) AS m030_analytical_retention,
    round(resolved_count::DOUBLE / nullif(english_count, 0), 10) AS m002_target_resolution_rate,
    round(english_count::DOUBLE / nullif(chronological_count, 0), 10) AS m003_language_pass_rate,
    round(author_count::DOUBLE / nullif(chronological_count, 0), 10) AS m004_author_id_coverage,
    round(narrative_count::DOUBLE / nullif(opinion_count, 0), 10) AS m006_narrative_coverage
  FROM (SELECT event_version_key, window_type,
      count(*) FILTER (sample_type = 'CHRONOLOGICAL') AS retrieved_canonical_count,
      count(*) FILTER (prim) AS chronological_count, count(*) FILTER (prim AND eng) AS english_count,
      count(*) FILTER (prim AND eng AND resolution_status = 'ACCEPTED') AS resolved_count,
      count(author_key) FILTER (prim) AS author_count
    FROM (SELECT *, sample_type = 'CHRONOLOGICAL' AND exclusion_reason IS NULL AS prim,
        language_code = 'en' AND language_confidence >= 0.1 AS eng FROM in_window) GROUP BY ALL) b
  LEFT JOIN (SELECT event_version_key, window_type, count(DISTINCT comment_key) AS analytical_count,
      count(*) AS opinion_count, count(*) FILTER (has_narrative) AS narrative_count
    FROM opinions GROUP BY ALL) o USING (event_version_key, window_type)
"""


@mart_query("mart_methodology_coverage_event_window", _COVERAGE_SQL, "in_window opinions")
def _mart_coverage(spark, sf):
    out = marts.mart_methodology_coverage_event_window(
        comments_in_window(spark, sf), opinions(spark, sf), LANGUAGE_THRESHOLD
    )
    return rounded(out, *[c for c in out.columns if c[:2] == "m0"])


def _coverage_metric(name, column):
    @query(name, f"SELECT event_version_key, window_type, {column} FROM ({_COVERAGE_SQL})", "in_window opinions")
    def run(spark, sf):
        out = coverage.methodology_coverage(comments_in_window(spark, sf), opinions(spark, sf), LANGUAGE_THRESHOLD)
        return rounded(out, column).select("event_version_key", "window_type", column)


for _name in (
    "m001_corpus_retention",
    "m002_target_resolution_rate",
    "m003_language_pass_rate",
    "m004_author_id_coverage",
    "m006_narrative_coverage",
    "m030_analytical_retention",
):
    _coverage_metric(_name, _name)


def _intended(spark, sf):
    """Every video active in a window counts as intended there."""
    return (
        comments_in_window(spark, sf)
        .select("event_version_key", "window_type", F.col("channel_type_value").alias("stratum_name"), "video_key")
        .distinct()
    )


def _run_status(spark, sf):
    """Scan log: one run per comment day and video; the status depends on the day's last comment."""
    return comments(spark, sf).select(
        "video_key",
        F.col("published_at").alias("started_at"),
        F.when(F.col("comment_key") % 4 == 0, F.lit("POTENTIAL_GAP"))
        .when(F.col("comment_key") % 4 == 1, F.lit("COMPLETE_AFTER_BACKFILL"))
        .when(F.col("comment_key") % 4 == 2, F.lit("CAPPED_BEFORE_WATERMARK"))
        .otherwise(F.lit("COMPLETE_TO_WATERMARK"))
        .alias("continuity_status"),
    )


@query(
    "m005_complete_window_coverage",
    """SELECT event_version_key, window_type, stratum_name, count(*) AS intended_video_count,
      count(*) FILTER (odd) AS complete_video_count, round(avg(odd::INT), 10) AS m005_complete_window_coverage
    FROM (SELECT DISTINCT event_version_key, window_type, channel_type_value AS stratum_name, video_key FROM in_window)
    JOIN (SELECT video_key, arg_max(comment_key, published_at) % 2 = 1 AS odd FROM comments GROUP BY ALL)
      USING (video_key) GROUP BY ALL""",
    "in_window comments",
)
def _m005(spark, sf):
    out = marts.mart_complete_window_coverage_stratum(_intended(spark, sf), _run_status(spark, sf))
    return rounded(out, "m005_complete_window_coverage")


_CONSTRUCTS = {c: f"{c}_status" for c in ("derision", "sarcasm", "toxicity")}


@query(
    "m007_classifier_output_coverage",
    " UNION ALL ".join(
        f"""SELECT event_version_key, window_type, '{c}' AS construct_key,
        count(*) FILTER ({c}_status = 'ACCEPTED') AS accepted_count, count(*) AS opinion_count,
        round(avg(({c}_status = 'ACCEPTED')::INT), 10) AS m007_classifier_output_coverage FROM opinions_tox GROUP BY ALL"""
        for c in _CONSTRUCTS
    ),
    "opinions_tox",
)
def _m007(spark, sf):
    out = marts.mart_classifier_output_coverage(toxic_opinions(spark, sf), _CONSTRUCTS)
    return rounded(out, "m007_classifier_output_coverage")


# ------------------------------------------------------------------ authors

cte(
    "presence",
    f"""SELECT event_version_key, target, salt_version_id, author_key,
      count(*) FILTER (window_type = '{PRE}') AS n_pre, count(*) FILTER (window_type <> '{PRE}') AS n_post,
      avg(valence) FILTER (window_type = '{PRE}') AS m_pre, avg(valence) FILTER (window_type <> '{PRE}') AS m_post
    FROM opinions WHERE author_key IS NOT NULL GROUP BY ALL""",
    "opinions",
)


@query(
    "m016_author_overlap",
    """SELECT event_version_key, target, count(*) FILTER (n_pre > 0 AND n_post > 0) AS shared_author_count,
      count(*) AS observed_author_count,
      round(count(*) FILTER (n_pre > 0 AND n_post > 0)::DOUBLE / count(*), 10) AS m016_author_overlap
    FROM presence GROUP BY ALL""",
    "presence",
)
def _m016(spark, sf):
    return rounded(authors.author_overlap(opinions(spark, sf), PRE, POST), "m016_author_overlap")


@query(
    "m017_new_author_contribution",
    """SELECT event_version_key, target, CAST(coalesce(sum(n_post) FILTER (n_pre = 0), 0) AS BIGINT) AS new_author_comment_count,
      CAST(sum(n_post) AS BIGINT) AS identifiable_comment_count,
      round(coalesce(sum(n_post) FILTER (n_pre = 0), 0)::DOUBLE / nullif(sum(n_post), 0), 10) AS m017_new_author_contribution
    FROM presence GROUP BY ALL""",
    "presence",
)
def _m017(spark, sf):
    return rounded(authors.new_author_contribution(opinions(spark, sf), PRE, POST), "m017_new_author_contribution")


@query(
    "m018_returning_author_shift",
    """SELECT event_version_key, target, count(*) AS shared_author_count,
      round(avg(m_post - m_pre), 10) AS m018_returning_author_shift
    FROM presence WHERE n_pre > 0 AND n_post > 0 GROUP BY ALL""",
    "presence",
)
def _m018(spark, sf):
    return rounded(authors.returning_author_shift(opinions(spark, sf), PRE, POST), "m018_returning_author_shift")


_PAIRS = f"(SELECT '{PRE}' AS pre_window, * FROM (VALUES {', '.join(f"('{w}')" for w in POST)}) p(post_window))"


@mart_query(
    "mart_returning_author_shift",
    f"""SELECT event_version_key, target, pre_window, post_window, count(*) AS shared_author_count, round(avg(b.m - a.m), 10) AS m018_returning_author_shift
    FROM (SELECT event_version_key, target, salt_version_id, author_key, window_type, avg(valence) AS m FROM opinions WHERE author_key IS NOT NULL GROUP BY ALL) a
    JOIN (SELECT event_version_key, target, salt_version_id, author_key, window_type AS post_window, avg(valence) AS m FROM opinions WHERE author_key IS NOT NULL GROUP BY ALL) b
      USING (event_version_key, target, salt_version_id, author_key)
    JOIN {_PAIRS} p USING (post_window) WHERE a.window_type = p.pre_window AND a.m IS NOT NULL AND b.m IS NOT NULL GROUP BY ALL""",
    "opinions",
)
def _mart_returning(spark, sf):
    return rounded(marts.mart_returning_author_shift(opinions(spark, sf), PRE, POST), "m018_returning_author_shift")


@mart_query(
    "mart_observed_author_overlap",
    f"""SELECT event_version_key, target, '{PRE}' AS pre_window, post_window,
      count(*) FILTER (n_pre > 0 AND n_post > 0) AS shared_author_count,
      count(*) FILTER (n_pre > 0 OR n_post > 0) AS observed_author_count,
      round(count(*) FILTER (n_pre > 0 AND n_post > 0)::DOUBLE / nullif(count(*) FILTER (n_pre > 0 OR n_post > 0), 0), 10)
        AS m016_author_overlap,
      round(coalesce(sum(n_post) FILTER (n_pre = 0), 0)::DOUBLE / nullif(sum(n_post), 0), 10) AS m017_new_author_contribution
    FROM (SELECT event_version_key, target, salt_version_id, author_key, post_window,
        count(*) FILTER (window_type = '{PRE}') AS n_pre, count(*) FILTER (window_type = post_window) AS n_post
      FROM opinions, (VALUES {", ".join(f"('{w}')" for w in POST)}) p(post_window)
      WHERE author_key IS NOT NULL GROUP BY ALL) GROUP BY ALL""",
    "opinions",
)
def _mart_overlap(spark, sf):
    out = marts.mart_observed_author_overlap(opinions(spark, sf), PRE, POST)
    return rounded(out, "m016_author_overlap", "m017_new_author_contribution")


@mart_query(
    "mart_author_window_activity",
    """SELECT event_version_key, target, salt_version_id, author_key, window_type, count(DISTINCT comment_key) AS observed_comment_count,
      count(DISTINCT channel_key) AS observed_channel_count, round(avg(valence), 10) AS mean_target_valence,
      min(published_at) AS first_observed_at
    FROM opinions WHERE author_key IS NOT NULL GROUP BY ALL""",
    "opinions",
)
def _g22(spark, sf):
    return rounded(marts.mart_author_window_activity(opinions(spark, sf)), "mean_target_valence")


_ORIGINS = ("CLUB_MEDIA", "ANALYSIS_PUBLISHER")
_SINCE, _LOOKBACK = "2024-01-03 00:00:00", 24


@query(
    "m029_cross_stratum_participation",
    f"""WITH c AS (SELECT event_id, ts, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
        user_id * 100 + event_id % 40 AS author, CASE WHEN event_id % 31 = 0 THEN 2 ELSE 1 END AS salt FROM events WHERE user_id % 10 <> 0),
      a AS (SELECT *, CASE k % 5 WHEN 0 THEN 'UNCLASSIFIED' WHEN 1 THEN 'BROAD_REACH_PUBLISHER' WHEN 2 THEN 'CLUB_MEDIA'
        WHEN 3 THEN 'ANALYSIS_PUBLISHER' ELSE 'INDEPENDENT_CREATOR' END AS stratum_name FROM c),
      f AS (SELECT stratum_name, author, salt, min(ts) AS t0 FROM a GROUP BY ALL HAVING min(ts) >= timestamp '{_SINCE}')
    SELECT stratum_name, count(*) AS newly_observed_author_count,
      count(*) FILTER (crossed) AS cross_participating_author_count,
      round(avg(crossed::INT), 10) AS m029_cross_stratum_participation
    FROM (SELECT f.stratum_name, EXISTS (SELECT 1 FROM a WHERE a.author = f.author AND a.salt = f.salt AND a.stratum_name <> f.stratum_name
        AND a.stratum_name IN {_ORIGINS} AND a.ts < f.t0 AND a.ts >= f.t0 - to_hours({_LOOKBACK})) AS crossed FROM f)
    GROUP BY ALL""",
)
def _m029(spark, sf):
    rows = comments(spark, sf).select(
        "salt_version_id",
        (F.col("author_key") * 100 + F.col("comment_key") % 40).alias("author_key"),
        F.col("channel_type_value").alias("stratum_name"),
        "published_at",
    )
    out = authors.cross_stratum_participation(rows, _ORIGINS, _LOOKBACK, _SINCE)
    return rounded(out, "m029_cross_stratum_participation")


# ------------------------------------------------------------------ decomposition

cte(
    "contributions",
    f"""WITH s AS (SELECT event_version_key, target, stratum_name,
        count(*) FILTER (window_type = '{PRE}') AS n0, count(*) FILTER (window_type <> '{PRE}') AS n1,
        avg(valence) FILTER (window_type = '{PRE}') AS s0, avg(valence) FILTER (window_type <> '{PRE}') AS s1
      FROM opinions WHERE stratum_name <> 'UNCLASSIFIED' GROUP BY ALL),
      f AS (SELECT *, n0 >= {N_MIN} AND n1 >= {N_MIN} AS is_shared FROM s),
      w AS (SELECT *, CASE WHEN is_shared THEN n0 / sum(n0) FILTER (is_shared) OVER g END AS w0,
        CASE WHEN is_shared THEN n1 / sum(n1) FILTER (is_shared) OVER g END AS w1
        FROM f WINDOW g AS (PARTITION BY event_version_key, target))
    SELECT *, (s0 + s1) / 2 * (w1 - w0) AS composition_term, (w0 + w1) / 2 * (s1 - s0) AS tone_term FROM w""",
    "opinions",
)
_TERMS = ("s0", "s1", "w0", "w1", "composition_term", "tone_term")
_DECOMPOSITION = """SELECT event_version_key, target, count(*) FILTER (is_shared) AS shared_strata_count,
      count(*) FILTER (NOT is_shared) AS unpaired_strata_count,
      round(sum(composition_term), 10) AS m019_composition_effect, round(sum(tone_term), 10) AS m020_tone_effect,
      round(sum(w1 * s1) - sum(w0 * s0), 10) AS shared_shift,
      round(sum(n0) FILTER (is_shared) / sum(n0), 10) AS pre_coverage,
      round(sum(n1) FILTER (is_shared) / sum(n1), 10) AS post_coverage, 'VALID' AS decomposition_status
    FROM contributions GROUP BY ALL"""


cte(
    "pair_terms",
    f"""WITH s AS (SELECT event_version_key, target, pre_window, post_window, stratum_name,
        count(valence) FILTER (window_type = pre_window) AS n0, count(valence) FILTER (window_type = post_window) AS n1,
        avg(valence) FILTER (window_type = pre_window) AS s0, avg(valence) FILTER (window_type = post_window) AS s1
      FROM opinions JOIN {_PAIRS} ON window_type IN (pre_window, post_window) WHERE stratum_name <> 'UNCLASSIFIED' GROUP BY ALL),
      t AS (SELECT event_version_key, target, pre_window, post_window, sum(n0) AS all0, sum(n1) AS all1 FROM s WHERE n0 >= {N_MIN} AND n1 >= {N_MIN} GROUP BY ALL),
      w AS (SELECT s.*, n0 >= {N_MIN} AND n1 >= {N_MIN} AS is_shared, n0 / all0 AS v0, n1 / all1 AS v1 FROM s LEFT JOIN t USING (event_version_key, target, pre_window, post_window))
    SELECT * EXCLUDE (v0, v1), CASE WHEN is_shared THEN v0 END AS w0, CASE WHEN is_shared THEN v1 END AS w1,
      CASE WHEN is_shared THEN (s0 + s1) / 2 * (v1 - v0) END AS composition_term, CASE WHEN is_shared THEN (v0 + v1) / 2 * (s1 - s0) END AS tone_term FROM w""",
    "opinions",
)


@mart_query(
    "mart_channel_shift_contribution",
    f"""SELECT event_version_key, target, pre_window, post_window, stratum_name, n0, n1, is_shared,
    {", ".join(f"round({c}::DOUBLE, 10) AS {c}" for c in _TERMS)} FROM pair_terms""",
    "pair_terms",
)
def _mart_contribution(spark, sf):
    return rounded(marts.mart_channel_shift_contribution(opinions(spark, sf), PRE, POST, N_MIN), *_TERMS)


_EFFECTS = ("m019_composition_effect", "m020_tone_effect", "shared_shift", "pre_coverage", "post_coverage")


_PAIR_DECOMPOSITION = """SELECT event_version_key, target, pre_window, post_window, shared_strata_count, unpaired_strata_count,
      CASE WHEN valid THEN round(c, 10) END AS m019_composition_effect, CASE WHEN valid THEN round(t, 10) END AS m020_tone_effect,
      CASE WHEN valid THEN round(shift, 10) END AS shared_shift, round(n0 / nullif(all0, 0), 10) AS pre_coverage, round(n1 / nullif(all1, 0), 10) AS post_coverage,
      CASE WHEN valid THEN 'VALID' ELSE 'INSUFFICIENT_STRATA' END AS decomposition_status
    FROM (SELECT event_version_key, target, pre_window, post_window, count(*) FILTER (is_shared) AS shared_strata_count, count(*) FILTER (NOT is_shared) AS unpaired_strata_count,
        count(*) FILTER (is_shared) >= 2 AS valid, sum(composition_term) AS c, sum(tone_term) AS t, sum(w1 * s1) - sum(w0 * s0) AS shift,
        coalesce(sum(n0) FILTER (is_shared), 0) AS n0, coalesce(sum(n1) FILTER (is_shared), 0) AS n1, sum(n0) AS all0, sum(n1) AS all1 FROM pair_terms GROUP BY ALL)"""


@mart_query(
    "mart_channel_shift_decomposition",
    _PAIR_DECOMPOSITION,
    "pair_terms",
)
def _mart_decomposition(spark, sf):
    return rounded(marts.mart_channel_shift_decomposition(opinions(spark, sf), PRE, POST, N_MIN, 2), *_EFFECTS)


def decomposition_mart(spark, sf):
    """All post windows taken together."""
    return decomposition.decompose_shift(decomposition.shift_contributions(opinions(spark, sf), PRE, POST, N_MIN), 2)


@query(
    "m019_composition_effect",
    f"SELECT event_version_key, target, m019_composition_effect FROM ({_DECOMPOSITION})",
    "contributions",
)
def _m019(spark, sf):
    return rounded(decomposition_mart(spark, sf), "m019_composition_effect").select(
        "event_version_key", "target", "m019_composition_effect"
    )


@query(
    "m020_tone_effect", f"SELECT event_version_key, target, m020_tone_effect FROM ({_DECOMPOSITION})", "contributions"
)
def _m020(spark, sf):
    return rounded(decomposition_mart(spark, sf), "m020_tone_effect").select(
        "event_version_key", "target", "m020_tone_effect"
    )


@query(
    "m021_stratum_adjusted_sentiment",
    f"""SELECT event_version_key, target, stratum_name, count(*) FILTER (window_type = '{PRE}') AS baseline_count,
      count(*) FILTER (window_type = 'EVENT') AS event_count,
      CASE WHEN count(*) FILTER (window_type = '{PRE}') >= {N_MIN} AND count(*) FILTER (window_type = 'EVENT') >= {N_MIN}
        THEN round(avg(valence) FILTER (window_type = 'EVENT') - avg(valence) FILTER (window_type = '{PRE}'), 10) END
        AS m021_stratum_adjusted_sentiment
    FROM opinions GROUP BY ALL""",
    "opinions",
)
def _m021(spark, sf):
    out = marts.mart_stratum_adjusted_reaction(opinions(spark, sf), PRE, ["EVENT"], N_MIN)
    return rounded(out, "m021_stratum_adjusted_sentiment")


@query(
    "m028_standardised_reaction",
    f"""WITH h AS (SELECT target, date_trunc('day', published_at) AS d, avg(valence) AS m FROM targeted
        WHERE sample_type = 'CHRONOLOGICAL' AND exclusion_reason IS NULL AND language_code = 'en'
          AND language_confidence >= {LANGUAGE_THRESHOLD} AND resolution_status = 'ACCEPTED'
          AND published_at < timestamp '2024-01-15 00:00:00' GROUP BY ALL),
      p AS (SELECT target, count(*) AS history_window_count, avg(m) AS mu, stddev_samp(m) AS sigma FROM h GROUP BY ALL),
      n AS (SELECT event_version_key, target, avg(valence) AS event_mean FROM opinions WHERE window_type = 'EVENT' GROUP BY ALL)
    SELECT event_version_key, target, history_window_count, round(event_mean, 10) AS event_mean, round(mu, 10) AS mu,
      round(sigma, 10) AS sigma, round((event_mean - mu) / nullif(sigma, 0), 10) AS m028_standardised_reaction
    FROM n JOIN p USING (target)""",
    "targeted opinions",
)
def _m028(spark, sf):
    history = (
        targeted(coverage.target_opinions(comments(spark, sf), LANGUAGE_THRESHOLD))
        .filter(F.col("published_at") < F.lit("2024-01-15 00:00:00").cast("timestamp_ntz"))
        .withColumn("history_window", F.to_date("published_at"))
    )
    out = decomposition.standardised_reaction(opinions(spark, sf), history, "EVENT")
    return rounded(out, "event_mean", "mu", "sigma", "m028_standardised_reaction")


# ------------------------------------------------------------------ narratives

_NARRATIVE_VALUES = (
    "m022_primary_share",
    "m023_multi_label_prevalence",
    "m024_broad_reach_share",
    "unclassified_share",
    "m025_support_rate",
    "m026_opposition_rate",
    "m027_stance_coverage",
)
_NARRATIVE_SQL = f"""
  SELECT {TW}, narrative, eligible_target_opinion_count, accepted_primary_narrative_count, narrative_assignment_count,
    accepted_stance_assignment_count, eligible_stance_assignment_count, round(primaries::DOUBLE / accepted_primary_narrative_count, 10) AS m022_primary_share,
    round(instances::DOUBLE / eligible_target_opinion_count, 10) AS m023_multi_label_prevalence,
    m024_broad_reach_share, unclassified_share, m025_support_rate, m026_opposition_rate,
    round(accepted_stance_assignment_count::DOUBLE / nullif(eligible_stance_assignment_count, 0), 10) AS m027_stance_coverage
  FROM (SELECT {TW}, narrative, count(*) AS narrative_assignment_count, count(stance) FILTER (stance_eligible) AS accepted_stance_assignment_count,
      count(*) FILTER (stance_eligible) AS eligible_stance_assignment_count,
      count(*) FILTER (is_primary) AS primaries, count(DISTINCT comment_key) AS instances,
      round(avg((channel_type_value = 'BROAD_REACH_PUBLISHER')::INT), 10) AS m024_broad_reach_share,
      round(avg((channel_type_value = 'UNCLASSIFIED')::INT), 10) AS unclassified_share,
      round(count(*) FILTER (stance = 'SUPPORTS')::DOUBLE / nullif(count(stance), 0), 10) AS m025_support_rate,
      round(count(*) FILTER (stance = 'OPPOSES')::DOUBLE / nullif(count(stance), 0), 10) AS m026_opposition_rate
    FROM assignments GROUP BY ALL)
  JOIN (SELECT {TW}, count(*) FILTER (is_primary) AS accepted_primary_narrative_count FROM assignments GROUP BY ALL) USING ({TW})
  JOIN (SELECT {TW}, count(DISTINCT comment_key) AS eligible_target_opinion_count FROM opinions GROUP BY ALL) USING ({TW})
"""


def narrative_mart(spark, sf):
    rows = opinions(spark, sf)
    return rounded(marts.mart_narrative_window(assignments(rows), rows), *_NARRATIVE_VALUES)


@mart_query("mart_narrative_window", _NARRATIVE_SQL, "assignments opinions")
def _mart_narrative(spark, sf):
    return narrative_mart(spark, sf)


def _narrative_metric(column):
    @query(column, f"SELECT {TW}, narrative, {column} FROM ({_NARRATIVE_SQL})", "assignments opinions")
    def run(spark, sf):
        return narrative_mart(spark, sf).select(*TW.split(", "), "narrative", column)


for _name in _NARRATIVE_VALUES:
    if _name.startswith("m0"):
        _narrative_metric(_name)


@query(
    "r3_narrative_lifecycle",
    """WITH d AS (SELECT narrative || ':' || (comment_key % 40) AS narrative, CAST(published_at AS DATE) AS day, count(*) AS n
        FROM assignments GROUP BY ALL),
      p AS (SELECT *, day - lag(day) OVER (PARTITION BY narrative ORDER BY day) AS pause FROM d)
    SELECT narrative, min(day) AS first_seen, max(day) AS last_seen, count(*) AS active_days,
      count(*) FILTER (pause > 2) AS reactivations, CAST(coalesce(max(pause), 0) AS BIGINT) AS longest_pause_days,
      CAST(max(day) - min(day) AS BIGINT) AS span_days, CAST(sum(n) AS BIGINT) AS assignment_count
    FROM p GROUP BY ALL""",
    "assignments",
)
def _r3(spark, sf):
    rows = assignments(opinions(spark, sf)).withColumn(
        "narrative", F.concat_ws(":", "narrative", (F.col("comment_key") % 40).cast("string"))
    )
    return narrative.narrative_lifecycle(rows, 2)


# ------------------------------------------------------------------ uncertainty

REPLICATES, SEED, LEVEL = 50, 7, 0.95


def _bootstrap_sql(clusters: str) -> str:
    """Same draws from the same hash, written as set operations."""
    return f"""
  SELECT target, cluster_count, round(estimate, 10) AS estimate, round(ci_low, 10) AS ci_low, round(ci_high, 10) AS ci_high
  FROM (SELECT target, count(*) AS cluster_count, sum(num) / sum(den) AS estimate FROM {clusters} GROUP BY ALL)
  JOIN (SELECT target, quantile_cont(est, {(1 - LEVEL) / 2}) AS ci_low, quantile_cont(est, {1 - (1 - LEVEL) / 2}) AS ci_high
    FROM (SELECT d.target, d.r, sum(num) / sum(den) AS est
      FROM (SELECT target, r, CAST(floor(('0x' || substr(md5('{SEED}|' || target || '|' || r || '|' || i), 1, 13))::UBIGINT
            / 4503599627370496.0::DOUBLE * n) AS BIGINT) AS pick
          FROM (SELECT target, row_number() OVER (PARTITION BY target ORDER BY cluster) - 1 AS i,
            count(*) OVER (PARTITION BY target) AS n FROM {clusters}), range({REPLICATES}) t(r)) d
      JOIN (SELECT target, num, den, row_number() OVER (PARTITION BY target ORDER BY cluster) - 1 AS i FROM {clusters}) c
        ON c.target = d.target AND c.i = d.pick
      GROUP BY ALL) GROUP BY ALL) USING (target)"""


cte(
    "video_clusters",
    """SELECT target, video_key * 40 + author_key % 40 AS cluster, sum(valence) AS num, count(*)::DOUBLE AS den
    FROM opinions WHERE author_key IS NOT NULL GROUP BY ALL""",
    "opinions",
)
cte(
    "author_clusters",
    """SELECT target, (salt_version_id, author_key) AS cluster, m_post - m_pre AS num, 1.0::DOUBLE AS den FROM presence
    WHERE n_pre > 0 AND n_post > 0""",
    "presence",
)


@query("b1_cluster_bootstrap", _bootstrap_sql("video_clusters"), "video_clusters")
def _b1(spark, sf):
    rows = (
        opinions(spark, sf)
        .filter("author_key IS NOT NULL")
        .withColumn("cluster", F.col("video_key") * 40 + F.col("author_key") % 40)
    )
    sums = bootstrap.clusters(rows, ["target"], "cluster", "valence")
    out = bootstrap.bootstrap_ratio(sums, ["target"], "cluster", REPLICATES, SEED, LEVEL)
    return rounded(out, "estimate", "ci_low", "ci_high")


@query("b2_paired_bootstrap", _bootstrap_sql("author_clusters"), "author_clusters")
def _b2(spark, sf):
    deltas = authors.returning_author_deltas(opinions(spark, sf), PRE, POST)
    out = bootstrap.paired_bootstrap(deltas, ["target"], "author_key", REPLICATES, SEED, LEVEL)
    return rounded(out, "estimate", "ci_low", "ci_high")


# ------------------------------------------------------------------ comparisons


@query(
    "r1_surfacing_audit",
    """WITH v AS (SELECT video_key FROM comments GROUP BY ALL HAVING count(DISTINCT sample_type) = 2),
      c AS (SELECT * FROM comments_tox WHERE video_key IN (SELECT video_key FROM v))
    SELECT (SELECT count(*) FROM v) AS common_video_count, count(*) FILTER (sample_type = 'CHRONOLOGICAL') AS chronological_count,
      count(*) FILTER (sample_type = 'RELEVANCE') AS relevance_count,
      round(avg(valence) FILTER (sample_type = 'RELEVANCE') - avg(valence) FILTER (sample_type = 'CHRONOLOGICAL'), 10) AS valence_delta,
      round(avg(derision_label::INT) FILTER (sample_type = 'RELEVANCE' AND derision_status = 'ACCEPTED')
        - avg(derision_label::INT) FILTER (sample_type = 'CHRONOLOGICAL' AND derision_status = 'ACCEPTED'), 10) AS derision_delta,
      round(avg(toxicity_label::INT) FILTER (sample_type = 'RELEVANCE' AND toxicity_status = 'ACCEPTED')
        - avg(toxicity_label::INT) FILTER (sample_type = 'CHRONOLOGICAL' AND toxicity_status = 'ACCEPTED'), 10) AS toxicity_delta
    FROM c""",
    "comments comments_tox",
)
def _r1(spark, sf):
    out = reaction.surfacing_audit(with_toxicity(spark, sf, comments(spark, sf)))
    return rounded(out, "valence_delta", "derision_delta", "toxicity_delta")


@query(
    "r1_author_concentration",
    """SELECT sample_type, round(sum(n * n)::DOUBLE / (sum(n) * sum(n)), 10) AS author_concentration
    FROM (SELECT sample_type, salt_version_id, author_key, count(*) AS n FROM comments WHERE author_key IS NOT NULL GROUP BY ALL) GROUP BY ALL""",
    "comments",
)
def _r1_authors(spark, sf):
    return rounded(reaction.author_concentration(comments(spark, sf)), "author_concentration")


@query(
    "r1_narrative_mix",
    """SELECT sample_type, narrative, round(n::DOUBLE / sum(n) OVER (PARTITION BY sample_type), 10) AS narrative_share
    FROM (SELECT sample_type, narrative, count(*) AS n FROM comments GROUP BY ALL)""",
    "comments",
)
def _r1_narratives(spark, sf):
    return rounded(reaction.narrative_mix_by_sample(comments(spark, sf)), "narrative_share")


@query(
    "r2_matched_events",
    """WITH m AS (SELECT event_version_key, target, window_type, avg(valence) AS v FROM opinions2 GROUP BY ALL)
    SELECT window_type AS comparison_stratum, count(DISTINCT event_version_key) AS event_count,
      round(avg(v) FILTER (target = 'A'), 10) AS mean_valence_a, round(avg(v) FILTER (target = 'B'), 10) AS mean_valence_b,
      round(avg(v) FILTER (target = 'A') - avg(v) FILTER (target = 'B'), 10) AS difference
    FROM m GROUP BY ALL""",
    "opinions2",
)
def _r2(spark, sf):
    rows = opinions(spark, sf, (EVENT_1, EVENT_2))
    metric = reaction.mean_valence(rows).withColumnRenamed("m008_mean_valence", "mean_valence")
    # each window type is a comparison stratum of both events here
    strata = rows.select("event_version_key", "target", F.col("window_type").alias("comparison_stratum")).distinct()
    per_stratum = metric.withColumnRenamed("window_type", "w")
    joined = reaction.matched_events(
        per_stratum.withColumn("event_version_key", F.concat_ws("/", "event_version_key", "w")).drop("w"),
        strata.withColumn("event_version_key", F.concat_ws("/", "event_version_key", "comparison_stratum")),
        ("A", "B"),
        "mean_valence",
    )
    return rounded(joined, "mean_valence_a", "mean_valence_b", "difference")


@query(
    "r4_same_comment_treatment",
    """SELECT event_version_key, window_type, count(*) AS paired_comment_count, round(avg(a - b), 10) AS mean_paired_difference
    FROM (SELECT event_version_key, window_type, comment_key, max(target_valence) FILTER (target = 'A') AS a,
      max(target_valence) FILTER (target = 'B') AS b FROM opinions GROUP BY ALL)
    WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY ALL""",
    "opinions",
)
def _r4(spark, sf):
    return rounded(reaction.same_comment_treatment(opinions(spark, sf), "A", "B"), "mean_paired_difference")


# ------------------------------------------------------------------ volumes, gates, attribution


@query(
    "g18_volumes",
    """SELECT event_version_key, window_type, comment_volume, coalesce(target_volume, 0) AS target_volume
    FROM (SELECT event_version_key, window_type, count(DISTINCT comment_key) AS comment_volume FROM in_window
      WHERE sample_type = 'CHRONOLOGICAL' AND exclusion_reason IS NULL GROUP BY ALL)
    LEFT JOIN (SELECT event_version_key, window_type, count(DISTINCT (comment_key, target)) AS target_volume
      FROM opinions GROUP BY ALL) USING (event_version_key, window_type)""",
    "in_window opinions",
)
def _g18(spark, sf):
    return coverage.volumes(comments_in_window(spark, sf), opinions(spark, sf))


MINIMUM = MinimumCohort(comments_per_window=100, target_opinions=60, stable_authors=10, represented_strata=3)
_MEASURES = """SELECT event_version_key, window_type, comment_count, author_count, opinion_count, strata_count,
    CASE WHEN comment_count < 100 OR author_count < 10 OR coalesce(opinion_count, 0) < 60 OR coalesce(strata_count, 0) < 3
      THEN 'INSUFFICIENT_SAMPLE' ELSE 'OK' END AS sample_status
  FROM (SELECT event_version_key, window_type, count(*) AS comment_count, count(DISTINCT (salt_version_id, author_key)) FILTER (author_key IS NOT NULL) AS author_count
      FROM in_window WHERE sample_type = 'CHRONOLOGICAL' AND exclusion_reason IS NULL GROUP BY ALL)
  LEFT JOIN (SELECT event_version_key, window_type, count(*) AS opinion_count, count(DISTINCT stratum_name) AS strata_count
      FROM opinions GROUP BY ALL) USING (event_version_key, window_type)"""


@query("g21_minimum_cohort", _MEASURES, "in_window opinions")
def _g21(spark, sf):
    return cohort_gate(coverage.sample_measures(comments_in_window(spark, sf), opinions(spark, sf)), MINIMUM)


@query(
    "mart_gated_reaction",
    f"""SELECT * EXCLUDE (sample_status, {", ".join(_REACTION_VALUES)}), sample_status,
      {", ".join(f"CASE WHEN sample_status = 'OK' THEN {c} END AS {c}" for c in _REACTION_VALUES)}
    FROM ({_REACTION}) JOIN (SELECT event_version_key, window_type, sample_status FROM ({_MEASURES}))
      USING (event_version_key, window_type)""",
    "in_window opinions opinions_tox",
)
def _gated(spark, sf):
    out = marts.gated_reaction(
        comments_in_window(spark, sf), toxic_opinions(spark, sf), MINIMUM, NEGATIVE_BELOW, POSITIVE_ABOVE
    )
    return rounded(out, *_REACTION_VALUES)


@query(
    "g17_engagement_attribution",
    """SELECT comment_key, target, CASE WHEN target = min(target) OVER c THEN likes ELSE 0 END AS comment_level_likes,
      likes AS full_likes, round(likes::DOUBLE / count(*) OVER c, 10) AS fractional_likes
    FROM targeted WINDOW c AS (PARTITION BY comment_key)""",
    "targeted",
)
def _g17(spark, sf):
    return rounded(attribute_engagement(targeted(comments(spark, sf))), "fractional_likes")


cte(
    "class_scores",
    """WITH p AS (SELECT CASE WHEN quality = 1 THEN 'GOOD' ELSE 'POOR' END AS truth,
        CASE WHEN n_chars % 5 = 0 THEN 'POOR' WHEN n_chars % 7 = 0 THEN 'MIXED' ELSE 'GOOD' END AS predicted
        FROM labels JOIN documents USING (doc_id)),
      l AS (SELECT truth AS label FROM p UNION SELECT predicted FROM p),
      s AS (SELECT label, (SELECT count(*) FROM p WHERE truth = label) AS support,
        (SELECT count(*) FROM p WHERE predicted = label) AS claimed,
        (SELECT count(*) FROM p WHERE predicted = label AND truth = label) AS hit FROM l)
    SELECT label, support, hit::DOUBLE / nullif(claimed, 0) AS precision, hit::DOUBLE / nullif(support, 0) AS recall,
      coalesce(2.0::DOUBLE * hit / nullif(support + claimed, 0), 0) AS f1 FROM s""",
)


def _class_scores(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "n_chars")
    n = F.col("n_chars")
    predicted = F.when(n % 5 == 0, F.lit("POOR")).when(n % 7 == 0, F.lit("MIXED")).otherwise(F.lit("GOOD"))
    pairs = (
        table(spark, sf, "labels")
        .join(docs, "doc_id")
        .select(
            F.when(F.col("quality") == 1, F.lit("GOOD")).otherwise(F.lit("POOR")).alias("truth"),
            predicted.alias("predicted"),
        )
    )
    return coverage.validation_scores(pairs)


@query(
    "g19_validation_scores",
    """SELECT label, support, round(precision, 10) AS precision, round(recall, 10) AS recall, round(f1, 10) AS f1 FROM class_scores""",
    "class_scores",
)
def _g19(spark, sf):
    return rounded(_class_scores(spark, sf), "precision", "recall", "f1")


@query(
    "g19_validation_summary",
    """SELECT count(*) AS class_count, round(avg(f1), 10) AS macro_f1, round(avg(recall), 10) AS balanced_accuracy FROM class_scores""",
    "class_scores",
)
def _g19_summary(spark, sf):
    return rounded(coverage.validation_summary(_class_scores(spark, sf)), "macro_f1", "balanced_accuracy")


@query(
    "g19_krippendorff_alpha",
    """WITH r AS (SELECT doc_id AS unit, 'q' || quality AS label FROM labels
        UNION ALL SELECT doc_id, 'q' || (1 - toxic) FROM labels
        UNION ALL SELECT doc_id, 'q' || (n_chars % 2) FROM documents),
      u AS (SELECT unit, label, count(*) AS c FROM r GROUP BY ALL),
      s AS (SELECT unit, sum(c) AS m, sum(c * c) AS sq FROM u GROUP BY ALL HAVING sum(c) >= 2),
      t AS (SELECT label, sum(c) AS t FROM u WHERE unit IN (SELECT unit FROM s) GROUP BY ALL)
    SELECT CAST(n AS BIGINT) AS pairable_ratings, round(1 - d / ((n * n - tsq)::DOUBLE / (n - 1)), 10) AS krippendorff_alpha
    FROM (SELECT sum(m) AS n, sum((m * m - sq)::DOUBLE / (m - 1)) AS d FROM s), (SELECT sum(t * t) AS tsq FROM t)""",
)
def _g19_alpha(spark, sf):
    labels = table(spark, sf, "labels")
    docs = table(spark, sf, "documents")

    def rating(df, value):
        return df.select(F.col("doc_id").alias("unit"), F.concat(F.lit("q"), value.cast("string")).alias("label"))

    ratings = (
        rating(labels, F.col("quality"))
        .unionByName(rating(labels, 1 - F.col("toxic")))
        .unionByName(rating(docs, F.col("n_chars") % 2))
    )
    return rounded(coverage.krippendorff_alpha(ratings), "krippendorff_alpha")


@query(
    "p15_population_levels",
    """SELECT event_version_key, window_type, count(*) AS retrieved,
      count(*) FILTER (sample_type = 'CHRONOLOGICAL' AND exclusion_reason IS NULL) AS chronological,
      count(*) FILTER (sample_type = 'CHRONOLOGICAL' AND exclusion_reason IS NULL AND language_code = 'en'
        AND language_confidence >= 0.1 AND resolution_status = 'ACCEPTED') AS analytical
    FROM in_window GROUP BY ALL""",
    "in_window",
)
def _p15(spark, sf):
    rows = comments_in_window(spark, sf)
    keys = list(coverage.WINDOW)

    def size(df, name):
        return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))

    out = size(rows, "retrieved")
    out = out.join(size(coverage.chronological(rows), "chronological"), keys, "left")
    out = out.join(size(coverage.target_opinions(rows, LANGUAGE_THRESHOLD), "analytical"), keys, "left")
    return out.fillna(0)




@query(
    "s11_mart_sink",
    f"SELECT *, {_LINEAGE_SQL} FROM ({_REACTION})",
    "opinions_tox",
)
def _s11(spark, sf):
    """Writes the mart to shared storage and reads it back."""
    path = scratch(spark, "mart_target_reaction")
    out = marts.mart_target_reaction_window(toxic_opinions(spark, sf), NEGATIVE_BELOW, POSITIVE_ABOVE)
    write_mart(rounded(out, *_REACTION_VALUES), path, LINEAGE)
    return spark.read.parquet(path)


def decomposition_rules():
    residual = F.abs(F.col("m019_composition_effect") + F.col("m020_tone_effect") - F.col("shared_shift"))
    share = lambda c: F.coalesce(F.col(c), F.lit(0.0)).between(0, 1)
    return {"additive": F.coalesce(residual <= 1e-4, F.lit(True)), "coverage_in_bounds": share("pre_coverage") & share("post_coverage")}


@query(
    "s11_gated_publish",
    f"""SELECT m.*, {_LINEAGE_SQL}, 'additive ' || (SELECT count(*) FROM ({_PAIR_DECOMPOSITION}) WHERE target = 'A' AND m020_tone_effect IS NOT NULL) AS rejected
    FROM ({_PAIR_DECOMPOSITION}) m""",
    "pair_terms",
)
def _s11_gated(spark, sf):
    """A mart that keeps its rules is published; the one that a faulty writer made afterwards isn't."""
    path = scratch(spark, "mart_decomposition")
    mart = marts.mart_channel_shift_decomposition(opinions(spark, sf), PRE, POST, N_MIN, 2)
    publish_mart(mart, path, LINEAGE, decomposition_rules())
    raised = F.when(F.col("target") == "A", F.lit(0.01)).otherwise(F.lit(0.0))
    rejected = "nothing"
    try:
        publish_mart(mart.withColumn("m020_tone_effect", F.col("m020_tone_effect") + raised), path, LINEAGE, decomposition_rules())
    except GateError as gate:
        rejected = str(gate).rpartition(": ")[2]
    return rounded(spark.read.parquet(path), *_EFFECTS).withColumn("rejected", F.lit(rejected))




# ------------------------------------------------------------------ marts that share a metric's query

for _mart, _metric in (
    ("mart_complete_window_coverage_stratum", "m005_complete_window_coverage"),
    ("mart_classifier_output_coverage", "m007_classifier_output_coverage"),
    ("mart_video_balanced_reaction", "m009_video_balanced_valence"),
    ("mart_stratum_adjusted_reaction", "m021_stratum_adjusted_sentiment"),
):
    mart_query(_mart, ORACLES[_metric])(QUERIES[_metric])
