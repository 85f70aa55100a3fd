"""Registry, and the canonical tables the queries derive from the given ones.

Each derived table exists twice: as a DataFrame function and as a DuckDB common table
expression. A query's oracle names the expressions it needs.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlens.config import Entity, Event, StratificationRules
from eventlens.functions.times import ntz
from eventlens.operators.windows import in_windows
from eventlens.session import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, needs: str = ""):
    """Register a query; `needs` lists the derived tables its oracle uses."""

    def add(fn):
        assert name not in QUERIES, name
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_tables(needs, sql)
        return fn

    return add


def with_tables(needs: str, body: str) -> str:
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in ordered:
            return
        for dep in CTE_DEPS.get(name, ()):
            visit(dep)
        ordered.append(name)

    for n in needs.split():
        visit(n)
    if not ordered:
        return body
    shared = "WITH " + ",\n".join(f"{n} AS ({CTES[n]})" for n in ordered)
    body = body.strip()
    # a body with expressions of its own continues the list
    return shared + (", " + body[5:] if body.startswith("WITH ") else "\n" + body)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    """The text table, spread for pattern matching when it is one small file."""
    return spread(table(spark, sf, "documents"))


def rounded(df: DataFrame, *columns: str, digits: int = 10) -> DataFrame:
    """Doubles rounded for comparison; both engines round the same way away from ties."""
    return df.withColumns({c: F.round(F.col(c).cast("double"), digits) for c in columns})


# ---------------------------------------------------------------- configuration of the runs

EVENT_1 = Event(
    event_key="EV1",
    event_name="First event",
    occurred_at=datetime(2024, 1, 15, 12),
    event_terms=("oning", "ontion"),
    baseline_terms=("nicht", "this"),
)
EVENT_2 = Event(
    event_key="EV2",
    event_name="Second event",
    occurred_at=datetime(2024, 1, 9, 20, 30),
    event_terms=("reing", "intion"),
    baseline_terms=("with", "from"),
)
ENTITIES = (
    Entity("A", "Entity A", ("Thble", "thing", "and the")),
    Entity("B", "Entity B", ("estion", "étion", "that the")),
)
ALIASES_A, ALIASES_B = ENTITIES[0].aliases, ENTITIES[1].aliases
ALL_ALIASES = (*ALIASES_A, *ALIASES_B)
LANGUAGE_THRESHOLD = 0.10
NEGATIVE_BELOW, POSITIVE_ABOVE = -0.1, 0.1
PRE = "PRE_EVENT"
POST = ("EVENT", "EARLY_POST_EVENT", "LATE_POST_EVENT", "RECOVERY_WINDOW")
N_MIN = 5

RULES = StratificationRules(
    combined_focus_threshold=0.40,
    club_winning_margin=0.10,
    analysis_share_threshold=0.50,
    clubs=(("North", ("the", "and")), ("South", ("der", "und")), ("West", ("que", "los"))),
    analysis_keywords=("with", "from"),
    broadcaster_registry_version="v1",
    broadcasters=("src3", "src11"),
    analysis_registry_version="v1",
    analysis_publishers=("src5",),
    deduplication_rule_version="same_title_v1",
    deduplication_rule_status="APPROVED",
)

# ---------------------------------------------------------------- derived tables, DuckDB side

CTES: dict[str, str] = {}
CTE_DEPS: dict[str, tuple[str, ...]] = {}


def cte(name: str, sql: str, *deps: str) -> None:
    CTES[name] = sql
    CTE_DEPS[name] = deps


def _window_rows(*events: Event) -> str:
    rows = ", ".join(
        f"('{e.event_key}', timestamp '{e.occurred_at}', '{w.window_type}', {w.start_hours}, {w.end_hours})"
        for e in events
        for w in e.windows
    )
    return (
        "SELECT event_version_key, occurred_at, window_type, so, eo, "
        "occurred_at + to_hours(so) AS start_at, occurred_at + to_hours(eo) AS end_at "
        f"FROM (VALUES {rows}) t(event_version_key, occurred_at, window_type, so, eo)"
    )


cte("windows1", _window_rows(EVENT_1))
cte("windows2", _window_rows(EVENT_1, EVENT_2))

cte(
    "comments",
    """
    SELECT event_id AS comment_key, ts AS published_at, event_id, value,
      k AS video_key, k % 20 AS channel_key,
      CASE WHEN user_id % 10 = 0 THEN NULL ELSE user_id END AS author_key, CASE WHEN event_id % 31 = 0 THEN 'salt2' ELSE 'salt1' END AS salt_version_id,
      CASE WHEN k % 7 = 0 THEN 'es' ELSE 'en' END AS language_code,
      (event_id % 100) / 100.0::DOUBLE AS language_confidence,
      CASE k % 5 WHEN 0 THEN 'UNCLASSIFIED' WHEN 1 THEN 'BROAD_REACH_PUBLISHER' WHEN 2 THEN 'CLUB_MEDIA'
        WHEN 3 THEN 'ANALYSIS_PUBLISHER' ELSE 'INDEPENDENT_CREATOR' END AS channel_type_value,
      CASE WHEN event_id % 19 = 0 THEN 'RELEVANCE' ELSE 'CHRONOLOGICAL' END AS sample_type,
      CASE WHEN event_id % 23 = 0 THEN 'LINK_SOLICITATION' END AS exclusion_reason,
      CASE WHEN event_id % 11 = 0 THEN 'LOW_CONFIDENCE' WHEN event_id % 13 = 0 THEN 'AMBIGUOUS'
        WHEN event_id % 17 = 0 THEN 'MODEL_ERROR' ELSE 'ACCEPTED' END AS resolution_status,
      greatest(-1.0::DOUBLE, least(1.0::DOUBLE, (value - 50) / 100)) AS valence,
      value > 80 AS derision_label,
      CASE WHEN event_id % 9 = 0 THEN 'LOW_CONFIDENCE' ELSE 'ACCEPTED' END AS derision_status,
      value < 5 AS sarcasm_label,
      CASE WHEN event_id % 8 = 0 THEN 'LOW_CONFIDENCE' ELSE 'ACCEPTED' END AS sarcasm_status,
      event_type AS narrative, event_id % 10 <> 3 AS has_narrative,
      CAST(floor(value) AS BIGINT) AS likes, user_id, event_type
    FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
    """,
)
cte(
    "toxicity",
    """SELECT doc_id AS comment_key, toxic = 1 AS toxicity_label, 'ACCEPTED' AS toxicity_status FROM labels""",
)
cte(
    "targeted",
    """
    SELECT c.*, t.target, CASE WHEN t.target = 'A' THEN valence ELSE -valence / 2 END AS target_valence
    FROM comments c JOIN (VALUES ('A'), ('B')) t(target)
      ON c.comment_key % 5 = 0 OR (t.target = 'A') = (c.comment_key % 2 = 0)
    """,
    "comments",
)
cte(
    "in_window",
    """SELECT c.*, w.event_version_key, w.window_type, w.start_at FROM comments c
    JOIN windows1 w ON c.published_at >= w.start_at AND c.published_at < w.end_at""",
    "comments",
    "windows1",
)
_OPINION_FILTER = (
    "sample_type = 'CHRONOLOGICAL' AND exclusion_reason IS NULL AND language_code = 'en' "
    f"AND language_confidence >= {LANGUAGE_THRESHOLD} AND resolution_status = 'ACCEPTED'"
)
cte(
    "opinions",
    f"""SELECT c.*, w.event_version_key, w.window_type, channel_type_value AS stratum_name FROM targeted c
    JOIN windows1 w ON c.published_at >= w.start_at AND c.published_at < w.end_at WHERE {_OPINION_FILTER}""",
    "targeted",
    "windows1",
)
cte(
    "opinions_tox",
    """SELECT o.*, toxicity_label, coalesce(toxicity_status, 'MODEL_ERROR') AS toxicity_status
    FROM opinions o LEFT JOIN toxicity USING (comment_key)""",
    "opinions",
    "toxicity",
)
cte(
    "comments_tox",
    """SELECT c.*, toxicity_label, coalesce(toxicity_status, 'MODEL_ERROR') AS toxicity_status
    FROM comments c LEFT JOIN toxicity USING (comment_key)""",
    "comments",
    "toxicity",
)
cte(
    "opinions2",
    f"""SELECT c.*, w.event_version_key, w.window_type, channel_type_value AS stratum_name FROM targeted c
    JOIN windows2 w ON c.published_at >= w.start_at AND c.published_at < w.end_at WHERE {_OPINION_FILTER}""",
    "targeted",
    "windows2",
)
_NEXT = {"click": "error", "error": "purchase", "purchase": "signup", "signup": "view", "view": "click"}
cte(
    "assignments",
    """SELECT o.* EXCLUDE (narrative), a.narrative, a.is_primary,
      CASE comment_key % 4 WHEN 0 THEN 'SUPPORTS' WHEN 3 THEN 'SUPPORTS' WHEN 1 THEN 'OPPOSES' END AS stance,
      comment_key % 4 <> 2 OR comment_key % 3 = 0 AS stance_eligible
    FROM opinions o, LATERAL (
      SELECT o.narrative AS narrative, TRUE AS is_primary
      UNION ALL SELECT CASE o.narrative """
    + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in _NEXT.items())
    + """ END, FALSE WHERE o.comment_key % 4 = 0) a""",
    "opinions",
)
cte(
    "videos",
    """
    SELECT doc_id AS video_key, md5(text) AS source_id, source AS channel_key,
      timestamp '2024-01-18 12:00:00' - to_seconds((doc_id * 7919) % 17280000) - to_milliseconds(doc_id % 1000) AS published_at,
      CASE doc_id % 10 WHEN 0 THEN TRUE WHEN 1 THEN NULL ELSE FALSE END AS is_short,
      CASE WHEN doc_id % 13 = 0 THEN 'UNKNOWN' ELSE lang END AS primary_language_code,
      CASE doc_id % 17 WHEN 0 THEN 'UNAVAILABLE' WHEN 1 THEN 'PENDING' WHEN 2 THEN NULL
        WHEN 3 THEN 'PARSE_ERROR' ELSE 'RESOLVED' END AS resolution_status,
      split_part(text, '.', 1) AS title, text AS description, n_chars, lang, doc_id
    FROM documents
    """,
)

# Word boundaries spelled out, since the oracle's \b knows ASCII words only.
_NOT_WORD = r"[^\p{L}\p{N}\p{M}_]"


def mentions_sql(text: str, terms) -> str:
    if not terms:
        return "FALSE"
    body = "|".join(t.lower() for t in sorted(terms))
    return f"regexp_matches(lower({text}), '(^|{_NOT_WORD})({body})($|{_NOT_WORD})')"


RELEVANCE_TEXT = "(lower(title) || ' ' || lower(description))"

# ---------------------------------------------------------------- derived tables, Spark side

# channel type by video number modulo five
CHANNEL_TYPE_OF = (
    "UNCLASSIFIED",
    "BROAD_REACH_PUBLISHER",
    "CLUB_MEDIA",
    "ANALYSIS_PUBLISHER",
    "INDEPENDENT_CREATOR",
)


def comments(spark: SparkSession, sf: str) -> DataFrame:
    base = table(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))
    one, hundred = F.lit(1.0), F.lit(100.0)
    e, k, v = F.col("event_id"), F.col("k"), F.col("value")

    def status(divisor: int) -> Column:
        return F.when(e % divisor == 0, F.lit("LOW_CONFIDENCE")).otherwise(F.lit("ACCEPTED"))

    return base.select(
        e.alias("comment_key"),
        F.col("ts").alias("published_at"),
        k.alias("video_key"),
        (k % 20).alias("channel_key"),
        F.when(F.col("user_id") % 10 != 0, F.col("user_id")).alias("author_key"),
        F.when(F.col("event_id") % 31 == 0, F.lit("salt2")).otherwise(F.lit("salt1")).alias("salt_version_id"),
        F.when(k % 7 == 0, F.lit("es")).otherwise(F.lit("en")).alias("language_code"),
        ((e % 100) / hundred).alias("language_confidence"),
        F.get(F.array(*map(F.lit, CHANNEL_TYPE_OF)), (k % 5).cast("int")).alias("channel_type_value"),
        F.when(e % 19 == 0, F.lit("RELEVANCE")).otherwise(F.lit("CHRONOLOGICAL")).alias("sample_type"),
        F.when(e % 23 == 0, F.lit("LINK_SOLICITATION")).alias("exclusion_reason"),
        F.when(e % 11 == 0, F.lit("LOW_CONFIDENCE"))
        .when(e % 13 == 0, F.lit("AMBIGUOUS"))
        .when(e % 17 == 0, F.lit("MODEL_ERROR"))
        .otherwise(F.lit("ACCEPTED"))
        .alias("resolution_status"),
        F.greatest(-one, F.least(one, (v - 50) / 100)).alias("valence"),
        (v > 80).alias("derision_label"),
        status(9).alias("derision_status"),
        (v < 5).alias("sarcasm_label"),
        status(8).alias("sarcasm_status"),
        F.col("event_type").alias("narrative"),
        (e % 10 != 3).alias("has_narrative"),
        F.floor(v).cast("bigint").alias("likes"),
        v.alias("value"),
        "user_id",
    )


def with_toxicity(spark: SparkSession, sf: str, rows: DataFrame) -> DataFrame:
    """Toxicity outputs where the label table has one; the rest are abstentions."""
    labels = table(spark, sf, "labels").select(F.col("doc_id").alias("comment_key"), "toxic")
    return (
        rows.join(labels, "comment_key", "left")
        .withColumn("toxicity_label", F.col("toxic") == 1)
        .withColumn(
            "toxicity_status",
            F.when(F.col("toxic").isNull(), F.lit("MODEL_ERROR")).otherwise(F.lit("ACCEPTED")),
        )
        .drop("toxic")
    )


def targeted(rows: DataFrame) -> DataFrame:
    """Even ids speak about A, odd ones about B, ids divisible by five about both."""
    e = F.col("comment_key")
    targets = F.array_compact(
        F.array(
            F.when((e % 2 == 0) | (e % 5 == 0), F.lit("A")), F.when((e % 2 == 1) | (e % 5 == 0), F.lit("B"))
        )
    )
    return rows.withColumn("target", F.explode(targets)).withColumn(
        "target_valence", F.when(F.col("target") == "A", F.col("valence")).otherwise(-F.col("valence") / 2)
    )


def comments_in_window(spark: SparkSession, sf: str) -> DataFrame:
    return in_windows(comments(spark, sf), [EVENT_1])


def opinions(spark: SparkSession, sf: str, events=(EVENT_1,)) -> DataFrame:
    from eventlens.plans.coverage import target_opinions

    subset = target_opinions(comments(spark, sf), LANGUAGE_THRESHOLD)
    return in_windows(targeted(subset), list(events)).withColumn("stratum_name", F.col("channel_type_value"))


def assignments(rows: DataFrame) -> DataFrame:
    """Primary narrative of every opinion, a secondary one for every fourth comment."""
    pairs = [F.lit(x) for kv in _NEXT.items() for x in kv]
    second = F.element_at(F.create_map(*pairs), F.col("narrative"))
    both = F.array_compact(
        F.array(
            F.struct(F.col("narrative").alias("n"), F.lit(True).alias("p")),
            F.when(F.col("comment_key") % 4 == 0, F.struct(second.alias("n"), F.lit(False).alias("p"))),
        )
    )
    rest = F.col("comment_key") % 4
    return (
        rows.withColumn("_a", F.explode(both))
        .withColumn("narrative", F.col("_a.n"))
        .withColumn("is_primary", F.col("_a.p"))
        .withColumn("stance", F.when(rest.isin(0, 3), F.lit("SUPPORTS")).when(rest == 1, F.lit("OPPOSES")))
        .withColumn("stance_eligible", (rest != 2) | (F.col("comment_key") % 3 == 0))
        .drop("_a")
    )


def videos(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("doc_id")
    back = (d * 7919) % 17280000 * 1000 + d % 1000
    return documents(spark, sf).select(
        d.alias("video_key"),
        F.md5("text").alias("source_id"),
        F.col("source").alias("channel_key"),
        F.timestamp_add("MILLISECOND", -back, ntz("2024-01-18 12:00:00")).alias("published_at"),
        F.when(d % 10 == 0, F.lit(True)).when(d % 10 != 1, F.lit(False)).alias("is_short"),
        F.when(d % 13 == 0, F.lit("UNKNOWN")).otherwise(F.col("lang")).alias("primary_language_code"),
        F.when(d % 17 == 0, F.lit("UNAVAILABLE"))
        .when(d % 17 == 1, F.lit("PENDING"))
        .when(d % 17 == 2, F.lit(None))
        .when(d % 17 == 3, F.lit("PARSE_ERROR"))
        .otherwise(F.lit("RESOLVED"))
        .alias("resolution_status"),
        F.split_part("text", F.lit("."), F.lit(1)).alias("title"),
        F.col("text").alias("description"),
        "n_chars",
        "lang",
        "doc_id",
    )
