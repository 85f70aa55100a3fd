"""Lookup, point-in-time, as-of, anti and upsert joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlens.errors import GateError
from eventlens.functions.times import ntz
from eventlens.operators.ordered import bounded, latest_per_key, one_per_key, time_slice


def alias_matches(texts: DataFrame, aliases: DataFrame, key: str, text: str = "text") -> DataFrame:
    """One row per text and alias it mentions; `aliases` has target_entity_key, alias_text, `key` tells texts apart.

    An index of the words that aliases have, with the number of texts that hold each, picks every alias's rarest
    word as its anchor. Narrow rows (key, word) meet the anchors, and a text is fetched once, for all its
    candidate aliases, to be checked against the whole phrases. So a text moves once, however many words or
    aliases there are, and a word that most texts hold brings nothing together unless an alias has no other.
    """
    lowered = F.lower("alias_text")
    words = F.array_distinct(F.regexp_extract_all(lowered, F.lit(r"(?U)(\w+)"), F.lit(1)))
    heads = aliases.select("target_entity_key", lowered.alias("alias_text"), words.alias("_words")).distinct()
    if heads.filter(F.size("_words") == 0).limit(1).count():
        raise GateError("an alias without any word character cannot be matched on word boundaries")
    parts = heads.select("target_entity_key", "alias_text", F.explode("_words").alias("_word"))
    mentioned = texts.select(F.col(key).alias("_key"), F.explode(F.array_distinct(F.split(F.lower(text), r"(?U)\W+"))).alias("_word"))
    mentioned = mentioned.join(parts.select("_word").distinct(), "_word", "left_semi")
    held = mentioned.groupBy("_word").agg(F.count(F.lit(1)).alias("_n"))
    rarest = F.min(F.struct("_n", "_word")).getField("_word")
    # an alias with a word that no text has can't be mentioned
    known = parts.join(held, "_word", "left").groupBy("target_entity_key", "alias_text").agg(rarest.alias("_word"), F.count_if(F.col("_n").isNull()).alias("_absent"))
    anchors = known.filter("_absent = 0").drop("_absent")
    candidates = mentioned.join(anchors, "_word").groupBy("_key").agg(F.collect_set(F.struct("target_entity_key", "alias_text")).alias("_aliases"))
    fetched = texts.join(candidates, texts[key] == candidates["_key"]).withColumn("_alias", F.explode("_aliases"))
    alias = F.col("_alias.alias_text")
    quoted = F.concat(F.lit(r"(?U)\b\Q"), F.replace(alias, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E\b"))
    hit = F.contains(F.lower(text), alias) & F.rlike(F.lower(text), quoted)
    return fetched.filter(hit).select(*texts.columns, "_alias.target_entity_key", "_alias.alias_text")


def scoped_aliases(aliases: DataFrame, event_entities: DataFrame) -> DataFrame:
    """Active aliases of the entities taking part in each event."""
    active = aliases.filter("is_active")
    return event_entities.select("event_version_key", "target_entity_key").distinct().join(
        bounded(active), "target_entity_key"
    )


#: Days of a slice of validity, and the span that is cut into slices: they move work, never results.
SLICE_DAYS = 90
SLICED_FROM = "2000-01-01 00:00:00"


def valid_at(
    facts: DataFrame, versions: DataFrame, key: str, at: str, columns: Sequence[str], slice_days: int = SLICE_DAYS
) -> DataFrame:
    """Point-in-time join: the version whose [valid_from, valid_to) holds the fact's instant.

    Facts and versions meet on the key and a slice of time: a version is there once for each slice that it
    reaches, from `SLICED_FROM` to now; what lies before or after belongs to the first and last slice. So a key
    with most of the facts is spread over its slices, a fact is compared with the versions of its slice only, and
    adaptive execution picks the kind of join by the size of what is read. Versions of one key do not overlap, so a
    fact matches at most one; facts without key, instant or version stay, with NULLs.
    """
    first, last = time_slice(ntz(SLICED_FROM), slice_days), time_slice(F.current_timestamp(), slice_days)
    within = lambda c: F.least(F.greatest(time_slice(c, slice_days), first), last)
    start = within(F.col("valid_from"))
    end = F.greatest(F.when(F.col("valid_to").isNotNull(), within(F.col("valid_to"))).otherwise(last), start)
    reach = versions.select(F.col(key).alias("_key"), "valid_from", "valid_to", *columns, F.explode(F.sequence(start, end)).alias("_reach"))
    t = F.col(at)
    alive = (t >= F.col("valid_from")) & (F.col("valid_to").isNull() | (t < F.col("valid_to")))
    cut = facts.withColumn("_slice", F.when(t.isNotNull(), within(t)))
    return cut.join(reach, (F.col(key) == F.col("_key")) & (F.col("_slice") == F.col("_reach")) & alive, "left").drop("_key", "_slice", "_reach")


def as_of(
    facts: DataFrame, observations: DataFrame, key: str, observed_at: str, cutoff: Column, columns: Sequence[str]
) -> DataFrame:
    """Latest observation at or before the cutoff; the aggregate combines map-side.

    Ties on the instant go to the greatest value tuple, so the result is total.
    """
    latest = (
        observations.filter(F.col(observed_at) <= cutoff)
        .groupBy(key)
        .agg(F.max(F.struct(observed_at, *columns)).alias("_s"))
        .select(key, *[F.col(f"_s.{c}").alias(c) for c in [observed_at, *columns]])
    )
    return facts.join(latest, key, "left")


def missing_from(required: DataFrame, present: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of `required` without a counterpart in `present`."""
    return required.join(present.select(*keys).distinct(), list(keys), "left_anti")


def insert_if_absent(current: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Append the incoming rows whose natural key is new, one per key; existing rows stay untouched."""
    fresh = one_per_key(incoming, keys).join(current.select(*keys), list(keys), "left_anti")
    return current.unionByName(fresh)


def upsert(
    current: DataFrame, changes: DataFrame, keys: Sequence[str], columns: Sequence[str]
) -> DataFrame:
    """New table version: changed rows take the new values, new keys are added.

    Plain Parquet has no MERGE, so the whole version is written again by the caller.
    """
    changed = changes.select(*keys, F.struct(*columns).alias("_new"))
    return (
        current.select(*keys, F.struct(*columns).alias("_old"))
        .join(changed, list(keys), "full_outer")
        .select(
            *keys,
            *[
                F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(f"_old.{c}")).alias(c)
                for c in columns
            ],
        )
    )


def require_all(required: DataFrame, present: DataFrame, keys: Sequence[str], what: str) -> DataFrame:
    """Gate: every key must be present, else the run stops naming a few of the missing."""
    absent = missing_from(required.select(*keys).distinct(), present, keys).orderBy(*keys).limit(5).collect()
    if absent:
        raise GateError(f"{what}: missing for {[tuple(r) for r in absent]}")
    return required


def stratum_label(facts: DataFrame, snapshots: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join to the pinned stratum; channels without one are UNCLASSIFIED."""
    label = snapshots.select(
        *keys, F.concat_ws(" x ", "channel_type_value", "focus_value").alias("_name")
    )
    return (
        facts.join(bounded(label), list(keys), "left")
        .withColumn("stratum_name", F.coalesce("_name", F.lit("UNCLASSIFIED")))
        .drop("_name")
    )


def candidate_videos(
    videos: DataFrame,
    video_events: DataFrame,
    frame_channels: DataFrame,
    resolution: DataFrame,
    snapshots: DataFrame,
    frame_version_key: str,
) -> DataFrame:
    """Videos linked to an event through the frame, with state and latest metadata.

    A link counts when the frame appears in its provenance, either in the discovery queries
    or as the frame of the whole record.
    """
    eligible = frame_channels.filter(
        (F.col("frame_version_key") == frame_version_key) & (F.col("frame_inclusion_status") == "ELIGIBLE")
    ).select("channel_key")
    through_frame = F.exists(
        F.coalesce("discovery_provenance.queries", F.array()),
        lambda q: q["frame_version_key"] == frame_version_key,
    ) | F.coalesce(F.col("discovery_provenance.frame_version_key") == frame_version_key, F.lit(False))
    latest = latest_per_key(
        snapshots, ["video_key"], [F.col("observed_at").desc(), F.col("video_snapshot_key").desc()]
    ).select("video_key", "title", "description")
    # candidates are distinct because every side is; deduplicating the narrow sides keeps texts out of it
    links = video_events.filter(through_frame).select("video_key", "event_version_key", "video_event_key").distinct()
    state = resolution.select("source_id", "resolution_status").distinct()
    return (
        videos.join(bounded(eligible), "channel_key", "left_semi")
        .join(links, "video_key")
        .join(state, "source_id", "left")
        .join(latest, "video_key", "left")
    )


def unique_frame_of_videos(links: DataFrame, snapshots: DataFrame, runs: DataFrame) -> DataFrame:
    """Frame a link was discovered through, where its snapshots name exactly one."""
    frames = (
        runs.filter("resource_scope_type = 'FRAME' AND endpoint = 'channels.list'")
        .select("ingestion_run_id", F.col("resource_scope_id").alias("frame_version_key"))
        .distinct()
    )
    plausible = (
        snapshots.select("video_key", "ingestion_run_id")
        .distinct()
        .join(frames, "ingestion_run_id")
        .groupBy("video_key")
        .agg(F.count_distinct("frame_version_key").alias("_frames"), F.min("frame_version_key").alias("_frame"))
    )
    return links.join(plausible, "video_key", "left").withColumn(
        "frame_version_key", F.when(F.col("_frames") == 1, F.col("_frame"))
    ).drop("_frames", "_frame")

