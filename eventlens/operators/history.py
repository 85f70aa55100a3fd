"""Versioned dimensions, change-only snapshots, deduplication and state logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlens.functions.keys import md5_uuid, sha256
from eventlens.functions.text import canonical_terms
from eventlens.operators.ordered import neighbours, sliced_neighbours, time_slice


def scd2_merge(
    current: DataFrame,
    incoming: DataFrame,
    keys: Sequence[str],
    tracked: Sequence[str],
    effective_at: Column,
    term_lists: Sequence[str] = (),
) -> DataFrame:
    """Type-2 merge of a full version table with incoming states.

    A key whose tracked columns changed gets its current row closed and a new current row;
    equal states reuse the existing version. Term lists compare case- and order-blind.
    `current` holds keys, tracked, valid_from, valid_to, is_current; history rows pass through.
    """

    def state(prefix: str) -> Column:
        return F.struct(
            *[
                (canonical_terms(F.col(c)) if c in term_lists else F.col(c)).alias(f"_{prefix}{i}")
                for i, c in enumerate(tracked)
            ]
        )

    fields = [*keys, *tracked, "valid_from", "valid_to", "is_current"]
    history = current.filter("NOT is_current").select(*fields)
    live = current.filter("is_current").select(
        *keys, F.struct(*tracked, "valid_from").alias("_old"), state("s").alias("_old_state")
    )
    new = incoming.select(*keys, F.struct(*tracked).alias("_new"), state("s").alias("_new_state"))
    both = live.join(new, list(keys), "full_outer")
    changed = F.col("_new").isNotNull() & ~F.col("_old_state").eqNullSafe(F.col("_new_state"))
    # every pair turns into one or two rows: what became of the old version, and the new one
    old_row = F.when(
        F.col("_old").isNotNull(),
        F.struct(
            *[F.col(f"_old.{c}").alias(c) for c in tracked],
            F.col("_old.valid_from").alias("valid_from"),
            F.when(changed, effective_at).alias("valid_to"),
            (~changed).alias("is_current"),
        ),
    )
    new_row = F.when(
        changed,
        F.struct(
            *[F.col(f"_new.{c}").alias(c) for c in tracked],
            effective_at.alias("valid_from"),
            F.lit(None).cast("timestamp_ntz").alias("valid_to"),
            F.lit(True).alias("is_current"),
        ),
    )
    merged = both.select(*keys, F.explode(F.array_compact(F.array(old_row, new_row))).alias("_v")).select(
        *keys, "_v.*"
    )
    return history.unionByName(merged)


def scd2_from_history(states: DataFrame, key: str, value: str, at: str, tie: str, slice_days: int = 90) -> DataFrame:
    """Ordered states to validity intervals; a new interval starts only when the value changes.

    A key's states are compared in slices of time, each with the edge of the one before, so a key with most
    of the states is no single task.
    """
    kept = states.select(key, value, at, tie).withColumn("_any", F.lit(True))
    cut = time_slice(F.col(at), slice_days)
    seen = sliced_neighbours(kept, [key], [at, tie], cut, before={"_prev": value, "_has_prev": "_any"})
    starts = seen.filter(F.col("_has_prev").isNull() | ~F.col(value).eqNullSafe(F.col("_prev")))
    starts = starts.select(key, value, at, tie)
    return sliced_neighbours(starts, [key], [at, tie], cut, after={"valid_to": at}).select(
        key,
        value,
        F.col(at).alias("valid_from"),
        "valid_to",
        F.col("valid_to").isNull().alias("is_current"),
    )


def freeze_once(current: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Lifecycle enrichment of videos: fill what is unknown, never overwrite what is resolved.

    The rule version belongs to the short flag, so it only moves with it.
    """
    c = current.select(*keys, F.struct(*[x for x in current.columns if x not in keys]).alias("c"))
    n = incoming.select(*keys, F.struct(*[x for x in incoming.columns if x not in keys]).alias("n"))
    known_language = F.col("c.primary_language_code").isNotNull() & (F.col("c.primary_language_code") != "UNKNOWN")
    rule = (
        F.when(F.col("c.is_short").isNotNull(), F.col("c.short_classification_rule_version"))
        .when(F.col("n.is_short").isNotNull(), F.col("n.short_classification_rule_version"))
        .otherwise(F.col("c.short_classification_rule_version"))
    )
    return c.join(n, list(keys), "full_outer").select(
        *keys,
        F.coalesce("c.published_at", "n.published_at").alias("published_at"),
        F.coalesce("c.duration_seconds", "n.duration_seconds").alias("duration_seconds"),
        F.coalesce("c.is_short", "n.is_short").alias("is_short"),
        rule.alias("short_classification_rule_version"),
        F.when(known_language, F.col("c.primary_language_code"))
        .otherwise(F.coalesce("n.primary_language_code", "c.primary_language_code"))
        .alias("primary_language_code"),
    )


def canonical_comments(observations: DataFrame) -> DataFrame:
    """First observation per source comment and the number of repeats.

    `min` of a struct combines map-side, so a comment seen very often is no hot key.
    """
    first = F.min(F.struct("published_at", "observed_at", "page_number", "item_position", "video_key", "author_key"))
    return (
        observations.groupBy("source_comment_id")
        .agg(first.alias("_f"), F.count(F.lit(1)).alias("_n"))
        .select(
            md5_uuid(F.col("source_comment_id")).alias("comment_key"),
            "source_comment_id",
            "_f.video_key",
            "_f.author_key",
            "_f.published_at",
            F.col("_f.observed_at").alias("first_observed_at"),
            (F.col("_n") - 1).alias("duplicate_observations"),
        )
    )


FIRST_SEEN = ("published_at", "observed_at", "page_number", "item_position", "video_key", "author_key")


def comment_states(marked: DataFrame, order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Per source comment its first observation, column by column, how often it was observed, and its `last` snapshot.

    `marked` as `marked_since` gives it: `last` is that of the snapshots that aren't late, NULL if all are.
    """
    last = F.max(F.when(~F.col("_late"), F.struct(*order, *values)))
    return (
        marked.groupBy("source_comment_id")
        .agg(F.min(F.struct(*FIRST_SEEN)).alias("_f"), F.count(F.lit(1)).alias("observations"), last.alias("last"))
        .select("source_comment_id", md5_uuid(F.col("source_comment_id")).alias("comment_key"), "_f.*", "observations", "last")
    )


def fold_comments(stored: DataFrame, new: DataFrame) -> DataFrame:
    """What `comment_states` gives for all observations, from that of the earlier and of the new ones."""

    def side(df: DataFrame, prefix: str) -> DataFrame:
        first = F.struct(*FIRST_SEEN).alias(f"_{prefix}f")
        rest = [F.col(c).alias(f"_{prefix}{c}") for c in ("comment_key", "observations", "last")]
        return df.select("source_comment_id", first, *rest)

    both = side(stored, "s").join(side(new, "n"), "source_comment_id", "full_outer").withColumn("_f", F.least("_sf", "_nf"))
    total = F.coalesce("_sobservations", F.lit(0)) + F.coalesce("_nobservations", F.lit(0))
    return both.select(
        "source_comment_id",
        F.coalesce("_scomment_key", "_ncomment_key").alias("comment_key"),
        "_f.*",
        total.alias("observations"),
        F.greatest("_slast", "_nlast").alias("last"),
    )


def text_states(observations: DataFrame, key: str = "source_comment_id") -> DataFrame:
    """Distinct texts per comment, with the instants of their first and last observation."""
    known = "text_hash" in observations.columns
    hashed = observations if known else observations.withColumn("text_hash", sha256(F.col("text_content")))
    return hashed.groupBy(key, "text_hash").agg(
        F.first("text_content").alias("text_content"),
        F.min("observed_at").alias("observed_at"),
        F.max("observed_at").alias("last_observed_at"),
    )


def fold_text_states(stored: DataFrame, new: DataFrame, key: str = "source_comment_id") -> DataFrame:
    renamed = new.select(key, "text_hash", F.struct("text_content", "observed_at", "last_observed_at").alias("_n"))
    return stored.join(renamed, [key, "text_hash"], "full_outer").select(
        key,
        "text_hash",
        F.coalesce("text_content", "_n.text_content").alias("text_content"),
        F.least("observed_at", "_n.observed_at").alias("observed_at"),
        F.greatest("last_observed_at", "_n.last_observed_at").alias("last_observed_at"),
    )


def with_latest(states: DataFrame, key: str = "source_comment_id") -> DataFrame:
    """Marks the text that was observed last; a text that returns to an earlier state is the latest again."""
    newest = states.groupBy(key).agg(F.max(F.struct("last_observed_at", "text_hash")).getField("text_hash").alias("_latest"))
    return states.join(newest, key).withColumn("is_latest_version", F.col("text_hash") == F.col("_latest")).drop("_latest")


def text_versions(observations: DataFrame, key: str = "source_comment_id") -> DataFrame:
    """Distinct text states per comment; the latest is the one observed last.

    A text that returns to an earlier state makes that state the latest again.
    """
    versions = (
        observations.withColumn("text_hash", sha256(F.col("text_content")))
        .groupBy(key, "text_hash")
        .agg(F.min("observed_at").alias("observed_at"), F.max("observed_at").alias("last_observed_at"))
    )
    newest = versions.groupBy(key).agg(
        F.max(F.struct("last_observed_at", "text_hash")).getField("text_hash").alias("_latest")
    )
    return versions.join(newest, key).select(
        key, "text_hash", "observed_at", (F.col("text_hash") == F.col("_latest")).alias("is_latest_version")
    )


def change_only(
    snapshots: DataFrame, key: str, order: Sequence[str], values: Sequence[str], hot: int | None = None
) -> DataFrame:
    """Snapshots whose values differ from the previous one of the same key."""
    packed = snapshots.withColumn("_cur", F.struct(*values))
    seen = neighbours(packed, [key], [F.col(o) for o in order], before={"_prev": "_cur"}, hot=hot)
    return seen.filter(~F.col("_cur").eqNullSafe(F.col("_prev"))).drop("_cur", "_prev")


def changes_since(
    stored: DataFrame, snapshots: DataFrame, key: str, order: Sequence[str], values: Sequence[str], hot: int | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """`change_only` in pieces: (changes, late, last) of new snapshots after those that were seen before.

    `stored` holds the last snapshot seen per key (key, order and value columns), changed or not. changes are the
    snapshots whose values differ from the one before, stored or new; late ones stand at or before the
    stored snapshot, where the change they would make can't be told any more; last is the new `stored` of the keys.
    """
    seen = marked_since(stored, snapshots, key, order, values, hot)
    extra = ("_late", "_changed")
    last = seen.filter("NOT _late").groupBy(key).agg(F.max(F.struct(*order, *values)).alias("_last")).select(key, "_last.*")
    return seen.filter("_changed").drop(*extra), seen.filter("_late").drop(*extra), last


def marked_since(
    stored: DataFrame,
    snapshots: DataFrame,
    key: str,
    order: Sequence[str],
    values: Sequence[str],
    hot: int | None = None,
    is_hot: bool | None = None,
) -> DataFrame:
    """All new snapshots with the flags `_late` and `_changed`, as told apart by `changes_since`.

    Late ones stand before all others of their key, so one order of the snapshots serves both.
    """
    at = F.struct(*order)
    known = stored.select(key, at.alias("_at"), F.struct(*values).alias("_known"))
    placed = snapshots.withColumn("_cur", F.struct(*values)).join(known, key, "left")
    placed = placed.withColumn("_late", F.col("_at").isNotNull() & (at <= F.col("_at")))
    before = {"_prev": "_cur", "_prev_late": "_late"}
    seen = neighbours(placed, [key], [F.col(o) for o in order], before=before, hot=hot, is_hot=is_hot)
    last = F.when(F.coalesce("_prev_late", F.lit(True)), F.col("_known")).otherwise(F.col("_prev"))
    changed = ~F.col("_late") & ~F.col("_cur").eqNullSafe(last)
    return seen.select(*snapshots.columns, "_late", changed.alias("_changed"))


def sample_observations(observations: DataFrame) -> DataFrame:
    """Lineage rows: comment x raw page x position."""
    return observations.select(
        md5_uuid(F.col("source_comment_id")).alias("comment_key"),
        "raw_response_id",
        F.col("item_position").alias("source_item_position"),
        "sample_type",
        "observed_at",
    )


def resolution_state(attempts: DataFrame, with_attempt: bool = False) -> DataFrame:
    """Current state per video from the attempt log; retries add up, success clears the error."""
    last = F.max(F.struct("attempted_at", "attempt_id", "status", "error_code"))
    return (
        attempts.groupBy("source_id")
        .agg(
            last.alias("_l"),
            F.sum("retry_count").cast("bigint").alias("retry_count"),
            F.min("attempted_at").alias("first_discovered_at"),
            F.max(F.when(F.col("status").isin("RESOLVED", "UNAVAILABLE"), F.col("attempted_at"))).alias("resolved_at"),
        )
        .select(
            "source_id",
            F.col("_l.status").alias("resolution_status"),
            "first_discovered_at",
            "resolved_at",
            F.col("_l.attempted_at").alias("updated_at"),
            F.when(F.col("_l.status") != "RESOLVED", F.col("_l.error_code")).alias("last_error_code"),
            "retry_count",
            *([F.col("_l.attempt_id").alias("last_attempt_id")] if with_attempt else []),
        )
    )


def fold_resolution(stored: DataFrame, new: DataFrame) -> DataFrame:
    """`resolution_state` of all attempts, from the state of the earlier ones and that of the new ones.

    Both have `last_attempt_id` beside the state's columns; attempts come in any order.
    """
    last = ["updated_at", "last_attempt_id", "resolution_status", "last_error_code"]

    def side(df: DataFrame, prefix: str) -> DataFrame:
        rest = ("first_discovered_at", "resolved_at", "retry_count")
        return df.select("source_id", F.struct(*last).alias(f"_{prefix}l"), *[F.col(c).alias(f"_{prefix}{c}") for c in rest])

    both = side(stored, "s").join(side(new, "n"), "source_id", "full_outer")
    return both.withColumn("_l", F.greatest("_sl", "_nl")).select(
        "source_id",
        "_l.*",
        F.least("_sfirst_discovered_at", "_nfirst_discovered_at").alias("first_discovered_at"),
        F.greatest("_sresolved_at", "_nresolved_at").alias("resolved_at"),
        (F.coalesce("_sretry_count", F.lit(0)) + F.coalesce("_nretry_count", F.lit(0))).alias("retry_count"),
    )


UNIT_KEYS = ("frame_version_key", "channel_key", "window_key", "discovery_policy_version", "query_hash")


def unit_state(attempts: DataFrame, with_attempt: bool = False) -> DataFrame:
    """Current state per discovery unit; started at the first attempt, errors cleared when completed."""
    last = F.max(F.struct("updated_at", "attempt_id", "status", "error_code", "pages_completed"))
    return (
        attempts.groupBy(*UNIT_KEYS)
        .agg(last.alias("_l"), F.min("started_at").alias("started_at"))
        .select(
            *UNIT_KEYS,
            F.col("_l.status").alias("status"),
            F.col("_l.pages_completed").alias("pages_completed"),
            "started_at",
            F.col("_l.updated_at").alias("updated_at"),
            F.when(F.col("_l.status") == "COMPLETED", F.col("_l.updated_at")).alias("completed_at"),
            F.when(F.col("_l.status") != "COMPLETED", F.col("_l.error_code")).alias("last_error_code"),
            *([F.col("_l.attempt_id").alias("last_attempt_id")] if with_attempt else []),
        )
    )


def fold_units(stored: DataFrame, new: DataFrame) -> DataFrame:
    """`unit_state` of all attempts, from the state of the earlier ones and that of the new ones; see `fold_resolution`."""
    last = ["updated_at", "last_attempt_id", "status", "pages_completed", "completed_at", "last_error_code"]
    left = stored.select(*UNIT_KEYS, F.struct(*last).alias("_sl"), F.col("started_at").alias("_s"))
    right = new.select(*UNIT_KEYS, F.struct(*last).alias("_nl"), F.col("started_at").alias("_n"))
    both = left.join(right, list(UNIT_KEYS), "full_outer").withColumn("_l", F.greatest("_sl", "_nl"))
    return both.select(*UNIT_KEYS, "_l.*", F.least("_s", "_n").alias("started_at"))
