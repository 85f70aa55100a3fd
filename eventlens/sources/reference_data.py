"""Configuration loaded as dimension rows with deterministic keys."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlens.config import Entity, Event, Frame
from eventlens.functions.keys import md5_uuid
from eventlens.functions.text import canonical_terms
from eventlens.operators.ordered import one_per_key
from eventlens.operators.windows import config_table

_TS = pa.timestamp("us")


def event_rows(spark: SparkSession, events: Sequence[Event]) -> DataFrame:
    """Incoming event states with canonical term lists."""
    base = config_table(
        spark,
        {
            "event_key": (pa.string(), [e.event_key for e in events]),
            "event_name": (pa.string(), [e.event_name for e in events]),
            "occurred_at": (_TS, [e.occurred_at for e in events]),
            "inclusion_rationale": (pa.string(), [e.inclusion_rationale for e in events]),
            "event_terms": (pa.list_(pa.string()), [list(e.event_terms) for e in events]),
            "baseline_terms": (pa.list_(pa.string()), [list(e.baseline_terms) for e in events]),
        },
    )
    return base.withColumn("event_terms", canonical_terms(F.col("event_terms"))).withColumn(
        "baseline_terms", canonical_terms(F.col("baseline_terms"))
    )


def alias_rows(spark: SparkSession, entities: Sequence[Entity]) -> DataFrame:
    """One row per entity and alias, all active."""
    pairs = [(e, a) for e in entities for a in e.aliases]
    return config_table(
        spark,
        {
            "target_entity_key": (pa.string(), [e.entity_key for e, _ in pairs]),
            "entity_name": (pa.string(), [e.entity_name for e, _ in pairs]),
            "alias_text": (pa.string(), [a for _, a in pairs]),
            "is_active": (pa.bool_(), [True for _ in pairs]),
        },
    ).withColumn("alias_key", md5_uuid(F.col("target_entity_key"), F.col("alias_text")))


def period_rows(spark: SparkSession, events: Sequence[Event], exclusion_buffer_hours: int) -> DataFrame:
    """End of the evidence period per event: the event instant minus the exclusion buffer."""
    base = config_table(
        spark,
        {
            "event_version_key": (pa.string(), [e.event_key for e in events]),
            "occurred_at": (_TS, [e.occurred_at for e in events]),
        },
    )
    return base.select(
        "event_version_key",
        (F.col("occurred_at") - F.make_dt_interval(F.lit(0), F.lit(exclusion_buffer_hours))).alias(
            "reference_period_end"
        ),
    )


def first_versions(rows: DataFrame, keys: Sequence[str], at: datetime) -> DataFrame:
    """Incoming states as the first version of each key."""
    return one_per_key(rows, keys).select(
        "*",
        F.lit(str(at)).cast("timestamp_ntz").alias("valid_from"),
        F.lit(None).cast("timestamp_ntz").alias("valid_to"),
        F.lit(True).alias("is_current"),
    )


def channel_rows(spark: SparkSession, frame: Frame) -> DataFrame:
    """The frame's configured channels."""
    names = ("source_id", "channel_name", "discovery_source", "discovery_source_version")
    return config_table(spark, {n: (pa.string(), [c[n] for c in frame.channels]) for n in names})


def frame_tables(channels: DataFrame, frame: Frame, source_system: str, evaluated_at: datetime) -> dict[str, DataFrame]:
    """Channel, frame membership and source observation rows of one frame version.

    All keys derive from natural keys, so loading the same configuration again gives the same
    rows and `insert_if_absent` adds nothing.
    """
    frame_key = md5_uuid(F.sha2(F.lit(frame.configuration), 256))
    at = F.lit(str(evaluated_at)).cast("timestamp_ntz")
    keyed = channels.select(
        md5_uuid(F.lit(source_system), F.col("source_id")).alias("channel_key"), frame_key.alias("frame_version_key"), "*"
    ).withColumn("frame_channel_key", md5_uuid(F.col("frame_version_key"), F.col("channel_key")))
    return {
        "channel": one_per_key(
            keyed.select("channel_key", F.lit(source_system).alias("source_system"), "source_id", "channel_name"),
            ["channel_key"],
        ),
        "frame_channel": keyed.select(
            "frame_channel_key",
            "frame_version_key",
            "channel_key",
            at.alias("evaluated_at"),
            F.lit(frame.methodology_version).alias("eligibility_rule_version"),
            F.lit("ELIGIBLE").alias("frame_inclusion_status"),
        ).distinct(),
        "source_observation": keyed.select(
            "frame_channel_key", "discovery_source", "discovery_source_version"
        ).distinct(),
    }
