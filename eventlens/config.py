"""Run configuration: events, windows, aliases, strata and approved parameters.

Values the methodology leaves open have no default. A rule that needs one calls
`approved()` and fails closed when the value is missing.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field
from datetime import datetime
from typing import Any

from eventlens.errors import UnapprovedParameterError

# Event-relative windows, offsets in hours from the event.
EVENT_WINDOWS = (
    ("PRE_EVENT", -336, -1),
    ("EVENT", -1, 6),
    ("EARLY_POST_EVENT", 6, 24),
    ("LATE_POST_EVENT", 24, 72),
    ("RECOVERY_WINDOW", 72, 336),
)

# The two axes of channel strata; focus labels name entity A and B.
CHANNEL_TYPES = (
    "BROAD_REACH_PUBLISHER",
    "CLUB_MEDIA",
    "ANALYSIS_PUBLISHER",
    "INDEPENDENT_CREATOR",
    "OTHER",
    "UNCLASSIFIED",
)
FOCUS_VALUES = (
    "A_FOCUSED",
    "B_FOCUSED",
    "MIXED_FOCUS",
    "NO_STRONG_DOMINANT_FOCUS",
    "UNCLASSIFIED",
)

# Sampling intervals around the event, in seconds.
BASELINE_START_SECONDS = -14 * 86400
OVERLAP_START_SECONDS = -24 * 3600
EVENT_START_SECONDS = -3600
EVENT_END_SECONDS = 72 * 3600

# Status vocabularies.
ABSTENTIONS = ("LOW_CONFIDENCE", "AMBIGUOUS", "MODEL_ERROR")
COMPLETE_SCANS = ("COMPLETE_TO_WATERMARK", "COMPLETE_AFTER_BACKFILL")
CAPPED_SCANS = ("CAPPED_BEFORE_WATERMARK", "INITIAL_LOAD_CAPPED")
CANDIDATE_STATUSES = ("SELECTED", "ELIGIBLE_UNSELECTED", "ELIGIBLE")


def approved(name: str, value: Any) -> Any:
    """The value, or an error naming the parameter that still needs approval."""
    if value is None:
        raise UnapprovedParameterError(f"parameter '{name}' is not approved")
    return value


@dataclass(frozen=True)
class Window:
    window_type: str
    start_hours: int
    end_hours: int


@dataclass(frozen=True)
class Event:
    event_key: str
    event_name: str
    occurred_at: datetime
    event_terms: tuple[str, ...] = ()
    baseline_terms: tuple[str, ...] = ()
    inclusion_rationale: str = ""
    windows: tuple[Window, ...] = tuple(Window(*w) for w in EVENT_WINDOWS)


@dataclass(frozen=True)
class Entity:
    entity_key: str
    entity_name: str
    aliases: tuple[str, ...]


@dataclass(frozen=True)
class StratificationRules:
    """Frozen thresholds have defaults; the rest stays unapproved until set."""

    smoothing_alpha: float = 1.0
    focus_ratio_threshold: float = 4.0
    prevalence_floor: float = 0.15
    club_dominance_threshold: float = 0.70
    club_high_confidence_share: float = 0.90
    min_videos: int = 10
    primary_days: int = 90
    fallback_days: int = 180
    subwindow_days: int = 30
    subwindow_min_videos: int = 3
    combined_focus_threshold: float | None = None
    club_winning_margin: float | None = None
    analysis_share_threshold: float | None = None
    broadcaster_registry_version: str | None = None
    broadcasters: tuple[str, ...] = ()
    analysis_registry_version: str | None = None
    analysis_publishers: tuple[str, ...] = ()
    analysis_keywords: tuple[str, ...] = ()
    clubs: tuple[tuple[str, tuple[str, ...]], ...] = ()
    third_party_channels: tuple[str, ...] = ()
    deduplication_rule_version: str | None = None
    deduplication_rule_status: str | None = None
    protocol_version: str = "1.1"

    def digest_text(self) -> str:
        return json.dumps(asdict(self), sort_keys=True, default=str)


@dataclass(frozen=True)
class SamplingPolicy:
    sampling_policy_version_key: str
    k_capacity: int | None = None
    k_capacity_status: str | None = None
    k_grain: str | None = None  # "stratum" or "channel"

    def approved_k(self) -> int:
        if self.k_capacity_status != "APPROVED":
            raise UnapprovedParameterError("parameter 'k_capacity' is not approved")
        return approved("k_capacity", self.k_capacity)

    def bucket_columns(self) -> list[str]:
        grain = approved("k_grain", self.k_grain)
        return {"stratum": ["stratum_name", "cohort_type"], "channel": ["channel_key", "stratum_name", "cohort_type"]}[
            grain
        ]


@dataclass(frozen=True)
class MinimumCohort:
    """Thresholds below which a result is INSUFFICIENT_SAMPLE; each use case sets its own."""

    comments_per_window: int | None = None
    target_opinions: int | None = None
    stable_authors: int | None = None
    represented_strata: int | None = None


@dataclass(frozen=True)
class Lineage:
    """Version columns every mart row carries."""

    sampling_policy_version: str
    model_bundle_version_key: str
    taxonomy_version_key: str
    threshold_config_version_key: str
    data_as_of_at: datetime
    extra: dict[str, str] = field(default_factory=dict)


def events_from_yaml(path: str) -> list[Event]:
    """Event catalogue file: a list under `events`, each with terms and windows."""
    return [
        Event(
            event_key=e["external_event_id"],
            event_name=e["event_name"],
            occurred_at=_naive_utc(e["occurred_at"]),
            event_terms=tuple(e.get("event_terms") or ()),
            baseline_terms=tuple(e.get("baseline_terms") or ()),
            inclusion_rationale=e.get("inclusion_rationale") or "",
            windows=tuple(
                Window(w["window_type"], w["relative_offset_start_hours"], w["relative_offset_end_hours"])
                for w in e.get("windows") or ()
            ),
        )
        for e in _yaml(path).get("events") or ()
    ]


def entities_from_yaml(path: str) -> list[Entity]:
    """Alias file: a list under `targets`, each with `entity_name` and `aliases`."""
    return [
        Entity(t["entity_name"], t["entity_name"], tuple(a["text"] for a in t.get("aliases") or ()))
        for t in _yaml(path).get("targets") or ()
    ]


def _naive_utc(value: str | datetime) -> datetime:
    from datetime import timezone

    moment = value if isinstance(value, datetime) else datetime.fromisoformat(value.strip().replace("Z", "+00:00"))
    return moment.astimezone(timezone.utc).replace(tzinfo=None) if moment.tzinfo else moment


@dataclass(frozen=True)
class Frame:
    """One version of a channel panel; its key follows from the configuration text."""

    frame_name: str
    frame_purpose: str
    methodology_version: str
    configuration: str
    code_version: str | None = None
    channels: tuple[dict[str, str], ...] = ()

    def __post_init__(self) -> None:
        if self.frame_purpose == "RESEARCH" and not self.code_version:
            raise UnapprovedParameterError("a RESEARCH frame needs the code version it was built with")


def _yaml(path: str) -> dict[str, Any]:
    import yaml  # optional dependency, only needed for configuration files

    with open(path, encoding="utf-8") as handle:
        return yaml.safe_load(handle) or {}


def frame_from_yaml(path: str, code_version: str | None = None) -> Frame:
    """Frame file: name, purpose and a list under `channels`."""
    data = _yaml(path)
    return Frame(
        data.get("frame_name", "Unknown Frame"),
        data.get("frame_purpose", "UNKNOWN"),
        data.get("methodology_version", "1.2"),
        json.dumps(data, sort_keys=True, default=str),
        code_version,
        tuple(
            {
                "source_id": c["channel_id"],
                "channel_name": c["channel_name"],
                "discovery_source": c.get("discovery_source", "manual_bootstrap"),
                "discovery_source_version": c.get("discovery_source_version", "pilot_v1"),
            }
            for c in data.get("channels") or ()
        ),
    )


def policy_from_yaml(path: str, sampling_policy_version_key: str, k_grain: str | None = None) -> SamplingPolicy:
    """Sampling policy file; the policy key and the grain of K are given explicitly."""
    data = _yaml(path)
    return SamplingPolicy(
        sampling_policy_version_key, data.get("k_capacity"), data.get("k_capacity_status"), k_grain
    )


def rules_from_yaml(path: str) -> StratificationRules:
    """Stratification file. A value without a status, or with any but an approved one, doesn't count.

    A registry's version is approved by the status of the registry.
    """
    data = _yaml(path)
    frozen = data.get("frozen_parameters") or {}

    def value(name: str, status: str | None = None) -> Any:
        return data.get(name) if data.get(status or f"{name}_status") == "APPROVED" else None

    defaults = StratificationRules()
    return StratificationRules(
        smoothing_alpha=frozen.get("smoothing_alpha", defaults.smoothing_alpha),
        focus_ratio_threshold=frozen.get("player_focus_ratio_threshold", defaults.focus_ratio_threshold),
        prevalence_floor=frozen.get("player_prevalence_floor", defaults.prevalence_floor),
        club_dominance_threshold=frozen.get("club_dominance_threshold", defaults.club_dominance_threshold),
        min_videos=frozen.get("min_videos_primary_90d", defaults.min_videos),
        subwindow_days=frozen.get("subwindow_duration_days", defaults.subwindow_days),
        combined_focus_threshold=value("combined_focus_threshold"),
        club_winning_margin=value("club_dominance_winning_margin"),
        analysis_share_threshold=value("analysis_topic_share_threshold"),
        broadcaster_registry_version=value("broadcaster_registry_version", "broadcaster_registry_status"),
        broadcasters=tuple(data.get("broadcasters_allowlist") or ()),
        analysis_registry_version=value("analysis_registry_version", "analysis_registry_status"),
        analysis_publishers=tuple(data.get("analysis_publishers_allowlist") or ()),
        analysis_keywords=tuple(data.get("analysis_keywords") or ()),
        clubs=tuple((club, tuple(names)) for club, names in (data.get("club_registry") or {}).items()),
        third_party_channels=tuple(data.get("third_party_categorisation_registry") or ()),
        deduplication_rule_version=data.get("deduplication_rule_version"),
        deduplication_rule_status=data.get("deduplication_rule_status"),
        protocol_version=str(data.get("classification_protocol_version", defaults.protocol_version)),
    )
