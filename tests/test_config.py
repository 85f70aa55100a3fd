"""Configuration files: only approved parameters count, open ones fail closed."""

import datetime as dt

import pytest

from eventlens import config
from eventlens.errors import UnapprovedParameterError
from eventlens.sources import reference_data

yaml = pytest.importorskip("yaml")


def write(tmp_path, data):
    path = tmp_path / "config.yml"
    path.write_text(yaml.safe_dump(data))
    return str(path)


def test_events_and_aliases(tmp_path):
    windows = [{"window_type": "EVENT", "relative_offset_start_hours": -1, "relative_offset_end_hours": 6}]
    path = write(tmp_path, {"events": [{"external_event_id": "E", "event_name": "n", "occurred_at": "2022-12-18T18:00:00+03:00", "event_terms": ["final"], "windows": windows}]})
    (event,) = config.events_from_yaml(path)
    assert event.occurred_at == dt.datetime(2022, 12, 18, 15) and event.windows == (config.Window("EVENT", -1, 6),)
    path = write(tmp_path, {"targets": [{"entity_name": "A", "aliases": [{"text": "x"}, {"text": "y"}]}]})
    assert config.entities_from_yaml(path)[0].aliases == ("x", "y")


def test_unapproved_parameters_stay_open(tmp_path):
    data = {
        "combined_focus_threshold": 0.4,
        "combined_focus_threshold_status": "HUMAN_APPROVAL_REQUIRED",
        "club_dominance_winning_margin": 0.1,
        "club_dominance_winning_margin_status": "APPROVED",
        "frozen_parameters": {"player_focus_ratio_threshold": 5.0},
    }
    rules = config.rules_from_yaml(write(tmp_path, data))
    assert rules.combined_focus_threshold is None
    assert (rules.club_winning_margin, rules.focus_ratio_threshold, rules.prevalence_floor) == (0.1, 5.0, 0.15)


def test_unapproved_registries_stay_open(tmp_path):
    def version(**status):
        return config.rules_from_yaml(write(tmp_path, {"broadcaster_registry_version": "v1", **status})).broadcaster_registry_version

    assert version() is None
    assert version(broadcaster_registry_status="HUMAN_APPROVAL_REQUIRED") is None
    assert version(broadcaster_registry_status="APPROVED") == "v1"


def test_policy_needs_value_status_and_grain(tmp_path):
    path = write(tmp_path, {"k_capacity": 5, "k_capacity_status": "UNAPPROVED_PENDING_STRATA_INSPECTION"})
    with pytest.raises(UnapprovedParameterError):
        config.policy_from_yaml(path, "sp", "stratum").approved_k()
    path = write(tmp_path, {"k_capacity": 5, "k_capacity_status": "APPROVED"})
    assert config.policy_from_yaml(path, "sp", "channel").approved_k() == 5


def test_frame_load_is_repeatable(spark, tmp_path):
    path = write(tmp_path, {"frame_name": "F", "frame_purpose": "PIPELINE_PILOT", "channels": [{"channel_id": "c1", "channel_name": "One"}, {"channel_id": "c2", "channel_name": "Two"}]})
    frame = config.frame_from_yaml(path)

    def load():
        tables = reference_data.frame_tables(reference_data.channel_rows(spark, frame), frame, "VIDEO", dt.datetime(2024, 1, 1))
        return {n: sorted(map(tuple, t.collect())) for n, t in tables.items()}

    assert load() == load()
    assert [len(rows) for rows in load().values()] == [2, 2, 2]
    with pytest.raises(UnapprovedParameterError):
        config.Frame("R", "RESEARCH", "1.2", "{}")
