"""eventlens: event-window discourse analytics on Spark DataFrames."""

from eventlens.errors import (
    DeduplicationRuleMissingError,
    GateError,
    SnapshotMutationError,
    UnapprovedParameterError,
)
from eventlens.session import build_session

__all__ = [
    "DeduplicationRuleMissingError",
    "GateError",
    "SnapshotMutationError",
    "UnapprovedParameterError",
    "build_session",
]
