"""Errors raised by fail-closed gates."""


class EventLensError(Exception):
    """Base class."""


class UnapprovedParameterError(EventLensError):
    """A rule needs a methodology parameter that nobody has approved."""


class DeduplicationRuleMissingError(EventLensError):
    """Cross-item deduplication is required but no approved rule is registered."""


class SnapshotMutationError(EventLensError):
    """A pinned snapshot would be changed."""


class GateError(EventLensError):
    """A precondition of a run does not hold; the message carries sample keys."""
