"""Errors and warnings; every infeasible request raises, nothing falls back silently."""

from __future__ import annotations


class SunderError(Exception):
    """Root of the library's errors; ``details`` is machine-readable."""

    def __init__(self, message: str, **details):
        super().__init__(message)
        self.details = details


class ParameterError(SunderError, ValueError):
    """A parameter is wrong, whatever the data."""


class ConfigurationError(ParameterError):
    """Parameters contradict each other."""


class UnknownOperatorError(ParameterError, KeyError):
    """No operator of that name."""


class InputError(SunderError, ValueError):
    """The data do not fit the operator."""


class ColumnError(InputError):
    """A required column is missing."""


class LabelError(InputError):
    """Labels are missing or not finite."""


class DuplicateRecordError(InputError):
    """Records repeat where that is forbidden."""


class InfeasibleError(SunderError, RuntimeError):
    """No split satisfies the request."""


class DegenerateGroupingError(InfeasibleError):
    """One group holds nearly all records."""


class ConstraintError(InfeasibleError):
    """A constraint cannot be met."""


class EmptyPartitionError(InfeasibleError):
    """A partition would be empty."""


class ScalabilityError(SunderError, RuntimeError):
    """Too many records for a kernel that runs in one task."""


class MissingDependencyError(SunderError, ImportError):
    """An optional library is not installed."""


class SplitWarning(UserWarning):
    """Root of the warnings; ``details`` is machine-readable."""

    def __init__(self, message: str, **details):
        super().__init__(message)
        self.details = details


class SmallPartitionWarning(SplitWarning):
    """A partition has under 10 records or under 1 %."""


class SizeToleranceWarning(SplitWarning):
    """A size is far from the one asked for."""


class LargeGroupWarning(SplitWarning):
    """One group holds over 60 % of the records."""


class ConvergenceWarning(SplitWarning):
    """A search stopped at its limit, not at its end."""


class MissingSourceWarning(SplitWarning):
    """Some records have no provenance."""
