"""Errors. In tables an error is a row's `error` struct with the class name; single-file calls raise."""

from __future__ import annotations


class TabscoutError(Exception):
    """Root of all errors of this package."""


class FileSampleReadError(TabscoutError):
    """A source could not be read."""


class EmptySampleError(TabscoutError):
    """A source has no bytes."""


class BodyTooLargeError(TabscoutError):
    """A source is larger than its cap."""


class ModelInvocationError(TabscoutError):
    """A model could not be called or gave no text."""


class ModelTimeoutError(ModelInvocationError):
    """A call outlasted its share of the budget."""


class BackendConfigurationError(TabscoutError):
    """Settings do not allow a call at all; no other model is tried."""


class CredentialsNotConfiguredError(BackendConfigurationError):
    """A backend lacks its key or project."""


class ResponseParsingError(TabscoutError):
    """An answer is no JSON."""


class SchemaValidationError(TabscoutError):
    """An answer breaks a rule; `rules` names them."""

    def __init__(self, message: str, rules: list[str] | None = None) -> None:
        super().__init__(message)
        self.rules = rules or []


class InspectionFailedError(TabscoutError):
    """Every model failed; `attempts` has each model's error."""

    def __init__(self, message: str, attempts: dict[str, str] | None = None) -> None:
        super().__init__(message)
        self.attempts = attempts or {}


class InspectionTimeoutError(InspectionFailedError):
    """The whole budget was spent."""


class ReplayMissError(ModelInvocationError):
    """A recorded run has no further answer of the model."""


class RunFileError(TabscoutError):
    """A run file is not one, or incomplete; names the line."""


#: HTTP status of each error, the first that matches (subclasses come before their parents).
STATUS = (
    ("EmptySampleError", 422, "Empty source"),
    ("BodyTooLargeError", 413, "Source too large"),
    ("FileSampleReadError", 400, "Unreadable source"),
    ("InspectionTimeoutError", 504, "Inspection timed out"),
    ("CredentialsNotConfiguredError", 503, "Backend not configured"),
    ("BackendConfigurationError", 503, "Backend not configured"),
    ("InspectionFailedError", 502, "No model answered"),
    ("ModelTimeoutError", 504, "Model timed out"),
    ("ModelInvocationError", 502, "Model failed"),
    ("SchemaValidationError", 502, "Invalid answer"),
    ("ResponseParsingError", 502, "Invalid answer"),
)


def status_of(error: BaseException) -> tuple[int, str]:
    """Status and title of an error by the first class in STATUS that it is of; 500 otherwise."""
    names = {c.__name__ for c in type(error).__mro__}
    return next(((code, title) for name, code, title in STATUS if name in names), (500, "Internal error"))
