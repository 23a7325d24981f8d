"""What can go wrong, as a status code each; callers may also catch the built-in base."""

from __future__ import annotations


class EngineError(RuntimeError):
    """Base of all; code names the status, stage the operation that met it."""

    code = "error"

    def __init__(self, message: str = "", stage: str = "none", detail: str = "none") -> None:
        super().__init__(message)
        self.stage, self.detail = stage, detail


class InvalidArgument(EngineError, ValueError):
    code = "invalid_argument"


class NotSupported(EngineError, NotImplementedError):
    code = "not_supported"


class Conflict(EngineError):
    code = "conflict"


class NotFound(EngineError, KeyError):
    code = "not_found"


class ResourceExhausted(EngineError):
    code = "resource_exhausted"


class DeadlineExceeded(EngineError):
    code = "deadline_exceeded"


class Cancelled(EngineError):
    code = "cancelled"


class IoError(EngineError):
    code = "io_error"


class Corruption(EngineError):
    code = "corruption"


class Closed(EngineError):
    code = "closed"


class Internal(EngineError):
    code = "internal"
