"""Errors of requests: what a caller did wrong, what isn't there, and how each is reported."""

from __future__ import annotations


class RequestError(Exception):
    """An error with a status, a code and, where it helps, details; reported to whoever asked."""

    status, code = 400, "bad_request"

    def __init__(self, message: str, details: dict | None = None):
        super().__init__(message)
        self.details = details


class InvalidRequest(RequestError, ValueError):
    """Arguments that break a rule."""

    code = "validation_error"


class NotFound(RequestError, LookupError):
    """What isn't there, or belongs to somebody else."""

    status, code = 404, "not_found"


class Conflict(RequestError):
    """What can't be done as things are."""

    status, code = 409, "conflict"


def envelope(error: Exception) -> tuple[int, dict]:
    """(status, body) of an error: its own code, message and details; others are internal and say nothing of their cause."""
    if isinstance(error, RequestError):
        body = {"code": error.code, "message": str(error)}
        return error.status, {"error": body if error.details is None else body | {"details": error.details}}
    return 500, {"error": {"code": "internal_error", "message": "Something went wrong"}}
