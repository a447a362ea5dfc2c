"""Errors, their status and what is told of them."""

import pytest

from siltstone.errors import Conflict, InvalidRequest, NotFound, envelope
from siltstone.operators.reads import checked_paging


def test_envelopes():
    assert envelope(NotFound("no such page")) == (404, {"error": {"code": "not_found", "message": "no such page"}})
    assert envelope(Conflict("there already", {"site": "a"})) == (409, {"error": {"code": "conflict", "message": "there already", "details": {"site": "a"}}})
    assert envelope(RuntimeError("secret")) == (500, {"error": {"code": "internal_error", "message": "Something went wrong"}})
    assert isinstance(NotFound("x"), LookupError) and isinstance(InvalidRequest("x"), ValueError)


def test_paging_errors():
    with pytest.raises(ValueError, match="page starts at 1") as error:
        checked_paging(0, 20, None)
    assert envelope(error.value) == (400, {"error": {"code": "validation_error", "message": str(error.value), "details": {"page": 0, "page_size": 20}}})
    with pytest.raises(InvalidRequest, match="200 characters"):
        checked_paging(1, 20, "x" * 201)
    assert checked_paging(1, 100, "  tea ") == "tea" and checked_paging(1, 1, " ") is None
