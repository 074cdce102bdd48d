"""Typed errors, each with the status that an HTTP shell would give it."""

from __future__ import annotations


class EngineError(Exception):
    """Base of all errors."""

    status = 500


class BadRequest(EngineError):
    """A parameter is out of its range."""

    status = 400


class NotFound(EngineError):
    """The asset is not active or has no book."""

    status = 404


class NotReady(EngineError):
    """The asset is active, but no snapshot has come yet."""

    status = 503


class NoSnapshot(NotFound):
    """Nothing to rebuild a book from in the window."""

    def __init__(self, asset_id: str, at_us: int):
        super().__init__(f"no snapshot or checkpoint of {asset_id} at or before {at_us} us; the lookback may be too short")


class RateLimited(EngineError):
    """The venue asks to slow down."""

    status = 429
