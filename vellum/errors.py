"""Errors of the engine."""


class EngineError(ValueError):
    """A filter, projection, pipeline or update that isn't valid."""


class DuplicateKeyError(EngineError):
    """A write would give two documents one key."""
