"""Errors that callers may want to tell apart."""


class LontarError(Exception):
    """Any failure of this library's own checks."""


class MissingDependency(LontarError):
    """An optional package isn't installed."""

    def __init__(self, package: str, extra: str):
        super().__init__(f"{package} is needed here; install the {extra} extra")


class BadInput(LontarError, ValueError):
    """A file or table doesn't hold what it should."""
