"""Errors raised while a plan is being built."""


class SeriesError(ValueError):
    """Base class for everything this package refuses."""


class SchemaError(SeriesError):
    """A column is missing or cannot play the role asked of it."""


class SourceError(SeriesError):
    """A source does not exist, is empty, or has an unsupported format."""
