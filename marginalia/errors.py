"""Errors of this library."""


class MarginaliaError(Exception):
    """Any of them."""


class ConfigError(MarginaliaError):
    """A setting that cannot be used."""


class SearchError(MarginaliaError):
    """A search that cannot be answered."""


class SourceError(MarginaliaError):
    """Input that cannot be read."""


class RunFailed(MarginaliaError):
    """A run that failed after all its attempts."""
