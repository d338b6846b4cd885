"""Errors a caller can tell apart; per-row failures are columns, not exceptions."""


class CadenzaError(Exception):
    """Base of all errors of this package."""


class AudioError(CadenzaError):
    """Files could not be found or handled."""


class MetadataError(CadenzaError):
    """Tags could not be read or written."""


class ServiceError(CadenzaError):
    """A lookup source failed."""
