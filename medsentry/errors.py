"""Errors that name what is wrong; nothing falls back to a silent default."""


class EngineError(Exception):
    """Base of the engine's errors."""


class IngestError(EngineError):
    """A source file or folder can't be used."""


class SchemaMismatchError(IngestError):
    """A file's header isn't the declared one."""


class NormalizationError(EngineError):
    """A drug-string table or override is missing or malformed."""


class EstimatorConvergenceError(EngineError):
    """A fit or a percentile search didn't converge, or ended on a bound."""


class ContingencyError(EngineError):
    """The contingency table can't be built as asked."""


class ReferenceSetError(EngineError):
    """A reference standard is malformed or incomplete."""
