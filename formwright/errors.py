"""What can go wrong, by where it does."""


class EngineError(Exception):
    """Any failure of this package that a user can act on."""


class SpecError(EngineError):
    """A dataset spec that cannot be."""


class SchemaError(EngineError):
    """A table or result whose columns do not fit."""


class RecordError(EngineError):
    """A record that strict mode does not take."""


class DriftError(EngineError):
    """A record outside the declared schema, under the policy ``error``."""


class SourceError(EngineError):
    """An input that cannot be read."""


class SinkError(EngineError):
    """An output that cannot be written."""
