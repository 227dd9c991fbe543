"""Errors of the engine."""


class EngineError(Exception):
    """Any error that this library raises on purpose."""


class InvalidArgument(EngineError, ValueError):
    """A parameter is out of range or malformed."""


class CollectionNotFound(EngineError, KeyError):
    """No vector collection has this name."""


class DimensionMismatch(EngineError, ValueError):
    """A vector's length is not the collection's."""

    def __init__(self, expected: int, got: int):
        super().__init__(f"expected {expected} dimensions, got {got}")
        self.expected, self.got = expected, got


class NodeNotFound(EngineError, KeyError):
    """No graph node has this id."""


class EdgeNotFound(EngineError, KeyError):
    """No edge has this (src, dst, relation)."""


class SchemaMigration(EngineError):
    """The stored schema version is not the library's."""


class Corruption(EngineError):
    """A stored table can't be read as written."""


class Serialization(EngineError, ValueError):
    """A value can't be written or parsed as JSON."""


class SqlError(EngineError):
    """A statement failed."""
