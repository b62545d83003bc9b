"""Error classes of the engine."""


class KvError(Exception):
    """Any error of the engine."""


class PatternError(KvError, ValueError):
    """A key pattern that cannot be used."""


class StoreError(KvError):
    """A store that cannot be opened, read or written."""


class ConflictError(StoreError):
    """Another writer changed the store in between."""


class TypeConversionError(KvError, ValueError):
    """Text that is no value of a column's type."""


class ConfigError(KvError, ValueError):
    """Options or declarations that do not fit."""

    def __init__(self, message: str, hint: str = "") -> None:
        super().__init__(message)
        self.hint = hint


class InvalidOptionName(ConfigError):
    """An option that is not known, or not allowed here."""


class InvalidOptionValue(ConfigError):
    """A value that an option cannot take."""


class MissingOption(ConfigError):
    """A required option that is not given."""
