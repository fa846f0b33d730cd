"""Failures that the engine declares; anything else is a defect."""


class MalformedData(ValueError):
    """Bytes that aren't what their format asks for."""


class Unsupported(ValueError):
    """Valid data that needs something the engine lacks, or a password that wasn't given."""


class LimitExceeded(ValueError):
    """A resource limit: its kind, the maximum, what was asked for, and the entry concerned."""

    def __init__(self, kind: str, maximum: int, actual: int, path: str | None = None):
        super().__init__(f"{kind} is limited to {maximum}, needed {actual}" + (f" for {path}" if path else ""))
        self.kind, self.maximum, self.actual, self.path = kind, maximum, actual, path

    def __reduce__(self):
        return type(self), (self.kind, self.maximum, self.actual, self.path)
