"""Errors that the API raises."""


class VectorloomError(Exception):
    """Base of all errors of this package."""


class InvalidDimension(VectorloomError):
    def __init__(self, expected: int, actual: int):
        super().__init__(f"expected {expected} dimensions, got {actual}")
        self.expected, self.actual = expected, actual


class CollectionNotFound(VectorloomError):
    pass


class CollectionAlreadyExists(VectorloomError):
    pass


class ConfigurationError(VectorloomError):
    pass


class InvalidInput(VectorloomError):
    pass


class NotFound(VectorloomError):
    pass


class Corruption(VectorloomError):
    pass


class AccessDenied(VectorloomError):
    pass
