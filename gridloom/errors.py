"""Errors raised while planning; all are ValueErrors."""


class GridError(ValueError):
    """What all errors of the engine derive from."""


class EmptyInput(GridError):
    pass


class InvalidGeometry(GridError):
    pass


class InvalidArgument(GridError):
    pass


class IoFailure(GridError):
    pass


class ParseFailure(GridError):
    pass


class NotFound(GridError):
    pass
