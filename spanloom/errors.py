"""Errors of the library."""


class SpanloomError(Exception):
    pass


class SourceError(SpanloomError):
    pass


class BudgetExceeded(SpanloomError):
    pass
