"""Exceptions, raised while a plan is built, and the mark of deprecated functions."""

import functools
import warnings


class DateError(Exception):
    pass


class InsufficientDateError(DateError):
    pass


class FrequencyDateError(DateError):
    pass


class ArithmeticDateError(DateError):
    pass


class DateCalcError(Exception):
    pass


class DateCalcRangeError(DateCalcError):
    pass


class TimeSeriesError(Exception):
    pass


class TimeSeriesCompatibilityError(TimeSeriesError):
    def __init__(self, mode: str, first, second):
        super().__init__(f"incompatible series ({mode}): {first} and {second}")
        self.mode = mode


def deprecated_for(instead: str):
    """A function that still works, and says what to use in its place."""

    def mark(f):
        @functools.wraps(f)
        def call(*args, **kwargs):
            warnings.warn(f"{f.__name__} is deprecated, use {instead}", DeprecationWarning, stacklevel=2)
            return f(*args, **kwargs)

        call.__doc__ = f"Deprecated: use {instead}.\n\n{f.__doc__ or ''}"
        return call

    return mark
