"""Status codes and the two mutable holders of the public interface.

No operation raises for a bad argument: it returns an invalid array (or leaves
its destination alone) and puts a code into the ``Status`` it was given.
``Status(strict=True)`` turns any code but SUCCESS into an exception.
"""

from __future__ import annotations

# The codes callers test for.
SUCCESS = 0
EINVAL = 1
ENOTFOUND = 2
ESHAPE = 3


class LabelGridError(ValueError):
    """Raised by a strict Status."""

    def __init__(self, code: int, message: str = ""):
        super().__init__(f"status {code}: {message}" if message else f"status {code}")
        self.code = code


class Status:
    """Receives the code of the last operation it was handed to."""

    def __init__(self, strict: bool = False):
        self.code = SUCCESS
        self.message = ""
        self.strict = strict

    def __eq__(self, other):
        return self.code == (other.code if isinstance(other, Status) else other)

    __hash__ = None

    def __repr__(self):
        return f"Status({self.code}, {self.message!r})"


def report(stat: Status | None, code: int, message: str = "") -> int:
    """Put ``code`` into ``stat`` if there is one; return it."""
    if stat is not None:
        stat.code, stat.message = code, message
        if stat.strict and code != SUCCESS:
            raise LabelGridError(code, message)
    return code


class Slot:
    """A reusable destination for ``mean_into`` and ``add_into``."""

    def __init__(self, array=None):
        from labelgrid.array import LabeledArray

        self.array = array if array is not None else LabeledArray.invalid()
