"""Named arrays in order of first insertion."""

from __future__ import annotations

from labelgrid.array import LabeledArray
from labelgrid.plans.meta import clean
from labelgrid.status import ENOTFOUND, SUCCESS, Status, report


class Dataset:
    """Variables need not share dimensions; ``attrs`` is a plain dict."""

    def __init__(self):
        self.attrs: dict[str, str] = {}
        self._arrays: dict[str, LabeledArray] = {}

    def set(self, name: str, array: LabeledArray) -> None:
        """Upsert; the stored array takes the key as its name."""
        self._arrays[clean(name)] = array.renamed(name)

    def get(self, name: str, stat: Status | None = None) -> LabeledArray:
        found = self._arrays.get(clean(name))
        report(stat, ENOTFOUND if found is None else SUCCESS)
        return LabeledArray.invalid() if found is None else found

    def has(self, name: str) -> bool:
        return clean(name) in self._arrays

    def size(self) -> int:
        return len(self._arrays)

    def names(self) -> list[str]:
        return list(self._arrays)
