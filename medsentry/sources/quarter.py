"""Quarters, whose labels sort as the quarters do."""

from __future__ import annotations

import re
from dataclasses import dataclass

from ..errors import IngestError


@dataclass(frozen=True, order=True)
class Quarter:
    year: int
    number: int

    def __post_init__(self):
        if not 2004 <= self.year <= 2100 or not 1 <= self.number <= 4:
            raise IngestError(f"no such quarter: {self.year}Q{self.number}")

    @classmethod
    def parse(cls, label: str) -> Quarter:
        m = re.fullmatch(r"(\d{4})[qQ](\d)", label.strip())
        if not m:
            raise IngestError(f"a quarter is written like 2013Q1, not {label!r}")
        return cls(int(m[1]), int(m[2]))

    @property
    def label(self) -> str:
        return f"{self.year}Q{self.number}"

    @property
    def suffix(self) -> str:
        """The form in file names: 13Q1."""
        return f"{self.year % 100:02d}Q{self.number}"

    @property
    def _ordinal(self) -> int:
        return self.year * 4 + self.number - 1

    @classmethod
    def _of(cls, ordinal: int) -> Quarter:
        return cls(ordinal // 4, ordinal % 4 + 1)

    def next(self) -> Quarter:
        return self._of(self._ordinal + 1)

    def previous(self) -> Quarter:
        return self._of(self._ordinal - 1)

    def until(self, last: Quarter) -> list[Quarter]:
        """This quarter to ``last``, both included."""
        if last < self:
            raise IngestError(f"{last.label} comes before {self.label}")
        return [self._of(i) for i in range(self._ordinal, last._ordinal + 1)]

    def __str__(self) -> str:
        return self.label
