"""One request model for all sources: validated before planning, then one predicate over the decisions."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, functions as F


@dataclass(frozen=True)
class Request:
    """What a search may ask of a decision; None asks nothing. Dates are closed ranges, texts match anywhere in any case."""

    court: str | None = None
    courts: tuple[str, ...] | None = None
    sources: tuple[str, ...] | None = None
    decision_type: str | None = None
    since: str | None = None
    until: str | None = None
    case_number: str | None = None
    limit: int = 20

    def __post_init__(self) -> None:
        for name in ("since", "until"):
            if (value := getattr(self, name)) is not None:
                dt.date.fromisoformat(value)  # a real day of the calendar, or ValueError
        if self.since and self.until and self.since > self.until:
            raise ValueError("the range ends before it begins")
        if not 1 <= self.limit <= 50:
            raise ValueError("limit must lie between 1 and 50")

    def predicate(self) -> Column:
        """Only what is asked becomes part of the plan, so it reaches the scan."""
        out = F.lit(True)
        if self.court is not None:
            out = out & F.contains(F.lower("court"), F.lit(self.court.lower()))
        if self.courts is not None:
            out = out & F.col("court_code").isin(*self.courts)
        if self.sources is not None:
            out = out & F.col("source").isin(*self.sources)
        if self.decision_type is not None:
            out = out & (F.col("decision_type") == self.decision_type)
        if self.since is not None:
            out = out & (F.col("decided_on") >= F.lit(self.since).cast("date"))
        if self.until is not None:
            out = out & (F.col("decided_on") <= F.lit(self.until).cast("date"))
        if self.case_number is not None:
            out = out & F.array_contains("case_numbers", self.case_number)
        return out


def upstream_pages(page: int, size: int, upstream: int) -> tuple[list[int], int]:
    """The upstream pages, from 1, that hold a page of our own size, and how many rows to skip in the first of them."""
    if page < 1 or size < 1 or upstream < 1:
        raise ValueError("pages and sizes count from 1")
    first, last = (page - 1) * size, page * size - 1
    return list(range(first // upstream + 1, last // upstream + 2)), first % upstream
