"""Counts taken while rows pass, without a scan of their own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


class CountMismatch(RuntimeError):
    """Rows went missing, or came from nowhere, between two places."""


class Tally:
    """Counts of rows at named places of running plans; known once a plan has run."""

    def __init__(self) -> None:
        self._seen: dict[str, Observation] = {}

    def at(self, df: DataFrame, place: str, **parts: Column) -> DataFrame:
        """``df``; counts its rows at ``place``, and those for which each of ``parts`` holds."""
        self._seen[place] = Observation()
        return df.observe(self._seen[place], F.count("*").alias("n"), *[F.count_if(c).alias(name) for name, c in parts.items()])

    def get(self, place: str) -> dict[str, int]:
        return dict(self._seen[place].get)

    def all(self) -> dict[str, dict[str, int]]:
        return {place: self.get(place) for place in self._seen}


def reconcile(what: str, came: int, went: dict[str, int]) -> None:
    """Fail unless all rows that came are among those that went on or were dropped for a reason."""
    if came != sum(went.values()):
        raise CountMismatch(f"{what}: {came} rows came, {sum(went.values())} are accounted for: {went}")
