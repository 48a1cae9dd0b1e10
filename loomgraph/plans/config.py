"""Thresholds and year windows, in one place; every operator takes them as arguments."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields

PREFIX = "LOOMGRAPH_"


@dataclass(frozen=True)
class Config:
    first_year: int = 1975
    last_year: int = 2023
    before_year: int = 1975
    min_papers: int = 10_000
    min_references: int = 3
    pair_batches: int = 20
    top_fields: int = 12
    first_rows: int = 15

    @classmethod
    def read(cls, settings: Mapping[str, str] | None = None) -> Config:
        """Values from settings (the environment unless given), such as LOOMGRAPH_FIRST_YEAR=1980; others keep their defaults."""
        settings = os.environ if settings is None else settings
        given = {f.name: settings[PREFIX + f.name.upper()] for f in fields(cls) if PREFIX + f.name.upper() in settings}
        return cls(**{name: int(value) for name, value in given.items()})


#: For the derived test graph, whose years and counts are small.
FIXTURE = Config(last_year=2010, min_papers=5)
