"""Settings of a linkage run; every field can be set from the environment as LINK_<NAME>."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class LinkConfig:
    data: str = "dataset"
    work: str = "work"
    out: str = "output"
    k_word: int = 24
    k_char: int = 12
    thr_word: float = 0.05
    thr_char: float = 0.2
    max_df: float = 0.002
    min_df_cap: int = 50
    stage1_folds: int = 6
    """Width of each stage-1 fold range, in percent of the id hash space."""
    stage2_folds: int = 6
    stage3_folds: int = 5
    valid_folds: int = 3
    """Validation folds are [50 - valid_folds, 50)."""
    early_stop_from: int = 48
    query_pct: int = 50
    orphan_pct: int = 16
    never_matched_pct: int = 100
    pseudo_p: float = 0.98
    selftrain_countries: str = ""
    shift_reference: str = ""
    """Country whose rates stand in for countries without labels; empty: the first one, by name."""
    seed: int = 7

    @classmethod
    def from_env(cls, **over) -> LinkConfig:
        found = {}
        for f in fields(cls):
            raw = os.environ.get(f"LINK_{f.name.upper()}")
            if raw is not None:
                found[f.name] = type(f.default)(raw)
        return cls(**{**found, **over})
