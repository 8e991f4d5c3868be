"""Every default of the matching in one place, checked when it is made."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Policy:
    per_paper: int = 5
    surplus: int = 1
    light_cap: int = 7
    full_cap: int = 15
    reserve_cap: int = 4
    min_seniors: int = 1
    max_juniors: int = 1
    max_out_of_area: int = 3
    country_cap: int = 2
    country_majority: float = 0.5
    country_min_resolved: float = 0.5
    almost_senior_window: int = 10
    almost_junior_pubs: int = 15
    almost_out_of_area_career: int = 5
    seniority_window: int = 15
    senior_rate: float = 0.8
    junior_pubs: int = 20
    out_of_area_career: int = 5
    service_senior: float = 6.0
    service_typical: float = 2.0
    coauthor_years: int = 5
    min_name_tokens: int = 2
    token_ratio: float = 0.85
    token_length: int = 6
    title_min: int = 10
    title_fallback: int = 10
    publication_years: int = 4
    score_seed: int = 2027

    def __post_init__(self) -> None:
        for name in ("per_paper", "surplus", "light_cap", "full_cap", "reserve_cap", "min_seniors", "max_juniors", "max_out_of_area", "country_cap"):
            if getattr(self, name) < 0:
                raise ValueError(f"{name} is negative")
        for name in ("seniority_window", "coauthor_years", "publication_years", "senior_rate"):
            if getattr(self, name) <= 0:
                raise ValueError(f"{name} is not positive")
        if not 0 < self.country_majority <= 1:
            raise ValueError("country_majority is not in (0, 1]")
        if not 0 <= self.country_min_resolved <= 1:
            raise ValueError("country_min_resolved is not in [0, 1]")
