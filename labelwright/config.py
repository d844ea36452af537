"""Parameters of the verification operators; values are inlined into plans as literals."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    match_threshold: int = 95
    review_threshold: int = 80
    near_miss_edits: int = 2
    legible_confidence: float = 80.0
    abv_tolerance: float = 0.0
    max_rows: int = 300
    max_photos: int = 3
    max_file_bytes: int = 10 << 20
    min_pixels: int = 250_000
    max_pictures: int = 8
    max_reads: int = 16
    size_tolerance: float = 0.25
    gap_lines: float = 2.5
    stand_out: float = 0.70
    column_gap_share: float = 0.025
    column_gap_type: float = 1.25
    confidence_tie: float = 1.0
    strict_text: bool = False


DEFAULT = Settings()
