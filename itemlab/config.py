"""Default parameters of the operators."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Defaults:
    # These must equal the published ones for results to agree.
    seed: int = 42
    splits: tuple[str, ...] = ("train", "val", "test")
    fractions: tuple[float, ...] = (0.70, 0.15, 0.15)
    majority_limit: int = 1000

    hash_side: int = 16
    near_max_bits: int = 25
    blank_std: float = 1.0
    extensions: tuple[str, ...] = (".bmp", ".gif", ".jpeg", ".jpg", ".png")
    min_side: int = 224
    crop_area: tuple[float, float] = (0.7, 1.0)
    crop_aspect: tuple[float, float] = (3 / 4, 4 / 3)

    precision_floor: float = 0.85
    target_recall: float = 0.95
    default_threshold: float = 0.5
    sweep_start: float = 0.05
    sweep_stop: float = 0.95
    sweep_step: float = 0.05

    small_dataset: int = 1000
    imbalance_ratio: float = 3.0
    leak_warn: float = 65.0
    leak_fail: float = 90.0
    block_min: int = 5
    block_purity: float = 0.95
    block_margin: float = 0.10
    block_fail_pct: float = 35.0
    small_item_warn: float = 0.10
    leak_cap: int = 2000
    leak_folds: int = 5
    leak_trees: int = 200

    attention_cut: float = 0.5
    attention_warn_pct: float = 50.0
    deletion_share: float = 0.25

    patience: int = 5
    agree_tolerance: float = 1e-3
    max_upload_bytes: int = 12 * 1024 * 1024

    # Physical tuning. None of these changes a result.
    hot_rows: int = 1_000_000
    rank_digits: int = 3


DEFAULTS = Defaults()
