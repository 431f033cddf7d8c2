"""Settings of the assignment checks, with their defaults."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class EngineConfig:
    num_turn: int = 10  # items of one batch
    profile_sample: int = 100  # papers sampled from a profile for the model
    distill_sample: int = 20  # the same for label distillation
    clean_sample: int = 40  # the same for profile cleaning
    clean_batch: int = 10  # papers that are judged at once there
    label_threshold: float = 0.9
    author_sim: float = 1.0
    upsample: bool = True
    psi: float = 1.0
    alpha: float = 0.5
    batching: str = "random"  # or "confidence"
    seed: str = "42"
    min_profile: int = 5
    attempts: int = 3
