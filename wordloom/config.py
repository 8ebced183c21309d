"""Options of the pipeline's steps, with the defaults of the original command-line tools."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class VocabOptions:
    max_vocab: int = 0  # 0: no limit
    min_count: int = 1


@dataclass(frozen=True)
class CooccurOptions:
    window_size: int = 15
    symmetric: bool = True
    distance_weighting: bool = True

    def __post_init__(self):
        if self.window_size < 1:
            raise ValueError("window_size must be at least 1")


@dataclass(frozen=True)
class TrainOptions:
    vector_size: int = 50
    iterations: int = 25
    eta: float = 0.05
    alpha: float = 0.75
    x_max: float = 100.0
    grad_clip: float = 100.0
    seed: int = 0
    checkpoint_every: int = 0
    blocks: int = 0  # stratified mode: least number of parts of the words, and of the contexts; more by the number of records
    batch: int = 256  # stratified mode: records of one update
    mode: str = "stratified"  # or exact, fullbatch

    def __post_init__(self):
        if self.mode not in ("stratified", "exact", "fullbatch"):
            raise ValueError(f"unknown mode {self.mode}")
        if self.vector_size < 1 or self.batch < 1:
            raise ValueError("vector_size and batch must be at least 1")


@dataclass(frozen=True)
class SaveOptions:
    model: int = 2  # 0: word and context with biases, 1: word, 2: sum, 3: word and context without biases
    binary: int = 0  # 0: text, 1: binary, 2: both
    header: bool = False
    gradsq: bool = False  # accumulators too
    initial: bool = False  # the parameters before the first iteration too, in binary form

    def __post_init__(self):
        if self.model not in (0, 1, 2, 3) or self.binary not in (0, 1, 2):
            raise ValueError("model must be 0 to 3, and binary 0, 1 or 2")
