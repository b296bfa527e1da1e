"""Settings of the corpus build and of training rows, checked when they are made."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame

from ..functions.encode import MAX_LABELS
from ..operators.entities import Tagger
from ..operators.windows import LEFT, MID, RIGHT
from .corpus import build_chunks, training_rows


def _of(cls, values: dict):
    unknown = set(values) - {f.name for f in fields(cls)}
    if unknown:
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    return cls(**values)


@dataclass(frozen=True)
class CorpusConfig:
    """Window lengths in milliseconds, and how windows and tails are taken."""

    left: int = LEFT
    mid: int = MID
    right: int = RIGHT
    strict: bool = False
    keep_tail: bool = False

    def __post_init__(self) -> None:
        if self.mid <= 0 or self.left < 0 or self.right < 0:
            raise ValueError("a window has a positive length and contexts that are not negative")

    @classmethod
    def of(cls, values: dict) -> CorpusConfig:
        return _of(cls, values)

    def build(self, parsed: DataFrame, tagger: Tagger | None = None) -> DataFrame:
        return build_chunks(parsed, left=self.left, mid=self.mid, right=self.right, strict=self.strict, keep_tail=self.keep_tail, tagger=tagger)


@dataclass(frozen=True)
class TrainingConfig:
    """Rows for a trainer: layout, label length, padding to a multiple, and the rate schedule."""

    windowed: bool = True
    max_labels: int = MAX_LABELS
    pad_to: int = 1
    peak_rate: float = 1e-4
    warmup_steps: int = 1250
    smoothing: float = 0.0

    def __post_init__(self) -> None:
        if self.max_labels < 1 or self.pad_to < 1 or not 0 <= self.smoothing < 1:
            raise ValueError("label length and padding are positive, smoothing is a share")

    @classmethod
    def of(cls, values: dict) -> TrainingConfig:
        return _of(cls, values)

    def rows(self, chunks: DataFrame) -> DataFrame:
        return training_rows(chunks, windowed=self.windowed, most=self.max_labels)

    def padded(self, length: int) -> int:
        """The least multiple of ``pad_to`` that holds so many labels."""
        return -(-length // self.pad_to) * self.pad_to
