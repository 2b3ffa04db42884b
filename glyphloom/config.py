"""Settings of the typing engine: immutable, validated, JSON round trip.

Only settings that something reads are here.  Unknown keys in a file are
ignored and missing ones take their defaults.
"""

from __future__ import annotations

import json
import os
import warnings
from dataclasses import asdict, dataclass, field, fields, is_dataclass, replace
from pathlib import Path


@dataclass(frozen=True)
class DetectorConfig:
    window_size: int = 5
    confidence_threshold: float = 0.90
    hysteresis_zone: float = 0.10
    min_words_before_switch: int = 5


@dataclass(frozen=True)
class CorrectionConfig:
    max_edit_distance: int = 1
    max_candidates: int = 3
    min_word_length: int = 2
    case_sensitive: bool = False
    enforce_accents: bool = False


@dataclass(frozen=True)
class PipelineConfig:
    detect_language: bool = True
    auto_correct: bool = True
    #: fixed: the initial language corrects all; propagate_next: a detection applies from the next word on.
    language_mode: str = "fixed"
    max_token_chars: int = 64
    #: the remainder at the end of a text is corrected even if auto_correct is off
    strict_remainder: bool = False


@dataclass(frozen=True)
class Config:
    data_path: str = "data"
    default_language: str = "en"
    supported_languages: tuple[str, ...] = ("en", "es")
    user_preferred_language: str | None = None
    detector: DetectorConfig = field(default_factory=DetectorConfig)
    correction: CorrectionConfig = field(default_factory=CorrectionConfig)
    pipeline: PipelineConfig = field(default_factory=PipelineConfig)

    def validate(self) -> Config:
        """Self, or ValueError."""
        if not self.supported_languages:
            raise ValueError("at least one supported language is required")
        if self.default_language not in self.supported_languages:
            raise ValueError(f"default language {self.default_language!r} must be supported")
        if self.user_preferred_language is not None and self.user_preferred_language not in self.supported_languages:
            raise ValueError(f"preferred language {self.user_preferred_language!r} must be supported")
        if self.pipeline.max_token_chars <= 0:
            raise ValueError("the buffer must hold at least one character")
        if not 0.0 <= self.detector.confidence_threshold <= 1.0:
            raise ValueError("confidence_threshold must be between 0 and 1")
        if self.pipeline.language_mode not in ("fixed", "propagate_next"):
            raise ValueError("language_mode is fixed or propagate_next")
        if self.correction.max_edit_distance > 2:
            warnings.warn("max_edit_distance above 2 makes candidate search expensive", stacklevel=2)
        return self

    def data_dir(self) -> Path:
        return Path(self.data_path) if os.path.isabs(self.data_path) else Path.cwd() / self.data_path

    def to_json(self) -> str:
        return json.dumps(asdict(self), indent=2)

    def to_file(self, path: str | os.PathLike) -> None:
        Path(path).write_text(self.to_json())

    def with_(self, **changes) -> Config:
        return replace(self, **changes).validate()

    @classmethod
    def from_dict(cls, data: dict) -> Config:
        return _build(cls, data).validate()

    @classmethod
    def from_json(cls, text: str) -> Config:
        return cls.from_dict(json.loads(text))

    @classmethod
    def from_file(cls, path: str | os.PathLike) -> Config:
        return cls.from_json(Path(path).read_text())

    @classmethod
    def load_or_default(cls, path: str | os.PathLike) -> Config:
        """The file's settings; defaults, without creating a file, if there is none."""
        return cls.from_file(path) if Path(path).exists() else cls().validate()


def _build(cls, data: dict):
    known = {}
    for f in fields(cls):
        if f.name not in data:
            continue
        value, default = data[f.name], f.default_factory() if callable(f.default_factory) else f.default
        known[f.name] = _build(type(default), value) if is_dataclass(default) else tuple(value) if isinstance(default, tuple) else value
    return cls(**known)
