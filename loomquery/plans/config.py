"""Settings as frozen values; ``resolve`` fills ${NAME} from the environment."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field
from typing import Any


@dataclass(frozen=True)
class Chunking:
    size: int = 500
    overlap: int = 50


@dataclass(frozen=True)
class Retrieval:
    top_k: int = 5
    score_threshold: float = 0.5
    semantic_weight: float = 0.7
    keyword_weight: float = 0.3
    rrf_k: int = 60


@dataclass(frozen=True)
class Settings:
    chunking: Chunking = field(default_factory=Chunking)
    retrieval: Retrieval = field(default_factory=Retrieval)
    rewrite_timeout: float = 3.0
    history_turns: int = 5
    context_characters: int = 8000


def resolve(value: Any) -> Any:
    """Strings, lists and dicts with ${NAME} replaced; an unset name stays as it is."""
    if isinstance(value, str):
        return re.sub(r"\$\{(\w+)\}", lambda m: os.environ.get(m[1], m[0]), value)
    if isinstance(value, dict):
        return {k: resolve(v) for k, v in value.items()}
    return [resolve(v) for v in value] if isinstance(value, list) else value
