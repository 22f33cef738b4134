"""Settings from the environment."""

from __future__ import annotations

import os
from pathlib import Path


def env_bool(name: str, default: bool = False) -> bool:
    """1, true, yes and on are true, whatever the case; unset or empty is the default."""
    value = os.environ.get(name, "").strip().lower()
    return value in ("1", "true", "yes", "on") if value else default


def store_url(default: str = "spark-warehouse/questions") -> str:
    """Where the question store is: QUESTION_STORE, or a path that is made absolute, so that all processes share it."""
    value = os.environ.get("QUESTION_STORE", "").strip() or default
    return value if "://" in value or value.startswith("/") else str(Path(value).resolve())


def first_folder(*candidates: str | None) -> str | None:
    """The first of the candidates that is a folder."""
    return next((c for c in candidates if c and Path(c).is_dir()), None)
