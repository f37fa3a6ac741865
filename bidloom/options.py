"""Limits of a deployment, read once on the driver and passed on as plain values."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass

from .functions.text import LIMIT_MB


@dataclass(frozen=True)
class Options:
    """Largest file in MB, files a streaming batch takes, and the key that requests must carry (none: open to all)."""

    max_file_mb: int = LIMIT_MB
    concurrent_jobs: int = 3
    api_key: str | None = None

    @classmethod
    def from_env(cls, env: Mapping[str, str] = os.environ) -> Options:
        return cls(int(env.get("MAX_FILE_SIZE_MB", LIMIT_MB)), int(env.get("MAX_CONCURRENT_JOBS", 3)), env.get("API_KEY") or None)
