"""Settings of the engine: defaults, overridden by environment variables ``LUMENFRAME_<NAME>``."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Settings:
    """Limits of retrieval, frames, slides, uploads and memory."""

    top_n_scenes: int = 5
    top_k_frames: int = 12
    max_scenes: int = 12
    max_frames: int = 36
    answer_frames: int = 6
    answer_side: int = 448
    scene_threshold: float = 27.0
    dense_fps: float = 1.0
    slide_fps: float = 0.25
    slide_hash: int = 8
    slide_difference: float = 7.5
    max_tool_calls: int = 8
    max_video_seconds: int = 600
    max_upload_mb: int = 2048
    title_chars: int = 48
    memory_limit: int = 6
    shard_count: int = 1
    shard_index: int = 0

    @classmethod
    def load(cls, env: dict[str, str] | None = None) -> Settings:
        """Values that can't be read keep their default."""
        env = os.environ if env is None else env
        out = {}
        for f in fields(cls):
            kind = type(f.default)
            try:
                out[f.name] = kind(env[f"LUMENFRAME_{f.name.upper()}"])
            except (KeyError, ValueError):
                continue
        return cls(**out)
