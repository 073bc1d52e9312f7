"""Settings of a library, from defaults, the environment (``PAPERLODE_<NAME>``) and arguments, in this order."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Settings:
    """M9: where a library lies, how it cuts text and how much of it goes into a prompt."""

    data_dir: str = "paperlode-data"
    chunk_max_tokens: int = 700
    chunk_min_tokens: int = 150
    table_max_tokens: int = 1000
    top_k: int = 5
    context_max_tokens: int = 3000
    upload_max_mb: int = 500
    host: str = "127.0.0.1"
    port: int = 8000

    @classmethod
    def load(cls, env: Mapping[str, str] | None = None, **given: object) -> Settings:
        """Settings with what the environment and the arguments (those that are not None) say; a value that cannot be
        read as its field's type is an error that names it."""
        env = os.environ if env is None else env
        out = cls()
        for f in fields(cls):
            text = env.get(f"PAPERLODE_{f.name.upper()}")
            value = given.get(f.name)
            if value is None and text is not None:
                value = text
            if value is not None:
                try:
                    out = replace(out, **{f.name: type(getattr(out, f.name))(value)})
                except ValueError as e:
                    raise ValueError(f"{f.name}: {value!r} is no {type(getattr(out, f.name)).__name__}") from e
        return out
