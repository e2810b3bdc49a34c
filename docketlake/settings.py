"""Settings of a deployment, read from the environment."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass

PREFIX = "DOCKETLAKE_"


@dataclass(frozen=True)
class Settings:
    """Where tables and models are, and what is switched on."""

    index_path: str
    chunks_path: str
    gateway_url: str
    vectors_path: str | None = None
    lexicon_path: str | None = None
    intent_weighting: bool = True
    loose_terms: bool = True
    timeout: float = 60.0

    @classmethod
    def read(cls, env: Mapping[str, str] = os.environ) -> Settings:
        """From variables such as DOCKETLAKE_INDEX_PATH; ValueError names those that lack or hold no value of their kind."""
        given, wrong = {}, []
        for name, field in cls.__dataclass_fields__.items():
            value = env.get(PREFIX + name.upper())
            if value is None:
                if field.default.__class__.__name__ == "_MISSING_TYPE":
                    wrong.append(PREFIX + name.upper())
                continue
            try:
                given[name] = {"bool": lambda v: {"true": True, "1": True, "false": False, "0": False}[v.lower()], "float": float}.get(field.type, str)(value)
            except (KeyError, ValueError):
                wrong.append(PREFIX + name.upper())
        if wrong:
            raise ValueError(f"settings that lack or hold no value of their kind: {wrong}")
        return cls(**given)
