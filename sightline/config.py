"""Settings by dotted paths, which environment variables override."""

from __future__ import annotations

import os
from typing import Any

PREFIX = "SIGHTLINE_"


class Settings:
    """A nested dictionary of settings. `SIGHTLINE_A__B` stands for the path `a.b`; its text is cast to the type of the value that it overrides."""

    def __init__(self, values: dict[str, Any], environment: dict[str, str] | None = None):
        self.values = values
        self.environment = os.environ if environment is None else environment

    def get(self, path: str, default: Any = None) -> Any:
        found: Any = self.values
        for part in path.split("."):
            found = found.get(part) if isinstance(found, dict) else None
            if found is None:
                break
        text = self.environment.get(PREFIX + path.upper().replace(".", "__"))
        own = default if found is None else found
        return own if text is None else self._cast(text, own)

    @staticmethod
    def _cast(text: str, like: Any) -> Any:
        if isinstance(like, bool):
            return text.strip().lower() in ("1", "true", "yes", "on")
        if isinstance(like, list):
            return [x.strip() for x in text.split(",") if x.strip()]
        return type(like)(text) if isinstance(like, (int, float)) else text
