"""Settings: fields from the environment (upper-case names, any case), then from a .env file. Driver only; never in a plan."""

from __future__ import annotations

import os
import re
from collections.abc import Mapping
from dataclasses import dataclass, field, fields
from typing import Any

from tabscout import constants as C
from tabscout.errors import BackendConfigurationError, CredentialsNotConfiguredError
from tabscout.sources.env import read_env

BACKENDS = ("offline", "local", "api")


@dataclass(frozen=True)
class Settings:
    """Secrets are not shown by repr()."""

    llm_backend: str = "offline"
    local_model: str = "heuristic"
    local_fallback_model: str | None = None
    api_model: str | None = None
    api_fallback_model: str | None = None
    local_host: str | None = None
    api_key: str | None = field(default=None, repr=False)
    api_project: str | None = None
    api_location: str | None = None

    def __post_init__(self) -> None:
        if self.llm_backend not in BACKENDS:
            raise BackendConfigurationError(f"LLM_BACKEND must be one of {', '.join(BACKENDS)}")

    def models(self) -> tuple[str | None, str | None]:
        """Primary and fallback model of the backend."""
        return (self.api_model, self.api_fallback_model) if self.llm_backend == "api" else (self.local_model, self.local_fallback_model)

    def credentials(self) -> dict[str, str]:
        """The key, or project and location; the error says which are missing."""
        if self.api_key:
            return {"mode": "api_key", "key": self.api_key}
        missing = [n for n in ("api_project", "api_location") if not getattr(self, n)]
        if missing:
            raise CredentialsNotConfiguredError(f"set API_KEY, or {' and '.join(m.upper() for m in missing)}")
        return {"mode": "project", "project": str(self.api_project), "location": str(self.api_location)}

    def ready(self) -> Settings:
        """Itself, if a call could be made: checked before any source is read."""
        if self.llm_backend == "api":
            self.credentials()
        if not self.models()[0]:
            raise BackendConfigurationError(f"no model is set for the backend {self.llm_backend}")
        return self


def load(env: Mapping[str, str] | None = None, env_file: str | None = ".env") -> Settings:
    """Blank values are unset; errors name the variable and never its value."""
    known = {f.name for f in fields(Settings)}
    values: dict[str, Any] = {}
    for source in (read_env(env_file) if env_file else {}, os.environ if env is None else env):
        values |= {k.lower(): v.strip() for k, v in source.items() if k.lower() in known and v.strip()}
    if "llm_backend" in values:
        values["llm_backend"] = values["llm_backend"].lower()
    return Settings(**values)


def check_request(n_bytes: int = C.DEFAULT_HEAD_BYTES, tail_bytes: int = C.DEFAULT_TAIL_BYTES, timeout: float | None = None, model: str | None = None, allow_override: bool = False, most_timeout: float = C.HOST_MAX_TIMEOUT_SECONDS) -> dict[str, Any]:
    """A host's parameters, if each is in range; a model needs `allow_override`."""
    if not C.HOST_MIN_HEAD_BYTES <= n_bytes <= C.MAX_WINDOW_BYTES:
        raise ValueError(f"n_bytes must be between {C.HOST_MIN_HEAD_BYTES} and {C.MAX_WINDOW_BYTES}")
    if not 0 <= tail_bytes <= C.MAX_WINDOW_BYTES:
        raise ValueError(f"tail_bytes must be between 0 and {C.MAX_WINDOW_BYTES}")
    timeout = min(C.HOST_TIMEOUT_SECONDS, most_timeout) if timeout is None else timeout
    if not 1 <= timeout <= most_timeout:
        raise ValueError(f"timeout must be between 1 and {most_timeout}")
    if model is not None and not re.fullmatch(C.MODEL_NAME, model):
        raise ValueError("model is not a model's name")
    if model is not None and not allow_override:
        raise PermissionError("a model can't be chosen here")
    return {"head_bytes": n_bytes, "tail_bytes": tail_bytes, "budget": timeout, "model": model}
