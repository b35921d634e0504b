"""Settings: a TOML file, then the environment, then what the caller says."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass, field, fields, replace
from pathlib import Path
from typing import Any


class ConfigError(ValueError):
    """The settings can't be used."""


@dataclass(frozen=True)
class Provider:
    name: str
    base_url: str
    api_key: str | None = None
    api_key_env: str | None = None

    def key(self, env: dict[str, str]) -> str:
        if self.api_key_env:
            if not env.get(self.api_key_env):
                raise ConfigError(f"provider {self.name} needs the variable {self.api_key_env}")
            return env[self.api_key_env]
        return self.api_key or "not-needed"


@dataclass(frozen=True)
class Config:
    provider_name: str = "lmstudio"
    seed: int = 42
    temperature: float = 0.0
    request_timeout_s: float = 900.0
    repeats: int = 1
    output_dir: str = "out"
    spell_backend: str = "lexicon"
    min_token_length: int = 3
    max_candidates_per_section: int = 120
    reference_provider: str = "crossref"
    web_provider: str = "none"
    max_results_per_query: int = 5
    searxng_url: str = ""
    pass0_max_chars: int = 120_000
    pass1_section_max_chars: int = 24_000
    pass3_batch_size: int = 10
    models: dict[str, str] = field(default_factory=dict)
    providers: dict[str, Provider] = field(default_factory=dict)

    @property
    def provider(self) -> Provider:
        if self.provider_name not in self.providers:
            raise ConfigError(f"unknown provider {self.provider_name}; there are: {', '.join(sorted(self.providers)) or 'none'}")
        return self.providers[self.provider_name]

    def model_for(self, pass_name: str) -> str | None:
        return self.models.get(pass_name) or self.models.get("default")


def dotenv(*places: Path, env: dict[str, str] | None = None) -> dict[str, str]:
    """env with the settings of the first of the files that exists, where env has none of that name."""
    out = dict(os.environ if env is None else env)
    for place in places:
        if place.exists():
            for line in place.read_text().splitlines():
                name, sep, value = line.strip().partition("=")
                if sep and not name.startswith("#"):
                    out.setdefault(name.strip(), value.strip().strip("'\""))
            break
    return out


def load(path: str | None = None, env: dict[str, str] | None = None, **said: Any) -> Config:
    """Unknown settings in a file are an error; those that are None are not said."""
    env = dict(os.environ if env is None else env)
    own = {f.name: f.type for f in fields(Config)}
    values: dict[str, Any] = {}
    if path:
        raw = tomllib.loads(Path(path).read_text())
        values["providers"] = {k: Provider(k, **v) for k, v in raw.pop("providers", {}).items()}
        values["models"] = raw.pop("models", {})
        for k, v in raw.items():
            values |= v if isinstance(v, dict) else {k: v}
    cast = {"int": int, "float": float}
    values |= {n: cast.get(str(own[n]), str)(env[f"MARGINALIA_{n.upper()}"]) for n in own if env.get(f"MARGINALIA_{n.upper()}")}
    values |= {k: v for k, v in said.items() if v is not None}
    if unknown := set(values) - set(own):
        raise ConfigError(f"unknown settings: {', '.join(sorted(unknown))}")
    return replace(Config(), **values)


PASSES = ("pass0", "pass1", "pass2", "pass3", "pass4")


def passes(only: str | None) -> list[str]:
    """The passes that 'pass1,pass3' names, in their order; all by default."""
    if not only:
        return list(PASSES)
    named = [p.strip() if p.strip().startswith("pass") else f"pass{p.strip()}" for p in only.split(",")]
    if wrong := [p for p in named if p not in PASSES]:
        raise ConfigError(f"unknown passes: {', '.join(wrong)}")
    return [p for p in PASSES if p in named]
