"""Configuration: two-level YAML with includes, typed access, and numbers by range."""

from __future__ import annotations

import os
import shlex
from collections.abc import Callable
from typing import Any

import yaml


class ConfigError(ValueError):
    pass


class NoSection(ConfigError):
    pass


class NoOption(ConfigError):
    pass


def load_yaml(text: str, **values: Any) -> Any:
    """Safe YAML; there is no template engine, so values are an error."""
    if values:
        raise TypeError("no template engine for " + ", ".join(values))
    return yaml.safe_load(text)


def number_range(text: str) -> list[int]:
    """'2,5,7-12' as sorted distinct numbers."""
    out: set[int] = set()
    for part in text.replace(" ", "").split(","):
        lo, _, hi = part.partition("-")
        out.update(range(int(lo), int(hi or lo) + 1))
    return sorted(out)


class Config:
    """Sections of options.  Files named under ``include`` fill in what is missing, the last one first."""

    def __init__(self, source: str | dict, includes: bool = True):
        folder = "."
        if isinstance(source, str):
            folder = os.path.dirname(source)
            with open(source, encoding="utf-8") as f:
                source = load_yaml(f.read()) or {}
        named = source.get("include", []) if includes else []
        held = {k: v for k, v in source.items() if not (includes and k == "include")}
        for name, options in held.items():
            if not isinstance(options, dict):
                raise ConfigError(f"section {name} holds no options")
        self.sections = {name: dict(options) for name, options in held.items()}
        for path in reversed([named] if isinstance(named, str) else named):
            self.merge(Config(os.path.join(folder, path)), overwrite=False)

    def merge(self, other: Config, overwrite: bool = True) -> None:
        for name, options in other.sections.items():
            own = self.sections.setdefault(name, {})
            for key, value in options.items():
                if overwrite or key not in own:
                    own[key] = value

    def has(self, section: str, option: str | None = None) -> bool:
        return section in self.sections and (option is None or option in self.sections[section])

    def options(self, section: str) -> list[str]:
        if section not in self.sections:
            raise NoSection(section)
        return list(self.sections[section])

    def set(self, section: str, option: str, value: Any) -> None:
        if section not in self.sections:
            raise NoSection(section)
        self.sections[section][option] = value

    def add(self, section: str) -> None:
        if section in self.sections:
            raise ConfigError(f"section {section} is there")
        self.sections[section] = {}

    _needed = object()

    def get(self, section: str, option: str, mapper: Callable = lambda v: v, default: Any = _needed, check: bool = False) -> Any:
        """The mapped value, or the default; with check the mapping must not change it."""
        if not self.has(section):
            raise NoSection(section)
        if not self.has(section, option):
            if default is self._needed:
                raise NoOption(f"{section}/{option}")
            return default
        raw = self.sections[section][option]
        try:
            value = mapper(raw)
        except Exception as e:
            raise ConfigError(f"{section}/{option}: {e}") from e
        if check and value != raw:
            raise ConfigError(f"{section}/{option}: {raw!r} is not exact")
        return value

    def get_list(self, section: str, option: str, mapper: Callable = lambda v: v, default: Any = _needed) -> list:
        """A list, or words of a string split as a shell does."""
        split = lambda v: [mapper(x) for x in (shlex.split(v) if isinstance(v, str) else v)]
        return self.get(section, option, split, default)

    def get_range(self, section: str, option: str, default: Any = _needed) -> list[int]:
        parse = lambda v: number_range(v) if isinstance(v, str) else sorted({int(x) for x in (v if isinstance(v, list) else [v])})
        return self.get(section, option, parse, default)
