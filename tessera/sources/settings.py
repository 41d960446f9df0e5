"""Settings of what is plugged in: which embedder, which reading model, which engines; kept on the driver.

A setting names an address and the environment variable that holds its key; keys are never stored.
"""

from __future__ import annotations

import json
import os
import platform
from collections.abc import Callable
from dataclasses import asdict, dataclass, replace
from pathlib import Path

import numpy as np

from tessera.sources import plugins

POLICIES = ("full", "tables_only")
BATCH = 64


@dataclass(frozen=True)
class Setting:
    """An address that answers (embedding or reading images), whether it is on, and what it may be asked for."""

    kind: str
    url: str = ""
    model: str = ""
    key_variable: str = ""
    dialect: str = "indexed"
    policy: str = "full"
    enabled: bool = False

    @property
    def configured(self) -> bool:
        return bool(self.url and self.model)

    def reads_figures(self) -> bool:
        return self.enabled and self.policy == "full"


class Settings:
    """Settings in one file that only its owner can read; an older file is copied once, never changed."""

    def __init__(self, path: str | Path, older: str | Path | None = None) -> None:
        self.path = Path(path)
        if older is not None and not self.path.exists() and Path(older).exists():
            self._write(json.loads(Path(older).read_text(encoding="utf-8")))

    def _read(self) -> dict:
        try:
            return json.loads(self.path.read_text(encoding="utf-8"))
        except (OSError, ValueError):
            return {}

    def _write(self, content: dict) -> None:
        self.path.parent.mkdir(parents=True, exist_ok=True)
        part = self.path.with_suffix(".part")
        handle = os.open(part, os.O_WRONLY | os.O_CREAT | os.O_TRUNC, 0o600)
        with os.fdopen(handle, "w", encoding="utf-8") as f:
            json.dump(content, f, ensure_ascii=False, indent=1)
        os.replace(part, self.path)

    def get(self, kind: str) -> Setting:
        known = self._read().get(kind, {})
        return Setting(kind, **{k: v for k, v in known.items() if k in Setting.__dataclass_fields__ and k != "kind"})

    def enable(self, setting: Setting, probe: Callable[[Setting], None]) -> Setting:
        """Keep a setting and switch it on, if a call through it works; the probe raises if it doesn't."""
        if setting.policy not in POLICIES:
            raise ValueError(f"policy must be one of {', '.join(POLICIES)}")
        if not setting.configured:
            raise ValueError("an address and a model are needed")
        probe(setting)
        on = replace(setting, enabled=True)
        content = self._read()
        content[setting.kind] = {k: v for k, v in asdict(on).items() if k != "kind"}
        self._write(content)
        return on

    def disable(self, kind: str) -> Setting:
        content = self._read()
        if kind in content:
            content[kind]["enabled"] = False
            self._write(content)
        return self.get(kind)

    def status(self) -> dict[str, dict]:
        """What is set, without keys: only whether the variable of the key is there."""
        return {kind: asdict(s) | {"key_is_set": bool(s.key_variable and os.environ.get(s.key_variable))} for kind in sorted(self._read()) for s in [self.get(kind)]}


def tri_state(flag: object, configured: bool, policy: bool) -> bool:
    """True and false as they are; on, true, yes, 1 and off, false, no, 0 as words; anything else by what is configured and the policy."""
    if isinstance(flag, bool):
        return flag
    word = str(flag or "").strip().lower()
    if word in ("on", "true", "yes", "1"):
        return True
    return word not in ("off", "false", "no", "0") and configured and policy


def parse_vectors(answer: dict, dialect: str) -> np.ndarray:
    """Vectors of an answer: of entries with an index, in the order of these, or of a plain list."""
    if dialect == "indexed":
        return np.array([e["embedding"] for e in sorted(answer["data"], key=lambda e: e["index"])], dtype=np.float32)
    if dialect == "plain":
        return np.array(answer["vectors"], dtype=np.float32)
    raise ValueError(f"no dialect {dialect!r}")


def remote_embedder(setting: Setting, send: Callable[[str, dict], dict], purpose: str = "db") -> Callable[[list[str]], np.ndarray]:
    """An embedder that asks an address through ``send`` (address, request) -> answer; fails if the answer has not as many vectors as texts."""

    def embed(texts: list[str]) -> np.ndarray:
        request = {"model": setting.model, "input": texts} if setting.dialect == "indexed" else {"model": setting.model, "texts": texts, "type": purpose}
        vectors = parse_vectors(send(setting.url, request), setting.dialect)
        if len(vectors) != len(texts):
            raise RuntimeError(f"{len(vectors)} vectors for {len(texts)} texts")
        return vectors

    return embed


_STORES: dict[str, str] = {}


def store_of(location: str) -> str:
    """Where an index is kept: an address with a scheme as it is, a plain path as a file's; the same place gives the same store."""
    if location not in _STORES:
        _STORES[location] = location.rstrip("/") if "://" in location else Path(location).absolute().as_uri()
    return _STORES[location]


def describe(settings: Settings | None = None) -> dict:
    """What there is: versions, engines that can run, what is set."""
    import pyspark

    engines = {name: e.is_available() for name, e in sorted(plugins.registered().items())}
    return {"python": platform.python_version(), "pyspark": pyspark.__version__, "engines": engines, "settings": settings.status() if settings else {}}
