"""Interfaces by reference: those in the package and those given."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from pathlib import Path

from .types import AbiError, Event, parse_abi

FOLDER = Path(__file__).parent / "interfaces"


def packaged(ref: str) -> str | None:
    path = FOLDER / f"{ref}.json"
    return path.read_text() if "/" not in ref and path.exists() else None


class AbiRegistry:
    """Parses each interface once. `seed` has texts by reference and goes before `load`."""

    def __init__(self, seed: Mapping[str, str] | None = None, load: Callable[[str], str | None] = packaged):
        self.seed, self.load, self.known = dict(seed or {}), load, {}

    def get(self, ref: str) -> dict[str, Event]:
        if ref not in self.known:
            text = self.seed.get(ref) or self.load(ref)
            if text is None:
                raise AbiError(f"unknown abiRef '{ref}'")
            self.known[ref] = parse_abi(text)
        return self.known[ref]

    def is_valid(self, ref: str) -> bool:
        try:
            self.get(ref)
            return True
        except AbiError:
            return False

    def all(self) -> dict[str, dict[str, Event]]:
        """Every interface that parses; what decoding tasks are given."""
        refs = {*self.seed, *(p.stem for p in FOLDER.glob("*.json"))}
        return {r: self.get(r) for r in sorted(refs) if self.is_valid(r)}
