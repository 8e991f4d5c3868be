"""Where a deployment keeps its files: one root, a folder for each kind."""

from __future__ import annotations

from dataclasses import dataclass

#: The folders under the root.
FOLDERS = {"input": "data/inputs", "curated": "data/curated", "cache": "data/cache", "assignment": "outputs/assignments", "report": "outputs/reports", "evaluation": "outputs/evaluations"}


@dataclass(frozen=True)
class Layout:
    """Paths under root, which may be a mounted folder or the address of a store."""

    root: str

    def path(self, kind: str, name: str) -> str:
        if kind not in FOLDERS:
            raise ValueError(f"no folder for {kind}")
        return f"{self.root.rstrip('/')}/{FOLDERS[kind]}/{name}"
