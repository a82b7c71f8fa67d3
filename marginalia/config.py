"""Sources that imports come from, and where the site lives."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class ResearchSource:
    """A repository whose folders are papers; `mirror` is a local copy, as the engine fetches nothing itself."""

    provider: str
    repository: str
    branch: str
    root: str
    entrypoint: str = "main.tex"
    mirror: str | None = None


@dataclass(frozen=True)
class Site:
    host: str = "https://host.example"
    base: str = "/atlas/"
