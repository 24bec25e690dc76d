"""Where tables live: every topic of a level has one folder, ``<base>/<level>/<topic>``, with
its rows, its stream's progress and, for saved results, their manifest below it."""

from __future__ import annotations

from dataclasses import dataclass

BRONZE, SILVER, GOLD = LEVELS = ("bronze", "silver", "gold")


@dataclass(frozen=True)
class TopicPaths:
    """The folder of one topic of one level."""

    base: str
    level: str
    topic: str

    def __post_init__(self) -> None:
        if self.level not in LEVELS:
            raise ValueError(f"level must be one of {LEVELS}, not {self.level!r}")

    def _below(self, name: str) -> str:
        return "/".join([self.base.rstrip("/"), self.level, self.topic, name])

    @property
    def rows(self) -> str:
        return self._below("rows")

    @property
    def archive(self) -> str:
        return self._below("archive")

    @property
    def progress(self) -> str:
        return self._below("progress")

    @property
    def manifest(self) -> str:
        return self._below("manifest")

    @property
    def unclustered(self) -> str:
        return self._below("unclustered")


@dataclass(frozen=True)
class Layout:
    """A base folder that every executor can reach."""

    base: str

    def of(self, level: str, topic: str) -> TopicPaths:
        return TopicPaths(self.base, level, topic)
