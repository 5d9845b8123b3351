"""A log of commits: rows appended batch by batch, seen whole or not at all, and compacted into snapshots.

path/<kind>/<name>      rows of one commit, a folder for each kind of rows
path/commits/<number>   its marker, created last, by one writer only; holds the name and what the commit says of itself
path/snapshots/<number> marker of a snapshot: the kinds' rows of all commits up to this number, merged

The number of a snapshot is the high-water mark: readers take the newest snapshot and the commits after it, no others.
"""

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import SparkSession

from kindred.sources.marks import Marks


@dataclass(frozen=True)
class Commit:
    number: int
    info: dict

    @property
    def name(self) -> str:
        return self.info["name"]


@dataclass(frozen=True)
class State:
    """What a log holds at one moment: a snapshot, or none, and the commits after it in order."""

    snapshot: Commit | None
    later: tuple[Commit, ...]

    @property
    def number(self) -> int:
        return self.newest.number if self.newest else 0

    @property
    def newest(self) -> Commit | None:
        return self.later[-1] if self.later else self.snapshot

    def runs(self) -> dict[str, int]:
        """The last batch of each stream that has committed."""
        last = dict(self.snapshot.info["runs"]) if self.snapshot else {}
        for commit in self.later:
            if commit.info.get("run") is not None:
                last[commit.info["run"]] = max(last.get(commit.info["run"], -1), commit.info["batch"])
        return last


class CommitLog:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._commits, self._snapshots = Marks(spark, f"{path}/commits"), Marks(spark, f"{path}/snapshots")

    def state(self) -> State:
        """The newest snapshot and the commits after it; older markers are not opened."""
        at = max(self._snapshots.numbers(), default=0)
        snapshot = Commit(at, json.loads(self._snapshots.text(str(at)))) if at else None
        later = [n for n in self._commits.numbers() if n > at]
        return State(snapshot, tuple(Commit(n, json.loads(self._commits.text(str(n)))) for n in later))

    def all(self) -> list[Commit]:
        """Every commit, also those that a snapshot holds."""
        return [Commit(n, json.loads(self._commits.text(str(n)))) for n in self._commits.numbers()]

    def folder(self, kind: str, commit: Commit | str) -> str:
        return f"{self.path}/{kind}/{commit if isinstance(commit, str) else commit.name}"

    def folders(self, kind: str, state: State, after: int = 0) -> list[str]:
        """Folders to read for one kind of rows, of the commits after a number if given."""
        held = [state.snapshot] if state.snapshot and not after else []
        return [self.folder(kind, c) for c in (*held, *state.later) if c.number > after]

    def commit(self, number: int, name: str, **info) -> bool:
        """Mark the rows written under the name as commit `number`; false if another writer has that number."""
        return self._commits.create(str(number), json.dumps({"name": name, **info}))

    def snapshot(self, state: State, name: str, **info) -> bool:
        """Mark rows written under the name as all rows up to the state's newest commit."""
        return self._snapshots.create(str(state.number), json.dumps({"name": name, "runs": state.runs(), **info}))


def fresh_name() -> str:
    return uuid.uuid4().hex
