"""Change feeds of outside stores."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Iterable, Iterator
from dataclasses import dataclass


@dataclass(frozen=True)
class SourceItem:
    external_id: str
    name: str
    modified_at: int
    etag: str | None = None
    deleted: bool = False


@dataclass(frozen=True)
class SyncPage:
    items: list[SourceItem]
    cursor: str | None


class SourceConnector(ABC):
    """Pages of changes since a cursor, and the bytes of an item."""

    name: str

    @abstractmethod
    def changes(self, scope: str, cursor: str | None) -> Iterator[SyncPage]: ...

    @abstractmethod
    def fetch(self, item: SourceItem) -> bytes: ...


class FolderConnector(SourceConnector):
    """Files of a folder by time of change; the cursor is the time and path of the last one seen, so files that share a time are all seen.

    `known` gives the paths of an earlier listing; those that are gone come as deleted, first.
    """

    def __init__(self, known: Iterable[str] = ()) -> None:
        self.known = known

    name = "folder"

    def changes(self, scope: str, cursor: str | None) -> Iterator[SyncPage]:
        from pathlib import Path

        t, _, path = (cursor or "-1\t").partition("\t")
        since = int(t), path
        found = sorted((int(p.stat().st_mtime_ns), str(p)) for p in Path(scope).rglob("*") if p.is_file())
        there = {p for _, p in found}
        gone = [SourceItem(p, p.rpartition("/")[2], 0, deleted=True) for p in sorted(set(self.known) - there)]
        if gone:
            yield SyncPage(gone, cursor)
        new = [SourceItem(p, p.rpartition("/")[2], t) for t, p in found if (t, p) > since]
        for a in range(0, len(new), 100):
            page = new[a : a + 100]
            yield SyncPage(page, f"{page[-1].modified_at}\t{page[-1].external_id}")

    def fetch(self, item: SourceItem) -> bytes:
        from pathlib import Path

        return Path(item.external_id).read_bytes()
