"""Saved views: column layouts, bookmarks, sessions and merge groups in one JSON document."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field
from pathlib import Path

from ..constants import MAX_BOOKMARKS, MAX_EXPANDED, MAX_FILES, MAX_SESSIONS, NAME_LENGTH
from .timeline import Source


def clean_name(name: str) -> str:
    """A session's name: no control characters, no space around, at most so many characters."""
    return "".join(c for c in name if c.isprintable() or c == " ").strip()[:NAME_LENGTH]


@dataclass
class State:
    files: dict[str, dict] = field(default_factory=dict)  # the most recently used last

    def touch(self, path: str) -> dict:
        entry = self.files.pop(path, {"layout": None, "bookmarks": [], "sessions": [], "expanded": []})
        self.files[path] = entry
        while len(self.files) > MAX_FILES:
            self.files.pop(next(iter(self.files)))
        return entry

    def set_layout(self, path: str, order: list[str], hidden: list[str], widths: dict[str, float]) -> None:
        self.touch(path)["layout"] = {"order": order, "hidden": hidden, "widths": widths}

    def set_bookmarks(self, path: str, marks: set[int]) -> None:
        self.touch(path)["bookmarks"] = sorted(marks)[:MAX_BOOKMARKS]

    def save_session(self, path: str, name: str, **view) -> bool:
        """Saves a view under a name, over an older one of that name; the oldest goes when there are too many."""
        name = clean_name(name)
        if not name:
            return False
        entry = self.touch(path)
        view["expanded"] = sorted(view.get("expanded", []))[:MAX_EXPANDED]
        entry["sessions"] = [s for s in entry["sessions"] if s["name"] != name][-(MAX_SESSIONS - 1) :] + [{"name": name, **view}]
        return True

    def session(self, path: str, name: str) -> dict | None:
        return next((s for s in self.files.get(path, {}).get("sessions", []) if s["name"] == clean_name(name)), None)

    def dump(self, path: str | Path) -> None:
        part = Path(str(path) + ".partial")
        part.write_text(json.dumps({"version": 1, "files": self.files}, ensure_ascii=False))
        os.replace(part, path)

    @classmethod
    def load(cls, path: str | Path) -> State:
        """The saved state; an empty one where the file is missing or damaged."""
        try:
            return cls(dict(json.loads(Path(path).read_text())["files"]))
        except (OSError, ValueError, KeyError, TypeError):
            return cls()


def group_of(sources: list[Source]) -> list[dict]:
    return [{"path": s.path, "offset_ms": s.offset_ms, "zone_ms": s.zone_ms, "hidden": s.hidden} for s in sources]


def restore_group(group: list[dict], opened: dict[str, Source]) -> list[Source] | None:
    """The sources of a saved group that can still be opened, with their time settings; None if fewer than two."""
    kept = [Source(**(vars(opened[g["path"]]) | {k: g[k] for k in ("offset_ms", "zone_ms", "hidden")})) for g in group if g["path"] in opened]
    return kept if len(kept) >= 2 else None
