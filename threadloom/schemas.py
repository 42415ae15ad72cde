"""Column names that operators are told, so that one operator runs on transcripts and on any table."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Columns:
    session: str = "session_key"
    order: tuple[str, ...] = ("line_number",)
    role: str = "role"
    text: str = "text"
    ts: str = "timestamp"
    kind: str = "source_type"
