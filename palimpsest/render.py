"""Rows as lines of text."""

from __future__ import annotations

from datetime import UTC, datetime


def day(seconds: int | None) -> str:
    """A date, or three dots for an open end."""
    return "..." if seconds is None else datetime.fromtimestamp(seconds, UTC).strftime("%Y-%m-%d")


def memory(row: dict, most: int = 400) -> str:
    content = row["content"] if len(row["content"]) <= most else row["content"][: most - 3] + "..."
    span = f" ({day(row['valid_from'])} - {day(row.get('valid_to'))})" if row.get("valid_from") is not None else ""
    return f"m{row['id']}{span} {content}"


def fact(row: dict) -> str:
    """source predicate target, with `not` for a denial and its span."""
    word = "" if row.get("polarity", 1) else "not "
    return f"r{row['id']} {row['source']} {word}{row['predicate']} {row['target']} ({day(row['valid_from'])} - {day(row.get('valid_to'))})"


def card(row: dict) -> str:
    kind = f" [{row['type']}]" if row.get("type") else ""
    others = [a for a in row.get("aliases", []) if a != row["name"]]
    lines = [f"{row['name']}{kind}" + (f", also {', '.join(others)}" if others else "")]
    lines += [row["description"]] if row.get("description") else []
    return "\n".join([*lines, *map(fact, row.get("facts", [])), *map(memory, row.get("timeline", []))])


def change(row: dict) -> str:
    if "error" in row:
        return f"refused: {row['error']}"
    state = "already known" if row["duplicate"] else "written"
    return f"{row['id']} {state}" + (f", ended {', '.join(row['ended'])}" if row["ended"] else "")


def table(rows: dict) -> str:
    width = max(map(len, rows), default=0)
    return "\n".join(f"{k:<{width}}  {v}" for k, v in rows.items())
