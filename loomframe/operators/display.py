"""Frames as text."""

from __future__ import annotations

MAX_ROW_WIDTH = 80


def set_max_row_width(width: int) -> None:
    global MAX_ROW_WIDTH
    MAX_ROW_WIDTH = width


def _cell(value, width: int) -> str:
    text = "None" if value is None else str(value)
    return text if len(text) <= width else text[: max(0, width - 4)] + " ..."


def table(frame, num_rows: int = 10, num_columns: int = 40, max_column_width: int = 30, max_row_width: int | None = None) -> str:
    """The first rows, in blocks of columns that fit into the width."""
    names = frame.df.columns[:num_columns]
    got = frame.df.select(*(f"`{n}`" for n in names)).take(num_rows + 1) if names else []
    rows = [[_cell(v, max_column_width) for v in r] for r in got[:num_rows]]
    widths = [max([len(_cell(n, max_column_width)), *(len(r[i]) for r in rows)]) for i, n in enumerate(names)]
    limit, out, at = max_row_width or MAX_ROW_WIDTH, [], 0
    while at < len(names):
        end, used = at, 1
        while end < len(names) and (end == at or used + widths[end] + 3 <= limit):
            used += widths[end] + 3
            end += 1
        rule = "+" + "+".join("-" * (w + 2) for w in widths[at:end]) + "+"
        line = lambda cells: "|" + "|".join(f" {c:<{w}} " for c, w in zip(cells, widths[at:end], strict=True)) + "|"  # noqa: E731,B023
        out += [rule, line([_cell(n, max_column_width) for n in names[at:end]]), rule, *(line(r[at:end]) for r in rows), rule]
        at = end
    known = frame._rows if frame._rows is not None else ("?" if len(got) > num_rows else len(got))
    return "\n".join([*out, f"[{known} rows x {len(frame.df.columns)} columns]"])
