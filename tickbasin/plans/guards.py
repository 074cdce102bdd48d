"""Guards on parameters; each raises BadRequest."""

from __future__ import annotations

from ..errors import BadRequest
from ..schemas import MODES

DAY_US = 24 * 3_600_000_000
DEFAULT_DEPTH, MOST_DEPTH, DEFAULT_LIMIT, MOST_LIMIT = 20, 200, 100, 1000


def time_window(start_us: int, end_us: int, most_us: int = DAY_US) -> tuple[int, int]:
    """A window that starts before it ends and spans a day at most."""
    if start_us >= end_us:
        raise BadRequest("start_us must be before end_us")
    if end_us - start_us > most_us:
        raise BadRequest(f"the window must span at most {most_us} us")
    return start_us, end_us


def depth(value: int | None, most: int = MOST_DEPTH) -> int:
    """A depth from 1 to the maximum."""
    value = DEFAULT_DEPTH if value is None else value
    if not 1 <= value <= most:
        raise BadRequest(f"depth must be 1 to {most}")
    return value


def limit(value: int | None) -> int:
    """A row limit from 1 to 1000."""
    value = DEFAULT_LIMIT if value is None else value
    if not 1 <= value <= MOST_LIMIT:
        raise BadRequest(f"limit must be 1 to {MOST_LIMIT}")
    return value


def mode(value: str | None) -> str:
    """A replay mode."""
    value = value or MODES[0]
    if value not in MODES:
        raise BadRequest(f"mode must be one of {', '.join(MODES)}")
    return value


def source(value: str | None, known: tuple[str, ...] = ("parquet",)) -> str:
    """A storage that can be read."""
    value = value or known[0]
    if value not in known:
        raise BadRequest(f"source must be one of {', '.join(known)}")
    return value


def tokens(text: str, drop_empty: bool = False) -> list[str]:
    """Ids of a comma-separated argument, trimmed."""
    parts = [p.strip() for p in text.split(",")]
    return [p for p in parts if p] if drop_empty else parts
