"""Job settings. Plain driver-side values; nothing here touches data."""

from __future__ import annotations

from dataclasses import dataclass

# Duration units, as parts of a second or seconds.
UNIT_PARTS = {"us": 1_000_000.0, "µs": 1_000_000.0, "ms": 1000.0}
UNIT_SECONDS = {"s": 1.0, "m": 60.0}


@dataclass(frozen=True)
class Options:
    """Thresholds and limits; the numbers are fixed values, the usual capture settings.

    Limits that would lose rows or text are off: requests open at once on a
    connection, and the length of queries and arguments. Who sets them gets what
    they say, templates and signatures included.
    """

    slow_ms: float = 100.0
    nplus1_threshold: int = 5
    nplus1_window_s: float = 1.0
    nplus1_cooldown_s: float = 10.0

    max_frame_bytes: int = 32 * 1024 * 1024
    max_pending: int | None = None
    max_events: int = 1000
    max_notices: int = 20

    max_query_chars: int | None = None
    max_arg_chars: int | None = None
    max_cell_chars: int = 200
    max_preview_rows: int = 5
    max_preview_bytes: int = 8192
    max_notice_chars: int = 300

    report_top: int = 10

    # Width of the blocks a long key is cut into (see operators/blocks.py):
    # rows for sequence-ordered scans, seconds for time-ordered ones. Detection
    # narrows the latter until no block of a key has more than ``block_most`` rows.
    block_rows: int = 65536
    block_seconds: float = 60.0
    block_most: int = 4_000_000

    @property
    def window_us(self) -> int:
        return round(self.nplus1_window_s * 1_000_000)

    @property
    def cooldown_us(self) -> int:
        return round(self.nplus1_cooldown_s * 1_000_000)

    @property
    def block_us(self) -> int:
        return max(1, round(self.block_seconds * 1_000_000))
