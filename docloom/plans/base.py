"""Registration of queries: an operator over frames, and its oracle over the same frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.sources.frames import frame, with_frames

QUERIES: dict = {}
ORACLES: dict = {}


def rounded(out):
    """Doubles to six places, as the oracles give them."""
    return out.withColumns({c: F.round(c, 6) for c, kind in out.dtypes if kind == "double"})


def add(name: str, frames: tuple[str, ...], operator, oracle: str | None = None, told: tuple[str, ...] | None = None) -> None:
    """Register ``operator`` over ``frames``; ``oracle`` follows the common tables of the frames ``told``, by default the same."""
    QUERIES[name] = lambda spark, sf_dir: rounded(operator(*[frame(spark, sf_dir, f) for f in frames]))
    if oracle is not None:
        ORACLES[name] = f"{with_frames(*(told or frames))}{oracle}"
