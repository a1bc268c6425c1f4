"""The analyses by name."""

from __future__ import annotations

from collections.abc import Callable

from ..frame import GridFrame
from .climatology import climatology
from .extract import extract_bottom, extract_layer, extract_surface
from .extremes import extract_annual_extremes, extract_annual_extremes_per_layer
from .reduce import compute_depth_average, compute_depth_integral, reduce_axes
from .stats import calculate_stats


class ActionNotFound(Exception):
    """No analysis has that name."""


ACTIONS: dict[str, Callable[..., GridFrame]] = {
    f.__name__: f
    for f in (
        calculate_stats, climatology, compute_depth_average, compute_depth_integral, extract_annual_extremes,
        extract_annual_extremes_per_layer, extract_bottom, extract_layer, extract_surface, reduce_axes,
    )
}


def run_action(name: str, frame: GridFrame, **arguments) -> GridFrame:
    """The result of the analysis ``name``; an unknown name is an :class:`ActionNotFound`."""
    if name not in ACTIONS:
        raise ActionNotFound(f"{name}; known are {', '.join(sorted(ACTIONS))}")
    return ACTIONS[name](frame, **arguments)
