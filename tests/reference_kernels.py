"""Plain one-event-at-a-time versions of the distributed operators, for comparison in tests."""

from __future__ import annotations

import numpy as np


def asof_places(reference: list[float], target: list[float]) -> list[int]:
    places = []
    for t in target:
        best, place = None, 0
        for i, r in enumerate(reference, start=1):
            if r <= t and (best is None or r >= best):
                best, place = r, i
        places.append(place)
    return places


def align(sensors: list[tuple[list[float], list[float]] | None]) -> list[tuple[float, list[float | None]]]:
    """Two sweeps over the sensors; each sensor is (times, values) or None when it has no rows."""
    if sensors[0] is None:
        return []
    clock = list(zip(*sensors[0], strict=True))
    picked: dict[int, list[float]] = {}
    for _ in range(2):
        for k in range(1, len(sensors)):
            if sensors[k] is None:
                continue
            times, values = sensors[k]
            first_hit: dict[int, int] = {}
            for j, place in enumerate(asof_places([c[0] for c in clock], times)):
                if place:
                    first_hit.setdefault(place, j)
            kept = sorted(first_hit)
            clock = [clock[p - 1] for p in kept]
            picked[k] = [values[first_hit[p]] for p in kept]
            if not clock:
                return []
    return [
        (t, [v] + [picked[k][row] if k in picked else None for k in range(1, len(sensors))])
        for row, (t, v) in enumerate(clock)
    ]


def filter_both_ways(sections: np.ndarray, x: np.ndarray, pad: int) -> np.ndarray:
    """Sample-by-sample cascade over the odd extension, forward then backward."""
    if len(x) <= pad:
        return x

    def one_way(v: np.ndarray) -> np.ndarray:
        level = v[0]
        for b0, b1, b2, _, a1, a2 in sections:
            gain = (b0 + b1 + b2) / (1 + a1 + a2)
            z1, z2 = (gain - b0) * level, (b2 - a2 * gain) * level
            out = []
            for s in v:
                y = b0 * s + z1
                z1, z2 = b1 * s - a1 * y + z2, b2 * s - a2 * y
                out.append(y)
            level, v = level * gain, np.array(out)
        return v

    left, right = 2 * x[0] - x[pad:0:-1], 2 * x[-1] - x[-2 : -pad - 2 : -1]
    y = one_way(one_way(np.concatenate([left, x, right]))[::-1])[::-1]
    return y[pad:-pad]
