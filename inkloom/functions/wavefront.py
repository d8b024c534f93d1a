"""Error diffusion of a band of raster lines along skewed diagonals, inside a task."""

from __future__ import annotations

import numpy as np

BAND = 1 << 20  # pixels of a band, all plates together

Kernel = list[tuple[int, int, float]]


def band_rows(w: int, h: int, plates: int) -> int:
    """Lines of a band: as many as fit, but not many more than the frame is wide, since the diagonals of a tall band are mostly empty."""
    return max(1, min(h, BAND // max(1, plates * w), max(16, w)))


def diffuse_band(base: np.ndarray, before: np.ndarray, kernel: Kernel, levels: int, intensity: float, overflow: float,
                 wiped: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tones of a band of lines (lines, plates, w), and the errors of its last two lines for the next band.

    A line waits only for what lies up to the kernel's reach to the right in the line above. So with skew = reach + 1 all pixels with the
    same x + skew * line are independent: one step takes the whole diagonal of all plates, and w + skew * lines steps take the
    place of w * lines. Errors are stored by step, which makes every kernel cell a slice at a fixed distance, and are added in the order
    of the serial scan and rounded to float32 after each, so the tones are those of the serial scan to the last bit. ``before``
    holds the errors of the two lines above; on ``wiped`` lines what arrives from above enters, clipped, and is then forgotten.
    """
    lines, n, w = base.shape
    skew = max([0, *(-dx for dy, dx, _ in kernel if dy)]) + 1
    in_order = sorted(kernel, key=lambda k: (-k[0], -k[1]))  # sources from the first line down, each from left to right
    above, own = ([(dy, dx + skew * dy, weight) for dy, dx, weight in in_order if bool(dy) == up] for up in (True, False))
    lead = max(delta for _, delta, _ in above + own)
    steps, top = w + skew * (lines + 1), levels - 1
    at = lambda line: slice(skew * line, skew * line + w)
    error = np.zeros((lead + steps, lines + 2, n))
    value_of, tone_of = np.zeros((steps, lines, n)), np.zeros((steps, lines, n))
    for line in range(2):
        error[lead:][at(line), line] = before[line].T
    for line in range(lines):
        value_of[at(line + 2), line] = base[line].T
    for t in range(2 * skew, steps):
        low, high = max(0, -(-(t - w + 1) // skew) - 2), min(lines, t // skew - 1)
        if low >= high:
            continue
        carry = np.zeros((high - low, n), np.float32)
        for dy, delta, weight in above:
            carry += error[t + lead - delta, low + 2 - dy:high + 2 - dy] * weight
        value = value_of[t, low:high]
        reset = wiped[low:high]
        if reset.any():
            value = np.where(reset[:, None], np.clip(value + carry, 0.0, 1.0), value)
            carry[reset] = 0
        for _, delta, weight in own:
            carry += error[t + lead - delta, low + 2:high + 2] * weight
        value = value + carry
        inside = np.minimum(1.0, np.maximum(0.0, value))
        if overflow > 0:
            inside = inside * (1.0 - overflow) + (value - np.floor(value)) * overflow
        tone = np.rint(inside * top) / top
        tone_of[t, low:high] = tone
        error[t + lead, low + 2:high + 2] = (value - tone) * intensity
    tones = np.stack([tone_of[at(line + 2), line].T for line in range(lines)])
    return tones, np.stack([error[lead:][at(line), line].T for line in (lines, lines + 1)])
