"""Charts of small tables as SVG text: lines, points, bars, bands; the data comes from the queries."""

from __future__ import annotations

import html
import math
from collections.abc import Sequence

WIDTH, HEIGHT, LEFT, BOTTOM, TOP, RIGHT = 900, 420, 70, 45, 40, 20
COLOURS = ("#1f5fa8", "#c2571a", "#2f7d4f", "#7a4ea3", "#8a6d1f")
Points = Sequence[tuple[float, float]]


def ticks(low: float, high: float, about: int = 6) -> list[float]:
    """Round values between two ends."""
    if not high > low:
        return [low]
    raw = (high - low) / about
    size = 10 ** math.floor(math.log10(raw))
    step = next(m * size for m in (1, 2, 5, 10) if m * size >= raw)
    first = math.ceil(low / step - 1e-9)
    return [i * step for i in range(first, math.floor(high / step + 1e-9) + 1)]


def chart(series: dict[str, Points], title: str = "", x_label: str = "", y_label: str = "", kind: str = "line", levels: Sequence[float] = ()) -> str:
    """One chart; ``kind`` is line, points or bars, ``levels`` are dashed horizontals (bands, thresholds)."""
    data = {k: [(float(x), float(y)) for x, y in v if math.isfinite(x) and math.isfinite(y)] for k, v in series.items()}
    xs = [x for v in data.values() for x, _ in v] or [0.0, 1.0]
    ys = [y for v in data.values() for _, y in v] + list(levels) + ([0.0] if kind == "bars" else []) or [0.0, 1.0]
    x0, x1, y0, y1 = min(xs), max(xs), min(ys), max(ys)
    x1, y1 = (x1 if x1 > x0 else x0 + 1), (y1 if y1 > y0 else y0 + 1)
    px = lambda x: LEFT + (x - x0) / (x1 - x0) * (WIDTH - LEFT - RIGHT)
    py = lambda y: HEIGHT - BOTTOM - (y - y0) / (y1 - y0) * (HEIGHT - BOTTOM - TOP)
    out = [f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {WIDTH} {HEIGHT}" font-family="sans-serif" font-size="12"><rect width="100%" height="100%" fill="white"/>']
    out.append(f'<text x="{WIDTH / 2}" y="22" text-anchor="middle" font-size="15">{html.escape(title)}</text>')
    for t in ticks(x0, x1):
        out.append(f'<text x="{px(t):.1f}" y="{HEIGHT - BOTTOM + 16}" text-anchor="middle">{t:g}</text>')
    for t in ticks(y0, y1):
        out.append(f'<line x1="{LEFT}" x2="{WIDTH - RIGHT}" y1="{py(t):.1f}" y2="{py(t):.1f}" stroke="#ddd"/><text x="{LEFT - 6}" y="{py(t) + 4:.1f}" text-anchor="end">{t:g}</text>')
    for v in levels:
        out.append(f'<line x1="{LEFT}" x2="{WIDTH - RIGHT}" y1="{py(v):.1f}" y2="{py(v):.1f}" stroke="#888" stroke-dasharray="5 4"/>')
    for i, (name, points) in enumerate(data.items()):
        colour = COLOURS[i % len(COLOURS)]
        if kind == "line":
            out.append(f'<polyline fill="none" stroke="{colour}" points="{" ".join(f"{px(x):.1f},{py(y):.1f}" for x, y in points)}"/>')
        elif kind == "points":
            out += [f'<circle cx="{px(x):.1f}" cy="{py(y):.1f}" r="1.6" fill="{colour}"/>' for x, y in points]
        else:
            wide = max(1.0, 0.8 * (WIDTH - LEFT - RIGHT) / max(1, len(points)))
            out += [f'<rect x="{px(x) - wide / 2:.1f}" y="{min(py(y), py(0)):.1f}" width="{wide:.1f}" height="{abs(py(y) - py(0)):.1f}" fill="{colour}"/>' for x, y in points]
        if len(data) > 1:
            out.append(f'<text x="{WIDTH - RIGHT - 4}" y="{TOP + 14 * i + 8}" text-anchor="end" fill="{colour}">{html.escape(name)}</text>')
    out.append(f'<text x="{WIDTH / 2}" y="{HEIGHT - 8}" text-anchor="middle">{html.escape(x_label)}</text><text x="16" y="{HEIGHT / 2}" text-anchor="middle" transform="rotate(-90 16 {HEIGHT / 2})">{html.escape(y_label)}</text></svg>')
    return "".join(out)
