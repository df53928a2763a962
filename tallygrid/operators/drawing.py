"""Drawings of networks and of their tables as SVG text, which needs no library."""

from __future__ import annotations

from collections.abc import Sequence
from html import escape

import numpy as np

from tallygrid.operators import graphs as G

COLOURS = ("#4269d0", "#efb118", "#ff725c", "#6cc5b0", "#a463f2", "#9c6b4e")


def layout(adjacency: np.ndarray) -> list[tuple[int, float, float]]:
    """Places for drawing: a row for each level, parents above children."""
    level: dict[int, int] = {}
    for v in G.topological(adjacency) or range(len(adjacency)):
        level[v] = 1 + max((level.get(u, -1) for u in G.parents(adjacency, v)), default=-1)
    rows: dict[int, list[int]] = {}
    for v, y in sorted(level.items()):
        rows.setdefault(y, []).append(v)
    return sorted((v, (i + 1) / (len(vs) + 1), -float(y)) for y, vs in rows.items() for i, v in enumerate(vs))


def _page(width: float, height: float, body: list[str]) -> str:
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width:g}" height="{height:g}" font-family="sans-serif" font-size="12">' + "".join(body) + "</svg>"


def network_svg(adjacency: np.ndarray, names: Sequence[str] | None = None, width: int = 640, gap: int = 90) -> str:
    at = {v: (x * width, 40 - y * gap) for v, x, y in layout(adjacency)}
    height = 80 + max((y for _, y in at.values()), default=0)
    body = ['<defs><marker id="end" viewBox="0 0 8 8" refX="8" refY="4" markerWidth="7" markerHeight="7" orient="auto"><path d="M0 0L8 4L0 8z"/></marker></defs>']
    for u, v in G.edges_of(adjacency):
        (x1, y1), (x2, y2) = at[u], at[v]
        r = 20 / max(np.hypot(x2 - x1, y2 - y1), 1e-9)
        body.append(f'<line x1="{x1 + (x2 - x1) * r:.1f}" y1="{y1 + (y2 - y1) * r:.1f}" x2="{x2 - (x2 - x1) * r:.1f}" y2="{y2 - (y2 - y1) * r:.1f}" stroke="#444" marker-end="url(#end)"/>')
    for v, (x, y) in at.items():
        body.append(f'<circle cx="{x:.1f}" cy="{y:.1f}" r="18" fill="#e8eefc" stroke="#4269d0"/><text x="{x:.1f}" y="{y + 4:.1f}" text-anchor="middle">{escape(names[v] if names else str(v))}</text>')
    return _page(width, height, body)


def bars_svg(table: np.ndarray, title: str, bar: int = 14, height: int = 120) -> str:
    """A bar for each state, a group for each row of the table."""
    q, k = table.shape
    group = bar * k + 12
    body = [f'<text x="8" y="16">{escape(title)}</text>']
    for c in range(q):
        for s in range(k):
            h = float(table[c, s]) * height
            body.append(f'<rect x="{8 + c * group + s * bar}" y="{24 + height - h:.1f}" width="{bar - 2}" height="{h:.1f}" fill="{COLOURS[s % len(COLOURS)]}"><title>{c}: {s} {table[c, s]:.4f}</title></rect>')
        body.append(f'<text x="{8 + c * group + bar * k / 2:.1f}" y="{height + 38}" text-anchor="middle">{c}</text>')
    return _page(16 + q * group, height + 48, body)
