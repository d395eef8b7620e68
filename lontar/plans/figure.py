"""A forest plot of effect rows as SVG: one line for each condition, drawn without any plotting package."""

from __future__ import annotations

from html import escape

WIDTH, LABELS, ROW = 720, 220, 28


def forest_svg(rows: list[dict], title: str = "") -> str:
    """``rows``: condition, mean_delta, ci_low, ci_high, cliffs_delta, n_pairs."""
    ends = [0.0, *(r[k] for r in rows for k in ("ci_low", "ci_high", "mean_delta"))]
    low, high = min(ends), max(ends)
    span = (high - low) or 1.0
    low, span = low - 0.05 * span, 1.1 * span

    def x(value: float) -> float:
        return LABELS + (WIDTH - LABELS - 150) * (value - low) / span

    height = ROW * (len(rows) + 2)
    out = [f'<svg xmlns="http://www.w3.org/2000/svg" width="{WIDTH}" height="{height}" font-family="sans-serif" font-size="12">', f'<text x="8" y="18" font-weight="bold">{escape(title)}</text>']
    out.append(f'<line x1="{x(0):.1f}" y1="{ROW}" x2="{x(0):.1f}" y2="{height - ROW / 2}" stroke="#888" stroke-dasharray="4 3"/>')
    for k, r in enumerate(rows):
        y = ROW * (k + 1.5)
        out.append(f'<text x="8" y="{y + 4}">{escape(str(r["condition"]))}</text>')
        out.append(f'<line x1="{x(r["ci_low"]):.1f}" y1="{y}" x2="{x(r["ci_high"]):.1f}" y2="{y}" stroke="#000"/>')
        out.append(f'<circle cx="{x(r["mean_delta"]):.1f}" cy="{y}" r="4"/>')
        out.append(f'<text x="{WIDTH - 145}" y="{y + 4}">{r["mean_delta"]:+.4f}, d {r["cliffs_delta"]:+.2f}, n {r["n_pairs"]}</text>')
    return "\n".join([*out, "</svg>"])
