"""An HTML page of run summaries."""

from __future__ import annotations

import html
import json
from pathlib import Path


def flatten(value: dict, prefix: str = "") -> dict[str, object]:
    """Nested dictionaries under dotted names."""
    out: dict[str, object] = {}
    for key, x in value.items():
        out |= flatten(x, f"{prefix}{key}.") if isinstance(x, dict) else {f"{prefix}{key}": x}
    return out


def page(summaries: list[dict]) -> str:
    """One table a summary, numbers to six places."""
    show = lambda x: f"{x:.6g}" if isinstance(x, float) else html.escape(str(x))
    cards = []
    for s in summaries:
        rows = "".join(f"<tr><th>{html.escape(k)}</th><td>{show(v)}</td></tr>" for k, v in sorted(flatten(s).items()))
        cards.append(f"<table>{rows}</table>")
    return "<!DOCTYPE html><html><head><meta charset='utf-8'><title>Runs</title></head><body>" + "".join(cards) + "</body></html>"


def write(source: str, out: str) -> None:
    """A report from JSON Lines on the driver's disk."""
    write_page([json.loads(x) for x in Path(source).read_text(encoding="utf-8").splitlines() if x.strip()], out)


def write_page(summaries: list[dict], out: str) -> None:
    """The page of some summaries on the driver's disk; it appears whole or not at all."""
    target = Path(out)
    partial = target.with_suffix(".part")
    partial.write_text(page(summaries), encoding="utf-8")
    partial.replace(target)
