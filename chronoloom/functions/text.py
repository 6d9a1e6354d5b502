"""Sizes of texts, from a table of how far each character moves on.

Fonts belong to whoever draws; a table of advances (parts of the font size, with
one for all other characters) is enough to break lines and to size a text.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .media import batched


def broken(text: str, advances: dict[str, float], other: float, size: float, most: float | None) -> list[float]:
    """Widths of the lines: words go to the next line where they don't fit, a longer word is broken between characters."""
    width = lambda s: sum(advances.get(c, other) for c in s) * size
    lines = []
    for paragraph in text.split("\n"):
        line = ""
        for i, word in enumerate(paragraph.split(" ")):
            longer = f"{line} {word}" if i else word
            if most is None or width(longer) <= most:
                line = longer
                continue
            if line:
                lines.append(width(line))
            line = ""
            for c in word:
                if line and width(line + c) > most:
                    lines.append(width(line))
                    line = ""
                line += c
        lines.append(width(line))
    return lines


def text_size(text: Column, size: Column, line_height: Column, mode: Column, width: Column, height: Column, advances: dict[str, float] | None = None, other: float = 0.6) -> Column:
    """Struct (width, height, n_lines) of a drawn text.

    ``mode``: fixed (the size that is given), fitted (the smallest that holds
    it, up to a greatest width) or fitted_column (that width, and the height it
    needs).  Below the last line there is a fifth of the font size.
    """
    table = advances or {}

    @batched("struct<width:long,height:long,n_lines:long>")
    def measure(text: pd.Series, size: pd.Series, line: pd.Series, mode: pd.Series, width: pd.Series, height: pd.Series) -> pd.DataFrame:
        rows = []
        for t, s, h, m, w, tall in zip(text, size, line, mode, width, height, strict=True):
            lines = broken(t or "", table, other, s, None if m == "fixed" and not w == w else w)
            need = int(len(lines) * math.ceil(h) + s / 5)
            if m == "fixed":
                rows.append((int(w), int(tall), len(lines)))
            else:
                most = int(tall // math.ceil(h)) if tall == tall and tall is not None else len(lines)
                shown = lines[: max(0, most)]
                need = int(len(shown) * math.ceil(h) + s / 5)
                rows.append((int(w) if m == "fitted_column" else math.ceil(max(shown, default=0.0) - 1e-9), need, len(shown)))
        return pd.DataFrame(rows, columns=["width", "height", "n_lines"])

    return measure(text, *[c.cast("double") for c in (size, line_height)], mode, *[F.coalesce(c.cast("double"), F.lit(float("nan"))) for c in (width, height)])
