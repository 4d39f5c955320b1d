"""Preparation of images for text recognition (S10) and tables of HTML pages (S9), with NumPy and the standard library."""

from __future__ import annotations

from html.parser import HTMLParser

import numpy as np

BLOCK, OFFSET, SMOOTH, MOST_DEGREES = 31, 10, 3, 45.0


def gray(image: np.ndarray) -> np.ndarray:
    """Luminance of an image of height x width (x 3 or 4) bytes."""
    return image.astype(float) if image.ndim == 2 else image[..., :3].astype(float) @ np.array([0.299, 0.587, 0.114])


def box_mean(image: np.ndarray, size: int) -> np.ndarray:
    """Mean over size x size neighbours; edges repeat."""
    half = size // 2
    padded = np.pad(image, half, mode="edge")
    total = np.pad(padded.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    return (total[size:, size:] - total[:-size, size:] - total[size:, :-size] + total[:-size, :-size]) / (size * size)


def denoised(image: np.ndarray, size: int = SMOOTH) -> np.ndarray:
    """Median of size x size neighbours."""
    padded = np.pad(image, size // 2, mode="edge")
    return np.median(np.lib.stride_tricks.sliding_window_view(padded, (size, size)), axis=(2, 3))


def thresholded(image: np.ndarray, block: int = BLOCK, offset: float = OFFSET) -> np.ndarray:
    """255 where a pixel is brighter than its neighbourhood's mean less ``offset``, else 0."""
    return np.where(image > box_mean(image, block) - offset, 255, 0).astype(np.uint8)


def skew(image: np.ndarray) -> float:
    """Degrees by which lines of dark pixels rise to the right: of turns by whole and then tenths of a degree, the one whose rows differ most."""
    y, x = np.nonzero(image < 128)
    if len(y) < 2:
        return 0.0

    def sharpness(degrees: float) -> float:
        a = np.deg2rad(degrees)
        rows = np.round(y * np.cos(a) + x * np.sin(a)).astype(int)
        return float((np.bincount(rows - rows.min()).astype(float) ** 2).sum())

    whole = max(np.arange(-MOST_DEGREES + 1, MOST_DEGREES), key=lambda d: (sharpness(d), -abs(d)))
    return float(max(np.arange(whole - 1, whole + 1.01, 0.1), key=lambda d: (sharpness(d), -abs(d))))


def turned(image: np.ndarray, degrees: float) -> np.ndarray:
    """The image turned clockwise about its middle, by nearest pixels; what comes in is white."""
    a = np.deg2rad(degrees)
    h, w = image.shape
    y, x = np.indices((h, w))
    y, x = y - h / 2, x - w / 2
    from_y, from_x = np.round(y * np.cos(a) - x * np.sin(a) + h / 2).astype(int), np.round(y * np.sin(a) + x * np.cos(a) + w / 2).astype(int)
    inside = (from_y >= 0) & (from_y < h) & (from_x >= 0) & (from_x < w)
    return np.where(inside, image[np.clip(from_y, 0, h - 1), np.clip(from_x, 0, w - 1)], 255).astype(np.uint8)


def prepared(image: np.ndarray) -> np.ndarray:
    """Gray, without specks, black on white, and upright if it was turned by less than MOST_DEGREES."""
    flat = thresholded(denoised(gray(image)))
    degrees = skew(flat)
    return turned(flat, degrees) if 0.1 <= abs(degrees) < MOST_DEGREES else flat


class _Tables(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tables: list[list[list[str]]] = []
        self.open: list[list[list[str]]] = []
        self.cell: list[str] | None = None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "table":
            self.open.append([])
            self.tables.append(self.open[-1])
        elif self.open and tag == "tr":
            self.open[-1].append([])
        elif self.open and tag in ("td", "th"):
            if not self.open[-1]:
                self.open[-1].append([])
            self.cell = []
            self.open[-1][-1].append("")

    def handle_endtag(self, tag: str) -> None:
        if tag == "table" and self.open:
            self.open.pop()
        if tag in ("td", "th", "tr", "table"):
            self.cell = None

    def handle_data(self, data: str) -> None:
        if self.cell is not None:
            self.cell.append(data)
            self.open[-1][-1][-1] = " ".join("".join(self.cell).split())


def html_tables(html: str) -> list[list[list[str]]]:
    """Rows of cells of each table, in page order; a table in a cell is one of its own."""
    reader = _Tables()
    reader.feed(html or "")
    reader.close()
    return [t for t in reader.tables if any(c for row in t for c in row)]
