"""Pictures and native charts inside office files."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.sources.files import safe_archive

MOST_IMAGES, MOST_IMAGE_BYTES, MOST_TOTAL_BYTES = 24, 20 << 20, 50 << 20
MOST_CHARTS, MOST_SERIES, MOST_POINTS = 24, 16, 256
_C = "{http://schemas.openxmlformats.org/drawingml/2006/chart}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
IMAGES = "source_file string, part string, extension string, image_hash string, length long, content binary, issue string"
POINTS = "source_file string, part string, title string, chart_type string, series int, series_name string, point int, category string, value double"


def _points(parent: ElementTree.Element | None) -> dict[int, str]:
    if parent is None:
        return {}
    found = {}
    for n, point in enumerate(parent.iter(f"{_C}pt")):
        text = (point.findtext(f"{_C}v") or "").strip()
        if text:
            found[int(point.get("idx", n))] = text
    return found


def chart_points(xml: bytes) -> Iterator[dict]:
    """The cached points of a native chart, category and value side by side."""
    root = ElementTree.fromstring(xml)
    title = " ".join(t.text.strip() for e in root.iter(f"{_C}title") for t in e.iter(f"{_A}t") if t.text and t.text.strip())
    kinds = [e.tag.removeprefix(_C).removesuffix("Chart") for area in root.iter(f"{_C}plotArea") for e in area if e.tag.endswith("Chart")]
    for n, series in enumerate([*root.iter(f"{_C}ser")][:MOST_SERIES], 1):
        label = series.find(f"{_C}tx")
        name = " ".join(e.text.strip() for e in (label.iter() if label is not None else ()) if e.tag in (f"{_C}v", f"{_A}t") and e.text and e.text.strip())
        first = lambda *tags: next((e for t in tags if (e := series.find(_C + t)) is not None), None)  # noqa: B023, E731
        categories, values = _points(first("cat", "xVal")), _points(first("val", "yVal"))
        for k in sorted({*categories, *values})[:MOST_POINTS]:
            try:
                value = float(values[k]) if k in values else None
            except ValueError:
                value = None
            yield {"title": title or None, "chart_type": kinds[0] if kinds else "unknown", "series": n, "series_name": name or f"Series {n}", "point": k, "category": categories.get(k, str(k + 1)), "value": value}


def _office(files: DataFrame) -> DataFrame:
    return files.filter(F.col("kind").isin(".docx", ".xlsx") & F.col("skip_reason").isNull()).select("source_file", "content")


def embedded_images(files: DataFrame) -> DataFrame:
    """Images of office files; one over a limit is an issue and takes nothing of the byte budget."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for f in frame.itertuples():
                rows, used, kept = [], 0, 0
                try:
                    archive = safe_archive(f.content)
                    parts = sorted(n for n in archive.namelist() if re.search(r"/media/[^/]+\.(png|jpe?g|gif|bmp|webp|tiff?)$", n, re.I))
                    for part in parts:
                        size = archive.getinfo(part).file_size
                        issue = "too_many_images" if kept >= MOST_IMAGES else "image_too_large" if size > MOST_IMAGE_BYTES else "image_budget" if used + size > MOST_TOTAL_BYTES else None
                        data = None if issue else archive.read(part)
                        used, kept = used + (0 if issue else size), kept + (not issue)
                        rows.append((f.source_file, part, part.rsplit(".", 1)[1].lower(), hashlib.sha256(data).hexdigest() if data is not None else None, size, data, issue))
                except Exception as error:  # a bad archive is a row, it must not fail the others
                    rows.append((f.source_file, None, None, None, 0, None, str(error)[:200] or type(error).__name__))
                yield pd.DataFrame(rows, columns=[c.split(" ")[0] for c in IMAGES.split(", ")])

    return _office(files).mapInPandas(read, IMAGES)


def charts(files: DataFrame) -> DataFrame:
    """The points of the native charts of office files."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split(" ")[0] for c in POINTS.split(", ")]
        for frame in frames:
            for f in frame.itertuples():
                rows = []
                try:
                    archive = safe_archive(f.content)
                    for part in sorted(n for n in archive.namelist() if re.search(r"/charts/chart\d*\.xml$", n))[:MOST_CHARTS]:
                        rows += [{"source_file": f.source_file, "part": part} | p for p in chart_points(archive.read(part))]
                except Exception:  # reported by embedded_images
                    rows = []
                yield pd.DataFrame(rows, columns=names)

    return _office(files).mapInPandas(read, POINTS)
