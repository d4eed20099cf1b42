"""Plug-in points for image models: readers and detectors by name, loaded once a worker, in Arrow batches.

No model is part of this package: the `none` backend returns nothing, and quality measures use numpy only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.presence import col, text
from ..schema import BOX_TYPE

# Names that mean the same reader.
READER_NAMES = {"": "auto", "auto": "auto", "none": "none", "off": "none", "disabled": "none", "no": "none", "paddle": "paddleocr", "paddleocr": "paddleocr", "easy": "easyocr", "easyocr": "easyocr"}
_readers: dict[str, Callable[[], Callable]] = {"none": lambda: lambda image: []}
_detectors: dict[str, Callable[[], Callable]] = {"none": lambda: lambda image: []}


def reader_name(x) -> Column:
    """Canonical reader name; unknown names mean auto. [U1]"""
    key = F.regexp_replace(F.lower(text(x)), "[-_ ]", "")
    return F.coalesce(F.element_at(F.create_map(*(F.lit(v) for kv in READER_NAMES.items() for v in kv)), key), F.lit("auto"))


def register_reader(name: str, load: Callable[[], Callable]) -> None:
    """load() gives a function from image bytes to a list of (text, conf, x0, y0, x1, y1). [U1]"""
    _readers[name] = load


def register_detector(name: str, load: Callable[[], Callable]) -> None:
    """load() gives a function from image bytes to a list of (x_min, y_min, x_max, y_max, confidence, cls_name). [U2]"""
    _detectors[name] = load


def _map(df: DataFrame, image: str, load: Callable, out: str, kind: str, fields: list[str]) -> DataFrame:
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name != image) + f", {out} {kind}"
    keep = [c for c in df.columns if c != image]

    def run(batches: Iterator) -> Iterator:
        model = load()
        for pdf in batches:
            found = []
            for raw in pdf[image]:
                try:
                    found.append([dict(zip(fields, r, strict=True)) for r in model(raw)])
                except Exception:  # noqa: BLE001 - a crop that can't be read has no boxes
                    found.append([])
            yield pdf[keep].assign(**{out: found})

    return df.mapInPandas(run, schema)


def read_text(df: DataFrame, reader: str = "none", image: str = "image") -> DataFrame:
    """df with `boxes` in place of the image column; images that fail have none. [U1, U8]"""
    return _map(df, image, _readers.get(reader, _readers["none"]), "boxes", BOX_TYPE, ["text", "conf", "x0", "y0", "x1", "y1"])


def detect(df: DataFrame, detector: str = "none", image: str = "image") -> DataFrame:
    """df with `detections` in place of the image column. [U2]"""
    kind = "array<struct<x_min:double,y_min:double,x_max:double,y_max:double,confidence:double,cls_name:string>>"
    return _map(df, image, _detectors.get(detector, _detectors["none"]), "detections", kind, ["x_min", "y_min", "x_max", "y_max", "confidence", "cls_name"])


def proposal_confidence(colour, edge) -> Column:
    """Confidence of a proposal by its shares of tag colours and of text edges; those under 0.25 don't count. [U3]"""
    return F.least(F.lit(0.99), 0.20 + 0.45 * col(colour) + 0.35 * col(edge))


def image_quality(gray) -> tuple[float, float, float]:
    """(sharpness, contrast, glare) of a grey image array: variance of the Laplacian, standard deviation, share of pixels over 245. [U5]"""
    import numpy as np

    g = np.asarray(gray, np.float64)
    if g.ndim != 2 or min(g.shape) < 3:
        return 0.0, 0.0, 0.0
    lap = g[:-2, 1:-1] + g[2:, 1:-1] + g[1:-1, :-2] + g[1:-1, 2:] - 4 * g[1:-1, 1:-1]
    return float(lap.var()), float(g.std()), float((g > 245).mean())


def quality_of(df: DataFrame, image: str = "image", height: str = "height", width: str = "width") -> DataFrame:
    """df with sharpness, contrast and glare in place of a column of raw grey bytes. [U5]"""
    keep = [c for c in df.columns if c != image]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name != image) + ", sharpness double, contrast double, glare double"

    def run(batches: Iterator) -> Iterator:
        import numpy as np

        for pdf in batches:
            rows = []
            for raw, h, w in zip(pdf[image], pdf[height], pdf[width], strict=True):
                ok = raw is not None and len(raw) == h * w
                rows.append(image_quality(np.frombuffer(raw, np.uint8).reshape(h, w)) if ok else (0.0, 0.0, 0.0))
            s, c, g = zip(*rows, strict=True) if rows else ((), (), ())
            yield pdf[keep].assign(sharpness=list(s), contrast=list(c), glare=list(g))

    return df.mapInPandas(run, schema)
