"""Images as arrays: resize, crop, rotate, standardise, convert. Cells are binary in the .npy or portable pixmap format."""

from __future__ import annotations

import io
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def read(cell: bytes) -> np.ndarray:
    """A height x width x channels array from .npy or binary PPM / PGM bytes."""
    if cell[:6] == b"\x93NUMPY":
        return np.load(io.BytesIO(cell), allow_pickle=False)
    kind, w, h, _ = cell[:64].split(None, 4)[:4]
    channels = 3 if kind == b"P6" else 1
    return np.frombuffer(cell[-int(w) * int(h) * channels :], np.uint8).reshape(int(h), int(w), channels)


def write(image: np.ndarray, kind: str = "npy") -> bytes:
    if kind == "npy":
        out = io.BytesIO()
        np.save(out, image)
        return out.getvalue()
    x = np.clip(image, 0, 255).astype(np.uint8)
    grey = kind == "pgm"
    if grey and x.ndim == 3 and x.shape[2] == 3:
        x = np.rint(x @ np.array([0.299, 0.587, 0.114])).astype(np.uint8)[:, :, None]
    return b"P%d %d %d 255\n" % (5 if grey else 6, x.shape[1], x.shape[0]) + x.tobytes()


def _cellwise(f: Callable[[np.ndarray], np.ndarray], kind: str = "npy"):
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda b: None if b is None else write(f(read(bytes(b))), kind))

    return F.pandas_udf(run, "binary")


def resize(c: str, height: int, width: int) -> Column:
    """Nearest pixels."""
    def f(x: np.ndarray) -> np.ndarray:
        return x[(np.arange(height) * x.shape[0] // height)[:, None], (np.arange(width) * x.shape[1] // width)[None, :]]

    return _cellwise(f)(F.col(c))


def crop(c: str, top: int, left: int, height: int, width: int) -> Column:
    return _cellwise(lambda x: x[top : top + height, left : left + width])(F.col(c))


def rotate(c: str, quarters: int = 1) -> Column:
    """Counter-clockwise by quarter turns."""
    return _cellwise(lambda x: np.rot90(x, quarters))(F.col(c))


def standardise(c: str) -> Column:
    """To mean 0 and deviation 1 of the whole image."""
    return _cellwise(lambda x: (x - x.mean()) / (x.std() or 1.0))(F.col(c))


def convert(c: str, kind: str) -> Column:
    """npy, ppm or pgm."""
    return _cellwise(lambda x: x, kind)(F.col(c))
