"""Media columns: payloads stored as lossless WebP images, and images read into pixel arrays.

Each row is stored, read back and measured on its own, so equal payloads give equal
values.  Null texts count as empty.  A payload is padded with 255 to a positive
multiple of `row_bytes`, one image row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as K
from .common import small_batches
from .webp import decode, encode

#: Rows of an image, so that what encoding and decoding it takes is bounded; longer payloads become several files, one after the other.
MOST_ROWS = 4096


def to_media(payload: np.ndarray, width: int) -> bytes:
    """Files of RGBA images `width` pixels wide."""
    rows = payload.reshape(-1, width, 4)
    return b"".join(encode(rows[at:at + MOST_ROWS]) for at in range(0, len(rows), MOST_ROWS))


def from_media(data: bytes) -> list[np.ndarray]:
    """The images of a media value, in order."""
    out, view = [], data
    while view:
        _, _, samples, used = decode(view)
        out.append(samples)
        view = view[used:]
    return out


def feature(images: list[np.ndarray]) -> str:
    """Sides, and for each channel the mean, the deviation and the number of values."""
    height, width = sum(len(x) for x in images), images[0].shape[1]
    parts = [f"{width}x{height}"]
    for name, channel in zip("rgba", range(4), strict=True):
        counts = sum(np.bincount(x[:, :, channel].reshape(-1), minlength=256) for x in images)
        n, values = counts.sum(), np.arange(256)
        mean = (counts * values).sum() / n
        spread = max(0.0, (counts * values * values).sum() / n - mean * mean) ** 0.5
        parts.append(f"{name}={mean:.3f},{spread:.3f},{(counts > 0).sum()}")
    return ";".join(parts)


def store_texts(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", row_bytes: int = 576) -> DataFrame:
    """One row for each row: id, n_bytes, media, pixels (the samples read back), feature."""
    if row_bytes % 4:
        raise ValueError("row_bytes must be a multiple of four")

    def run(batches):
        for batch in batches:
            for first, data, offsets in K.chunks(batch.column(1)):
                media, pixels, features = [], [], []
                for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    payload = np.full(max(1, -(-(b - a) // row_bytes)) * row_bytes, 255, np.uint8)
                    payload[:b - a] = data[a:b]
                    media.append(to_media(payload, row_bytes // 4))
                    images = from_media(media[-1])
                    pixels.append(b"".join(x.tobytes() for x in images))
                    features.append(feature(images))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(offsets) - 1), pa.array(np.diff(offsets)), pa.array(media, pa.binary()), pa.array(pixels, pa.binary()), pa.array(features)],
                                                 ["id", "n_bytes", "media", "pixels", "feature"])

    base = small_batches(docs).select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    return base.mapInArrow(run, "id long, n_bytes long, media binary, pixels binary, feature string").withColumnRenamed("id", id_column)


def read_media(table: DataFrame, media_column: str = "media", id_column: str = "doc_id") -> DataFrame:
    """One row for each image of each row: id, frame, width, height, pixels (RGBA samples).

    Null media give no rows; a value that cannot be read gives one row whose other columns are null.
    """
    def run(batches):
        for batch in batches:
            rows = []
            for id_, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if value.is_valid:
                    try:
                        rows += [(id_, i, x.shape[1], x.shape[0], x.tobytes()) for i, x in enumerate(from_media(value.as_py()))]
                    except (ValueError, IndexError):  # what damaged files raise
                        rows.append((id_, None, None, None, None))
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(5)], ["id", "frame", "width", "height", "pixels"])

    base = table.select(F.col(id_column).cast("long").alias("id"), F.col(media_column).alias("media"))
    return base.mapInArrow(run, "id long, frame int, width int, height int, pixels binary").withColumnRenamed("id", id_column)
