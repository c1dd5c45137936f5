"""Texts as lossless WebP images: stored, read back, and described."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wickwork.llm.webp import SIDE, decode, encode

#: Payloads are padded with bytes 255 to a multiple of this: one row of 144 pixels of four samples.
ROW_BYTES = 576


def payload(text: str | None) -> bytes:
    raw = (text or "").encode("utf-8")
    return raw + b"\xff" * (max(1, -(-len(raw) // ROW_BYTES)) * ROW_BYTES - len(raw))


def to_image(data: bytes) -> bytes:
    """A WebP file whose samples (alpha, red, green, blue) are the bytes in turn; images too high for the format get wider rows, padded with 255."""
    pixels = np.frombuffer(data, np.uint8).reshape(-1, 4)
    width = ROW_BYTES // 4
    while -(-len(pixels) // width) > SIDE:
        width += ROW_BYTES // 4
    short = -len(pixels) % width
    return encode(np.concatenate([pixels, np.full((short, 4), 255, np.uint8)]) if short else pixels, width)


def feature(width: int, height: int, pixels: np.ndarray) -> str:
    """Size, mean of each channel in 1/256, and an 8 x 8 average hash of the sample means, as text."""
    means = pixels.sum(axis=0, dtype=np.int64) * 256 // len(pixels)
    edges = np.linspace(0, len(pixels), 65).astype(int)
    total = np.concatenate([[0], np.cumsum(pixels.sum(axis=1, dtype=np.int64))])
    cell = (total[edges[1:]] - total[edges[:-1]]) * len(pixels) > total[-1] * np.diff(edges)
    return f"{width}x{height}:" + ",".join(map(str, means.tolist())) + ":" + np.packbits(cell).tobytes().hex()


def text_images(docs: DataFrame, text: str = "text", keep_media: bool = True) -> DataFrame:
    """Adds n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature and, with keep_media, media (the WebP file) and pixels (the array read back).

    Whole texts, row by row; null counts as empty, and an empty text is one row of bytes 255. Everything but n_bytes, media_bytes
    and media_sha256 is computed from the decoded file. Equal texts give equal values. Other columns are carried, columns with the added names replaced.
    """
    kinds = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string" + ", media binary, pixels binary" * keep_media
    names = [x.split()[0] for x in kinds.split(", ")]
    base = docs.drop(*names, "media", "pixels")

    @F.pandas_udf(kinds)
    def solve(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for x in texts:
                data = payload(x)
                media = to_image(data)
                width, height, pixels = decode(media)
                back = pixels.tobytes()[: len(data)]
                rows.append((len((x or "").encode()), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature(width, height, pixels), *[media, back][: 2 * keep_media]))
            yield pd.DataFrame(rows, columns=names)

    return base.withColumn("_m", solve(F.col(text))).select(*base.columns, *[F.col(f"_m.{n}").alias(n) for n in names])
