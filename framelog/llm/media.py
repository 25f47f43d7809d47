"""Media columns: bytes stored in progressive JPEG files, decoded to coefficients and full-resolution RGB tensors.

Each row is worked on alone in a narrow pass, so a lost executor costs its rows and nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from framelog.llm import jpeg


def padded(text: str | None) -> tuple[int, bytes]:
    """Bytes of a text, and the text filled up with bytes 0 to a positive multiple of 64."""
    data = (text or "").encode()
    return len(data), data + b"\0" * (-len(data) % 64 if data else 64)


def describe(rgb: np.ndarray) -> str:
    """Size, mean of each channel in thousandths and CRC of an RGB tensor."""
    h, w, _ = rgb.shape
    means = rgb.reshape(-1, 3).sum(axis=0, dtype=np.int64) * 1000 // (h * w)
    return f"{w}x{h} rgb={','.join(map(str, means))} crc={zlib.crc32(np.ascontiguousarray(rgb)):08x}"


def encode_media(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media binary): every text stored as a progressive JPEG. Null is an empty text; an empty text is 64 bytes 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            both = [padded(t.as_py()) for t in b.column(1)]
            media = [jpeg.store(p) for _, p in both]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([n for n, _ in both], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary")


def decode_rgb(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, width, height, rgb binary, error): the tensor of each progressive JPEG in ``media``, rows of pixels of 3 bytes.

    A null file gives nulls; one that can't be decoded gives nulls and what is wrong with it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, m in enumerate(b.column(1)):  # a tensor is large: one row at a time
                data, row = m.as_py(), (None, None, None, None)
                if data is not None:
                    try:
                        t = jpeg.Decoder(data).rgb()
                        row = (t.shape[1], t.shape[0], t.tobytes(), None)
                    except (jpeg.JpegError, IndexError, KeyError) as e:
                        row = (None, None, None, str(e) or type(e).__name__)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, 1), *(pa.array([x], k) for x, k in zip(row, (pa.int32(), pa.int32(), pa.binary(), pa.string()), strict=True))], names=["id", "width", "height", "rgb", "error"]
                )

    kind = media.schema[id_col].dataType.simpleString()
    return media.select(id_col, "media").mapInArrow(run, f"id {kind}, width int, height int, rgb binary, error string").withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature) of every row of docs (doc_id, text).

    The payload digests are of what is read back from the stored file; feature describes the decoded RGB tensor. Null and empty texts
    are 64 bytes 0. Repeated rows and null ids are rows like any other; an empty table gives no rows; other columns are ignored.
    """
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def row(text: str | None) -> tuple:
        n, payload = padded(text)
        file = jpeg.store(payload)
        decoded = jpeg.Decoder(file)
        back = jpeg.load(decoded)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        return n, len(back), sha(back), zlib.crc32(back[-64:]), len(file), sha(file), describe(decoded.rgb())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = zip(*rows) if (rows := [row(t.as_py()) for t in b.column(1)]) else ((),) * 7
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return docs.select("doc_id", "text").mapInArrow(run, schema)
