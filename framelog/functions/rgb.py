"""Full decoding of payloads, only where a decoder is installed on the executors. Nothing else here needs one."""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf


def _decoder():  # noqa: ANN202
    """A function from bytes to a height x width x 3 array, RGB; looked for at the first call."""
    try:
        import cv2

        def read(data: bytes) -> np.ndarray:
            image = cv2.imdecode(np.frombuffer(data, np.uint8), cv2.IMREAD_COLOR)
            if image is None:
                raise ValueError("not an image")
            return image[:, :, ::-1]

        return read
    except ImportError:
        pass
    try:
        from PIL import Image
    except ImportError:
        raise RuntimeError("decoding needs cv2 or PIL on the executors") from None
    return lambda data: np.asarray(Image.open(io.BytesIO(data)).convert("RGB"))


def decode_rgb(data: Column | str) -> Column:
    """struct<width, height, rgb binary> of payloads; an error if no decoder is installed."""

    def run(batch: pd.Series) -> pd.DataFrame:
        read = _decoder()
        images = [read(d) if d is not None else None for d in batch]
        rows = [(i.shape[1], i.shape[0], np.ascontiguousarray(i).tobytes()) if i is not None else (None, None, None) for i in images]
        return pd.DataFrame(rows, columns=["width", "height", "rgb"]).astype({"width": "Int32", "height": "Int32"})

    return pandas_udf(run, "struct<width:int,height:int,rgb:binary>")(data)
