"""Sizes of image files, read from their headers.

PNG, GIF and WebP state their size at fixed places, which Spark reads from the
stored bytes.  A JPEG states it in a frame segment that may stand anywhere, so
only JPEG bodies go to Python, where all files of a batch are searched at once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the file formats.
LEAST_BYTES = 24
PNG, GIF, RIFF, WEBP, JPEG = b"\x89PNG", b"GIF", b"RIFF", b"WEBP", b"\xff\xd8"
NOT_FRAMES = (0xC4, 0xC8, 0xCC)
IS_FRAME = np.zeros(256, bool)
IS_FRAME[0xC0:0xD0] = True
IS_FRAME[list(NOT_FRAMES)] = False


def _has(content: Column, value: bytes, at: int = 0) -> Column:
    return F.substring(content, at + 1, len(value)) == F.lit(bytearray(value))


def _number(content: Column, at: int, size: int, little: bool) -> Column:
    """Unsigned number of ``size`` bytes at a fixed place."""
    places = range(at, at + size) if little else range(at + size - 1, at - 1, -1)
    parts = [F.conv(F.hex(F.substring(content, p + 1, 1)), 16, 10).cast("bigint") * 256**i for i, p in enumerate(places)]
    return sum(parts[1:], parts[0])


def frame_sizes(bodies: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Width and height of each JPEG body, 0 where no frame is found.

    Every file has a cursor.  In each round all open cursors move to the next
    marker byte at or behind them, looked up in the sorted places of all marker
    bytes; files at a frame are done, the others pass over their segment.
    """
    bodies = bodies.cast(pa.large_binary())
    width, height = np.zeros(len(bodies), np.int64), np.zeros(len(bodies), np.int64)
    _, offsets, values = bodies.buffers()
    if values is None:
        return width, height
    data = np.frombuffer(values, np.uint8)
    ends = np.frombuffer(offsets, np.int64)[bodies.offset: bodies.offset + len(bodies) + 1]
    marks = np.append(np.flatnonzero(data == 0xFF), len(data))
    cursor = ends[:-1] + len(JPEG)
    still = np.flatnonzero(ends[1:] > ends[:-1])
    pair = lambda at: data[at].astype(np.int64) * 256 + data[at + 1]
    while len(still):
        at = marks[np.searchsorted(marks, np.minimum(cursor[still], len(data)))]
        room = at + 9 < ends[1:][still]
        still, at = still[room], at[room]
        frame = IS_FRAME[data[at + 1]]
        height[still[frame]], width[still[frame]] = pair(at[frame] + 5), pair(at[frame] + 7)
        still, at = still[~frame], at[~frame]
        cursor[still] = at + 2 + pair(at + 2)
    return width, height


@F.arrow_udf(T.StructType([T.StructField("width", T.LongType()), T.StructField("height", T.LongType())]))
def jpeg_size(content: pa.Array) -> pa.Array:
    width, height = frame_sizes(content)
    return pa.StructArray.from_arrays([pa.array(width), pa.array(height)], names=["width", "height"])


def image_inventory(files: DataFrame, content: str = "content") -> DataFrame:
    """Adds width, height and mime; all null where the header cannot be read."""
    c = F.col(content)
    number = lambda at, size, little=True: _number(c, at, size, little)
    long_enough = F.length(c) >= LEAST_BYTES
    webp = _has(c, RIFF) & _has(c, WEBP, 8)
    extended = _has(c, b"VP8X", 12) & (F.length(c) >= 30)
    lossy = _has(c, b"VP8 ", 12) & (F.length(c) > 30)
    mime = (
        F.when(_has(c, PNG), "image/png").when(_has(c, GIF), "image/gif").when(webp, "image/webp")
        .when(_has(c, JPEG), "image/jpeg"))
    marked = files.withColumn("_mime", F.when(long_enough, mime))
    # Bodies of other formats are not handed to Python.
    marked = marked.withColumn("_jpeg", jpeg_size(F.when(F.col("_mime") == "image/jpeg", c)))

    def side(png: Column, gif: Column, vp8x: Column, vp8: Column, jpeg: Column) -> Column:
        return (
            F.when(F.col("_mime") == "image/png", png).when(F.col("_mime") == "image/gif", gif)
            .when(F.col("_mime") == "image/webp", F.when(extended, vp8x).when(lossy, vp8).otherwise(0))
            .when(F.col("_mime") == "image/jpeg", F.nullif(jpeg, F.lit(0))))

    width = side(number(16, 4, False), number(6, 2), number(24, 3) + 1, number(26, 2) % 2**14, F.col("_jpeg.width"))
    height = side(number(20, 4, False), number(8, 2), number(27, 3) + 1, number(28, 2) % 2**14, F.col("_jpeg.height"))
    frameless = (F.col("_mime") == "image/jpeg") & (F.col("_jpeg.width") == 0) & (F.col("_jpeg.height") == 0)
    return marked.withColumns({
        "width": width, "height": height, "mime": F.when(~F.coalesce(frameless, F.lit(False)), F.col("_mime")),
    }).select(*files.columns, "width", "height", "mime", F.length(content).cast("bigint").alias("bytes")).drop(content)


def read_image_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
