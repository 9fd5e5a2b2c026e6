"""Image files as grey or coloured pixels, and back: PNG and binary netpbm, by zlib and array operations alone."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Channels of a PNG's colour types: grey, red-green-blue, palette, grey and alpha, red-green-blue and alpha.
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def grey(pixels: np.ndarray) -> np.ndarray:
    """Rounded luma of the last axis; one or two channels are grey already, a fourth is not looked at."""
    if pixels.shape[-1] < 3:
        return pixels[..., 0]
    return np.rint(pixels[..., :3].astype(np.float64) @ np.array([0.299, 0.587, 0.114])).astype(np.uint8)


def colours(pixels: np.ndarray) -> np.ndarray:
    """Red, green and blue; one or two channels are grey, a fourth is not looked at."""
    return pixels[..., :3] if pixels.shape[-1] > 2 else np.repeat(pixels[..., :1], 3, axis=-1)


def decode(data: bytes) -> np.ndarray:
    """Height by width of grey values."""
    return grey(channels(data))


def channels(data: bytes) -> np.ndarray:
    """Height by width by channels; what is no 8-bit PNG without interlacing, and no P5 or P6 file, is an error."""
    if data[:2] in (b"P5", b"P6"):
        return _netpbm(data)
    if not data.startswith(SIGNATURE):
        raise ValueError("neither PNG nor netpbm")
    at, packed, palette, head = len(SIGNATURE), [], None, None
    while at + 8 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + size]
        if len(body) < size or zlib.crc32(kind + body) != struct.unpack_from(">I", data, at + 8 + size)[0]:
            raise ValueError("broken chunk")
        at += size + 12
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            packed.append(body)
        elif kind == b"IEND":
            break
    if head is None or head[2] != 8 or head[6] != 0 or head[3] not in CHANNELS:
        raise ValueError("unsupported kind of PNG")
    width, height, n = head[0], head[1], CHANNELS[head[3]]
    rows = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, 1 + width * n)
    pixels = _unfiltered(rows, n).reshape(height, width, n)
    return palette[pixels[..., 0]] if head[3] == 3 else pixels


def _unfiltered(rows: np.ndarray, channels: int) -> np.ndarray:
    """Undoes each row's filter: none, left, above, their mean, or the nearest of left, above and corner."""
    out = np.zeros((len(rows) + 1, rows.shape[1] - 1 + channels), np.int64)  # a row above and a pixel to the left of zeros
    for y, row in enumerate(rows, 1):
        kind, raw, above = int(row[0]), row[1:].astype(np.int64), out[y - 1]
        if kind in (0, 2):
            out[y, channels:] = (raw + above[channels:] * (kind == 2)) & 255
        elif kind == 1:
            out[y, channels:] = (np.cumsum(raw.reshape(-1, channels), axis=0) & 255).ravel()
        elif kind in (3, 4):
            now = out[y]
            for i in range(channels, len(now)):
                a, b, c = int(now[i - channels]), int(above[i]), int(above[i - channels])
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    guess = min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]
                now[i] = (raw[i - channels] + guess) & 255
        else:
            raise ValueError("unknown filter")
    return out[1:, channels:].astype(np.uint8)


def _netpbm(data: bytes) -> np.ndarray:
    fields, at = [], 2
    while len(fields) < 3:
        while data[at : at + 1].isspace() or data[at : at + 1] == b"#":
            at = data.index(b"\n", at) + 1 if data[at : at + 1] == b"#" else at + 1
        end = at
        while data[end : end + 1].isdigit():
            end += 1
        fields.append(int(data[at:end]))
        at = end
    width, height, most = fields
    channels = 1 if data[:2] == b"P5" else 3
    body = np.frombuffer(data, np.uint8, width * height * channels, at + 1)
    if most != 255:
        raise ValueError("not 8 bits deep")
    return body.reshape(height, width, channels)


def encode(pixels: np.ndarray) -> bytes:
    """A PNG of height by width grey values, or by three colours, its rows filtered by the row above."""
    height, width = pixels.shape[:2]
    kind = 2 if pixels.ndim == 3 else 0
    pixels = pixels.reshape(height, -1)
    above = np.vstack([np.zeros((1, pixels.shape[1]), np.int64), pixels[:-1].astype(np.int64)])
    rows = np.hstack([np.full((height, 1), 2, np.uint8), ((pixels.astype(np.int64) - above) & 255).astype(np.uint8)])
    parts = [(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, kind, 0, 0, 0)), (b"IDAT", zlib.compress(rows.tobytes())), (b"IEND", b"")]
    return SIGNATURE + b"".join(struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b)) for k, b in parts)


def read_images(spark: SparkSession, folder: str, pattern: str = "*.{png,pgm,ppm}") -> DataFrame:
    """path, width, height, grey (a byte a pixel, row by row), red, green, blue (likewise), error: null but for files that can't be decoded."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder)
    names = ["path", "width", "height", "grey", "red", "green", "blue", "error"]
    kinds = (pa.string(), pa.int32(), pa.int32(), *[pa.binary()] * 4, pa.string())

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    pixels = channels(content.as_py())
                    planes = [grey(pixels), *np.moveaxis(colours(pixels), -1, 0)]
                    rows.append((path, pixels.shape[1], pixels.shape[0], *[np.ascontiguousarray(p).tobytes() for p in planes], None))
                except (ValueError, IndexError, struct.error, zlib.error) as e:
                    rows.append((path, *[None] * 6, str(e)))
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    schema = "path string, width int, height int, grey binary, red binary, green binary, blue binary, error string"
    return files.select("path", "content").mapInArrow(decoded, schema)


def write_images(images: DataFrame, folder: str) -> DataFrame:
    """name, width, height, and grey, or red, green and blue, as PNG files of those names; returns the names written."""
    planes = ["grey"] if "grey" in images.columns else ["red", "green", "blue"]

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(folder) if ":" in folder else (fs.LocalFileSystem(), folder)
        system.create_dir(base, recursive=True)
        for batch in batches:
            for row in batch.to_pylist():
                with system.open_output_stream(f"{base}/{row['name']}.png") as out:
                    held = [np.frombuffer(row[p], np.uint8).reshape(row["height"], row["width"]) for p in planes]
                    out.write(encode(held[0] if len(held) == 1 else np.stack(held, -1)))
            yield batch.select(["name"])

    return images.select("name", "width", "height", *planes).mapInArrow(written, "name string")


def pixels(images: DataFrame, key: str) -> DataFrame:
    """key, y, x, v of decoded images."""
    at = F.posexplode(
        F.transform(F.sequence(F.lit(1), F.length("grey")), lambda i: F.conv(F.hex(F.substring("grey", i, F.lit(1))), 16, 10).cast("int"))
    )
    each = images.where("grey is not null").select(key, "width", at.alias("at", "v"))
    return each.select(key, F.floor(F.col("at") / F.col("width")).cast("int").alias("y"), (F.col("at") % F.col("width")).cast("int").alias("x"), "v")
