"""Media columns: Netpbm and BMP bytes decoded to arrays, area-resized, kept as NPY tiles with difference hashes."""

from __future__ import annotations

import hashlib
import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagescale.session import cut_lineage

WIDTH = 64
TILE = 32


def _fields(data: bytes, n: int) -> tuple[list[bytes], int]:
    """The first n fields of a Netpbm head and where the samples start; '#' begins a comment up to the line end."""
    out, i = [], 0
    while len(out) < n:
        while data[i : i + 1].isspace():
            i += 1
        if data[i : i + 1] == b"#":
            i = data.index(b"\n", i)
            continue
        j = i
        while j < len(data) and not data[j : j + 1].isspace():
            j += 1
        if j == i:
            raise ValueError("a Netpbm head ends early")
        out.append(data[i:j])
        i = j
    return out, i + 1


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6 as a (height, width) or (height, width, 3) array: uint8, or uint16 where the largest value needs it."""
    kind = data[:2]
    head, start = _fields(data, 3 if kind in (b"P1", b"P4") else 4)
    w, h = int(head[1]), int(head[2])
    shape = (h, w, 3) if kind in (b"P3", b"P6") else (h, w)
    size = int(np.prod(shape))
    if kind == b"P1":
        return 1 - np.frombuffer(bytes(x for x in data[start - 1 :] if x in b"01")[:size], np.uint8).reshape(shape) + np.uint8(48)
    if kind == b"P4":
        rows = np.frombuffer(data, np.uint8, h * ((w + 7) // 8), start).reshape(h, -1)
        return 1 - np.unpackbits(rows, axis=1)[:, :w]
    dtype = np.uint8 if int(head[3]) < 256 else np.uint16
    if kind in (b"P2", b"P3"):
        return np.array(data[start:].split()[:size], dtype=int).astype(dtype).reshape(shape)
    if kind in (b"P5", b"P6"):
        return np.frombuffer(data, np.dtype(dtype).newbyteorder(">"), size, start).astype(dtype).reshape(shape)
    raise ValueError("not a Netpbm image")


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP of 8, 24 or 32 bits: palette entries and channels in red, green, blue order."""
    start, head = struct.unpack_from("<I", data, 10)[0], struct.unpack_from("<I", data, 14)[0]
    w, h, _, bits, packed = struct.unpack_from("<iiHHI", data, 18)
    if packed not in (0, 3) or bits not in (8, 24, 32) or w <= 0 or h == 0:
        raise ValueError("not a supported BMP image")
    stride = (w * bits // 8 + 3) // 4 * 4
    rows = np.frombuffer(data, np.uint8, stride * abs(h), start).reshape(abs(h), stride)[:, : w * bits // 8]
    rows = rows[::-1] if h > 0 else rows
    if bits == 8:
        n = struct.unpack_from("<I", data, 46)[0] or 256
        return np.frombuffer(data, np.uint8, 4 * n, 14 + head).reshape(n, 4)[:, 2::-1][rows]
    return rows.reshape(abs(h), w, bits // 8)[:, :, 2::-1].copy()


def decode(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def grey(image: np.ndarray) -> np.ndarray:
    """Mean of the channels as float64."""
    return image.mean(axis=2) if image.ndim == 3 else image.astype(np.float64)


def resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean over the exact area of each target cell, from the integral image read at fractional corners."""
    h, w = image.shape
    whole = np.zeros((h + 1, w + 1))
    whole[1:, 1:] = image.cumsum(0).cumsum(1)

    def at(table: np.ndarray, n: int, m: int) -> np.ndarray:
        edges = np.arange(m + 1) * n / m
        low = np.minimum(edges.astype(int), n - 1)
        part = (edges - low)[:, None]
        return table[low] * (1 - part) + table[low + 1] * part

    corners = at(at(whole, h, height).T, w, width).T
    return np.diff(np.diff(corners, axis=0), axis=1) * (height * width / (h * w))


def difference_hash(image: np.ndarray) -> str:
    """64 bits: whether each cell of an 8 x 9 reduction is brighter than its right neighbour, as 16 hex digits."""
    small = np.round(resize(image, 8, 9), 6)
    return np.packbits(small[:, :-1] > small[:, 1:]).tobytes().hex()


def npy(array: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, array, allow_pickle=False)
    return out.getvalue()


def tile(image: np.ndarray, size: int = TILE) -> bytes:
    """A square tile of float32 means as NPY bytes."""
    return npy(np.round(resize(image, size, size), 3).astype(np.float32))


MEDIA_SCHEMA = "doc_id long, n_bytes long, width int, height int, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, tile binary, feature string"
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("width", pa.int32()), ("height", pa.int32()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("tile", pa.binary()), ("feature", pa.string())])
STEP = 200


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, STEP):
            part = batch.slice(at, STEP)
            rows = []
            for doc_id, n_bytes, media in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist()):
                image = decode(media)
                payload, flat = image.tobytes(), grey(image)
                rows.append((doc_id, n_bytes, image.shape[1], image.shape[0], len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), tile(flat), difference_hash(flat)))
            yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows), _ARROW)], schema=_ARROW)


def features(media: DataFrame) -> DataFrame:
    """For rows (doc_id, n_bytes, media): size, digests of the decoded samples and of the stored form, tile and hash."""
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_features, MEDIA_SCHEMA)


def as_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every text as a binary PGM column: 64 grey samples a row, filled up with samples 0, one row at least.

    Null counts as empty; nothing else is dropped or cut. Repeated rows give a row each.
    """
    data = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    n = F.octet_length(data)
    rows = F.greatest(F.lit(1), F.ceil(n / WIDTH))
    head = F.encode(F.concat(F.lit(f"P5\n{WIDTH} "), rows.cast("string"), F.lit("\n255\n")), "UTF-8")
    fill = F.unhex(F.repeat(F.lit("00"), (rows * WIDTH - n).cast("int")))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), n.cast("long").alias("n_bytes"), F.concat(head, data, fill).alias("media"))


def stored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The media column written to the shared folder, read back and described."""
    return features(cut_lineage(as_media(docs, id_col, text_col), "media"))
