"""Media columns: bytes as 8-bit greyscale PNG in a binary column, and what is read back from it.

A payload is the text's UTF-8 bytes, padded with zeros to a positive multiple of 64. It is stored row by row, 64 samples
a row, and written as the PNG signature and the chunks IHDR, IDAT (zlib) and IEND, each with its CRC-32. The decoder checks
signature, chunk order and every CRC, inflates the data, undoes the five row filters with numpy and returns the samples.
The feature is a perceptual hash: the picture's area means on a 32 x 32 grid, their 8 x 8 lowest cosine-transform
coefficients, and one bit for each that is above the median.

The encoder takes one filter for a picture: the row above where most samples equal it, the sample to the left where most equal
that, else none, as text compresses best that way; any filter can be asked for.
Defined cases: null is the empty text; repeated rows and equal texts give equal values; a damaged picture raises
MediaError in decode_png and gives null columns in read_media; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTH = 64
LEVEL = 6
SIGNATURE = b"\x89PNG\r\n\x1a\n"
GRID, LOW = 32, 8
READ_SCHEMA = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


class MediaError(ValueError):
    pass


def payload_of(text: str | None) -> bytes:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + bytes(-len(raw) % WIDTH or (WIDTH if not raw else 0))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def _paeth(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    p = a + b - c
    da, db, dc = abs(p - a), abs(p - b), abs(p - c)
    return np.where((da <= db) & (da <= dc), a, np.where(db <= dc, b, c))


def filter_rows(rows: np.ndarray, kind: int) -> np.ndarray:
    """Rows of samples under one of PNG's five filters."""
    x = rows.astype(np.int16)
    left = np.zeros_like(x)
    left[:, 1:] = x[:, :-1]
    up = np.zeros_like(x)
    up[1:] = x[:-1]
    corner = np.zeros_like(x)
    corner[1:, 1:] = x[:-1, :-1]
    minus = (0, left, up, (left + up) // 2, _paeth(left, up, corner))[kind]
    return ((x - minus) & 255).astype(np.uint8)


def filter_of(rows: np.ndarray) -> int:
    """The filter that leaves most samples zero, if that is over half of them."""
    up, left = (rows[1:] == rows[:-1]).sum(), (rows[:, 1:] == rows[:, :-1]).sum()
    return 0 if 2 * max(up, left) <= rows.size else 2 if up >= left else 1


def encode_png(payload: bytes, kind: int | None = None, level: int = LEVEL) -> bytes:
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    kind = filter_of(rows) if kind is None else kind
    data = np.empty((len(rows), WIDTH + 1), np.uint8)
    data[:, 0], data[:, 1:] = kind, filter_rows(rows, kind) if kind else rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(data.tobytes(), level)) + _chunk(b"IEND", b"")


def _unfilter(kinds: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Runs of rows with one filter at a time; only filters that depend on the sample to the left go sample by sample."""
    cut = np.flatnonzero(np.concatenate(([True], kinds[1:] != kinds[:-1])))
    above = np.zeros(rows.shape[1], np.uint8)
    for a, b in zip(cut, [*cut[1:], len(kinds)], strict=True):
        kind, own = kinds[a], rows[a:b]
        if kind == 1:
            own[:] = np.cumsum(own, axis=1, dtype=np.uint8)
        elif kind == 2:
            own[0] += above
            own[:] = np.cumsum(own, axis=0, dtype=np.uint8)
        elif kind in (3, 4):
            for row in own:
                done, up, left, corner = [], above.tolist(), 0, 0
                for x, u in zip(row.tolist(), up, strict=True):
                    if kind == 3:
                        left = (x + (left + u) // 2) & 255
                    else:
                        p = left + u - corner
                        da, db, dc = abs(p - left), abs(p - u), abs(p - corner)
                        left = (x + (left if da <= db and da <= dc else u if db <= dc else corner)) & 255
                    corner = u
                    done.append(left)
                row[:] = done
                above = row
        elif kind:
            raise MediaError(f"row filter {kind}")
        above = own[-1]
    return rows


def decode_png(media: bytes) -> np.ndarray:
    """The samples of an 8-bit greyscale picture, rows by columns; every checksum is tested."""
    if media[:8] != SIGNATURE:
        raise MediaError("signature")
    at, size, data, ended = 8, None, [], False
    while at + 12 <= len(media) and not ended:
        n, kind = struct.unpack(">I4s", media[at : at + 8])
        body, crc = media[at + 8 : at + 8 + n], media[at + 8 + n : at + 12 + n]
        if len(crc) < 4 or zlib.crc32(kind + body) != struct.unpack(">I", crc)[0]:
            raise MediaError(f"checksum of {kind!r}")
        if kind == b"IHDR":
            *size, depth, colour, method, filters, interlace = struct.unpack(">IIBBBBB", body)
            if (depth, colour, method, filters, interlace) != (8, 0, 0, 0, 0):
                raise MediaError("not plain 8-bit greyscale")
        elif kind == b"IDAT":
            data.append(body)
        ended = kind == b"IEND"
        at += 12 + n
    if not ended or not size:
        raise MediaError("chunks missing")
    width, height = size
    try:
        raw = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8)
        raw = raw.reshape(height, width + 1)
    except (zlib.error, ValueError) as e:
        raise MediaError(str(e)) from e
    return _unfilter(raw[:, 0], raw[:, 1:].copy())


_angle = (2 * np.arange(GRID)[None, :] + 1) * np.arange(LOW)[:, None] * np.pi / (2 * GRID)
COSINES = np.cos(_angle)


def cosine_hash(picture: np.ndarray) -> str:
    """64 bits as hex: which low-frequency coefficients of the 32 x 32 area means are above their median."""
    small = picture.astype(np.float64)
    for axis in (0, 1):
        n = small.shape[axis]
        if n < GRID:
            small = np.take(small, np.arange(GRID) * n // GRID, axis)
        elif n > GRID:
            edges = np.arange(GRID) * n // GRID
            counts = np.diff(np.append(edges, n))
            small = np.add.reduceat(small, edges, axis) / (counts[:, None] if axis == 0 else counts[None, :])
    low = np.round(COSINES @ small @ COSINES.T, 6).ravel()
    bits = low > np.median(low[1:])
    return np.packbits(bits).tobytes().hex()


def store_media(docs: DataFrame, kind: int | None = None) -> DataFrame:
    """docs plus n_bytes and media, the PNG of the text's payload."""

    @F.pandas_udf("n_bytes long, media binary")
    def store(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            sizes = [len((t or "").encode("utf-8", "surrogatepass")) for t in part]
            yield pd.DataFrame({"n_bytes": sizes, "media": [encode_png(payload_of(t), kind) for t in part]})

    return docs.withColumn("_m", store("text")).withColumn("n_bytes", F.col("_m.n_bytes")).withColumn("media", F.col("_m.media")).drop("_m")


def features_of(media: bytes) -> tuple:
    picture = decode_png(media)
    payload = picture.tobytes()
    return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), cosine_hash(picture)


def read_media(stored: DataFrame) -> DataFrame:
    """stored plus what its media column holds: READ_SCHEMA, null where a picture is missing or damaged."""

    @F.pandas_udf(READ_SCHEMA)
    def read(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in READ_SCHEMA.split(", ")]
        for part in parts:
            rows = []
            for m in part:
                try:
                    rows.append(features_of(bytes(m)) if m is not None else (None,) * 6)
                except MediaError:
                    rows.append((None,) * 6)
            out = pd.DataFrame(rows, columns=names)
            yield out.astype({c: "Int64" for c in ("payload_bytes", "tail_crc32", "media_bytes")})

    return stored.withColumn("_r", read("media")).select(*stored.columns, "_r.*")
