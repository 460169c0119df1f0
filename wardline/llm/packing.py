"""Number arrays as compressed bytes, for rows that hold many numbers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

KINDS = "BHIQdq"


def pack(values: np.ndarray) -> bytes:
    """Bytes of an array: unsigned numbers in the fewest bytes, byte by byte, compressed."""
    values = np.ascontiguousarray(values)
    if values.dtype.kind in "iu" and (not len(values) or values.min() >= 0):
        top = int(values.max()) if len(values) else 0
        kind = next(k for k in "BHIQ" if top <= np.iinfo(np.dtype(k)).max)
        values = values.astype(kind)
    else:
        values = values.astype("q" if values.dtype.kind in "iu" else "d")
        kind = values.dtype.char if values.dtype.char in KINDS else "q"
    planes = values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()
    return kind.encode() + len(values).to_bytes(8, "little") + pa.compress(
        planes, codec="zstd", asbytes=True)


def unpack(data: bytes) -> np.ndarray:
    kind, n = np.dtype(data[:1].decode()), int.from_bytes(data[1:9], "little")
    planes = pa.decompress(data[9:], n * kind.itemsize, codec="zstd", asbytes=True) if n else b""
    flat = np.frombuffer(planes, dtype=np.uint8).reshape(kind.itemsize, n).T
    return np.ascontiguousarray(flat).view(kind).reshape(n)
