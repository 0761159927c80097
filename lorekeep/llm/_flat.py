"""Arrays in one flat file that every worker of a machine maps into memory."""

from __future__ import annotations

import json
import os
import tempfile
import uuid

import numpy as np
from pyspark.sql import SparkSession

#: Folders of the driver that hold files for the executors; deleted when the driver ends.
_FOLDERS: list[tempfile.TemporaryDirectory] = []


def save(arrays: dict[str, np.ndarray], name: str = "arrays") -> str:
    """Path of a new file on the driver: a JSON directory, then the arrays at multiples of 64 bytes."""
    at, entries, chunks = 0, {}, []
    for key, x in arrays.items():
        x = np.ascontiguousarray(x)
        entries[key] = [x.dtype.str, list(x.shape), at]
        pad = -x.nbytes % 64
        chunks += [x.tobytes(), bytes(pad)]
        at += x.nbytes + pad
    head = json.dumps(entries).encode()
    head += b" " * (-(len(head) + 8) % 64)
    _FOLDERS.append(tempfile.TemporaryDirectory(prefix=f"{name}-"))
    path = os.path.join(_FOLDERS[-1].name, f"{name}-{uuid.uuid4().hex}.bin")
    with open(path, "wb") as f:
        f.write(len(head).to_bytes(8, "little") + head + b"".join(chunks))
    return path


def share(spark: SparkSession, arrays: dict[str, np.ndarray], name: str) -> str:
    """Hand arrays to the executors; the name by which SparkFiles finds the file there."""
    path = save(arrays, name)
    spark.sparkContext.addFile(path)
    return os.path.basename(path)


def open_mapped(path: str) -> dict[str, np.ndarray]:
    """The arrays of a file, mapped into memory."""
    raw = np.memmap(path, dtype=np.uint8, mode="r")
    n = int.from_bytes(raw[:8].tobytes(), "little")
    out = {}
    for name, (kind, shape, at) in json.loads(raw[8 : 8 + n].tobytes()).items():
        kind = np.dtype(kind)
        out[name] = np.asarray(raw[8 + n + at : 8 + n + at + kind.itemsize * int(np.prod(shape))]).view(kind).reshape(shape)
    return out
