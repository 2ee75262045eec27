"""A minimal PNG writer, so that image scans can be checked on files Spark wrote itself."""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame


def encode_png(arr: np.ndarray) -> bytes:
    """An 8-bit RGB or grey array as PNG bytes."""

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    h, w = arr.shape[:2]
    rows = arr.reshape(h, -1)
    raw = np.concatenate([np.zeros((h, 1), dtype=np.uint8), rows], axis=1).tobytes()
    head = struct.pack(">IIBBBBB", w, h, 8, 0 if arr.ndim == 2 else 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def write_pngs(images: DataFrame, path: str, per_folder: int = 1000) -> list[str]:
    """Write single-block images as ``<image_id div per_folder>/<image_id>.png`` to any file system Arrow knows; returns the folders."""
    import pyarrow.fs as pafs

    from tessella.operators.blocks import map_blocks, pixels

    uri = "file://" + path.removeprefix("file:") if path.startswith("file:/") and not path.startswith("file://") else path

    made = set()

    def kernel(b):
        fs, root = pafs.FileSystem.from_uri(uri)
        folder = b["image_id"] // per_folder
        if folder not in made:
            fs.create_dir(f"{root}/{folder}", recursive=True)
            made.add(folder)
        with fs.open_output_stream(f"{root}/{folder}/{b['image_id']}.png") as f:
            f.write(encode_png(pixels(b)))
        return {"folder": np.array([folder])}

    folders = map_blocks(images, kernel, "folder bigint", ()).distinct()
    return [f"{path}/{r.folder}" for r in folders.sort("folder").toLocalIterator()]
