"""Frames of the blosc format (its first version, which array stores use), decoded with numpy and pyarrow.

A frame has a header of 16 bytes, the starts of its blocks, and the blocks; a
block is one compressed stream or one a byte of the element size, each behind
its length, and its bytes may be shuffled by place within the element.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa

# Fixed values of the format.
_SHUFFLED, _PLAIN, _BITS, _WHOLE = 0x01, 0x02, 0x04, 0x10
_CODECS = {1: "lz4", 3: "zlib", 4: "zstd"}
_MOST_STREAMS, _LEAST_STREAM = 16, 128


def _stream(codec: str, raw: bytes, size: int) -> bytes:
    if len(raw) == size:  # stored as it is
        return raw
    if codec == "zlib":
        return zlib.decompress(raw)
    return pa.Codec("lz4_raw" if codec == "lz4" else codec).decompress(raw, size, asbytes=True)


def unshuffled(block: bytes, width: int) -> bytes:
    """Bytes of whole elements again; what does not fill an element stays at the end."""
    n = len(block) // width
    flat = np.frombuffer(block, np.uint8)
    return flat[: n * width].reshape(width, n).T.tobytes() + flat[n * width :].tobytes()


def decompress(frame: bytes) -> bytes:
    """The bytes of a frame; raises ValueError for a codec or filter that has no decoder here, or for a frame that is cut short."""
    if len(frame) < 16:
        raise ValueError("no blosc frame")
    _, _, flags, width, size, block_size, held = struct.unpack_from("<BBBBIII", frame)
    if held > len(frame):
        raise ValueError("blosc frame cut short")
    if flags & _PLAIN:
        return frame[16 : 16 + size]
    codec = _CODECS.get(flags >> 5)
    if codec is None or flags & _BITS:
        raise ValueError("blosc frames of this codec or with shuffled bits have no decoder")
    out = []
    for i, start in enumerate(struct.unpack_from(f"<{-(-size // block_size)}i", frame, 16)):
        here = min(block_size, size - i * block_size)
        parted = not flags & _WHOLE and width <= _MOST_STREAMS and block_size // width >= _LEAST_STREAM and here == block_size
        streams = width if parted else 1
        block, at = b"", start
        for _ in range(streams):
            n = struct.unpack_from("<i", frame, at)[0]
            block += _stream(codec, frame[at + 4 : at + 4 + n], here // streams)
            at += 4 + n
        out.append(unshuffled(block, width) if flags & _SHUFFLED and width > 1 else block)
    return b"".join(out)
