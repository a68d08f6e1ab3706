"""Patched frame-of-reference coding of token ids, and segment files of whole documents.

A segment holds the ids of consecutive documents. Its ids are cut into blocks of
``BLOCK``; of each block the minimum is subtracted, the rest is packed at a width that holds a
given percentile of the block, and what doesn't fit goes to an exception list. The index has
each block's minimum, width, number of exceptions and payload start, so that a block is decoded alone.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"EVPF\x01"
BLOCK = 128
PERCENTILE = 90
_HEAD = struct.Struct("<5sIIIQI")
_INDEX = np.dtype([("low", "<u4"), ("width", "u1"), ("patched", "u1"), ("start", "<u4")])


def _bits(values: np.ndarray) -> np.ndarray:
    """Bits that each value needs."""
    return np.ceil(np.log2(values.astype(np.float64) + 1)).astype(np.uint8)


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of ``BLOCK`` values at ``width`` bits each, as bytes; higher bits of a value are dropped."""
    columns = (values & np.uint32((1 << width) - 1)).astype(np.uint64).T.copy()
    words = np.zeros((width * BLOCK // 64, values.shape[0]), np.uint64)
    for i in range(BLOCK):
        word, shift = divmod(i * width, 64)
        words[word] |= columns[i] << np.uint64(shift)
        if shift + width > 64:
            words[word + 1] |= columns[i] >> np.uint64(64 - shift)
    return np.ascontiguousarray(words.T).astype("<u8").view(np.uint8)


def _unpack(packed: np.ndarray, width: int) -> np.ndarray:
    words = np.ascontiguousarray(packed).view("<u8").T.copy()
    mask = np.uint64((1 << width) - 1)
    out = np.empty((BLOCK, packed.shape[0]), np.uint32)
    for i in range(BLOCK):
        word, shift = divmod(i * width, 64)
        value = words[word] >> np.uint64(shift)
        if shift + width > 64:
            value = value | words[word + 1] << np.uint64(64 - shift)
        out[i] = value & mask
    return out.T


def encode_ids(ids: np.ndarray, percentile: int = PERCENTILE) -> tuple[np.ndarray, bytes]:
    """Block index and payload of unsigned 32-bit ids."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    index = np.zeros(blocks, _INDEX)
    if not n:
        return index, b""
    last = ids[(blocks - 1) * BLOCK :]
    full = np.empty(blocks * BLOCK, np.uint32)
    full[:n] = ids
    full[n:] = last.min()  # padding costs no width
    full = full.reshape(blocks, BLOCK)
    low = full.min(axis=1)
    rest = full - low[:, None]
    at = BLOCK * percentile // 100 - 1
    width = _bits(np.partition(rest, at, axis=1)[:, at])
    over = (rest.astype(np.uint64) >> width[:, None].astype(np.uint64)) > 0
    patched = over.sum(axis=1)
    body = width.astype(np.int64) * (BLOCK // 8)
    sizes = body + patched * 5
    start = np.concatenate([[0], np.cumsum(sizes)])
    index["low"], index["width"], index["patched"], index["start"] = low, width, patched, start[:-1]
    out = np.zeros(int(start[-1]), np.uint8)
    for w in np.unique(width):
        which = np.flatnonzero(width == w)
        if w:
            packed = _pack(rest[which], int(w))
            out[start[which][:, None] + np.arange(packed.shape[1])] = packed
    block, place = np.nonzero(over)
    if len(block):
        nth = np.arange(len(block)) - np.concatenate([[0], np.cumsum(patched)])[block]
        begin = start[block] + body[block]
        out[begin + nth] = place
        values = rest[block, place].astype("<u4").view(np.uint8).reshape(-1, 4)
        out[(begin + patched[block] + nth * 4)[:, None] + np.arange(4)] = values
    return index, out.tobytes()


def decode_blocks(index: np.ndarray, payload: np.ndarray) -> np.ndarray:
    """The ids of the given blocks, whole blocks each; ``start`` counts from the payload's first byte."""
    out = np.zeros((len(index), BLOCK), np.uint32)
    start = index["start"].astype(np.int64)
    for w in np.unique(index["width"]):
        which = np.flatnonzero(index["width"] == w)
        if w:
            packed = payload[start[which][:, None] + np.arange(int(w) * BLOCK // 8)]
            out[which] = _unpack(packed, int(w))
    patched = index["patched"].astype(np.int64)
    if patched.any():
        block = np.repeat(np.arange(len(index)), patched)
        nth = np.arange(len(block)) - np.concatenate([[0], np.cumsum(patched)])[block]
        begin = start[block] + index["width"][block].astype(np.int64) * (BLOCK // 8)
        values = payload[(begin + patched[block] + nth * 4)[:, None] + np.arange(4)]
        out[block, payload[begin + nth]] = np.ascontiguousarray(values).view("<u4").ravel()
    return (out + index["low"][:, None]).ravel()


def encode_segment(lengths: np.ndarray, ids: np.ndarray, percentile: int = PERCENTILE) -> bytes:
    """File bytes: head, length of each document, block index, payload, checksum."""
    index, payload = encode_ids(ids, percentile)
    head = _HEAD.pack(MAGIC, BLOCK, len(lengths), len(index), len(ids), len(payload))
    body = head + lengths.astype("<u4").tobytes() + index.tobytes() + payload
    return body + struct.pack("<I", zlib.crc32(body))


def decode_segment(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and ids of a segment; raises ValueError if it is damaged."""
    magic, block, docs, blocks, n, size = _HEAD.unpack_from(data)
    if magic != MAGIC or block != BLOCK or zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
        raise ValueError("not a whole segment")
    at = _HEAD.size
    lengths = np.frombuffer(data, "<u4", docs, at)
    at += 4 * docs
    index = np.frombuffer(data, _INDEX, blocks, at)
    at += index.nbytes
    payload = np.frombuffer(data, np.uint8, size, at)
    return lengths, decode_blocks(index, payload)[:n]
