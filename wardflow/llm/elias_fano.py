"""Elias-Fano code of a non-decreasing list of non-negative integers, with select.

A value's low bits are packed side by side; its high part is a one at bit (high + index) of a bit
vector. The position of every STEP-th one is kept in 32 bits, so select reads one short stretch. For
m values below U this takes about m * (2 + log2(U / m)) bits, in place of 64 per value.
"""

import numpy as np

STEP = 256


def encode(values):
    """(header, low, high, samples): a dictionary and three byte strings."""
    x = np.asarray(values, np.int64)
    m = len(x)
    if m == 0:
        return {"m": 0, "l": 0}, b"", b"", b""
    if x[0] < 0 or (np.diff(x) < 0).any():
        raise ValueError("values must be non-negative and in ascending order")
    width = max(0, int((int(x[-1]) + 1) // m).bit_length() - 1)
    low = np.packbits(((x[:, None] >> np.arange(width)) & 1).astype(np.uint8).ravel(), bitorder="little") if width else np.zeros(0, np.uint8)
    ones = (x >> width) + np.arange(m)
    if ones[-1] >= 1 << 32:
        raise ValueError("too many values for one file")
    bits = np.zeros(int(ones[-1]) // 8 + 1, np.uint8)
    np.bitwise_or.at(bits, ones >> 3, (1 << (ones & 7)).astype(np.uint8))
    return {"m": m, "l": width}, low.tobytes(), bits.tobytes(), ones[::STEP].astype("<u4").tobytes()


def select(header, low, high, samples, begin, end):
    """The values with index begin..end-1; low, high and samples are functions (from, to) -> bytes."""
    if end <= begin:
        return np.zeros(0, np.int64)
    width, m = header["l"], header["m"]
    first, last = begin // STEP, min((end - 1) // STEP + 1, (m - 1) // STEP)
    at = np.frombuffer(samples(4 * first, 4 * last + 4), "<u4").astype(np.int64)
    from_byte = int(at[0]) // 8
    to_byte = int(at[-1]) // 8 + 1 if last * STEP >= end else None
    bits = np.unpackbits(np.frombuffer(high(from_byte, to_byte), np.uint8), bitorder="little")
    ones = np.flatnonzero(bits) + from_byte * 8
    ones = ones[ones >= at[0]][begin - first * STEP:end - first * STEP]
    value = (ones - np.arange(begin, end)) << width
    if width:
        a, z = begin * width, end * width
        raw = np.unpackbits(np.frombuffer(low(a // 8, -(-z // 8)), np.uint8), bitorder="little")
        raw = raw[a % 8:a % 8 + z - a].reshape(-1, width).astype(np.int64)
        value |= (raw << np.arange(width)).sum(1)
    return value
