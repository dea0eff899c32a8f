"""Filterbank files: keyword header, then samples with the channel fastest.

The header is a series of length-prefixed keywords with typed values between
``HEADER_START`` and ``HEADER_END``. ``cubes`` reads such files by ranges.
"""

from __future__ import annotations

import struct

import numpy as np
#: The format's keywords and the types of their values.
KEYWORDS = {
    "source_name": "s", "rawdatafile": "s",
    "az_start": "d", "za_start": "d", "src_raj": "d", "src_dej": "d", "tstart": "d", "tsamp": "d", "period": "d", "fch1": "d", "foff": "d", "fchannel": "d", "refdm": "d",
    "nchans": "i", "telescope_id": "i", "machine_id": "i", "data_type": "i", "ibeam": "i", "nbeams": "i", "nbits": "i", "barycentric": "i", "pulsarcentric": "i", "nbins": "i", "nsamples": "i", "nifs": "i", "npuls": "i",
}
BITS = (1, 2, 4, 8, 16, 32)


def read_string(data: bytes, at: int) -> tuple[str, int]:
    (n,) = struct.unpack_from("<i", data, at)
    if not 1 <= n <= 80:
        raise ValueError("a keyword's length must lie between 1 and 80")
    return data[at + 4 : at + 4 + n].decode("latin-1"), at + 4 + n


def read_header(data: bytes) -> tuple[dict, int]:
    """The header's values and its length; a file without one has none and length 0."""
    try:
        word, at = read_string(data, 0)
    except (ValueError, struct.error):
        return {}, 0
    if word != "HEADER_START":
        return {}, 0
    found: dict = {}
    while True:
        word, at = read_string(data, at)
        if word == "HEADER_END":
            return found, at
        if word in ("FREQUENCY_START", "FREQUENCY_END"):
            continue
        kind = KEYWORDS.get(word)
        if kind is None:
            raise ValueError(f"unknown keyword {word}")
        if kind == "s":
            found[word], at = read_string(data, at)
            continue
        (value,) = struct.unpack_from(f"<{kind}", data, at)
        at += struct.calcsize(f"<{kind}")
        if word == "fchannel":
            found.setdefault(word, []).append(value)
        else:
            found[word] = value


def unpack(data: bytes, bits: int) -> np.ndarray:
    """Samples of 1 to 32 bits as floats; fields of a byte lowest first, 32 bits are floats already."""
    if bits not in BITS:
        raise ValueError(f"{bits} bits a sample aren't supported")
    if bits >= 8:
        kind = {8: "<u1", 16: "<u2", 32: "<f4"}[bits]
        return np.frombuffer(data[: len(data) // np.dtype(kind).itemsize * np.dtype(kind).itemsize], kind).astype("<f4")
    raw = np.frombuffer(data, np.uint8)
    fields = (raw[:, None] >> np.arange(0, 8, bits)) & ((1 << bits) - 1)
    return fields.ravel().astype("<f4")
