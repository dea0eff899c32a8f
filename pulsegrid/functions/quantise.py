"""Packed samples, nibbles, channel order, decibels and mu-law codes, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: entries of the quantiser's table of logarithms, and the largest magnitude of a 16-bit part.
LEVELS = 32768


def unpack_bits(byte: Column, bits: int) -> Column:
    """Array of a byte's unsigned fields of ``bits`` bits, lowest first."""
    return F.array(*(F.shiftright(byte, k).bitwiseAND((1 << bits) - 1) for k in range(0, 8, bits)))


def nibble(n: Column) -> Column:
    """Signed value of a four-bit field."""
    return n - F.lit(16) * (n > 7).cast("int")


def signed_byte(word: Column) -> Column:
    """Signed value of a word's lowest byte."""
    return (word + 128).bitwiseAND(255) - 128


def band_order(chan: Column) -> Column:
    """Place in the band of a packet's channel: even ones first."""
    return F.when(chan % 2 == 0, F.floor(chan / 2)).otherwise(512 + F.floor((chan - 1) / 2))


def decibels(power: Column, least: float = 1e-3) -> Column:
    return F.lit(10.0) * F.log10(F.when(power == 0, least).otherwise(power))


def whole(x: Column) -> Column:
    """Towards zero."""
    return F.signum(x) * F.floor(F.abs(x))


def mulaw_encode(x: Column, top: Column, mu: float = 255.0, bits: int = 8) -> Column:
    """Code of a power between 0 and ``top``, by a table of ``LEVELS`` steps; larger powers get the last code."""
    step = F.least(F.floor(x / top * LEVELS), F.lit(LEVELS - 1))
    share = F.log10(F.lit(1.0) + step * mu / LEVELS) / F.log10(F.lit(1.0 + mu))
    return F.least(F.floor(share * (1 << bits)), F.lit((1 << bits) - 1)).cast("int")


def mulaw_decode(code: Column, top: Column, mu: float = 255.0, bits: int = 8) -> Column:
    """Power that a code stands for: 0 for the first, ``top`` for the last."""
    return (F.pow(F.lit(10.0), F.log10(F.lit(1.0 + mu)) * code / F.lit(float((1 << bits) - 1))) - 1) / mu * top


def mulaw_encode_complex(re: Column, im: Column, mu: float = 255.0) -> Column:
    """A byte of two halves, each a sign and three bits, from signed 16-bit parts."""

    def half(x: Column) -> Column:
        share = F.log10(F.lit(1.0) + F.abs(x) * mu / LEVELS) / F.log10(F.lit(1.0 + mu))
        return F.when(x < 0, 8).otherwise(0) + F.least(F.floor(share * 8), F.lit(7)).cast("int")

    return half(re) * 16 + half(im)


def mulaw_decode_complex(code: Column, mu: float = 255.0) -> tuple[Column, Column]:
    """The signed 16-bit parts of such a byte."""

    def part(half: Column) -> Column:
        size = F.floor(F.lit(float(LEVELS)) * (F.pow(F.lit(10.0), F.log10(F.lit(1.0 + mu)) * half.bitwiseAND(7) / 8.0) - 1) / mu).cast("int")
        return F.when(half >= 8, -size).otherwise(size)

    return part(F.shiftright(code, 4)), part(code.bitwiseAND(15))
