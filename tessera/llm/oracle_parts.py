"""Pieces of DuckDB SQL that several oracles use."""

from __future__ import annotations


def _table() -> list[int]:
    """The CRC-32 remainders of the sixteen half bytes."""
    out = []
    for value in range(16):
        for _ in range(4):
            value = (value >> 1) ^ (0xEDB88320 if value & 1 else 0)
        out.append(value)
    return out


def crc32_sql(text: str) -> str:
    """The unsigned CRC-32 of a string expression's UTF-8 bytes, half byte by half byte; null for null."""
    digits = f"hex(encode({text}))"
    halves = f"list_transform(range(len({digits})), lambda k: CAST(instr('0123456789ABCDEF', substr({digits}, k + 2 - 2 * (k % 2), 1)) - 1 AS BIGINT))"
    step = f"lambda c, x: xor(c >> 4, {_table()}[1 + (xor(c, x) & 15)])"
    return f"CASE WHEN {text} IS NOT NULL THEN xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {halves}), {step}), CAST(4294967295 AS BIGINT)) END"
