"""CRC-32 in DuckDB's SQL, which has no function for it."""

from __future__ import annotations


def _entry(i: int) -> int:
    for _ in range(8):
        i = (i >> 1) ^ (0xEDB88320 if i & 1 else 0)
    return i


def crc32_sql(text: str) -> str:
    """The unsigned CRC-32 of a text's UTF-8 bytes, a byte at a time."""
    steps = ", ".join(str(_entry(i)) for i in range(256))
    octets = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: ('0x' || x)::bigint)"
    step = f"lambda a, b: xor(a >> 8, ([{steps}]::bigint[])[((xor(a, b) & 255) + 1)::int])"
    return f"xor(list_reduce(list_concat([4294967295::bigint], {octets}), {step}), 4294967295::bigint)"
