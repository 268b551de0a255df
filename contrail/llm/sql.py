"""Pieces of DuckDB SQL that several oracles use."""

from __future__ import annotations

#: ``crc_table``: one row with the 256 entries of CRC-32 as list ``t``, made from its polynomial.
CRC_TABLE = """crc_table AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(
    [i::UBIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) AS v
    FROM range(256) r(i)))"""


def crc32(text: str) -> str:
    """CRC-32 of a text of code points below U+0100, those above ASCII from U+00C0 on, where ``crc_table`` is joined."""
    code = "CASE WHEN unicode(c) < 128 THEN [unicode(c)::UBIGINT] ELSE [195::UBIGINT, (unicode(c) - 64)::UBIGINT] END"
    data = f"flatten(list_transform(string_split({text}, ''), lambda c: {code}))"
    step = "xor(a >> 8, t[((xor(a, b) & 255) + 1)::BIGINT])"
    return f"xor(list_reduce(list_concat([4294967295::UBIGINT], {data}), lambda a, b: {step}), 4294967295::UBIGINT)"
