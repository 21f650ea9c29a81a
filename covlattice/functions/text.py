"""Instruction text, stable hashes and cache keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def format_instruction(mnemonic: Column, operands: Column) -> Column:
    """``mnemonic a, b``; the mnemonic alone without operands."""
    has = F.size(F.coalesce(operands, F.array().cast("array<string>"))) > 0
    return F.when(has, F.concat(mnemonic, F.lit(" "), F.array_join(operands, ", "))).otherwise(mnemonic)


def format_block(instructions: Column) -> Column:
    """One instruction a line; ``nop`` for an empty block."""
    lines = F.transform(instructions, lambda i: format_instruction(i["mnemonic"], i["operands"]))
    return F.when(F.size(F.coalesce(lines, F.array())) > 0, F.array_join(lines, "\n")).otherwise("nop")


def without_controls(text: Column) -> Column:
    """Control characters, but tab and line breaks, as spaces."""
    return F.regexp_replace(text, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]", " ")


def sha_prefix(text: Column, n: int = 16) -> Column:
    return F.substring(F.sha2(text.cast("binary"), 256), 1, n)


def stable_seed(*parts: Column) -> Column:
    """First eight bytes of the SHA-256 of the NUL-joined parts, as an unsigned decimal string."""
    joined = F.concat_ws("\0", *parts)
    return F.conv(sha_prefix(joined, 16), 16, 10)


def shuffle_key(*parts: Column) -> Column:
    """Order of a seeded shuffle: the MD5 of the parts joined by bars."""
    return F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]).cast("binary"))


def cache_fingerprint(model: str, max_length: int, pooling: str) -> str:
    return f"{model}|{max_length}|{pooling}"


def cache_key(content: Column, fingerprint: str) -> Column:
    """Key of an encoding: content and encoder settings."""
    return sha_prefix(F.concat(content, F.lit("\0" + fingerprint)), 32)
