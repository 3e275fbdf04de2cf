"""Ids and hashes."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F


def stable_id(tier: Column, path: Column, scope: Column) -> Column:
    """60-bit id: the first 15 hex digits of md5(tier::path::scope)."""
    return F.conv(F.substring(F.md5(F.concat_ws("::", tier, path, scope)), 1, 15), 16, 10).cast("long")


def stable_id_of(tier: str, path: str, scope: str) -> int:
    return int(hashlib.md5(f"{tier}::{path}::{scope}".encode()).hexdigest()[:15], 16)


def lf(text: Column) -> Column:
    """Line ends as line feeds."""
    return F.regexp_replace(text, "\r\n?", "\n")


def content_hash(content: Column) -> Column:
    """MD5 with line ends made alike. The bytes pass as Latin-1, so nothing else changes."""
    return F.md5(F.encode(lf(F.decode(content, "ISO-8859-1")), "ISO-8859-1"))


def summary_key(text: Column) -> Column:
    """MD5 of a chunk's text without its line numbers and part count."""
    plain = F.regexp_replace(F.regexp_replace(text, r"Lines: [0-9]+-[0-9]+", ""), r"\(Part [0-9]+/[0-9]+\)", "(Part)")
    return F.md5(plain)


def short_sha(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 12)
