"""Digest texts of signed requests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..fixed import SIGNATURE_SEPARATOR


def body_base64(body: Column) -> Column:
    """One-line base64 (Spark breaks the lines by default); no body gives an empty text."""
    return F.coalesce(F.regexp_replace(F.base64(body.cast("binary")), r"[\r\n]", ""), F.lit(""))


def digest(text: Column) -> Column:
    return F.upper(F.sha2(text, 256))


def signature(body: Column, path: Column, stamp: Column, nonce: Column, key: Column,
              salt: Column, salt_index: Column) -> Column:
    signed = F.concat(body_base64(body), path, stamp, nonce, key, salt)
    return F.concat(digest(signed), F.lit(SIGNATURE_SEPARATOR), salt_index)


def body_hash(body: Column) -> Column:
    return F.base64(F.unhex(F.sha2(body.cast("binary"), 256)))
