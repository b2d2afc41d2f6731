"""Keys of answers kept between runs: everything that decides an answer, hashed."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import text_of


def content_hash(*fields: str) -> Column:
    """16 hex digits of an item's fields, names and order included."""
    pairs = F.array(*[F.array(F.lit(f), text_of(F.col(f))) for f in fields])
    return F.left(F.sha2(F.to_json(pairs), 256), F.lit(16))


def fingerprint(length: int = 12, **settings) -> str:
    """Hex digits of the settings that decide an answer (prompt, schema, limits): one change, and no kept answer is used."""
    text = json.dumps(settings, sort_keys=True, ensure_ascii=False, default=str)
    return hashlib.sha256(text.encode()).hexdigest()[:length]


def answer_key(content: Column, print_: str, backend: str, model: str) -> Column:
    return F.concat_ws(":", content, F.lit(print_), F.lit(backend), F.lit(model))


def source_key(kind: str, slug: str, label: str, **shape) -> str:
    """kind:slug:label, and a short hash of the options that shape what is read, if any differ from their defaults."""
    base = f"{kind}:{slug}:{label}"
    return f"{base}:{fingerprint(8, **shape)}" if shape else base


def one_sentence(c: Column, most: int = 220) -> Column:
    """A text cut at the last space that fits, with an ellipsis; whole if it fits."""
    text = F.trim(F.regexp_replace(text_of(c), "(?U)\\s+", " "))
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.rtrim(F.regexp_replace(F.left(text, F.lit(most - 1)), " [^ ]*$", "")), F.lit("…")))
