"""Token estimates by script: how many characters of a text make a token."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

#: Characters a token in ASCII and in scripts without an entry; characters of which a long text's estimate takes a strided sample.
ASCII, OTHER, SAMPLE = 4.0, 2.0, 60_000
#: First and last code point of a script, and its characters a token.
SCRIPTS = (
    (0x0100, 0x024F, 3.00),  # extended Latin
    (0x0300, 0x036F, 2.00),  # combining marks
    (0x0370, 0x03FF, 1.68),  # Greek
    (0x0400, 0x04FF, 4.00),  # Cyrillic
    (0x0590, 0x05FF, 1.40),  # Hebrew
    (0x0600, 0x06FF, 3.40),  # Arabic
    (0x0750, 0x077F, 3.40),
    (0x1E00, 0x1EFF, 3.00),  # Latin with further marks
    (0x1F00, 0x1FFF, 1.68),  # Greek with breathings
    (0x3040, 0x30FF, 1.50),  # kana
    (0x3400, 0x4DBF, 1.50),  # Han
    (0x4E00, 0x9FFF, 1.50),
    (0xAC00, 0xD7AF, 1.50),  # Hangul
    (0xF900, 0xFAFF, 1.50),
    (0xFB1D, 0xFB4F, 1.40),  # Hebrew forms
)
_FIRST, _LAST, _RATE = (np.array(x) for x in zip(*SCRIPTS, strict=True))


def costs(text: str) -> np.ndarray:
    """Tokens of each sampled character."""
    codes = np.frombuffer(text[:: len(text) // SAMPLE + 1 if len(text) > SAMPLE else 1].encode("utf-32-le", "surrogatepass"), "<u4")
    at = np.maximum(np.searchsorted(_FIRST, codes, "right") - 1, 0)
    known = (codes >= _FIRST[at]) & (codes <= _LAST[at])
    return 1 / np.where(codes < 128, ASCII, np.where(known, _RATE[at], OTHER))


def rate(text: str) -> float:
    """Characters a token: the harmonic mean over the text's characters."""
    return ASCII if text.isascii() else len(own := costs(text)) / own.sum()


def densest(text: str) -> float:
    """Characters a token of the densest script in the text."""
    return ASCII if text.isascii() else 1 / costs(text).max()


def count(n_chars: int, rate: float) -> int:
    """Tokens of a text of that length, at least one."""
    return max(1, int(n_chars / rate))


def budget(tokens: int, rate: float) -> int:
    """Characters that so many tokens take, at least one."""
    return max(1, int(tokens * rate))


@F.pandas_udf(Ty.StructType([Ty.StructField("rate", Ty.DoubleType()), Ty.StructField("densest", Ty.DoubleType())]))
def _measured(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([(ASCII, ASCII) if t is None else (rate(t), densest(t)) for t in texts], columns=["rate", "densest"])


def rates(text: Column) -> Column:
    """(rate, densest) of a text; pure ASCII texts don't travel to Python. Null texts count as empty."""
    return _measured(F.when(F.octet_length(text) != F.length(text), text))


def estimate(text: Column, rate: Column) -> Column:
    """Tokens of a text at that rate; one for an empty or null text."""
    return F.greatest(F.lit(1), F.floor(F.length(F.coalesce(text, F.lit(""))) / rate)).cast("int")


def by_bytes(text: Column) -> Column:
    """Tokens (a double) without reading a character: those beyond ASCII show in the bytes they take, and count two thirds of a token a byte."""
    n, octets = F.length(text), F.octet_length(text)
    return F.greatest(F.lit(0), 2 * n - octets) / 4.0 + (octets - n) / 1.5
