"""Expressions on token arrays: fixed-length rows and attention masks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Token limits by role.
MAX_LENGTH = {"passage": 1024, "query": 128}


def fit_tokens(tokens: Column, max_length: int, eos: Column, pad: Column) -> Column:
    """The first ``max_length - 1`` tokens, then ``eos``, then ``pad`` to length."""
    if max_length < 1:
        raise ValueError("max_length must be at least 1")
    # Padded in full and cut, so that the tokens are computed once.
    padding = F.array_repeat(pad, max_length - 1)
    row = F.concat(F.slice(tokens, 1, max_length - 1), F.array(eos), padding)
    return F.slice(row, 1, max_length)


def attention_mask(tokens: Column, pad: Column) -> Column:
    """1 where a token is real, 0 where it is padding."""
    return F.transform(tokens, lambda t: (t != pad).cast("int"))


def fit_tokens_for(tokens: Column, role: str, eos: Column, pad: Column) -> Column:
    """``fit_tokens`` with the limit of the given role."""
    if role not in MAX_LENGTH:
        raise ValueError(f"role must be one of {sorted(MAX_LENGTH)}, not {role!r}")
    return fit_tokens(tokens, MAX_LENGTH[role], eos, pad)
