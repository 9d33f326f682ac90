"""Sequence-level column expressions: ids, cleaning, composition, chunks, token ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The twenty standard residues, the id pattern, the residues folded into X.
STANDARD_RESIDUES = "ACDEFGHIKLMNPQRSTVWY"
NUMERIC_ID_PATTERN = r"^[A-Za-z]+(\d+)$"
AMBIGUOUS_RESIDUES = "BOUZ"
PAD_TOKEN = 0
UNKNOWN_TOKEN = 21


def numeric_id(col: Column) -> Column:
    """The digits of a letters-then-digits id as a number, -1 for any other id."""
    digits = F.regexp_extract(col, NUMERIC_ID_PATTERN, 1)
    return F.coalesce(F.nullif(digits, F.lit("")).try_cast("bigint"), F.lit(-1).cast("bigint"))


def sequence_text(col: Column) -> Column:
    """A missing sequence reads as the text ``nan``."""
    return F.coalesce(col, F.lit("nan"))


def sequence_key(col: Column) -> Column:
    """32-byte stand-in for a whole sequence, so group-bys shuffle digests and not texts."""
    return F.unhex(F.sha2(col, 256))


def clean_sequence(col: Column) -> Column:
    return F.translate(F.upper(col), AMBIGUOUS_RESIDUES, "X" * len(AMBIGUOUS_RESIDUES))


def residue_fraction(col: Column, residue: str) -> Column:
    size = F.length(col)
    hits = size - F.length(F.replace(col, F.lit(residue), F.lit("")))
    return F.when(size == 0, F.lit(0.0)).otherwise(hits / size)


def composition(col: Column) -> dict[str, Column]:
    """Share of each standard residue over the full length, plus ``log1p`` of the length."""
    columns = {f"frac_{r}": residue_fraction(col, r) for r in STANDARD_RESIDUES}
    columns["log_length"] = F.log1p(F.length(col).cast("double"))
    return columns


def chunks(col: Column, max_len: int, stride: int, min_len: int = 10) -> Column:
    """Overlapping windows of ``max_len``; the last one is the first that reaches the end.

    A sequence that fits is one chunk whatever its size; otherwise pieces of ``min_len`` or fewer
    characters are dropped.
    """
    size = F.length(col)
    last = F.ceil((size - max_len) / F.lit(stride)).cast("int")
    pieces = F.transform(
        F.sequence(F.lit(0), F.greatest(last, F.lit(0))),
        lambda i: F.substring(col, i * stride + 1, F.lit(max_len)),
    )
    return F.when(size <= max_len, F.array(col)).otherwise(
        F.filter(pieces, lambda piece: F.length(piece) > min_len)
    )


def token_ids(col: Column, max_len: int) -> Column:
    """Fixed-length residue ids: padded when short; head, middle and tail thirds when long."""
    third = max_len // 3
    middle = max_len - 2 * third
    size = F.length(col)
    start = F.greatest(F.lit(0), F.floor(size / 2).cast("int") - middle // 2)
    kept = F.when(size <= max_len, col).otherwise(
        F.concat(
            F.substring(col, F.lit(1), F.lit(third)),
            F.substring(col, start + 1, F.lit(middle)),
            F.substring(col, size - third + 1, F.lit(third)),
        )
    )
    letters = F.filter(F.split(kept, ""), lambda c: c != "")
    known = F.transform(letters, lambda c: F.instr(F.lit(STANDARD_RESIDUES), c))
    ids = F.transform(known, lambda i: F.when(i > 0, i).otherwise(UNKNOWN_TOKEN).cast("smallint"))
    padding = F.array_repeat(F.lit(PAD_TOKEN).cast("smallint"), F.greatest(F.lit(0), max_len - size))
    return F.concat(ids, padding)
