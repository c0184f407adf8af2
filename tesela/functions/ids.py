"""Normal forms of identifiers that people and systems write in several ways."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def work_key(written: Column) -> Column:
    """``W`` and the digits a written work id ends in; null for null, blank or digitless."""
    digits = F.regexp_extract(written, r"(\d+)\s*$", 1)
    return F.when(digits != "", F.concat(F.lit("W"), digits))


def registry_key(written: Column) -> Column:
    """Registry number without leading zeros (prefix, thousands commas and a ``.0`` tail drop).

    Null when the cell holds no number.
    """
    bare = F.regexp_replace(F.regexp_replace(written, r"[.]0+\s*$", ""), r"(?<=\d)[,.\s](?=\d{3})", "")
    digits = F.regexp_replace(F.regexp_extract(bare, r"(\d+)", 1), r"^0+", "")
    return F.when(digits != "", digits)


def registry_level(written: Column) -> Column:
    """Level of a registry row as C, 1, 2, 3 or E; null for blanks, sentinels and unknown text."""
    bare = F.translate(F.lower(F.trim(written)), "áéíóúÁÉÍÓÚ", "aeiouaeiou")
    bare = F.regexp_replace(bare, r"^(?:sni\w*|nivel|level|n)[\s.:_-]*(?=(?:[0-3c]|i+|uno|dos|tres|emerit)\b|emerit)", "")
    bare = F.trim(F.regexp_replace(bare, r"^0+(?=\d)|\.0+$", ""))
    return (
        F.when(bare.rlike(r"^(c|cand\b.*|candidat.*)$"), "C")
        .when(bare.rlike(r"^(1|i|uno)$"), "1")
        .when(bare.rlike(r"^(2|ii|dos)$"), "2")
        .when(bare.rlike(r"^(3|iii|tres)$"), "3")
        .when(bare.rlike(r"^e$|emerit"), "E")
    )
