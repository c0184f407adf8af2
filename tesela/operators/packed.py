"""Several values packed in one cell, split by a parsing expression grammar (problem 7).

The grammar, with ordered alternatives and backtracking::

    cell   <- gap? value (gap value)* gap? END
    value  <- group? (quoted &(gap / group / END)  /  bare)
    quoted <- '"' ('""' / !'"' .)* '"'
    group  <- '[' (!']' .)* ']'            fields with author groups only
    bare   <- (entity / !gap !(space '[') .)+
    entity <- '&' name ';'                 protects the ';' of HTML entities

A quoted alternative that does not close, or is not followed by a joiner or the end,
fails and the parser backtracks to ``bare``; such values carry an error flag. What a
``gap`` is depends on the cell: hard joiners (``; | tab line-break`` and bullets) always
count; where a cell has none outside quotes, the grammar of soft joiners (commas) is the
next alternative, if the field allows it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SIGNS = r"[;；|\n\r\t·•]|(?<=\s)/(?=\s)"
_WORDS = r"(?:,\s*|\s+|(?<=\"))(?:and|AND|And|y|&)(?=\s)"
_QUOTED = re.compile(r'"((?:""|[^"])*)"')
_GROUP = re.compile(r"\[[^\]]*\]\s*")
_ENTITY = re.compile(r"&(?:[A-Za-z][A-Za-z0-9]*|#\d+|#x[0-9A-Fa-f]+);")
_SPACE = re.compile(r"\s*")


@dataclass(frozen=True)
class FieldGrammar:
    """What joins values in a field: words (and, y, &), commas, bracketed author groups."""

    words: bool = False
    commas: bool = False
    groups: bool = False
    slash: bool = True


AUTHORS = FieldGrammar(words=True, commas=True)
ADDRESSES = FieldGrammar(groups=True, slash=False)
KEYWORDS = FieldGrammar(commas=True)


def _gap(grammar: FieldGrammar, commas: bool) -> re.Pattern:
    parts = [_SIGNS if grammar.slash else _SIGNS.split("|(?<=")[0]]
    if grammar.words:
        parts.insert(0, _WORDS)
    if commas:
        parts.append(",")
    return re.compile("(?:" + "|".join(parts) + ")")


_GAPS = {(g, c): _gap(g, c) for g in (AUTHORS, ADDRESSES, KEYWORDS) for c in (False, True)}
_HARD = {g: re.compile(_SIGNS if g.slash else _SIGNS.split("|(?<=")[0]) for g in (AUTHORS, ADDRESSES, KEYWORDS)}


def _parse(cell: str, grammar: FieldGrammar, commas: bool) -> list[tuple[str, int, bool, bool]]:
    """Values of a cell as (text, offset, malformed, quoted)."""
    gap = _GAPS[grammar, commas]
    out: list[tuple[str, int, bool, bool]] = []
    pos, end = 0, len(cell)
    while pos < end:
        pos = _SPACE.match(cell, pos).end()
        while pos < end and (m := gap.match(cell, pos)):
            pos = _SPACE.match(cell, m.end()).end()
        if grammar.words and (m := re.compile(r"(?:and|AND|And|y|&)\s+").match(cell, pos)) and out:
            pos = m.end()
        if pos >= end:
            break
        malformed = False
        if grammar.groups and cell[pos] == "[":
            if m := _GROUP.match(cell, pos):
                pos = m.end()
                continue_at = gap.match(cell, pos)
                if pos >= end or continue_at or cell[pos] == "[":
                    continue
            else:
                malformed = True
        if cell[pos] == '"':
            m = _QUOTED.match(cell, pos)
            after = _SPACE.match(cell, m.end()).end() if m else pos
            if m and (after >= end or gap.match(cell, after) or gap.match(cell, m.end()) or cell[after] in (",", "[")):
                text = m.group(1).replace('""', '"').strip()
                if text:
                    out.append((text, pos, malformed, True))
                pos = after + 1 if after < end and cell[after] == "," else after
                continue
            malformed = True
        start = pos
        while pos < end:
            if m := _ENTITY.match(cell, pos):
                pos = m.end()
            elif gap.match(cell, pos) or (grammar.groups and cell[pos] == "[" and pos > start and cell[pos - 1].isspace()):
                break
            else:
                pos += 1
        text = cell[start:pos].strip()
        if text:
            out.append((text, start, malformed, False))
    return out


def _inverted_name(value: str) -> bool:
    """Whether a text with a comma reads as one name: surnames, a comma, given names or initials."""
    left, _, right = value.partition(",")
    before, after = left.split(), right.split()
    if "," in right or not before or not after or not right.startswith(" "):
        return False
    initial = re.compile(r"^(?:\w\.?-?){1,3}$|^\w\.$")
    short = [bool(initial.match(t)) and (t.endswith(".") or t.isupper()) for t in after]
    if len(before) > 2 or re.match(r"^\w\.$", before[0]):
        return False
    return all(short) or (len(after) <= 2 and not short[0])


def split_cell(cell: str | None, grammar: FieldGrammar) -> list[tuple[str, int, bool]]:
    """``(value, offset, malformed)`` for every non-empty value; null and blank cells have none."""
    if cell is None or not cell.strip():
        return []
    found = _parse(cell, grammar, False)
    if grammar.commas:
        bare = [v for v, _, _, quoted in found if not quoted]
        outside = _ENTITY.sub("", _QUOTED.sub("", cell))
        hard = bool(_HARD[grammar].search(outside.strip()))
        with_comma = [v for v in bare if "," in v]
        soft = bool(with_comma) and not hard
        if soft and grammar.words:  # names: a comma may stand inside each one
            soft = not all(_inverted_name(v) for v in bare)
        if soft:
            found = _parse(cell, grammar, True)
    return [(v, at, bad) for v, at, bad, _ in found]


GRAMMARS = {"au": AUTHORS, "c1": ADDRESSES, "de": KEYWORDS}


def split_fields(records: DataFrame, key: str, fields: dict[str, FieldGrammar]) -> DataFrame:
    """One row per value: ``key, field_name, item_no, item_value, offset, malformed``.

    Exact duplicate records count once; item numbers start at 1 in each cell; values keep
    their text without outer space and wrapping quotes. Null and blank cells give no rows.
    Work is per record and needs no data beyond it.
    """
    names = list(fields)
    key_type = records.schema[key].dataType.simpleString()
    rows = records.select(key, *names).distinct()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out: dict[str, list] = {c: [] for c in (key, "field_name", "item_no", "item_value", "offset", "malformed")}
            for name in names:
                grammar = fields[name]
                for k, cell in zip(pdf[key], pdf[name]):
                    for no, (value, at, bad) in enumerate(split_cell(cell if isinstance(cell, str) else None, grammar), 1):
                        for c, v in zip(out, (k, name, no, value, at, bad)):
                            out[c].append(v)
            yield pd.DataFrame(out)

    schema = f"`{key}` {key_type}, field_name string, item_no int, item_value string, offset int, malformed boolean"
    return rows.mapInPandas(run, schema)


def field_report(values: DataFrame) -> DataFrame:
    """Per field: cells, values, malformed values and the most values in a cell."""
    return values.groupBy("field_name").agg(
        F.sum(F.when(F.col("item_no") == 1, 1).otherwise(0)).alias("n_cells"), F.count(F.lit(1)).alias("n_values"), F.sum(F.col("malformed").cast("int")).alias("n_malformed"), F.max("item_no").alias("most_values")
    )
