"""Words, roles and forms of typed names of persons and organizations, in any script.

No vocabulary of names is built in: which words are given names or surnames, which are slips,
short forms or translations of others, is learned from the names themselves (``variants``,
``organizations``).
"""

from __future__ import annotations

import math
import re
import unicodedata
from functools import lru_cache
from itertools import accumulate, pairwise

import pyarrow as pa

# Academic titles, and particles that belong to the surname after them.
TITLES = frozenset("dr dra mtro mtra prof profa phd msc ing lic".split())
PARTICLES = frozenset("de del la las los da das do dos y e von van".split())
_MOJIBAKE = re.compile("[ÃÂ]")
_GAP = re.compile(r"[\s\-–,;]+")
_OUTER = re.compile(r"[^\w.'’]")
_NO_LETTER = re.compile(r"[\W\d_]")


def values(column: pa.Array) -> list:
    """The values of a column of texts, or of numbers of which none is null; much faster than ``to_pylist``."""
    return column.to_numpy(zero_copy_only=False).tolist()


def lists(column: pa.ListArray) -> list[list[str]]:
    """The lists of a column, none of them null; much faster than ``to_pylist``."""
    flat = values(column.values)
    return [flat[i:j] for i, j in pairwise(values(column.offsets))]


def list_array(rows: list[list], kind: pa.DataType) -> pa.ListArray:
    """The opposite of ``lists``."""
    offsets = [0, *accumulate(map(len, rows))]
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array([x for row in rows for x in row], kind))


def repair(text: str) -> str:
    """Undoes UTF-8 read as a one-byte encoding, where the text shows the usual signs of it."""
    if _MOJIBAKE.search(text):
        for codec in ("latin-1", "cp1252"):
            try:
                return text.encode(codec).decode("utf-8")
            except (UnicodeEncodeError, UnicodeDecodeError):
                continue
    return text


def plain(text: str) -> str:
    """Lower case without accents; letters of other scripts stay."""
    if text.isascii():
        return text.lower()
    return "".join(c for c in unicodedata.normalize("NFKD", repair(text)) if not unicodedata.combining(c)).casefold()


def near(a: str, b: str) -> bool:
    """Whether two words differ by at most one insertion, deletion, substitution or swap of neighbours."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])
    return a[i + 1 :] == b[i:] if len(a) > len(b) else a[i:] == b[i + 1 :]


def initial(word: str) -> bool:
    """Whether a word is a single letter of a script with capitals; in other scripts one sign is a word."""
    return len(word) == 1 and word.upper() != word.lower()


@lru_cache(1 << 15)
def _typed_word(raw: str) -> tuple[tuple[str, ...], bool]:
    """The words that a typed one stands for (letters with full stops are one each; titles and what has no letter are none), and whether it is two or three capitals."""
    bare = _OUTER.sub("", raw)
    letters = [x for x in bare.split(".") if x]
    if not letters:
        return (), False
    if "." in bare and all(len(x) == 1 for x in letters):
        found = tuple(plain(x) for x in letters)
    else:
        word = _NO_LETTER.sub("", plain("".join(letters)))
        if not word or word in TITLES:
            return (), False
        found = (word,)
    return found, 2 <= len(found[0]) <= 3 and len(found) == 1 and "." not in bare and bare.isupper()


def person_tokens(name: str) -> tuple[list[str], list[int], list[int]]:
    """Words of a typed name, where they stand (0 before a comma, 1 after it, 2 without one), and whether they may be initials.

    The last is 0 for a plain word, 1 for two or three capitals in a name written in capitals, and 2
    for two or three capitals in another name.
    """
    text = repair(name)
    lower = any(c.islower() for c in text)
    left, comma, right = text.partition(",")
    parts = [(left, 0), (right, 1)] if comma and left.strip() else [(text, 2)]
    words, sides, caps = [], [], []
    for part, side in parts:
        for raw in _GAP.split(part):
            found, short = _typed_word(raw)
            for w in found:
                words.append(w)
                sides.append(side)
                caps.append((2 if lower else 1) if short else 0)
    if PARTICLES.isdisjoint(words):
        return words, sides, caps
    # a particle stands before the word it belongs to; in capitals at the end of a name, or in a name not in capitals, it is initials
    keep = [not (w in PARTICLES and len(w) > 1 and caps[i] < 2 and i + 1 < len(words) and sides[i] == sides[i + 1]) for i, w in enumerate(words)]
    return tuple([x for x, k in zip(y, keep) if k] for y in (words, sides, caps))


@lru_cache(1 << 15)
def _costs(left: int, right: int) -> tuple[float, float]:
    """Log probabilities that a word is a given name or a surname, of the numbers of names that have it before a comma and after one."""
    r = min(max(math.log((right + 0.5) / (left + 0.5)), -30), 30)
    return -math.log1p(math.exp(-r)), -math.log1p(math.exp(r))


def parse_person(tokens: list[tuple[int, int, list[tuple[str, int, int, int]]]]) -> tuple[list[str], list[str]]:
    """Given names and surnames of a tokenized name.

    tokens: side, whether it may be initials, and the (repaired) words, each with the number of names
    that have it before a comma, after one, and written otherwise than in capitals. A comma decides;
    without one, the split is taken under which the words stand most often where they belong.
    """
    words: list[str] = []
    sides: list[int] = []
    stand: list[tuple[int, int]] = []  # before a comma, after one
    lone = sum(t[0] == 0 for t in tokens) == 1
    for side, caps, parts in tokens:
        if caps and not (lone and side == 0) and len(tokens) > 1 and (caps == 2 or not any(p[3] for p in parts)):
            found = [(c, (0, 0)) for p in parts for c in p[0].replace(" ", "")]
        else:
            found = [(p[0], (p[1], p[2])) for p in parts]
        for w, at in found:
            words.append(w)
            sides.append(side)
            stand.append(at)
    family = [w for w, s in zip(words, sides) if s == 0]
    if family:
        return [w for w, s in zip(words, sides) if s == 1], family
    n = len(words)
    if n < 2:
        return [], words
    single = [initial(w) for w in words]
    cost = [(0.0, -2.5) if one else _costs(*at) for one, at in zip(single, stand)]
    as_given, as_family, every = [c[0] for c in cost], [c[1] for c in cost], all(single)
    best: tuple[float, list[str], list[str]] | None = None
    for k in range(1, n):
        size = -0.1 * abs(k - min(2, n // 2)) - (0.7 if k > 2 else 0.0) - (0.7 if n - k > 2 else 0.0)
        for first in (True, False):
            g, f = (slice(k), slice(k, n)) if first else (slice(n - k, n), slice(n - k))
            if single[f.start or 0] and not every:
                continue
            total = size - (0.0 if first else 0.3) + sum(as_given[g]) + sum(as_family[f])
            if best is None or total > best[0] + 1e-9:
                best = (total, words[g], words[f])
    return (best[1], best[2]) if best else ([], words)


@lru_cache(1 << 15)
def _shortened(parts: tuple[str, ...], least: int) -> tuple[str, ...]:
    """Parts joined by blanks, and their shorter forms: some in full, the next as initials, the others left out."""
    n = len(parts)
    out = []
    for shown in range(min(least, n), n + 1):
        for full in range(shown + 1):
            out.append(" ".join([p if i < full else p[:1] for i, p in enumerate(parts[:shown])]))
    return tuple(dict.fromkeys(out))


def forms(given: list[str], family: list[str]) -> list[str]:
    """Signatures that the same name may have when shortened, without its own. The first surname stays in full."""
    own = signature(given, family)
    heads = [" ".join([*family[:1], rest]) if rest else " ".join(family[:1]) for rest in _shortened(tuple(family[1:]), 0)]
    out = {f"{g}|{f}" for g in (_shortened(tuple(given), 1) if given else [""]) for f in heads}
    out.discard(own)
    return sorted(out)


def signature(given: list[str], family: list[str]) -> str:
    return " ".join(given) + "|" + " ".join(family)


def fits(a: list[str], b: list[str]) -> bool:
    """Whether two lists of name parts agree: as far as both go, equal or one the initial of the other."""
    return a == b or all(x == y or (initial(x) and y.startswith(x)) or (initial(y) and x.startswith(y)) for x, y in zip(a, b))


_ALIAS = re.compile(r"\(([^()\s]{2,})\)")
_DOTTED = re.compile(r"\s*(?:[^\W\d_]\.){2,}\s*")
_ACRONYM = re.compile(r"\s*([^\W\d_]{2,})(?:-(?=\w)|\s*$)")


def organization_pieces(name: str) -> tuple[list[str], str, str]:
    """Pieces of a typed organization name between commas (words joined by blanks), its acronym, and the acronym written in brackets behind it.

    An acronym is a piece of dotted letters, or a word in capitals that is the whole piece or is
    joined by a hyphen to what follows, where the name is not written in capitals throughout.
    """
    text = repair(name)
    alias = ""
    if m := _ALIAS.search(text):
        alias, text = plain(m.group(1)).replace(".", ""), text[: m.start()] + text[m.end() :]
    pieces, acronym = [], ""
    for piece in re.split(r"[,;]", text):
        if not piece.strip():
            continue
        rest = piece
        if _DOTTED.fullmatch(piece):
            acronym, rest = acronym or _NO_LETTER.sub("", plain(piece)), ""
        elif (m := _ACRONYM.match(piece)) and m.group(1).isupper():
            tail = piece[m.end() :]
            if tail.strip() or not any(c.isupper() and w.isupper() and len(w) > 3 for w in re.split(r"[\s,;]+", text.replace(m.group(1), "", 1)) for c in w):
                acronym, rest = acronym or plain(m.group(1)), tail
        words = [w for raw in re.split(r"[\s\-–./]+", plain(rest)) if (w := _NO_LETTER.sub("", raw))]
        if words:
            pieces.append(" ".join(words))
    return pieces, acronym, alias
