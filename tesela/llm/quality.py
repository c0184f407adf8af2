"""Per-document text statistics and form: prose, list, table or junk (problem 10).

Every line becomes a vector of binned statistics (cells, markers, shares of common words, digits and
symbols, shape of its words and so on). A hidden Markov model reads the lines of a document; its
states are kinds of lines, each of which belongs to one of the four forms, and emit the statistics
independently. Start, transition and emission tables are estimated by expectation maximisation over
all documents, from starting tables that count as much as a few lines. The document's form is the
one with the largest share of its characters.
"""

from __future__ import annotations

import re
from bisect import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesela.session import durable

# Frequent function words of Spanish, English and Portuguese.
COMMON = frozenset(
    """a al ante aunque cada como con contra cuando de del desde donde dos durante e el ella en entre era es esta este esto fue ha han hasta la las le les lo los más mas mientras muy ni no nos o para pero por porque que qué se según ser si sí sin sobre solo son su sus también tiene un una uno y ya
    about after all although an and are as at be because been before between but by can did do for from had has have he her his how i if in into is it its more most no not of on only or our she since so some such than that the their them there these they this to under was we were what when where which while who with would you
    ainda ao aos as até ate cerca com da das dele do dos é em embora enquanto entre essa esse esta está este foi mais mas muito na nas nem no nos num numa não nao os ou para pela pelo pelas pelos quando quem sem ser seu seus são sao só sua suas também tambem tem um uma""".split()
)

STATES = ("prose", "list", "table", "junk")

_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)?")
_BULLET = re.compile(r"[-–—*•+☐☑☒▪◦‣·]\s|\[[ xX✓]?\]\s")
_NUMBERED = re.compile(r"(?:\[\d+\]|\(\w{1,3}\)|\d+(?:\.\d+)*[.)]|\d+\.\d+(?:\.\d+)*|[a-z][.)])\s")
_KEY = re.compile(r"[^:\t]{1,24}:(?:\s|$)")
_TIGHT = re.compile(r"[;,](?=[^\s])")
_WIDE = re.compile(r"(?<=\S) {2,}(?=\S)")
_LOOSE = re.compile(r"[,;|·•/]\s")
_NOISE = "$%&*+=_#?¡¿<>{}@^~\\©€™�Ã¤¦§¬¢"
_YEAR = re.compile(r"\((?:19|20)\d\d[a-z]?\)")
_RUN = re.compile(r"[^\W\d_aeiouyáéíóúàâêôãõüAEIOUYÁÉÍÓÚÂÊÔÃÕÜ]{5,}")
#: Whether a byte of Latin-1 may be a letter of a run: ``?``, which also stands for all that Latin-1 has not, and what ``_RUN`` admits.
_IN_RUN = bytes(ord("x" if c == "?" or _RUN.fullmatch(c * 5) else " ") for c in map(chr, range(256)))
_LEADER = re.compile(r"(?:\.{3,}|…{2,}|(?: \.){3,})\s*\d+$")
_DIGITS = re.compile(r"\d\S*")
_ENDS = (".", "?", "!", ":", "…", '."', ".”", ".»", ".)")

#: Statistics of a line and the number of their bins.
FEATURES = {"cells": 5, "delimiter": 5, "items": 3, "marker": 6, "end": 4, "common": 5, "words": 5, "digits": 4, "signs": 4, "noise": 4, "shape": 7, "year": 2, "token": 5, "distinct": 4}


def line_statistics(line: str, text: str, previous: str, words: list[str], n_common: int, n_letters: int, tokens: list[str], visible: int, ended: bool, noisy: str) -> bytes:
    """Bins of the statistics of a non-blank line, in the order of ``FEATURES``; every test takes time linear in the line, at any length.

    text: the line without blanks around it; n_letters and visible: summed lengths of its words and
    tokens; noisy: the characters of ``_NOISE`` that its document has. A search is left out where a
    cheaper one shows that it finds nothing.
    """
    size, n, n_words = len(text), len(tokens), len(words)
    first, last = text[0], text[-1]
    bars, commas, tabs = text.count("|"), text.count(",") + text.count(";"), line.strip(" ").count("\t")
    spaced = text.count(", ") + text.count("; ") if commas else 0
    counts = (tabs, bars if bars > 1 or bars and " | " not in text else 0, len(_TIGHT.findall(text)) if commas > spaced + (last in ",;") else 0, len(_WIDE.findall(text)) if "  " in text else 0)
    most = max(counts)
    kind = counts.index(most)
    cells = 1 + most
    grid = first == "|" or text.startswith(("+-", "+="))
    if cells > 1 and kind == 1 and not grid and bars < 2:
        cells = 1
    per_cell = n / cells
    cell_bin = 4 if grid else 0 if cells == 1 else 1 if per_cell <= 2 else 2 if per_cell <= 5 else 3
    delimiter = 0 if cells == 1 and not grid else 2 if grid else kind + 1
    items = 1 + (len(_LOOSE.findall(text)) if commas or bars or "/" in text or "·" in text or "•" in text else 0)
    item_bin = 0 if items < 3 else 1 if n_words <= 4 * items else 2
    upper = first.isupper()
    if not upper and _BULLET.match(text + " "):
        marker = 1
    elif not upper and _NUMBERED.match(text + " "):
        marker = 2
    elif n <= 9 and ":" in text and (m := _KEY.match(text)) and len(m.group().split()) <= 3:
        marker = 3
    else:
        marker = 4 if upper else 5 if first.islower() else 0
    number = last.isdigit()
    end = 2 if number and _LEADER.search(text[-80:]) else 1 if ended else 3 if number else 0
    share = n_common / n_words if n_words else 0.0
    digits = len(_DIGITS.findall(text)) / n
    signs = max(0, visible - n_letters)
    distinct = len(set(words))
    lengths = [*map(len, tokens)]
    longest = max(lengths)
    if n <= 8 and text == previous:
        shape = 1
    elif longest >= 40 and longest > size / 2:
        shape = 2
    elif n >= 8 and lengths.count(1) >= 0.6 * n:
        shape = 3
    elif n >= 8 and distinct <= 10 and distinct <= n_words / 4:
        shape = 4
    elif n >= 3 and b"xxxxx" in text.encode("latin-1", "replace").translate(_IN_RUN) and len(_RUN.findall(text)) >= 0.35 * n:
        shape = 5
    else:
        shape = 6 if n >= 12 and share < 0.06 and item_bin != 1 else 0
    noise = sum(map(text.count, noisy)) if signs else 0
    return bytes((
        cell_bin, delimiter, item_bin, marker, end, 0 if share == 0 else 1 + bisect(_SHARES, share), bisect(_WORDS, n), 0 if digits == 0 else 1 + bisect(_DIGIT_SHARES, digits),
        bisect(_SIGNS, signs / size), 1 + bisect(_NOISES, noise / size) if noise else 0, shape, 1 if "(" in text and _YEAR.search(text) else 0,
        bisect(_TOKENS, visible / n), 0 if n_words < 8 else 1 + bisect(_REPEATS, -distinct / n_words),
    ))


# Bounds of bins; a value at a bound is in the upper bin.
_SHARES, _WORDS, _DIGIT_SHARES, _SIGNS, _NOISES, _TOKENS, _REPEATS = (0.1, 0.2, 0.35), (3, 6, 9, 17), (0.25, 0.5), (0.03, 0.08, 0.2), (0.025, 0.08), (1.5, 3, 9, 20), (-0.5, -0.25)


#: Starting weights of the statistics of a line in general.
USUAL = {
    "cells": [9, 0.3, 0.3, 0.3, 0.02], "delimiter": [9, 0.3, 0.1, 0.3, 0.3], "items": [8, 1, 1], "marker": [1, 0.1, 0.2, 0.2, 5, 3], "end": [5, 4, 0.1, 1], "common": [3, 2, 2, 2, 2], "words": [1, 1, 1, 2, 3],
    "digits": [7, 2, 0.5, 0.3], "signs": [5, 3, 1, 0.3], "noise": [9, 1, 0.3, 0.1], "shape": [9, 0.1, 0.02, 0.02, 0.05, 0.2, 0.3], "year": [9.5, 0.3], "token": [0.02, 0.5, 9, 0.3, 0.05], "distinct": [5, 5, 0.5, 0.02],
}
#: Kinds of lines: their form, and the starting weights of the statistics that tell them from lines in general.
KINDS = {
    "sentence": ("prose", {"cells": [9, 0.1, 0.2, 0.6, 0.02], "items": [6, 0.3, 3], "marker": [0.3, 0.1, 0.2, 0.1, 6, 3], "end": [3, 7, 0.05, 0.2], "common": [0.1, 0.3, 1, 5, 5], "words": [0.2, 0.5, 1, 3, 6], "digits": [6, 3, 0.3, 0.05], "signs": [6, 4, 0.3, 0.02], "noise": [9, 0.6, 0.1, 0.02], "shape": [9.8, 0.01, 0.002, 0.002, 0.01, 0.03, 0.1]}),
    "phrase": ("prose", {"cells": [9, 0.1, 0.2, 0.2, 0.02], "marker": [0.3, 0.05, 0.1, 0.1, 5, 5], "end": [6, 4, 0.05, 0.2], "common": [0.5, 0.5, 1.5, 4, 4], "words": [2, 3, 3, 2, 1], "digits": [8, 1, 0.3, 0.1], "signs": [6, 3, 0.3, 0.05], "noise": [9, 0.3, 0.1, 0.02], "shape": [9.8, 0.01, 0.002, 0.002, 0.01, 0.03, 0.05]}),
    "bullet": ("list", {"cells": [9, 0.3, 0.2, 0.2, 0.01], "marker": [0.1, 5, 5, 0.1, 0.1, 0.1], "end": [7, 1, 1, 1], "words": [2, 4, 3, 1, 0.3], "noise": [6, 2, 2, 0.3], "shape": [9.5, 0.01, 0.01, 0.01, 0.01, 0.1, 0.05]}),
    "items": ("list", {"cells": [9, 0.2, 0.3, 0.3, 0.01], "items": [0.3, 9, 0.5], "end": [6, 3, 0.1, 0.5], "common": [5, 3, 1, 0.2, 0.05], "words": [0.3, 1, 2, 3, 3], "digits": [8, 1.5, 0.3, 0.1], "noise": [9, 0.6, 0.2, 0.05], "shape": [9, 0.05, 0.02, 0.02, 0.05, 0.1, 0.8]}),
    "reference": ("list", {"cells": [9, 0.1, 0.2, 0.4, 0.01], "year": [0.1, 9], "common": [2, 3, 3, 1, 0.1], "words": [0.1, 0.2, 0.5, 4, 5], "end": [3, 4, 0.1, 3], "noise": [9, 0.6, 0.1, 0.02], "shape": [9, 0.02, 0.02, 0.02, 0.02, 0.05, 0.5]}),
    "entry": ("list", {"cells": [9.5, 0.2, 0.1, 0.05, 0.01], "marker": [0.3, 0.05, 0.1, 0.5, 5, 4], "end": [8, 0.3, 2, 0.3], "common": [6, 0.5, 1, 1, 0.3], "words": [4, 5, 1, 0.3, 0.02], "digits": [9, 0.3, 0.5, 0.3], "signs": [8, 1, 0.4, 0.1], "noise": [9.5, 0.2, 0.1, 0.05], "shape": [9.5, 0.01, 0.01, 0.01, 0.01, 0.1, 0.01]}),
    "rows": ("table", {"marker": [4, 1, 1, 1, 3, 3], "digits": [2, 2, 2, 2], "signs": [3, 3, 3, 3], "noise": [5, 1, 1, 3], "words": [3, 3, 3, 3, 3], "end": [5, 1, 0.1, 3], "cells": [0.05, 4, 3, 0.5, 4], "delimiter": [0.02, 5, 5, 0.1, 0.1], "common": [6, 2, 1, 0.5, 0.2]}),
    "tight": ("table", {"marker": [3, 0.3, 0.3, 0.3, 3, 3], "digits": [1, 1, 2, 4], "signs": [2, 3, 3, 2], "words": [5, 2, 1, 1, 1], "end": [5, 0.5, 0.1, 5], "cells": [0.1, 9, 0.5, 0.05, 0.01], "delimiter": [0.05, 0.1, 0.1, 9, 0.1], "common": [8, 1, 0.5, 0.2, 0.1], "shape": [9, 0.1, 0.3, 0.02, 0.02, 0.1, 0.1]}),
    "columns": ("table", {"marker": [3, 0.3, 0.3, 0.3, 3, 3], "digits": [2, 2, 2, 3], "words": [1, 3, 3, 2, 1], "end": [5, 0.5, 0.1, 5], "cells": [0.1, 7, 3, 0.2, 0.01], "delimiter": [0.05, 0.1, 0.1, 0.1, 9], "common": [7, 2, 1, 0.3, 0.1], "shape": [9, 0.1, 0.02, 0.1, 0.02, 0.1, 0.1]}),
    "key": ("table", {"cells": [9, 0.5, 0.3, 0.1, 0.01], "marker": [0.05, 0.02, 0.02, 9, 0.1, 0.1], "words": [5, 4, 1, 0.1, 0.01], "end": [5, 1, 0.1, 4]}),
    "noise": ("junk", {"cells": [6, 2, 1, 1, 0.1], "signs": [0.1, 0.5, 2, 7], "noise": [0.3, 0.5, 2, 7], "common": [8, 1, 0.5, 0.2, 0.1], "marker": [6, 0.5, 0.3, 0.1, 1, 1]}),
    "odd": ("junk", {"cells": [8, 0.5, 0.3, 0.3, 0.02], "noise": [0.1, 1, 7, 3], "common": [4, 3, 2, 1, 0.5], "signs": [0.5, 2, 4, 4]}),
    "repeat": ("junk", {"distinct": [4, 0.1, 0.5, 6], "shape": [0.02, 6, 0.1, 0.1, 6, 0.1, 0.1], "items": [4, 4, 4], "common": [5, 2, 2, 2, 2]}),
    "spaced": ("junk", {"token": [9, 0.3, 0.05, 0.02, 0.02], "distinct": [1, 2, 3, 5], "shape": [0.02, 0.05, 0.1, 9, 0.1, 0.1, 0.1], "words": [0.1, 0.1, 0.3, 1, 9]}),
    "glued": ("junk", {"token": [0.02, 0.05, 0.3, 3, 7], "shape": [0.02, 0.05, 9, 0.1, 0.1, 0.3, 0.1], "common": [9, 0.3, 0.1, 0.1, 0.1], "words": [9, 1, 0.3, 0.1, 0.1]}),
    "letters": ("junk", {"shape": [0.1, 0.05, 0.2, 0.1, 0.1, 8, 4], "common": [8, 2, 0.3, 0.1, 0.05], "cells": [9, 0.3, 0.2, 0.2, 0.02], "year": [9.5, 0.1], "items": [8, 0.3, 1]}),
    "numbers": ("junk", {"cells": [9.5, 0.1, 0.1, 0.05, 0.01], "digits": [0.02, 0.1, 0.5, 9], "words": [0.05, 2, 3, 3, 3], "marker": [6, 0.1, 0.3, 0.05, 1, 1], "common": [9, 0.5, 0.2, 0.05, 0.02], "noise": [7, 1, 1, 1]}),
}
STAY = 0.94  # starting chance that the next line has the same form
STRENGTH = 200.0  # lines that the starting tables of a kind count as


def text_features(text: str) -> tuple:
    """Statistics of one text and the binned statistics and sizes of its non-blank lines.

    ``(n_words, mean_word_length, symbol_ratio, punct_line_share, common_share, lines, sizes)``; the
    ratios of a text without words or characters are 0.
    """
    n_words = n_letters = n_common = ended = visible = 0
    lines, sizes, previous = [], [], ""
    # signs other than apostrophes become blanks, so that words are split off; line breaks stay
    spelled = text.lower()
    for c in set(spelled):
        if not (c.isalnum() or c.isspace() or c in "'’"):
            spelled = spelled.replace(c, " ")
    marked = "'" in spelled or "’" in spelled
    noisy = "".join(c for c in _NOISE if c in text)
    for line, low in zip(text.splitlines(), spelled.splitlines()):
        tokens = line.split()
        if not tokens:
            continue
        bare = line.strip()
        words = _WORD.findall(low) if marked and ("'" in low or "’" in low) else low.split()
        common, letters, seen, ends = sum(map(COMMON.__contains__, words)), len("".join(words)), len("".join(tokens)), bare.endswith(_ENDS)
        n_words += len(words)
        n_letters += letters
        n_common += common
        visible += seen
        ended += ends
        lines.append(line_statistics(line, bare, previous, words, common, letters, tokens, seen, ends, noisy))
        sizes.append(len(bare))
        previous = bare
    symbol_ratio = max(0, visible - n_letters) / len(text) if text else 0.0
    return (n_words, n_letters / n_words if n_words else 0.0, symbol_ratio, ended / len(sizes) if sizes else 0.0, n_common / n_words if n_words else 0.0, b"".join(lines), sizes)


_FEATURES = "n_words long, mean_word_length double, symbol_ratio double, punct_line_share double, common_share double, lines binary, sizes array<int>"


def document_features(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Statistics of every text and its lines; a null text counts as empty."""
    kind = docs.schema[key].dataType.simpleString()
    names = ["n_words", "mean_word_length", "symbol_ratio", "punct_line_share", "common_share", "lines", "sizes"]
    types = [pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.float64(), pa.binary(), pa.list_(pa.int32())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(zip(*[text_features(t or "") for t in batch.column(1).to_pylist()])) or [[]] * 7
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(columns, types)]], [key, *names])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, {_FEATURES}")


class LineModel:
    """Start, transition and emission tables of the hidden Markov model over the kinds of lines."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: list[np.ndarray]):
        self.start, self.move, self.emit = start, move, emit
        self.logs = [np.log(e) for e in emit]

    @classmethod
    def starting(cls) -> LineModel:
        forms = [f for f, _ in KINDS.values()]
        k = len(forms)
        same = np.array([[a == b for b in forms] for a in forms])
        move = np.where(same, STAY / same.sum(1, keepdims=True), (1 - STAY) / (~same).sum(1, keepdims=True))
        start = np.array([0.7 if f == "prose" else 0.1 for f in forms]) / np.array([forms.count(f) for f in forms])
        emit = []
        for name, bins in FEATURES.items():
            table = np.array([np.array(w.get(name, USUAL[name]), float) for _, w in KINDS.values()])
            emit.append((table / table.sum(1, keepdims=True) + 0.0003) / (1 + 0.0003 * bins))
        return cls(start / start.sum(), move.reshape(k, k), emit)

    def likelihoods(self, codes: np.ndarray) -> np.ndarray:
        """Of every kind for lines ``(sequences, lines, statistics)``, scaled per line."""
        logs = sum(table.T[codes[:, :, f]] for f, table in enumerate(self.logs))
        return np.exp(logs - logs.max(2, keepdims=True))

    def posteriors(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For sequences of one length: the kinds' posteriors per line, and the summed moves."""
        n, size, _ = codes.shape
        lik = self.likelihoods(codes).transpose(1, 0, 2)
        ahead = np.empty_like(lik)
        a = self.start * lik[0]
        ahead[0] = a / a.sum(1, keepdims=True)
        for t in range(1, size):
            a = (ahead[t - 1] @ self.move) * lik[t]
            ahead[t] = a / a.sum(1, keepdims=True)
        moves = np.zeros_like(self.move)
        back = np.ones((n, len(self.start)))
        for t in range(size - 1, 0, -1):
            right = lik[t] * back
            total = ((ahead[t - 1] @ self.move) * right).sum(1, keepdims=True)
            moves += (ahead[t - 1] / total).T @ right * self.move
            back = right @ self.move.T
            back /= back.sum(1, keepdims=True)
            p = ahead[t - 1] * back
            ahead[t - 1] = p / p.sum(1, keepdims=True)
        return ahead.transpose(1, 0, 2), moves


_CELLS = 1 << 20  # likelihoods held at a time, whatever the number of documents and lines


def _by_length(lines: list[bytes]) -> Iterator[tuple[list[int], np.ndarray]]:
    """Documents of equal numbers of lines: their rows and codes."""
    width = len(FEATURES)
    groups: dict[int, list[int]] = {}
    for i, x in enumerate(lines):
        if x:
            groups.setdefault(len(x) // width, []).append(i)
    for size, rows in groups.items():
        step = max(1, _CELLS // (size * len(KINDS)))
        for at in range(0, len(rows), step):
            part = rows[at : at + step]
            yield part, np.frombuffer(b"".join(lines[i] for i in part), np.uint8).reshape(len(part), size, width)


def train(features: DataFrame, rounds: int = 3) -> LineModel:
    """Expectation maximisation over all documents; tasks return sums of expected counts (some hundred numbers), never sequences."""
    sequences = features.where(F.length("lines") > 0).select("lines")
    first = model = LineModel.starting()
    k, bins = len(KINDS), list(FEATURES.values())
    for _ in range(rounds):

        def expect(batches: Iterator[pa.RecordBatch], m: LineModel = model) -> Iterator[pa.RecordBatch]:
            start, move, emit = np.zeros(k), np.zeros((k, k)), [np.zeros((k, b)) for b in bins]
            for batch in batches:
                for _, codes in _by_length(batch.column(0).to_pylist()):
                    post, moves = m.posteriors(codes)
                    start += post[:, 0].sum(0)
                    move += moves
                    flat, each = post.reshape(-1, k), codes.reshape(-1, len(bins))
                    for f, b in enumerate(bins):
                        emit[f] += (flat.T @ np.eye(b)[each[:, f]])
            out = np.concatenate([start, move.ravel(), *[e.ravel() for e in emit]])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(out)), pa.int32()), pa.array(out)], ["i", "v"])

        total = {r["i"]: r["v"] for r in sequences.mapInArrow(expect, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()}
        flat = np.array([total.get(i, 0.0) for i in range(k + k * k + k * sum(bins))])
        start = flat[:k] + STRENGTH * first.start
        move = flat[k : k + k * k].reshape(k, k) + STRENGTH * first.move
        ends = k + k * k + k * np.cumsum([0, *bins])
        emit = [flat[ends[f] : ends[f + 1]].reshape(k, b) + STRENGTH * first.emit[f] for f, b in enumerate(bins)]
        model = LineModel(start / start.sum(), move / move.sum(1, keepdims=True), [e / e.sum(1, keepdims=True) for e in emit])
    return model


def label_documents(features: DataFrame, model: LineModel, key: str = "doc_id") -> DataFrame:
    """Features plus the character shares of the four forms and ``form``; null form for texts without visible lines."""
    kept = ["n_words", "mean_word_length", "symbol_ratio", "punct_line_share", "common_share"]
    kind = features.schema[key].dataType.simpleString()
    form_of = np.array([[f == s for s in STATES] for f, _ in KINDS.values()], float)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines, sizes = batch.column("lines").to_pylist(), batch.column("sizes").to_pylist()
            shares = np.zeros((len(lines), len(STATES)))
            for rows, codes in _by_length(lines):
                forms = model.posteriors(codes)[0] @ form_of
                weight = np.array([sizes[i] for i in rows], float)
                shares[rows] = np.einsum("nl,nls->ns", weight, forms) / weight.sum(1, keepdims=True)
            form = [None if not t else STATES[0] if s[0] >= 0.5 else STATES[1 + int(s[1:].argmax())] for t, s in zip(lines, shares)]
            yield pa.RecordBatch.from_arrays([batch.column(key), *[batch.column(c) for c in kept], *[pa.array(shares[:, i]) for i in range(len(STATES))], pa.array(form, pa.string())], [key, *kept, *[f"{s}_share" for s in STATES], "form"])

    schema = f"`{key}` {kind}, n_words long, mean_word_length double, symbol_ratio double, punct_line_share double, common_share double, " + ", ".join(f"{s}_share double" for s in STATES) + ", form string"
    return features.select(key, *kept, "lines", "sizes").mapInArrow(run, schema)


def quality(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Statistics, label shares and form of every document."""
    features = durable(document_features(docs, key, text), eager=True)
    return label_documents(features, train(features), key)
