"""Encoding with a public byte-level BPE tokenizer through a tokenization automaton (problem 8).

The automaton has one state per last token; a transition from state ``p`` by token ``w`` exists
iff ``p w`` can stand side by side in a canonical tokenization. It is defined by adding one merge
gadget after the other: the gadget of merge ``(u, v) -> w``

* gives state ``w`` the arcs that state ``v`` has so far,
* takes the arc ``v`` away from state ``u``,
* adds the arc ``w`` to every state that still has the arc ``u``.

Whether an arc survives all gadgets is decided once by unrolling the gadgets that touch it (their
order is the rank of the merges) and kept in the transition table, which therefore holds only
arcs that texts ask for. A word is read byte by byte; at every position exactly one arc label can
end the canonical path, the labels of the path are the ids, and decoding emits the labels.
"""

from __future__ import annotations

import json
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

#: Fixed value: the published pre-splitting pattern of the 50k byte-level vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
DEFAULT_PATH = "/opt/tokenizers/byte_bpe_50k.json"
CACHE_WORDS = 200_000  # words kept per worker; the cache starts anew beyond it


def _printable_bytes() -> dict[str, int]:
    """The reversible byte-to-character alphabet of byte-level vocabularies, inverted."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in plain}
    out |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    return out


def read_vocabulary(path: str = DEFAULT_PATH) -> tuple[list[bytes], list[tuple[int, int, int]]]:
    """Labels by id and the merges ``(left id, right id, id)`` in rank order; added special tokens stay out."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    of = _printable_bytes()
    vocab = {k: v for k, v in model["vocab"].items() if all(c in of for c in k)}
    merges = []
    for pair in model["merges"]:
        left, right = pair.split(" ") if isinstance(pair, str) else pair
        merges.append((vocab[left], vocab[right], vocab[left + right]))
    made = {m[2] for m in merges}
    labels = [b""] * (max(vocab.values()) + 1)
    for text, i in vocab.items():
        if len(text) == 1 or i in made:
            labels[i] = bytes(of[c] for c in text)
    return labels, merges


class MergeAutomaton:
    """Deterministic tokenization automaton of a merge list."""

    def __init__(self, labels: list[bytes], merges: list[tuple[int, int, int]]):
        self.labels = labels
        self.ids = {b: i for i, b in enumerate(labels) if b}
        self.longest = [1] * 256  # longest label that ends in a byte
        for b in self.ids:
            self.longest[b[-1]] = max(self.longest[b[-1]], len(b))
        self.birth = [-1] * len(labels)
        self.left, self.right = [0] * len(labels), [0] * len(labels)
        self.rank: dict[int, int] = {}
        for k, (u, v, w) in enumerate(merges):
            if self.birth[w] < 0:
                self.birth[w], self.left[w], self.right[w] = k, u, v
            self.rank.setdefault(u << 32 | v, k)
        self.arcs: dict[int, bool] = {}
        self.words: dict[str, tuple[int, ...]] = {}
        self.split = regex.compile(PATTERN).findall

    def arc(self, p: int, w: int) -> bool:
        """Whether the arc ``w`` of state ``p`` survives all merge gadgets."""
        key = p << 32 | w
        known = self.arcs.get(key)
        if known is None:
            known = self.arcs[key] = self._unroll(p, w)
        return known

    def _unroll(self, p: int, w: int) -> bool:
        rank, birth = self.rank, self.birth
        before = len(rank) + 1  # gadgets of a lower rank than this have acted on the arc
        while True:
            if rank.get(p << 32 | w, before) < before:
                return False
            bp, bw = birth[p], birth[w]
            if bp < 0 and bw < 0:
                return True
            if bw > bp:  # the gadget of w added it, if the arc of its left part was there after the removal
                before, w = bw + 1, self.left[w]
            elif bp > bw:  # state p began as a copy of the state of its right part
                before, p = bp, self.right[p]
            else:
                before, p, w = bw, self.right[p], self.left[w]

    def encode_word(self, word: str) -> tuple[int, ...]:
        data = word.encode("utf-8")
        whole = self.ids.get(data)
        if whole is not None:
            return (whole,)
        ids, arc, size, longest = self.ids.get, self.arc, len(data), self.longest
        last = [0] * (size + 1)
        for end in range(1, size + 1):
            for begin in range(max(0, end - longest[data[end - 1]]), end):
                w = ids(data[begin:end])
                if w is not None and (begin == 0 or arc(last[begin], w)):
                    last[end] = w
                    break
            else:
                raise ValueError("a byte has no token")
        out, end = [], size
        while end:
            out.append(last[end])
            end -= len(self.labels[last[end]])
        return tuple(reversed(out))

    def encode_into(self, text: str, out: array) -> None:
        """Appends the ids of a text."""
        words, extend = self.words, out.extend
        for word in self.split(text):
            ids = words.get(word)
            if ids is None:
                if len(words) >= CACHE_WORDS:
                    words.clear()
                    self.arcs.clear()
                ids = words[word] = self.encode_word(word)
            extend(ids)

    def encode(self, text: str | None) -> list[int]:
        out = array("i")
        if text:
            self.encode_into(text, out)
        return out.tolist()

    def decode(self, ids: list[int]) -> str:
        """Emits the labels along the path of ids."""
        return b"".join(self.labels[i] for i in ids).decode("utf-8", "replace")


_COMPILED: dict[int, MergeAutomaton] = {}


def _compiled(packed: bytes) -> MergeAutomaton:
    """One automaton per worker process and vocabulary."""
    key = zlib.crc32(packed)
    if key not in _COMPILED:
        labels, merges = json.loads(zlib.decompress(packed))
        _COMPILED[key] = MergeAutomaton([bytes.fromhex(x) for x in labels], [tuple(m) for m in merges])
    return _COMPILED[key]


def pack_vocabulary(path: str = DEFAULT_PATH) -> bytes:
    """The vocabulary as about 1 MB of bytes; its size is that of the vocabulary, not of the data."""
    labels, merges = read_vocabulary(path)
    return zlib.compress(json.dumps([[x.hex() for x in labels], merges]).encode())


def encode_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str = DEFAULT_PATH, counts_only: bool = False) -> DataFrame:
    """``key, ids`` (or ``key, n_tokens``) of every text by the vocabulary at ``path``, without special tokens.

    Empty and null texts give an empty list. Special-token strings in a text are ordinary text.
    Texts are read whole; rows keep their partition, nothing is shuffled.
    """
    spark: SparkSession = docs.sparkSession
    vocabulary = spark.sparkContext.broadcast(pack_vocabulary(path))
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _compiled(vocabulary.value)
        for batch in batches:
            flat, ends = array("i"), np.zeros(batch.num_rows + 1, np.int32)
            for i, t in enumerate(batch.column(1)):
                if t := t.as_py():
                    automaton.encode_into(t, flat)
                ends[i + 1] = len(flat)
            ids = np.frombuffer(flat, np.int32) if len(flat) else np.zeros(0, np.int32)
            if counts_only:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(ends).astype(np.int64))], [key, "n_tokens"])
            else:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(ids))], [key, "ids"])

    out = "n_tokens long" if counts_only else "ids array<int>"
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, {out}")
