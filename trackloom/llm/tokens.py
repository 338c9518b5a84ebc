"""Encoding with a public byte-level BPE vocabulary by dynamic programming over prefixes.

A text is a token sequence that the merges would produce exactly if every two neighbours would survive
the merges of their own joined bytes.  So each prefix of a piece has one last token: the one among the
tokens that end there (found by an automaton over the vocabulary, whose links lead from a match to its
suffixes) that is compatible with the last token of the prefix before it.  Following the last tokens back
from the end gives the ids, in time linear in the piece however long it is.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Splits a text before the merges; fixed with the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
FOLDER = "/opt/tokenizers"
#: Distinct pieces a worker remembers; the memory is emptied when full, which costs time only.
MEMORY = 400_000


def byte_letters() -> list[str]:
    """The letter each byte is written as in the vocabulary file: printable bytes are themselves, the others follow from 256."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, more = [], 256
    for b in range(256):
        if b in printable:
            out.append(chr(b))
        else:
            out.append(chr(more))
            more += 1
    return out


#: Pairs of tokens a worker remembers.
FITS = 1_000_000


class Encoder:
    """Exact ids of texts; ``vocabulary``: path of the tokenizer's JSON file."""

    def __init__(self, vocabulary: str):
        import ahocorasick
        import regex

        model = json.load(open(vocabulary, encoding="utf-8"))["model"]
        ids = model["vocab"]
        self.split = regex.compile(PATTERN).findall
        self.letters = dict(enumerate(byte_letters()))
        self.merged: dict[tuple[int, int], tuple[int, int]] = {}  # pair of ids -> (rank, id)
        halves: dict[int, tuple[int, int, int]] = {}  # id -> (rank, left, right)
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            token = ids[a + b]
            self.merged.setdefault((ids[a], ids[b]), (rank, token))
            halves.setdefault(token, (rank, ids[a], ids[b]))
        self.halves = halves
        usable = [t for t in ids if t in self.letters.values() or ids[t] in halves]
        self.ids = {t: ids[t] for t in usable}
        self.ends = ahocorasick.Automaton()
        for t in usable:
            self.ends.add_word(t, (len(t), ids[t]))
        self.ends.make_automaton()
        self.spines: tuple[dict, dict] = ({}, {})
        self.fits: dict[tuple[int, int], bool] = {}
        self.known: dict[str, tuple[int, ...]] = {}

    def _spine(self, token: int, side: int) -> list[tuple[int, float]]:
        """The tokens on one edge of a token's merge tree, with the rank at which each was merged away."""
        got = self.spines[side].get(token)
        if got is None:
            got, gone, at = [], float("inf"), token
            while True:
                got.append((at, gone))
                if at not in self.halves:
                    break
                gone = self.halves[at][0]
                at = self.halves[at][1 + side]
            self.spines[side][token] = got
        return got

    def compatible(self, left: int, right: int) -> bool:
        """Whether no merge would cross the border: one does if it comes before both its sides are merged away; of equal ranks the left one comes first."""
        got = self.fits.get((left, right))
        if got is None:
            merged, got = self.merged, True
            for a, gone_a in self._spine(left, 1):
                for b, gone_b in self._spine(right, 0):
                    m = merged.get((a, b))
                    if m is not None and m[0] < gone_a and m[0] <= gone_b:
                        got = False
                        break
                if not got:
                    break
            if len(self.fits) >= FITS:
                self.fits.clear()
            self.fits[left, right] = got
        return got

    def piece(self, text: str) -> tuple[int, ...]:
        s = text.encode("utf-8", "replace").decode("latin-1").translate(self.letters)
        whole = self.ids.get(s)
        if whole is not None:
            return (whole,)
        last: list[tuple[int, int] | None] = [None] * (len(s) + 1)  # prefix -> (last token, its length)
        compatible = self.compatible
        for end, (size, token) in self.ends.iter(s):
            end += 1
            if last[end] is None:
                start = end - size
                if start == 0 or ((before := last[start]) is not None and compatible(before[0], token)):
                    last[end] = (token, size)
        out, at = [], len(s)
        while at:
            token, size = last[at]
            out.append(token)
            at -= size
        return tuple(reversed(out))

    def encode(self, text: str) -> list[int]:
        known, out = self.known, []
        for p in self.split(text):
            ids = known.get(p)
            if ids is None:
                ids = self.piece(p)
                if len(known) >= MEMORY:
                    known.clear()
                if len(p) < 256:
                    known[p] = ids
            out += ids
        return out


@lru_cache(maxsize=2)
def encoder(vocabulary: str) -> Encoder:
    return Encoder(vocabulary)


def _encode(vocabulary: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(vocabulary)
        for batch in batches:
            texts = batch.column(1)
            for a in range(0, batch.num_rows, 500):
                flat, ends = [], [0]
                for t in texts.slice(a, 500).to_pylist():
                    if t:
                        flat += e.encode(t.decode("utf-8", "replace"))
                    ends.append(len(flat))
                ids = pa.ListArray.from_arrays(pa.array(np.array(ends, np.int32)), pa.array(np.array(flat, np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, 500), ids], ["id", "ids"])

    return run


def encode_texts(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text", vocabulary: str = "byte_bpe_50k", folder: str = FOLDER) -> DataFrame:
    """(doc_id, ids) for every row: the ids of the whole text without special tokens; null and empty texts give an empty list.

    The names of special tokens in a text are ordinary text.  Repeated rows are encoded each; a null doc_id is kept.  Bytes
    that are not UTF-8 become U+FFFD.  ``folder``: where the vocabulary files lie on every executor.
    """
    ids = df.select(F.col(doc_id).alias("id"), F.col(text).cast("binary").alias("text"))
    out = ids.mapInArrow(_encode(os.path.join(folder, vocabulary + ".json")), f"id {df.schema[doc_id].dataType.simpleString()}, ids array<int>")
    return out.select(F.col("id").alias(doc_id), "ids")
