"""Evaluation items leaking into training text, by spaced-seed hashing.

Fixed masks hash some words of every window of the items and ignore the others, so a changed word inside a
window does not hide it.  The documents' windows are hashed the same way and joined to the items' hashes;
around each hit a substitution-tolerant count of equal words on the neighbouring diagonals decides whether
the exact alignment is worth while, and a banded local alignment measures the passage.  Where that alignment,
grown through loose text, has too many errors, the farthest words that few errors reach either way from each
run of equal words tell whether some stretch of it is a passage nevertheless.

Any passage of 20 words within the error bound holds six equal words in a row, which every mask finds.  Items of
under 20 words may hold less: those of five to nine words are also hashed without each one of their words, those of 13
and 14 by four words, so that every passage within the bound has a seed whatever the item's length.

Items are the small side, a stated query set: they are read in blocks of at most ``BLOCK_WORDS`` words, one pass over
the documents each.  A block's result is written before the next block is read, so the driver and the executors hold
the table of one block whatever the number of items.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm.words import Joiner, compounds, words
from trackloom.plans.cut import cut

#: 1 counts, 0 is ignored.
MASKS = ("11111", "110111", "111011", "1101011")
WEIGHT = 5
#: Lengths of items that one error may leave without WEIGHT equal words in a row, and those that two may.
ONE, TWO = range(5, 10), (13, 14)
#: Hits held at a time.
HELD = 2_000_000
BLOCK_WORDS = 500_000
#: A passage has at least this many of an item's words, or the whole item if it is shorter.
PASSAGE = 20
#: Changed, added or dropped words that do not matter, as a share of the passage.
ERRORS = 0.12
_P = np.uint64(0x9E3779B97F4A7C15)
_BITS = 22
_SHIFT = 4
#: Any passage holds one of PASSAGE to 2 * PASSAGE - 1 words within the error bound, so no more errors need be allowed from a run.
_MOST = round(ERRORS * (2 * PASSAGE - 1))
#: Words looked at on either side of the start of a run: a run of under PASSAGE words and such a passage.
_FAR = 3 * PASSAGE


def _hash(ids: np.ndarray, at: list[int], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the words at the given offsets from each of n positions; valid where all are known."""
    h = np.full(n, np.uint64(len(at)))
    ok = np.ones(n, bool)
    for o in at:
        w = ids[o : o + n]
        ok &= w > 0
        h = (h ^ w.astype(np.uint64)) * _P
        h ^= h >> np.uint64(29)
    return h, ok


@dataclass
class Items:
    """Items of one block: words as ids, seeds sorted by hash."""

    ids: np.ndarray
    lengths: np.ndarray
    starts: np.ndarray
    flat: np.ndarray
    vocabulary: dict[str, int]
    seeds: list[tuple[list[str], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]]
    joined: Joiner

    @staticmethod
    def build(rows: list[tuple[int, list[str]]], parts: set[tuple[str, ...]] = frozenset()) -> Items:
        joined = Joiner(parts)
        rows = [(i, joined(w)) for i, w in rows if w]
        vocabulary: dict[str, int] = {}
        coded = [np.array([vocabulary.setdefault(x, len(vocabulary) + 1) for x in w], np.int32) for _, w in rows]
        lengths = np.array([len(c) for c in coded], np.int64)
        gap = max(len(m) for m in MASKS)
        starts = np.cumsum(lengths + gap) - lengths - gap if len(rows) else np.zeros(0, np.int64)
        flat = np.zeros(int((lengths + gap).sum()), np.int32)
        owner = np.full(len(flat), -1, np.int32)
        for k, c in enumerate(coded):
            flat[starts[k] : starts[k] + len(c)] = c
            owner[starts[k] : starts[k] + len(c)] = k
        seeds = []

        def add(doc_masks: list[str], at: list[list[int]], whole: set[int] | None = None, anywhere: bool = True) -> None:
            """Seeds of the item words at each of some lists of offsets, of all items or those of some lengths, looked up by the words under the documents' masks."""
            found = []
            for offsets in at:
                n = len(flat) - max(offsets)
                if n <= 0:
                    continue
                h, ok = _hash(flat, offsets, n)
                if whole is not None:
                    ok &= (owner[:n] >= 0) & np.isin(lengths[np.maximum(owner[:n], 0)], list(whole))
                if not anywhere:
                    ok &= np.arange(n) == starts[np.maximum(owner[:n], 0)]
                pos = np.flatnonzero(ok)
                found.append((h[pos], pos + offsets[0]))
            if sum(len(h) for h, _ in found):
                h, pos = (np.concatenate(v) for v in zip(*found, strict=True))
                order = np.argsort(h, kind="stable")
                h, pos = h[order], pos[order]
                table = np.zeros(1 << _BITS, bool)
                table[(h >> np.uint64(64 - _BITS)).astype(np.int64)] = True
                seeds.append((doc_masks, (h, owner[pos], pos - starts[owner[pos]], np.packbits(table))))

        hole = lambda n: ["1" * k + "0" + "1" * (n - 1 - k) for k in range(1, n - 1)]
        for mask in MASKS:
            add([mask], [_under(mask)])
        have = {int(n) for n in lengths}
        for n in sorted(have):
            if n < WEIGHT:
                add(["1" * n], [list(range(n))], {n}, False)
            elif n in ONE:
                add(["1" * (n - 1), *hole(n)], [[j for j in range(n) if j != k] for k in range(n)], {n}, False)
                add(hole(n + 1), [list(range(n))], {n}, False)
        if have & set(TWO):
            add(["1111"], [[0, 1, 2, 3]], have & set(TWO))
        return Items(np.array([i for i, _ in rows], np.int64), lengths, starts, flat, vocabulary, seeds, joined)

    def hits(self, ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Every (word position, item, item position) whose windows share a hash, about HELD at a time."""
        for masks, (hs, owner, pos, bits) in self.seeds:
            for mask in masks:
                n = len(ids) - len(mask) + 1
                if n <= 0:
                    continue
                h, ok = _hash(ids, _under(mask), n)
                at = np.flatnonzero(ok)
                slot = (h[at] >> np.uint64(64 - _BITS)).astype(np.int64)
                at = at[(bits[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8)) & 1 == 1]
                lo, hi = np.searchsorted(hs, h[at], "left"), np.searchsorted(hs, h[at], "right")
                upto = np.cumsum(hi - lo)
                for a in range(0, int(upto[-1]) if len(at) else 0, HELD):
                    z = slice(np.searchsorted(upto, a, "right"), np.searchsorted(upto, a + HELD, "left") + 1)
                    count = hi[z] - lo[z]
                    rep = np.repeat(np.arange(len(count)), count)
                    which = np.arange(len(rep)) - np.repeat(np.cumsum(count) - count, count) + lo[z][rep]
                    yield at[z][rep], owner[which], pos[which]


def _under(mask: str) -> list[int]:
    return [j for j, c in enumerate(mask) if c == "1"]


def _promising(items: Items, ids: np.ndarray, d: np.ndarray, k: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Hits around which some stretch has nearly enough equal words on the neighbouring diagonals."""
    off = np.arange(-_FAR, _FAR + 1)
    ip = p[:, None] + off
    inside = (ip >= 0) & (ip < items.lengths[k][:, None])
    want = np.where(inside, items.flat[np.clip(items.starts[k][:, None] + ip, 0, len(items.flat) - 1)], -1)
    equal = np.zeros(want.shape, bool)
    for s in range(-_MOST, _MOST + 1):
        dp = d[:, None] + off + s
        equal |= (dp >= 0) & (dp < len(ids)) & (ids[np.clip(dp, 0, len(ids) - 1)] == want)
    need = np.minimum(PASSAGE, items.lengths[k])
    total = np.concatenate([np.zeros((len(d), 1), np.int64), np.cumsum(equal, axis=1)], axis=1)
    most = (total[:, PASSAGE:] - total[:, :-PASSAGE]).max(axis=1)
    return most >= np.floor(need * (1 - ERRORS)) - 1


def align(doc: list[int], item: list[int], diagonal: int, band: int) -> tuple[int, int, int]:
    """Best local alignment near a diagonal: (item words spanned, equal words, errors); an error costs two equal words."""
    n, best, out, ends = len(doc), 0, (0, 0, 0), (0, 0, 0, 0)
    width = 2 * band + 1
    zero = (0, 0, 0, 0, 0)  # score, first item word, first document word, equal, errors
    row = [zero] * (width + 1)
    for i, w in enumerate(item):
        new = [zero] * (width + 1)
        left = zero
        for b in range(width):
            j = i + diagonal + b - band
            if j < 0 or j >= n:
                left = zero
                continue
            dg = row[b]
            if doc[j] == w:
                cell = (dg[0] + 1, dg[1], dg[2], dg[3] + 1, dg[4]) if dg[0] > 0 else (1, i, j, 1, 0)
            else:
                up = row[b + 1]
                top = dg if dg[0] >= up[0] else up
                if left[0] > top[0]:
                    top = left
                cell = (top[0] - 2, top[1], top[2], top[3], top[4] + 1) if top[0] > 2 else zero
            new[b] = left = cell
            if cell[0] > best:
                best, out, ends = cell[0], (i + 1 - cell[1], cell[3], cell[4]), (cell[1], cell[2], i, j)
        row = new
    if not best or out[0] >= PASSAGE:
        return out
    # near either end few equal words behind an error do not pay for the error, yet belong to the passage
    span, equal, errors = out
    for i, j, step in ((ends[0], ends[1], -1), (ends[2], ends[3], 1)):
        word = lambda seq, at: seq[at] if 0 <= at < len(seq) else None
        for di, dj in ((2, 2), (2, 1), (1, 2)):
            x = word(item, i + step * di)
            if x is not None and x == word(doc, j + step * dj):
                span, equal, errors = span + di, equal + 1, errors + 1
                i, j = i + step * (di + 1), j + step * (dj + 1)
                while (x := word(item, i)) is not None and x == word(doc, j):
                    span, equal, i, j = span + 1, equal + 1, i + step, j + step
                break
    return span, equal, errors


def leaks(span: int, equal: int, errors: int, length: int) -> bool:
    """Whether an aligned passage is long and exact enough for an item of the given length."""
    need = min(PASSAGE, length)
    # an error in the first or last word of a passage is cut off by the alignment
    missing = max(0, need - span)
    return missing <= 2 and errors + missing <= round(ERRORS * max(span, need))


def _reached(doc: list[int], item: list[int], most: int) -> list[tuple[int, int]]:
    """The most leading words of the item, and the equal ones among them, that leading words of the document match with at most 0, 1, ... errors."""
    n, m = len(doc), len(item)

    def slide(i: int, j: int, equal: int) -> tuple[int, int]:
        start = i
        while i < m and j < n and item[i] == doc[j]:
            i, j = i + 1, j + 1
        return i, equal + i - start

    far = {0: slide(0, 0, 0)}  # by the document's words beyond the item's
    out = [far[0]]
    for _ in range(most):
        new: dict[int, tuple[int, int]] = {}
        for o, (i, equal) in far.items():
            for oo, ii in ((o, i + 1), (o + 1, i), (o - 1, i + 1)):
                if ii <= m and 0 <= ii + oo <= n and (ii, equal) > new.get(oo, (-1, 0)):
                    new[oo] = ii, equal
        far = {o: slide(i, i + o, equal) for o, (i, equal) in new.items()}
        out.append(max([out[-1], *far.values()]))
    return out


def stretch(doc: list[int], item: list[int], j: int, i: int) -> tuple[int, int, int] | None:
    """(item words spanned, equal words, errors) of the longest leaking passage through the equal words at j and i, if any."""
    right = _reached(doc[j : j + _FAR + _MOST], item[i : i + _FAR], _MOST)
    left = _reached(doc[max(0, j - _FAR - _MOST) : j][::-1], item[max(0, i - _FAR) : i][::-1], _MOST)
    need = min(PASSAGE, len(item))
    good = [(x + y, -(a + b), e + f) for a, (x, e) in enumerate(left) for b, (y, f) in enumerate(right) if x + y >= need and leaks(x + y, e + f, a + b, len(item))]
    if not good:
        return None
    span, errors, equal = max(good)
    return span, equal, -errors


def find_in(items: Items, docs: list[list[int]]) -> list[tuple[int, int, int, int, int]]:
    """(document, item, span, equal, errors) of the best alignment of every promising pair."""
    gap = np.zeros(max(len(m) for m in MASKS) + 1, np.int32)
    parts, starts, n = [], [], 0
    for w in docs:
        starts.append(n)
        parts += [np.array(w, np.int32), gap]
        n += len(w) + len(gap)
    if not n:
        return []
    ids, starts = np.concatenate(parts), np.array(starts, np.int64)
    # one hit per item, diagonal and run of hits
    longest = int(items.lengths.max()) if len(items.lengths) else 0

    def runs(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
        d, k, p = (np.concatenate(v) for v in zip(*parts, strict=True))
        key, first = np.unique((k.astype(np.int64) * (len(ids) + longest) + (d - p + longest)) * (longest + 1) + p, return_index=True)
        first = first[np.diff(key, prepend=-2) > 1]
        return d[first], k[first], p[first]

    hits = [runs([h]) for h in items.hits(ids) if len(h[0])]
    if not hits:
        return []
    d, k, p = runs(hits)
    keep = np.zeros(len(d), bool)
    for a in range(0, len(d), 50_000):
        z = slice(a, a + 50_000)
        keep[z] = _promising(items, ids, d[z], k[z], p[z])
    d, k, p = d[keep], k[keep], p[keep]
    doc = np.searchsorted(starts, d, "right") - 1
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    done: dict[tuple[int, int], set[int]] = {}
    for a, b, diag, at in zip(doc.tolist(), k.tolist(), (d - p).tolist(), p.tolist(), strict=True):
        length = int(items.lengths[b])
        old = best.get((a, b))
        if old and leaks(*old, length):
            continue
        seen = done.setdefault((a, b), set())
        item = items.flat[items.starts[b] : items.starts[b] + length].tolist()
        if diag // 3 not in seen:
            seen.add(diag // 3)
            band = _SHIFT + length // 16
            lo, hi = max(0, diag - starts[a] - band), max(0, diag - starts[a] + length + band)
            got = align(docs[a][lo:hi], item, int(diag - starts[a] - lo), band)
            if not old or leaks(*got, length) or got[1] - 2 * got[2] > old[1] - 2 * old[2]:
                best[a, b] = old = got
        if not leaks(*old, length) and (got := stretch(docs[a], item, int(diag + at - starts[a]), at)):
            best[a, b] = got
    return [(a, b, *v) for (a, b), v in best.items()]


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("span", pa.int32()), ("equal", pa.int32()), ("errors", pa.int32())])


def _search(items: Items, every: bool, step: int = 2000):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get, joined = items.vocabulary.get, items.joined
        for batch in batches:
            names, texts = batch.column(0), batch.column(1).to_pylist()
            rows = []
            for a in range(0, len(texts), step):
                docs = [[get(w, 0) for w in joined(words(t.decode("utf-8", "replace") if t is not None else None))] for t in texts[a : a + step]]
                rows += [(names[a + i].as_py(), int(items.ids[k]), s, e, x) for i, k, s, e, x in find_in(items, docs) if every or leaks(s, e, x, int(items.lengths[k]))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _SCHEMA.types, strict=True)], schema=_SCHEMA)

    return run


def blocks_of(items: DataFrame, item_id: str, text: str) -> Iterator[tuple[list[tuple[int, list[str]]], set[tuple[str, ...]]]]:
    """The items, with the parts of their hyphenated words, in blocks of at most BLOCK_WORDS words (a longer item is a block of its own)."""
    block, parts, held = [], set(), 0
    for r in items.select(F.col(item_id).cast("long").alias("i"), F.col(text).cast("binary").alias("t")).where("i is not null and t is not null").toLocalIterator():
        t = bytes(r["t"]).decode("utf-8", "replace")
        w = words(t)
        if block and held + len(w) > BLOCK_WORDS:
            yield block, parts
            block, parts, held = [], set(), 0
        block.append((r["i"], w))
        parts |= compounds(t)
        held += len(w)
    if block:
        yield block, parts


def find_leaks(documents: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", every: bool = False) -> DataFrame:
    """(doc_id, item_id, span, equal, errors) of each document that holds a passage of an item.

    Null, empty and blank texts on either side match nothing; repeated rows give repeated results, which
    ``distinct`` removes at the end.  Whole texts are searched.  ``every`` also returns the aligned pairs that fall short.
    """
    docs = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text")).where("doc_id is not null and text is not null")
    kind = "doc_id long, item_id long, span int, equal int, errors int"
    found, last = None, None
    for block, parts in blocks_of(items, item_id, text):
        if last is not None:
            last = cut(last)
            found = last if found is None else found.union(last)
        last = docs.mapInArrow(_search(Items.build(block, parts), every), kind)
    if last is None:
        return documents.sparkSession.createDataFrame([], kind)
    return (last if found is None else found.union(last)).distinct()
