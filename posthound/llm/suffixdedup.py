"""Removal of repeated passages: every byte of a WIDTH-byte string that also starts earlier in the corpus.

Equal strings share their rarest gram: of the grams of GRAM bytes in a string, the one of the smallest hash (the first, if
several) sits at the same place in every copy. So each string belongs to one *anchor*, the place of its gram, and to compare
strings it is enough to compare anchors of the same gram. An anchor's *context* spans all the strings that it owns.

1. `_entries` reads the texts and lists (gram, context) hashes, each once per document; of equal contexts in a task's hands only
   the earliest document stays, all others are known to repeat it.
2. `_matched` brings the entries of a gram together: gram met once: nothing repeats. A context of several documents: all but the
   earliest repeat it whole. Different contexts of one gram: these may share strings, and are compared byte by byte.
3. `_contexts` reads the texts of documents with such marks again and sends the contexts to be compared to their gram.
4. `_compared` sorts the suffixes that start at the anchors, and the reversed texts before them, by deep-shallow sorting: multikey
   sorting to SHALLOW bytes, then blind tries for the groups whose prefixes still agree. Two contexts share the string that
   starts o bytes before their anchors if they lie in one run of reversed texts with common prefixes of o, and in one run of
   suffixes with common prefixes of WIDTH - o; the earliest of each such class stays.
5. `_cleaned` takes the removed runs out of the texts.

A gram with very many contexts is not gathered: each string of its anchors goes by the string's own hash instead, so that only
equal strings meet, and of those in a task's hands only the first is sent.

Order: a document's id, then a hash of its text, then the start. Contexts count as equal by 128 bits of hash; whatever differs
within a gram is compared byte by byte.

Cases: a null text counts as empty; texts below WIDTH bytes stay whole; rows of a null id come after all others; rows of the
same id are ordered by a hash of their texts, and rows of the same id and text count as one document, so that neither removes
bytes of the other; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from posthound.llm import bytesops as bo
from posthound.llm.common import text_batches

WIDTH, GRAM, SHALLOW = 100, 48, 16
#: Contexts of one gram in a task's hands, and in all, beyond which its strings are compared one by one.
MANY_IN_HAND, MANY = 64, 4096
#: Bytes of text whose entries a task holds before it passes them on, and contexts that are sorted together.
HELD_BYTES, SORTED = 16_000_000, 200_000
LAST = (1 << 63) - 1
#: What is known of a context in a document: the places after the first repeat it; compare by gram; compare by string; all places repeat an earlier document.
WITHIN, BY_GRAM, BY_STRING, SEEN = 0, 1, 2, 3

_U, _I = np.uint64, np.int64
_LETTER = bo.mix(np.arange(1, 257, dtype=np.uint64))
_LETTER2 = bo.mix(_LETTER + _U(bo.BASE))
_B2 = 0xC2B2AE3D27D4EB4F


def _gram_hashes(buf: np.ndarray, gram: int) -> np.ndarray:
    """Hash of the `gram` bytes at each place, by doubling: a polynomial of twice the length is two of the length."""
    h, m, out, done = _LETTER[buf], 1, None, 0
    while True:
        if gram & m:
            out = h if out is None else out[: len(h) - done] * _U(pow(bo.BASE, m, 2**64)) + h[done:]
            done += m
        if done == gram:
            return bo.mix(out)
        h = h[:-m] * _U(pow(bo.BASE, m, 2**64)) + h[m:]
        m *= 2


def _least(x: np.ndarray, w: int) -> np.ndarray:
    """Smallest of each w values that follow each other."""
    m = 1
    while m * 2 <= w:
        x = np.minimum(x[:-m], x[m:])
        m *= 2
    return np.minimum(x[: len(x) - (w - m)], x[w - m :]) if m < w else x


class Anchors:
    """Anchors of the texts in one buffer: place, first and last start of the strings it owns, hashes of gram and context, text number."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray, width: int, gram: int) -> None:
        self.p = self.lo = self.hi = self.doc = np.zeros(0, _I)
        self.gram = self.context = np.zeros(0, _U)
        if len(buf) < width:
            return
        g = _gram_hashes(buf, gram)
        # The hash's upper half, then the place: the first of the smallest.
        owner = (_least((g & _U(0xFFFFFFFF00000000)) | np.arange(len(g), dtype=_U), width - gram + 1) & _U(0xFFFFFFFF)).astype(_I)
        beyond = np.zeros(len(buf) + 1, _I)
        np.add.at(beyond, np.maximum(offs[1:] - width + 1, offs[:-1]), 1)
        np.add.at(beyond, offs[1:], -1)
        owner[np.cumsum(beyond)[: len(owner)] > 0] = -1  # strings that reach into the next text
        first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        last = np.concatenate([first[1:], [len(owner)]]) - 1
        own = owner[first] >= 0
        self.lo, self.hi = first[own], last[own]
        self.p, self.gram = owner[self.lo], g[owner[self.lo]]
        self.doc = np.searchsorted(offs, self.lo, side="right") - 1
        self.sums = np.concatenate([np.zeros(1, _U), np.cumsum(_LETTER2[buf] * _powers(len(buf) + 1)[0][: len(buf)])])
        size = self.hi + width - self.lo
        self.context = bo.mix(self.hash(self.lo, size) ^ (size * 131 + self.p - self.lo).astype(_U))

    def hash(self, start: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        """Polynomial of the bytes from start on, the same wherever they stand."""
        return (self.sums[start + size] - self.sums[start]) * _powers(len(self.sums))[1][start]


_POWERS = [np.ones(1, _U), np.ones(1, _U)]


def _powers(n: int) -> list[np.ndarray]:
    """Powers of the context hash's base and of its inverse, from 0 to at least n - 1."""
    if len(_POWERS[0]) < n:
        for i, b in enumerate((_B2, pow(_B2, -1, 2**64))):
            _POWERS[i] = np.concatenate([np.ones(1, _U), np.cumprod(np.full(max(n, bo.CHUNK_BYTES + 1), _U(b)))])
    return _POWERS


def _pack(**columns: np.ndarray) -> dict[str, bytes]:
    return {k: v.tobytes() for k, v in columns.items()}


def _runs(*keys: np.ndarray) -> np.ndarray:
    """True where one of the sorted keys changes, and at the first place."""
    out = np.ones(len(keys[0]), bool)
    if len(out):
        out[1:] = False
        for k in keys:
            out[1:] |= k[1:] != k[:-1]
    return out


def _spread(first: np.ndarray, value: np.ndarray) -> np.ndarray:
    """value, one for each run, at every place of the run."""
    return value[np.cumsum(first) - 1]


def _repeated(key: np.ndarray) -> np.ndarray:
    """Which values of the sorted key occur more than once."""
    if not len(key):
        return np.zeros(0, bool)
    same = np.concatenate([[False], key[1:] == key[:-1], [False]])
    return same[1:] | same[:-1]


class Entries:
    """Anchors of the documents a task holds, as (gram, context, document)."""

    def __init__(self, buckets: int, in_hand: int) -> None:
        self.buckets, self.in_hand = buckets, in_hand
        self.ids: list[np.ndarray] = []
        self.ths: list[np.ndarray] = []
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.docs = 0

    def add(self, ids: np.ndarray, ths: np.ndarray, anchors: Anchors) -> None:
        self.ids.append(ids)
        self.ths.append(ths)
        self.parts.append((anchors.gram, anchors.context, anchors.doc + self.docs))
        self.docs += len(ids)

    def flush(self, salt: int) -> Iterator[dict]:
        """Rows for the buckets of grams (kind 0), and marks that are known here already (kind 1)."""
        if not self.docs:
            return
        ids, ths = np.concatenate(self.ids), np.concatenate(self.ths)
        gram, context, doc = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        by = np.lexsort((ths, ids))
        rank = np.empty(len(ids), _I)
        rank[by] = np.cumsum(_runs(ids[by], ths[by]))
        order = np.argsort(gram)
        again = _repeated(gram[order])
        alone, several = order[~again], order[again]
        several = several[np.lexsort((rank[doc[several]], context[several], gram[several]))]
        g, c, d = gram[several], context[several], rank[doc[several]]
        new_doc, new_context, new_gram = _runs(g, c, d), _runs(g, c), _runs(g)
        marks = [(several[~new_doc], WITHIN), (several[new_doc & ~new_context], SEEN)]
        first, starts = several[new_context], new_gram[new_context]
        if len(first):
            heads = np.flatnonzero(starts)
            number = np.diff(np.append(heads, len(first)))
            hot = _spread(starts, number > self.in_hand)
            place = np.arange(len(first)) - _spread(starts, heads)
            marks.append((first[hot & (place >= 2)], BY_STRING))
            hot, first = hot[~hot | (place < 2)], first[~hot | (place < 2)]
        else:
            hot = np.zeros(0, bool)
        sent, flag = np.concatenate([alone, first]), np.concatenate([np.zeros(len(alone), bool), hot])
        by = np.argsort(gram[sent])
        sent, flag = sent[by], flag[by].astype(np.uint8)
        bucket = ((gram[sent] >> _U(32)) * _U(self.buckets) >> _U(32)).astype(_I)
        cut = np.searchsorted(bucket, np.arange(self.buckets + 1))
        for b in range(self.buckets):
            own = sent[cut[b] : cut[b + 1]]
            if len(own):
                held, at = np.unique(doc[own], return_inverse=True)
                yield {"bucket": b, "kind": 0, **_pack(id=ids[held], th=ths[held], at=at.astype("<u4" if len(held) > 65535 else "<u2"), gram=gram[own], context=context[own], flag=flag[cut[b] : cut[b + 1]])}
        at = np.concatenate([m for m, _ in marks])
        if len(at):
            flag = np.concatenate([np.full(len(m), f, np.uint8) for m, f in marks])
            by = np.lexsort((ths[doc[at]], ids[doc[at]]))
            at = at[by]
            yield {"bucket": salt % self.buckets, "kind": 1, **_pack(id=ids[doc[at]], th=ths[doc[at]], at=np.zeros(0, "<u2"), gram=np.zeros(0, _U), context=context[at], flag=flag[by])}


_ENTRY = "bucket int, kind int, id binary, th binary, at binary, gram binary, context binary, flag binary"
_MARK = ["id", "th", "context", "flag"]


def _rows(found: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(found, schema=schema)


def _schema(ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    return pa.schema([(n, kinds[k]) for n, k in (f.split() for f in ddl.split(","))])


def _entries(docs: DataFrame, buckets: int, width: int, gram: int, in_hand: int) -> DataFrame:
    schema = _schema(_ENTRY)

    def run(batches):
        part = TaskContext.get().partitionId()
        held, size, number = Entries(buckets, in_hand), 0, 0
        for batch in batches:
            ids, ths = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for a, b, buf, offs in bo.chunks(batch.column(2)):
                held.add(ids[a:b], ths[a:b], Anchors(buf, offs, width, gram))
                size += len(buf)
                if size >= HELD_BYTES:
                    if rows := list(held.flush(part + number)):
                        yield _rows(rows, schema)
                    held, size, number = Entries(buckets, in_hand), 0, number + 1
        if rows := list(held.flush(part + number)):
            yield _rows(rows, schema)

    return text_batches(docs.select("_id", "_th", "text")).mapInArrow(run, _ENTRY)


def _matched(entries: DataFrame, many: int) -> DataFrame:
    """id, th, context, flag: what is known of the contexts of each document."""

    def marks(id_, th, context, flag):
        return pa.RecordBatch.from_arrays([pa.array(id_), pa.array(th), pa.array(context.view(_I)), pa.array(flag.astype(np.int8))], names=_MARK)

    def run(batches):
        parts = []
        for batch in batches:
            for r in batch.to_pylist():
                id_, th, flag = np.frombuffer(r["id"], _I), np.frombuffer(r["th"], np.int32), np.frombuffer(r["flag"], np.uint8)
                context = np.frombuffer(r["context"], _U)
                if r["kind"]:
                    yield marks(id_, th, context, flag)
                    continue
                at = np.frombuffer(r["at"], "<u2" if len(r["at"]) == 2 * len(flag) else "<u4")
                parts.append((np.frombuffer(r["gram"], _U), context, id_[at], th[at], flag))
        if not parts:
            return
        gram = np.concatenate([p[0] for p in parts])
        order = np.argsort(gram)
        again = _repeated(gram[order])
        flags = np.concatenate([p[4] for p in parts])
        order = order[again | (flags[order] > 0)]
        g, c, i, t = (np.concatenate([p[k] for p in parts])[order] for k in range(4))
        f = flags[order]
        by = np.lexsort((t, i, c, g))
        g, c, i, t, f = g[by], c[by], i[by], t[by], f[by]
        new_context, new_gram = _runs(g, c), _runs(g)
        if not len(g):
            return
        heads = np.flatnonzero(new_gram)
        contexts = np.add.reduceat(new_context.astype(_I), heads)
        hot = _spread(new_gram, (np.maximum.reduceat(f, heads) > 0) | (contexts > many))
        mixed = _spread(new_gram, contexts > 1)
        # The document of a context's first entry is its earliest.
        earliest = np.flatnonzero(new_context)[np.cumsum(new_context) - 1]
        seen = (i != i[earliest]) | (t != t[earliest])
        flag = np.where(seen, SEEN, np.where(hot, BY_STRING, BY_GRAM))
        keep = (seen | hot | mixed) & (seen | new_context)
        by = np.flatnonzero(keep)
        by = by[np.lexsort((t[by], i[by]))]
        yield marks(i[by], t[by], c[by], flag[by])

    return entries.mapInArrow(run, "id long, th int, context long, flag byte")


_CONTEXT = "bucket int, kind int, id binary, th binary, key binary, p binary, left binary, size binary, bytes binary"


def _contexts(marked: DataFrame, buckets: int, width: int, gram: int) -> DataFrame:
    """Contexts to be compared (kind 0), and runs of bytes that repeat earlier ones (kind 1: p and left are their starts and ends)."""
    schema = _schema(_CONTEXT)

    def chunk(ids, ths, buf, offs, mark_doc, mark_context, mark_flag):
        x = Anchors(buf, offs, width, gram)
        n, m = len(x.p), len(mark_doc)
        doc, context = np.concatenate([mark_doc, x.doc]), np.concatenate([mark_context, x.context])
        place = np.concatenate([mark_flag.astype(_I) - 8, x.p])  # marks first, the strongest last
        by = np.lexsort((place, context, doc))
        first = _runs(doc[by], context[by])
        strongest = np.full(int(first.sum()), -1)
        group = np.cumsum(first) - 1
        is_mark = by < m
        np.maximum.at(strongest, group[is_mark], mark_flag[by[is_mark]])
        flag, own = strongest[group][~is_mark], by[~is_mark] - m
        leads = _runs(group[~is_mark])
        known, own, leads = flag >= 0, own, leads
        whole = own[known & ((flag == SEEN) | ~leads)]
        compare = own[known & leads & (flag == BY_GRAM)]
        strings = own[known & leads & (flag == BY_STRING)]
        ranges = [(x.doc[whole], x.lo[whole], x.hi[whole] + width)]
        found = [(x.gram[compare], x.doc[compare], x.lo[compare], x.p[compare] - x.lo[compare], x.hi[compare] + width - x.lo[compare])]
        if len(strings):
            count = x.hi[strings] - x.lo[strings] + 1
            s = np.repeat(x.lo[strings], count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
            d, key = np.repeat(x.doc[strings], count), bo.mix(x.hash(s, width) ^ _U(width))
            by = np.lexsort((s - offs[d], ths[d], ids[d], key))
            s, d, key = s[by], d[by], key[by]
            head = np.flatnonzero(_runs(key))[np.cumsum(_runs(key)) - 1]
            earlier = (ids[d] != ids[d[head]]) | (ths[d] != ths[d[head]]) | (s - offs[d] != (s - offs[d])[head])
            at = np.flatnonzero(earlier)
            same = (buf[s[at][:, None] + np.arange(width)] == buf[s[head[at]][:, None] + np.arange(width)]).all(1)
            gone = np.zeros(len(s), bool)
            gone[at[same]] = True
            ranges.append((d[gone], s[gone], s[gone] + width))
            d, s, key = d[~gone], s[~gone], key[~gone]
            found.append((key, d, s, np.zeros(len(s), _I), np.full(len(s), width)))
        key, d, lo, left, size = (np.concatenate(z) for z in zip(*found, strict=True))
        by = np.argsort(key)
        key, d, lo, left, size = key[by], d[by], lo[by], left[by], size[by]
        cut = np.searchsorted(((key >> _U(32)) * _U(buckets) >> _U(32)).astype(_I), np.arange(buckets + 1))
        for b in np.flatnonzero(np.diff(cut)).tolist():
            k = slice(cut[b], cut[b + 1])
            z = size[k]
            at = np.arange(int(z.sum())) - np.repeat(np.cumsum(z) - z - lo[k], z)
            yield {"bucket": b, "kind": 0, **_pack(id=ids[d[k]], th=ths[d[k]], key=key[k], p=(lo[k] + left[k] - offs[d[k]]).astype("<u4"), left=left[k].astype("<u2"), size=z.astype("<u2"), bytes=buf[at])}
        d, a, z = (np.concatenate(y) for y in zip(*ranges, strict=True))
        if len(d):
            by = np.lexsort((a, d))
            d, a, z = _merged(d[by], a[by], z[by])
            yield {"bucket": int(ids[d[0]] + len(d)) % buckets, "kind": 1, **_pack(id=ids[d], th=ths[d], key=np.zeros(0, _U), p=(a - offs[d]).astype("<u4"), left=(z - offs[d]).astype("<u4"), size=np.zeros(0, "<u2"), bytes=np.zeros(0, np.uint8))}

    def run(batches):
        for batch in batches:
            ids, ths, marks = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(3)
            upto = marks.offsets.to_numpy().astype(_I)
            flat = marks.values
            context, flag = flat.field(0).to_numpy().view(_U), flat.field(1).to_numpy()
            for a, b, buf, offs in bo.chunks(batch.column(2)):
                own = slice(upto[a], upto[b])
                doc = np.repeat(np.arange(b - a), np.diff(upto[a : b + 1]))
                if rows := list(chunk(ids[a:b], ths[a:b], buf, offs, doc, context[own], flag[own])):
                    yield _rows(rows, schema)

    return marked.mapInArrow(run, _CONTEXT)


def _merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of the union of ranges, sorted by document and start; runs that touch are one."""
    if not len(doc):
        return doc, start, end
    step = int(end.max()) + 2
    reach = np.maximum.accumulate(doc * step + end)
    first = np.concatenate([[True], (doc * step + start)[1:] > reach[:-1]])
    at = np.flatnonzero(first)
    last = np.append(at[1:], len(doc)) - 1
    return doc[at], start[at], reach[last] - doc[at] * step


def deep_shallow(rows: np.ndarray, group: np.ndarray, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """(order, common): the rows (equally long strings of bytes) of each group in lexicographic order, groups in order of their
    numbers, and the length of the prefix that each has in common with the one before it (-1: the first of its group).

    Multikey sorting to `shallow` bytes, eight at a time: groups of rows that agree so far are ordered by their next bytes and
    parted. What is left of them goes into blind tries, all groups at once: a node is the first byte in which its rows differ,
    whatever stands before it is skipped, and its rows part by that byte alone.
    """
    n, width = rows.shape
    pad = -width % 8
    padded = np.concatenate([rows, np.zeros((n, pad), np.uint8)], axis=1) if pad else np.ascontiguousarray(rows)
    words = padded.view(">u8")
    order = np.argsort(group, kind="stable")
    head = _runs(group[order])

    def members(closed: np.ndarray | None = None) -> np.ndarray:
        tail = np.append(~head, False)
        return np.flatnonzero((tail[1:] | tail[:-1]) & (True if closed is None else ~closed))

    def part(at: np.ndarray, key: np.ndarray) -> None:
        by = np.lexsort((key, np.cumsum(head)[at]))
        order[at] = order[at[by]]
        head[at[1:]] |= key[by][1:] != key[by][:-1]

    for c in range(min(shallow // 8, words.shape[1])):
        if len(at := members()):
            part(at, words[order[at], c].astype(_U))
    equal = np.zeros(n, bool)
    while len(at := members(equal)):
        lead = np.maximum.accumulate(np.where(head, np.arange(n), 0))[at]
        differs = rows[order[at]] != rows[order[lead]]
        depth = np.where(differs.any(1), differs.argmax(1), width)
        first = _runs(lead)
        depth = _spread(first, np.minimum.reduceat(depth, np.flatnonzero(first)))
        equal[at[depth == width]] = True
        if len(inner := at[depth < width]):
            part(inner, rows[order[inner], depth[depth < width]])
    differs = rows[order[1:]] != rows[order[:-1]]
    common = np.where(differs.any(1), differs.argmax(1), width) if n > 1 else np.zeros(0, _I)
    return order, np.concatenate([[-1], np.where(np.diff(group[order]) == 0, common, -1)]).astype(_I)[:n]


def repeats(key: np.ndarray, rank: np.ndarray, p: np.ndarray, left: np.ndarray, size: np.ndarray, flat: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(entry, start) of every string of the contexts that an entry of smaller rank has too.

    Entries of one key are compared. Context k is size[k] bytes of flat, its anchor is left[k] bytes in, at p[k] of its text.
    """
    n, head = len(key), np.cumsum(size) - size
    _, group = np.unique(key, return_inverse=True)

    def strings(at: np.ndarray, step: int, length: np.ndarray, w: int) -> np.ndarray:
        """n x w bytes from at on, in steps of 1 or -1; zeros beyond length."""
        k = np.arange(w)
        inside = k < length[:, None]
        return np.where(inside, flat[np.where(inside, at[:, None] + step * k, 0)], np.uint8(0))

    after, before = (strings(head + left, 1, size - left, width), strings(head + left - 1, -1, left, max(1, width - gram)))
    placed = []
    for m in (before, after):
        order, common = deep_shallow(m, group)
        place = np.empty(n, _I)
        place[order] = np.arange(n)
        placed.append((place, common))
    by_rank = np.argsort(rank, kind="stable")
    found = [(np.zeros(0, _I), np.zeros(0, _I))]
    for o in range(width - gram + 1):
        own = by_rank[(o <= left[by_rank]) & (width - o <= (size - left)[by_rank])]
        if not len(own):
            continue
        klass = [np.cumsum(common < depth)[place[own]] for (place, common), depth in zip(placed, (o, width - o), strict=True)]
        _, first, inverse = np.unique(klass[0] * (n + 1) + klass[1], return_index=True, return_inverse=True)
        late = own[rank[own] > rank[own[first[inverse]]]]
        found.append((late, p[late] - o))
    return tuple(np.concatenate(z) for z in zip(*found, strict=True))


def _compared(contexts: DataFrame, width: int, gram: int) -> DataFrame:
    """id, th, runs (pairs of unsigned 32-bit starts and ends) of bytes to be removed, any number of rows a document."""
    names = ["id", "th", "runs"]

    def by_document(ids, ths, start, end):
        by = np.lexsort((start, ths, ids))
        ids, ths, start, end = ids[by], ths[by], start[by], end[by]
        doc = np.cumsum(_runs(ids, ths)) - 1
        lead = np.flatnonzero(_runs(doc))
        doc, start, end = _merged(doc, start, end)
        cut = np.searchsorted(doc, np.arange(len(lead) + 1))
        pairs = np.stack([start, end], 1).astype("<u4")
        return pa.RecordBatch.from_arrays([pa.array(ids[lead]), pa.array(ths[lead]), pa.array([pairs[a:b].tobytes() for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)], pa.binary())], names=names)

    def run(batches):
        parts = []
        for batch in batches:
            for r in batch.to_pylist():
                ids, ths, p = np.frombuffer(r["id"], _I), np.frombuffer(r["th"], np.int32), np.frombuffer(r["p"], "<u4").astype(_I)
                if r["kind"]:
                    yield by_document(ids, ths, p, np.frombuffer(r["left"], "<u4").astype(_I))
                else:
                    left, size = (np.frombuffer(r[c], "<u2").astype(_I) for c in ("left", "size"))
                    parts.append((np.frombuffer(r["key"], _U), ids, ths, p, left, size, np.frombuffer(r["bytes"], np.uint8)))
        if not parts:
            return
        key, ids, ths, p, left, size, flat = (np.concatenate(z) for z in zip(*parts, strict=True))
        parts.clear()
        head, order = np.cumsum(size) - size, np.argsort(key, kind="stable")
        ends = np.flatnonzero(np.append(_runs(key[order])[1:], True)) + 1
        at = 0
        while at < len(order):
            to = int(ends[max(0, np.searchsorted(ends, at + SORTED, side="right") - 1)])
            to = to if to > at else int(ends[np.searchsorted(ends, at, side="right")])
            own, at = order[at:to], to
            by = np.lexsort((p[own], ths[own], ids[own]))
            rank = np.empty(len(own), _I)
            rank[by] = np.cumsum(_runs(ids[own[by]], ths[own[by]], p[own[by]]))
            z = size[own]
            bytes_ = flat[np.arange(int(z.sum())) - np.repeat(np.cumsum(z) - z - head[own], z)]
            entry, start = repeats(key[own], rank, p[own], left[own], z, bytes_, width, gram)
            if len(entry):
                yield by_document(ids[own[entry]], ths[own[entry]], start, start + width)

    return contexts.mapInArrow(run, "id long, th int, runs binary")


def _cleaned(docs: DataFrame, keep_text: bool) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept: the text that stays) of docs(doc_id, _id, _th, text, runs)."""

    def run(batches):
        for batch in batches:
            data, offs = bo.buffers(batch.column(3))
            out = {k: [] for k in ("n_removed", "n_spans", "kept_sha256", "kept")}
            for i, blobs in enumerate(batch.column(4).to_pylist()):
                text = data[offs[i] : offs[i + 1]]
                pairs = np.frombuffer(b"".join(blobs or []), "<u4").astype(_I).reshape(-1, 2)
                pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
                _, start, end = _merged(np.zeros(len(pairs), _I), pairs[:, 0], pairs[:, 1])
                cut = [0, *np.stack([start, end], 1).ravel().tolist(), len(text)]
                kept = b"".join(text[a:b].tobytes() for a, b in zip(cut[::2], cut[1::2], strict=True))
                out["n_removed"].append(len(text) - len(kept))
                out["n_spans"].append(len(start))
                out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                if keep_text:
                    out["kept"].append(kept)
            cols = [batch.column(0), pa.array(np.diff(offs)), pa.array(out["n_removed"], pa.int64()), pa.array(out["n_spans"], pa.int64()), pa.array(out["kept_sha256"], pa.string())]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(out["kept"], pa.binary())] if keep_text else cols, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if keep_text else [])])

    return docs.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if keep_text else ""))


def remove_repeats(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, many: int = MANY, in_hand: int = MANY_IN_HAND, keep_text: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, kept: one row per row of docs.

    A partition of spark.sql.shuffle.partitions holds its share of all anchors (one in about 25 bytes of text, 30 bytes each).
    """
    if not 0 < gram <= width <= 30_000:
        raise ValueError("a string holds its gram, and is at most 30,000 bytes long")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    own = F.col(id_col).cast("long")
    rows = docs.select(own.alias("doc_id"), F.coalesce(own, F.lit(LAST)).alias("_id"), F.hash(text).alias("_th"), text.alias("text"))
    entries = _entries(rows, n, width, gram, in_hand).repartitionById(n, F.col("bucket"))
    marks = _matched(entries, many).groupBy(F.col("id").alias("_id"), F.col("th").alias("_th")).agg(F.collect_list(F.struct("context", "flag")).alias("marks"))
    # Both joins take the same columns of rows, so that their texts are shuffled once.
    marked = rows.join(marks, ["_id", "_th"]).select("_id", "_th", "text", "marks", "doc_id")
    contexts = _contexts(marked, n, width, gram).repartitionById(n, F.col("bucket"))
    runs = _compared(contexts, width, gram).groupBy(F.col("id").alias("_id"), F.col("th").alias("_th")).agg(F.collect_list("runs").alias("runs"))
    return _cleaned(rows.join(runs, ["_id", "_th"], "left").select("doc_id", "_id", "_th", "text", "runs"), keep_text)
