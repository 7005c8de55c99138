"""Benchmark decontamination by template canonicalisation.

Words lose their outer punctuation and case; numbers, units after numbers and names (capitalised within a sentence) become
typed placeholders. Windows of five such tokens are joined by hash between documents and benchmark items. Along each
alignment of an item in a document the placeholders' values must map one to one (5 apples and 5 pears may become 7 and 7, not
7 and 9); windows of alignments that fail do not count, nor do those of further alignments (after words put in or left out) whose
values contradict the longer ones. A document is contaminated by an item if at least
`coverage` of the item's windows are found.

A bitmap of fixed size, set by all items' windows, drops most document windows before the join.

Cases: null or empty texts and texts without letters or digits have no window; texts of fewer than five tokens are one window, and documents
have windows of each such length that items have; a shorter window inside a document with fewer literals than placeholders, and less than
two, counts only where its values are the item's own; a capitalised first word of an item counts as a literal and as a name; a
five-token window of fewer than two literals counts only in items most of whose windows are so, and only with the item's own values;
repeated rows of
one id count once; null ids match nothing; empty tables give an empty result; extra columns are ignored.
Case folding covers ASCII and Latin-1.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from posthound.llm import bytesops as bo
from posthound.llm.common import text_batches, without
from posthound.session import written

WIDTH = 5
BITS = 24
#: Measurement units that follow a number.
UNITS = (
    "mm cm m km kilometers metres meters miles inches feet yards mg g kg tons grams kilograms pounds ml l liters litres "
    "s sec seconds min minutes h hours days weeks months years hz kb mb gb tb percent dollars euros eur usd cents degrees"
).split()
_UNIT_HASHES = np.sort(np.array([bo.span_hashes(np.frombuffer(u.encode(), np.uint8), np.array([0]), np.array([len(u)]))[0] for u in UNITS]))
_NUM, _UNIT, _NAME = np.uint64(0x1F3D5B79A2C4E680), np.uint64(0x2B4D6F8193A5C7E9), np.uint64(0x3C5E7092B4D6F81A)
_ALNUM = np.zeros(256, bool)
_ALNUM[48:58] = _ALNUM[65:91] = _ALNUM[97:123] = _ALNUM[128:] = True
_STOP = np.zeros(256, bool)
_STOP[[0x21, 0x2E, 0x3A, 0x3F, 0x0A, 0x0D]] = True


def fold(buf: np.ndarray) -> np.ndarray:
    """ASCII and Latin-1 capitals to small letters."""
    out = bo.LOWER[buf]
    if len(buf) > 1:
        capital = np.concatenate([[False], buf[:-1] == 0xC3]) & (buf >= 0x80) & (buf <= 0x9E) & (buf != 0x97)
        out[capital] += 32
    return out


def tokens(buf: np.ndarray, offs: np.ndarray, capitals: bool = False):
    """(canonical hash, value hash or 0 for literals, text number) of each token; on demand, whether it is capitalised."""
    starts, ends, doc = bo.words(buf, offs)
    if not len(starts):
        z = np.zeros(0, np.uint64)
        return (z, z, np.zeros(0, np.int64), np.zeros(0, bool)) if capitals else (z, z, np.zeros(0, np.int64))
    pos = np.arange(len(buf))
    solid = _ALNUM[buf]
    a = np.minimum.reduceat(np.where(solid, pos, len(buf)), starts)
    # Bytes between words are not solid, so they cannot move the last position.
    b = np.maximum.reduceat(np.where(solid, pos, -1), starts) + 1
    some = b > 0
    lead = np.ones(len(starts), bool)
    same = doc[1:] == doc[:-1]
    breaks = np.concatenate([[0], np.cumsum(_STOP[buf])])
    lead[1:] = ~same | (breaks[starts[1:]] > breaks[np.maximum(b[:-1], starts[:-1])])
    # A word without letters or digits is no token, but the next word still begins a sentence if it did.
    carry = np.flatnonzero(~some[:-1] & lead[:-1]) + 1
    lead[carry] = True
    a, b, doc, lead = a[some], b[some], doc[some], lead[some]
    h = bo.span_hashes(fold(buf), a, b)
    first = buf[a]
    number = (first >= 48) & (first <= 57)
    second = buf[np.minimum(a + 1, len(buf) - 1)]
    capital = ((first >= 65) & (first <= 90)) | ((first == 0xC3) & (second >= 0x80) & (second <= 0x9E))
    name = capital & ~lead
    after = np.concatenate([[False], number[:-1] & (doc[1:] == doc[:-1])])
    unit = after & ~number & np.isin(h, _UNIT_HASHES)
    kind = np.where(number, _NUM, np.where(unit, _UNIT, np.where(name, _NAME, np.uint64(0))))
    out = np.where(kind > 0, kind, h), np.where(kind > 0, bo.mix(h ^ kind), np.uint64(0)), doc
    return (*out, capital) if capitals else out


def _exact(w: np.ndarray, value: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Hashes of windows together with their placeholders' values."""
    out = w ^ np.uint64(0x6A09E667F3BCC909)
    for k in range(size):
        out = bo.mix(out ^ value[at + k])
    return out


def _short(h: np.ndarray, value: np.ndarray, doc: np.ndarray, n_docs: int, width: int, whole: bool):
    """(owner, pos, first token, window) of the windows of `width` < WIDTH tokens inside longer texts, or of whole texts so long.
    Windows that are mostly placeholders stand for their own values only."""
    count = np.bincount(doc, minlength=n_docs)
    first = np.concatenate([[0], np.cumsum(count)])[:-1]
    w, upto = bo.shingles(h, doc, n_docs, width)
    owner = np.repeat(np.arange(n_docs), np.diff(upto))
    pos = np.arange(len(w)) - upto[:-1][owner]
    keep = np.flatnonzero(count[owner] == width if whole else count[owner] > width)
    owner, pos, w = owner[keep], pos[keep], w[keep]
    at = first[owner] + pos
    literal = np.concatenate([[0], np.cumsum(value == 0)])
    plain = literal[at + width] - literal[at]
    weak = (plain < 2) & (2 * plain < width)
    w[weak] = _exact(w[weak], value, at[weak], width)
    if whole:
        owner, pos, at, w = owner[weak], pos[weak], at[weak], w[weak]
    return owner, pos, at, w


def _as_names(h: np.ndarray, value: np.ndarray, doc: np.ndarray, capital: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens with each text's capitalised first word as a name, and the numbers of the texts that have one."""
    lead = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])) if len(doc) else np.zeros(0, np.int64)
    lead = lead[capital[lead] & (value[lead] == 0)]
    named, values = h.copy(), value.copy()
    named[lead], values[lead] = _NAME, bo.mix(h[lead] ^ _NAME)
    return named, values, doc[lead]


def _windows(rows: DataFrame, bitmap: np.ndarray | None, widths: tuple[int, ...] = ()) -> DataFrame:
    """id, pos, window, slots (value hashes of its placeholders), n (windows of the whole text that count).

    Without a bitmap the rows are items: their first windows come a second time with a capitalised first word as a name. widths:
    lengths below WIDTH of which documents have windows too.
    """
    cast = rows.sparkSession.sparkContext.broadcast(bitmap) if bitmap is not None else None

    def run(batches):
        held = cast.value if cast is not None else None
        for batch in batches:
            for a, b, buf, offs in bo.chunks(batch.column(1)):
                h, value, doc, capital = tokens(buf, offs, True)
                w, upto = bo.shingles(h, doc, b - a, WIDTH)
                owner = np.repeat(np.arange(b - a), np.diff(upto))
                count = np.bincount(doc, minlength=b - a)
                first = np.concatenate([[0], np.cumsum(count)])[:-1]
                pos = np.arange(len(w)) - upto[:-1][owner]
                at, size = first[owner] + pos, np.minimum(count, WIDTH)[owner]
                literal = np.concatenate([[0], np.cumsum(value == 0)])
                plain = literal[at + size] - literal[at]
                ok = (plain >= 2) | (count[owner] < WIDTH)
                values, weak = value, ~ok
                w[weak] = _exact(w[weak], value, at[weak], WIDTH)
                # Items of hardly any literals are told by their values too; in documents, the bitmap leaves only such items' windows.
                poor = 2 * np.bincount(owner[ok], minlength=b - a) < np.bincount(owner, minlength=b - a)
                ok |= poor[owner] if held is None else True
                n = np.bincount(owner[ok], minlength=b - a)
                if held is None:
                    # Variants read from a second copy of the tokens, which follows the first.
                    named, own, some = _as_names(h, value, doc, capital)
                    again = (pos == 0) & np.isin(owner, some)
                    other, _ = bo.shingles(named, doc, b - a, WIDTH)
                    more = [(owner[again], pos[again], at[again] + len(h), size[again], other[again])]
                    literal = np.concatenate([[0], np.cumsum(own == 0)])
                    plain = literal[(at + size)[again]] - literal[at[again]]
                    good = (plain >= 2) | (count[owner[again]] < WIDTH)
                    more[0][4][~good] = _exact(more[0][4][~good], own, at[again][~good], WIDTH)
                    good |= poor[owner[again]]
                    more = [tuple(x[good] for x in more[0])]
                    for k in range(1, WIDTH):
                        for t, v, shift in ((h, value, 0), (named, own, len(h))):
                            o, p, i, x = _short(t, v, doc, b - a, k, True)
                            more.append((o, p, i + shift, np.full(len(o), k), x))
                    values = np.concatenate([value, own])
                else:
                    more = []
                    for k in widths:
                        o, p, i, x = _short(h, value, doc, b - a, k, False)
                        more.append((o, p, i, np.full(len(o), k), x))
                if more:
                    owner, pos, at, size, w = (np.concatenate([x, *y]) for x, y in zip((owner, pos, at, size, w), zip(*more, strict=True), strict=True))
                    ok = np.concatenate([ok, np.ones(len(w) - len(ok), bool)])
                if held is not None:
                    bit = (w >> np.uint64(64 - BITS)).astype(np.int64)
                    ok &= (held[bit >> 6] >> (bit & 63).astype(np.uint64)) & np.uint64(1) > 0
                keep = np.flatnonzero(ok)
                slots = [values[at[i] : at[i] + size[i]] for i in keep]
                slots = [s[s > 0].view(np.int64) for s in slots]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a).take(pa.array(owner[keep])),
                        pa.array(pos[keep]),
                        pa.array(w[keep].view(np.int64)),
                        pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(s) for s in slots])]).astype(np.int32)), pa.array(np.concatenate(slots) if slots else np.zeros(0, np.int64), pa.int64())),
                        pa.array(n[owner[keep]]),
                        pa.array(size[keep].astype(np.int64)),
                        pa.array(at[keep] >= len(h)),
                    ],
                    names=["id", "pos", "window", "slots", "n", "width", "named"],
                )

    return text_batches(rows).mapInArrow(run, "id long, pos long, window long, slots array<long>, n long, width long, named boolean")


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, item_id, coverage, windows: the items of benchmark(item_id, text) that documents hold."""
    named = lambda rows, c, t: rows.filter(F.col(c).isNotNull()).select(F.col(c).cast("long").alias("id"), F.col(t).cast("string").alias("text"))
    items = written(_windows(named(benchmark, "item_id", "text"), None), "items").select(F.col("id").alias("item_id"), F.col("pos").alias("item_pos"), "window", F.col("slots").alias("item_slots"), "n", "width", "named")
    bit = F.shiftrightunsigned("window", 64 - BITS)
    # At most 2 ** (BITS - 6) rows, whatever the benchmark's size.
    words = items.groupBy(F.shiftright(bit, 6).alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(window, {64 - BITS}) & 63 as int))")).alias("mask")).collect()
    bitmap = np.zeros(1 << (BITS - 6), np.uint64)
    for r in words:
        bitmap[r["at"]] = np.uint64(r["mask"] & 0xFFFFFFFFFFFFFFFF)
    widths = tuple(sorted(r["width"] for r in items.filter(F.col("width") < WIDTH).select("width").distinct().collect()))
    seen = _windows(named(docs, id_col, text_col), bitmap, widths).select("id", "pos", "window", "slots")
    pairs = F.arrays_zip(F.col("item_slots").alias("i"), F.col("slots").alias("d"))
    lines = (
        seen.join(items, "window")
        # An alignment counts with its first word as a name or without that window: a name that fits badly takes no other window away.
        .withColumn("as_name", F.explode(F.when(F.col("named"), F.array(F.lit(True))).otherwise(F.array(F.lit(True), F.lit(False)))))
        .groupBy("id", "item_id", (F.col("pos") - F.col("item_pos")).alias("shift"), "as_name")
        .agg(F.max("n").alias("n"), F.collect_set("item_pos").alias("at"), F.array_distinct(F.flatten(F.collect_list(pairs))).alias("map"))
    )
    one_to_one = (F.size(F.array_distinct(F.col("map.i"))) == F.size("map")) & (F.size(F.array_distinct(F.col("map.d"))) == F.size("map"))
    # The alignment of most windows leads; others add theirs where their slots agree with all before.
    aligned = lines.filter(one_to_one).groupBy("id", "item_id").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct(F.size("at").alias("k"), F.array_sort("at").alias("at"), F.array_sort("map").alias("map"))), False).alias("lines"))

    def joined(acc, line):
        both = F.array_distinct(F.concat(acc["map"], line["map"]))
        fits = (F.size(F.array_distinct(both["i"])) == F.size(both)) & (F.size(F.array_distinct(both["d"])) == F.size(both))
        return F.when(fits, F.struct(F.array_union(acc["at"], line["at"]).alias("at"), both.alias("map"))).otherwise(acc)

    first, rest = F.col("lines")[0], F.slice("lines", 2, F.size("lines"))
    windows = F.aggregate(rest, F.struct(first["at"].alias("at"), first["map"].alias("map")), joined, lambda acc: F.size(acc["at"]).cast("long"))
    found = aligned.select("id", "item_id", "n", windows.alias("windows"))
    return found.filter(F.col("windows") >= coverage * F.col("n")).select(F.col("id").alias("doc_id"), "item_id", (F.col("windows") / F.col("n")).alias("coverage"), "windows")


def decontaminate(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """docs without the documents that hold an item."""
    found = written(contaminated(docs, benchmark, **how).select(F.col("doc_id").alias("id")).distinct(), "leaks")
    return without(docs, found)
