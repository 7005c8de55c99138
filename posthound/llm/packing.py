"""Mixture-controlled packing by deficit round-robin over source queues.

Every source is a queue of its documents' tokens, cut into quanta. A queue's deficit grows with its target share, and the
queue whose deficit comes due first is served one quantum next; what it is owed beyond that carries on to the following windows.
The c-th quantum of a queue with weight w comes due at time (c + 1/2) / w (ties: by the queue's name), so deficits carry over all
windows and partitions and no pass over the windows in order is needed. Up to `broadcast_queues` queues, the place of a quantum
in the whole order is a sum of closed forms over the queues, which every task holds; beyond them, quanta are rows that are sorted
by due time and joined. Both ways give the same rows. Windows are runs of quanta; a queue that runs dry leaves its share to the
others. Only the last quantum of a queue can be short, so at most one window a queue is padded.

Cases: a null or empty text is the end id alone; a null source is a queue of its own; repeated rows are packed each; a source that
`weights` leaves out, or gives 0, gets a share of a millionth; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import functools
import itertools
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from posthound.llm import bytesops as bo
from posthound.llm.common import sized, text_batches
from posthound.llm.hilbert import ranked
from posthound.session import written

WINDOW, QUANTUM = 1024, 256
#: Pieces whose ids a task remembers, about 40 bytes each.
CACHED_SEGMENTS = 500_000
_HEAD = np.zeros(256, dtype=bool)
_HEAD[[0xE1, 0xE2, 0xE3]] = True


class Pieces:
    """Token ids of text pieces, found by the pieces' 64-bit hashes: flat arrays, no object per piece.

    Where more than `room` would be held, those not met since the last time go, then all but those in hand.
    """

    def __init__(self, room: int) -> None:
        self.room = room
        self.keys, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.uint32)
        self.heads, self.sizes, self.met = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def places(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(where each hash is or would be, whether it is there)."""
        at = np.searchsorted(self.keys, h)
        held = at < len(self.keys)
        held[held] = self.keys[at[held]] == h[held]
        return at, held

    def missing(self, h: np.ndarray) -> np.ndarray:
        """Which of the distinct hashes must be added; makes room for them."""
        at, held = self.places(h)
        own = np.zeros(len(self.keys), bool)
        own[at[held]] = True
        self.met |= own
        more = len(h) - int(held.sum())
        if len(self.keys) + more > self.room:
            self.keep(self.met if int(self.met.sum()) + more <= self.room else own)
        return ~held

    def keep(self, chosen: np.ndarray) -> None:
        sizes = self.sizes[chosen]
        heads = np.cumsum(sizes) - sizes
        self.ids = self.ids[np.arange(int(sizes.sum())) + np.repeat(self.heads[chosen] - heads, sizes)]
        self.keys, self.heads, self.sizes, self.met = self.keys[chosen], heads, sizes, np.zeros(len(sizes), bool)

    def add(self, h: np.ndarray, ids: list[list[int]]) -> None:
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        keys = np.concatenate([self.keys, h])
        by = np.argsort(keys, kind="stable")
        self.keys = keys[by]
        self.heads = np.concatenate([self.heads, len(self.ids) + np.cumsum(sizes) - sizes])[by]
        self.sizes = np.concatenate([self.sizes, sizes])[by]
        self.met = np.concatenate([self.met, np.ones(len(h), bool)])[by]
        self.ids = np.concatenate([self.ids, np.fromiter(itertools.chain.from_iterable(ids), np.uint32, int(sizes.sum()))])


def _runs(flat: np.ndarray, heads: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the runs flat[heads[k] : heads[k] + sizes[k]] one after another, offsets of each)."""
    upto = np.concatenate([[0], np.cumsum(sizes)])
    return flat[np.arange(int(upto[-1])) - np.repeat(upto[:-1] - heads, sizes)], upto


class Segmenter:
    """Token ids of many texts by a byte-level BPE vocabulary.

    Texts are cut before every space that follows a character other than white space; a pre-token never spans such a cut, so
    each distinct piece is encoded once. Texts with strings of special tokens go through the tokenizer itself.
    """

    def __init__(self, vocabulary: str, ranks: str, pattern: str, special: list[bytes]) -> None:
        import base64

        import tiktoken

        self.vocabulary, self.special = vocabulary, special
        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bpe = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.known = Pieces(CACHED_SEGMENTS)
        spelt = {i: b for b, i in table.items()}
        each = [spelt.get(i, b"") for i in range(max(spelt) + 1)]
        self.letters = np.frombuffer(b"".join(each), np.uint8)
        self.letter_offs = np.concatenate([[0], np.cumsum([len(b) for b in each])])

    @functools.cached_property
    def whole(self):
        """The tokenizer, loaded for the first text with a special string."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.vocabulary)

    def misspelt(self, ids: np.ndarray, upto: np.ndarray, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[int]:
        """Pieces (which follow each other in buf) whose ids, upto[k] to upto[k + 1], do not spell their bytes."""
        size = np.diff(self.letter_offs)[ids]
        length = np.concatenate([[0], np.cumsum(size)])[upto]
        bad = np.diff(length) != ends - starts
        if not bad.any():
            spelt, _ = _runs(self.letters, self.letter_offs[ids], size)
            bad[np.searchsorted(ends, np.flatnonzero(spelt != buf), side="right")] = True
        else:  # only those of the right length can be held against the text byte by byte
            for k in np.flatnonzero(~bad):
                spelt, _ = _runs(self.letters, self.letter_offs[ids[upto[k] : upto[k + 1]]], size[upto[k] : upto[k + 1]])
                bad[k] = not np.array_equal(spelt, buf[starts[k] : ends[k]])
        return np.flatnonzero(bad).tolist()

    def encode(self, buf: np.ndarray, offs: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of the texts, each closed by end_id."""
        raw, n = buf.tobytes(), len(offs) - 1
        odd = [i for i in range(n) if any(s in raw[offs[i] : offs[i + 1]] for s in self.special)] if any(s in raw for s in self.special) else []
        cut = np.zeros(len(buf) + 1, dtype=bool)
        if len(buf):
            at = np.flatnonzero(buf == 32)
            at = at[at > 0]
            p1, p2, p3 = buf[at - 1], buf[np.maximum(at - 2, 0)], buf[np.maximum(at - 3, 0)]
            ascii_ok = (p1 < 128) & (p1 > 32) & (p1 != 127)
            wide_ok = (p1 >= 128) & (p2 != 0xC2) & ~_HEAD[p3] & ~_HEAD[p2]
            cut[at[ascii_ok | wide_ok]] = True
        cut[offs] = True
        bounds = np.flatnonzero(cut)
        starts, ends = bounds[:-1], bounds[1:]
        h = bo.span_hashes(buf, starts, ends)
        h, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        new = self.known.missing(h)
        at = first[new]
        self.known.add(h[new], [self.bpe.encode_ordinary(raw[s:e].decode("utf-8", "replace")) for s, e in zip(starts[at].tolist(), ends[at].tolist(), strict=True)])
        place, _ = self.known.places(h)
        flat, heads, lens = self.known.ids, self.known.heads[place], self.known.sizes[place]
        ids, upto = _runs(flat, heads[inverse], lens[inverse])
        # Hashes only find pieces: ids that do not spell a piece's own bytes are another's, and it is encoded anew.
        if wrong := self.misspelt(ids, upto, buf, starts, ends):
            own = {k: np.array(self.bpe.encode_ordinary(raw[starts[k] : ends[k]].decode("utf-8", "replace")), np.uint32) for k in wrong}
            parts = [own.get(k, ids[upto[k] : upto[k + 1]]) for k in range(len(starts))]
            ids, upto = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        tok = upto[np.searchsorted(starts, offs)] if len(starts) else np.zeros(n + 1, np.int64)
        parts, sizes = [], []
        end = np.array([end_id], np.uint32)
        swap = {i: np.array(self.whole.encode(raw[offs[i] : offs[i + 1]].decode("utf-8", "replace"), add_special_tokens=False).ids, np.uint32) for i in odd}
        for i in range(n):
            part = swap.get(i)
            part = ids[tok[i] : tok[i + 1]] if part is None else part
            parts += [part, end]
            sizes.append(len(part) + 1)
        return np.concatenate(parts) if parts else ids, np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def token_table(docs: DataFrame, vocabulary: str, ranks: str, pattern: str, end_id: int) -> DataFrame:
    """id, queue, part, at (tokens of the queue before it in its part), n, ids (little-endian unsigned, of 16 bits if the vocabulary
    fits them, else of 32), of docs(id, queue, text)."""
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(vocabulary)
    special = [t.content.encode() for t in whole.get_added_tokens_decoder().values()]
    kind = id_type(max(whole.get_vocab_size(True) - 1, end_id))

    def run(batches):
        segmenter = Segmenter(vocabulary, ranks, pattern, special)
        part, done = TaskContext.get().partitionId(), {}
        for batch in batches:
            queues = batch.column(1).to_pylist()
            for a, b, buf, offs in bo.chunks(batch.column(2)):
                ids, toks = segmenter.encode(buf, offs, end_id)
                small = ids.astype(kind)
                n = np.diff(toks)
                at = np.empty(b - a, np.int64)
                for i in range(b - a):
                    q = queues[a + i]
                    at[i] = done.get(q, 0)
                    done[q] = at[i] + int(n[i])
                blob = pa.array([small[s:e].tobytes() for s, e in zip(toks[:-1], toks[1:], strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(np.full(b - a, part, np.int32)), pa.array(at), pa.array(n), blob], names=["id", "queue", "part", "at", "n", "ids"])

    return text_batches(docs.select("id", "queue", "text")).mapInArrow(run, "id long, queue string, part int, at long, n long, ids binary")


def id_type(largest: int) -> str:
    return "<u2" if largest < 1 << 16 else "<u4"


class Schedule:
    """Places of quanta in the deficit round-robin order. totals: tokens of each queue; weights: target shares, all above 0."""

    def __init__(self, totals: np.ndarray, weights: np.ndarray, window: int, quantum: int) -> None:
        self.totals, self.quantum, self.slots = totals.astype(np.int64), quantum, window // quantum
        self.weights = weights.astype(np.float64)
        self.quanta = -(-self.totals // quantum)
        self.order = np.arange(len(totals))
        tails = np.flatnonzero(self.totals % quantum)
        place = self.rank(tails, self.quanta[tails] - 1)
        by = np.argsort(place)
        self.tail_rank = place[by]
        self.tail_gap = np.concatenate([[0], np.cumsum((quantum - self.totals[tails] % quantum)[by])])

    def rank(self, queue: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Place of the c-th quantum of each queue: how many come due before it, ties by queue."""
        due = (c + 0.5) / self.weights[queue]
        out = np.zeros(len(c), np.int64)
        for j, w in enumerate(self.weights):
            before = np.ceil(due * w - 0.5).astype(np.int64)
            ahead = lambda k: ((k + 0.5) / w < due) | (((k + 0.5) / w == due) & (j < queue))  # noqa: B023, E731
            before = np.where(ahead(before), before + 1, before)
            before = np.where(~ahead(before - 1) & (before > 0), before - 1, before)
            out += np.where(queue == j, c, np.clip(before, 0, self.quanta[j]))
        return out

    def offset(self, rank: np.ndarray) -> np.ndarray:
        """Tokens of the window that lie before the quantum."""
        first = rank // self.slots * self.slots
        gaps = self.tail_gap[np.searchsorted(self.tail_rank, rank)] - self.tail_gap[np.searchsorted(self.tail_rank, first)]
        return (rank - first) * self.quantum - gaps


def _cut(start: np.ndarray, n: np.ndarray, quantum: int):
    """The pieces of documents at [start, start + n) of their queues, one per quantum: (document, quantum, first token, length, place in the quantum)."""
    lo, hi = start // quantum, (start + n - 1) // quantum
    count = hi - lo + 1
    doc = np.repeat(np.arange(len(n)), count)
    c = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count - lo, count)
    a, b = np.maximum(c * quantum, start[doc]), np.minimum((c + 1) * quantum, (start + n)[doc])
    return doc, c, a - start[doc], b - a, a - c * quantum


def _share(wanted: float | np.ndarray, total: float):
    """Part of the tokens that a queue should have; one without a weight gets a millionth."""
    return np.where(wanted > 0, wanted, max(1e-9, total * 1e-6)) / max(1e-9, total)


def order_of_quanta(queues: DataFrame, window: int, quantum: int) -> DataFrame:
    """queue, c, sequence_id, before: the window of every quantum of queues(queue, m, share) and the tokens before it there."""
    c, slots = F.col, window // quantum
    step = 1 << 16
    runs = queues.withColumn("n", F.ceil(c("m") / quantum).cast("long")).withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((c("n") - 1) / step).cast("long"))))
    quanta = runs.repartition("queue", "run").withColumn("c", F.explode(F.sequence(c("run") * step, F.least(c("n"), (c("run") + 1) * step) - 1)))
    sized_ = quanta.select("queue", "c", ((c("c") + 0.5) / c("share")).alias("due"), F.least(F.lit(quantum).cast("long"), c("m") - c("c") * quantum).alias("size"))
    placed = ranked(sized_, ["due", "queue", "c"]).withColumn("sequence_id", F.floor(c("rank") / slots).cast("long"))
    before = F.sum("size").over(W.partitionBy("sequence_id").orderBy("rank")) - c("size")
    return placed.select("queue", "c", "sequence_id", before.alias("before"))


def pack(docs: DataFrame, vocabulary: str | None = None, ranks: str | None = None, weights: dict[str | None, float] | None = None, window: int = WINDOW, quantum: int = QUANTUM, end_id: int = 0, even: bool = False, broadcast_queues: int = 1024, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source_queue: one row per piece.

    weights: target share per source; default: each source's share of all tokens, or, if even, shares in proportion to the square
    roots of the sources' tokens, which lift small sources over large ones. window: a multiple of quantum.
    """
    import public_tokenizers

    vocabulary = vocabulary or public_tokenizers.path("byte_bpe_50k.json")
    ranks = ranks or public_tokenizers.path("byte_bpe_50k.tiktoken")
    if window % quantum:
        raise ValueError("a window holds whole quanta")
    shares = {("null" if k is None else f"={k}"): float(v) for k, v in (weights or {}).items()}
    source = F.col(source_col).cast("string")
    queue = F.when(source.isNull(), F.lit("null")).otherwise(F.concat(F.lit("="), source))
    queued = docs.select(F.col(id_col).cast("long").alias("id"), queue.alias("queue"), F.col(text_col).cast("string").alias("text"))
    table = written(token_table(queued, vocabulary, ranks, public_tokenizers.PATTERN, end_id), "tokens")
    parts = table.groupBy("queue", "part").agg(F.sum("n").alias("m"))
    # One row per part and queue; few enough, they are broadcast and the ids stay where they are.
    base = written(parts.select("queue", "part", "m", (F.sum("m").over(W.partitionBy("queue").orderBy("part")) - F.col("m")).alias("base")), "bases")
    placed = table.join(sized(base.drop("m")), ["queue", "part"]).select("id", "queue", "n", (F.col("base") + F.col("at")).alias("start"), "ids")
    sums = written(base.groupBy("queue").agg(F.sum("m").alias("m")), "queues")
    few = sums.limit(broadcast_queues + 1).collect()
    schedule, index = None, {}
    if len(few) <= broadcast_queues:
        held = {r["queue"]: r["m"] for r in few}
        index = {q: i for i, q in enumerate(sorted(held))}
        totals = np.array([held[q] for q in index], dtype=np.int64)
        wanted = np.array([shares.get(q, 0.0) for q in index]) if shares else np.sqrt(totals.astype(float)) if even else totals.astype(float)
        schedule = Schedule(totals, _share(wanted, float(wanted.sum())), window, quantum)
    names = [id_col, "start", "length", "ids_crc32", "doc_tokens", *(("sequence_id", "offset") if schedule else ("_c", "_in")), "source_queue"]

    def run(batches):
        for batch in batches:
            blobs, n, start = batch.column(4), batch.column(2).to_numpy(), batch.column(3).to_numpy()
            doc, c, first, length, inside = _cut(start, n, quantum)
            crc, held, own = np.empty(len(doc), np.int64), -1, b""
            for k, (d, s, m) in enumerate(zip(doc.tolist(), first.tolist(), length.tolist(), strict=True)):
                if d != held:
                    held, blob = d, blobs[d].as_py()
                    own = np.frombuffer(blob, f"<u{len(blob) // int(n[d])}").astype("<u4")
                crc[k] = zlib.crc32(own[s : s + m])
            if schedule:
                rank = schedule.rank(np.array([index[q] for q in batch.column(1).to_pylist()], dtype=np.int64)[doc], c)
                c, inside = rank // schedule.slots, schedule.offset(rank) + inside
            take = pa.array(doc)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), pa.array(first), pa.array(length), pa.array(crc), pa.array(n[doc]), pa.array(c), pa.array(inside), batch.column(1).take(take)], names=names)

    pieces = placed.mapInArrow(run, ", ".join(f"`{x}` long" for x in names[:-1]) + ", source_queue string")
    if schedule:
        return pieces
    given = sums.sparkSession.createDataFrame(list(shares.items()), "queue string, wanted double")
    wanted = sums.join(sized(given), "queue", "left").select("queue", "m", F.coalesce("wanted", F.lit(0.0)).alias("w")) if shares else sums.select("queue", "m", (F.sqrt("m") if even else F.col("m").cast("double")).alias("w"))
    total = float(wanted.agg(F.sum("w")).first()[0])
    share = F.when(F.col("w") > 0, F.col("w")).otherwise(F.lit(max(1e-9, total * 1e-6))) / F.lit(max(1e-9, total))
    order = order_of_quanta(wanted.select("queue", "m", share.alias("share")), window, quantum)
    return pieces.join(order.withColumnsRenamed({"queue": "source_queue", "c": "_c"}), ["source_queue", "_c"]).withColumn("offset", F.col("before") + F.col("_in")).select(*names[:5], "sequence_id", "offset", "source_queue")
