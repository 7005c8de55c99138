"""Secret scans by a linear-chain conditional random field over tokens.

Base patterns find assignments, access keys and hexadecimal runs. Besides, every token of a text is tagged as begin, inside or
outside of a secret: its weights come from its shape, its own and the neighbouring words, what stands between them, and
features of the whole file; Viterbi decoding gives the tags. A token that cannot be other than outside, whatever its neighbours
are, parts the chain, so that decoding runs over the short stretches in between; the result is that of the whole chain.

The field is trained once per process by maximum likelihood on `TRAIN_TEXTS` texts made by a seeded rule (invented words in which
invented secrets and look-alikes such as addresses, numbers and file names are set), never on the corpus.

Cases: null and empty texts have no span; equal scores go to the tag that comes first in begin, inside, outside; a text of any length is
scanned whole in time linear in it and its spans; a secret at a text's start or end counts; repeated rows are scanned alike; empty tables
give empty results; extra columns pass through redact(). Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import itertools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from posthound.llm import bytesops as bo
from posthound.llm.common import text_batches

KINDS = ("assign", "access", "hex", "crf")
#: Base patterns and the shortest match (of group 2 for assignments); the flags fold ASCII letters only.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 6, "access": 20, "hex": 24}
_HINTS = (b"passw", b"secret", b"token", b"api")

TRAIN_TEXTS, TRAIN_SEED, ROUNDS = 450, 11, 50
_SLOTS = 4096
_TOKEN = np.zeros(256, bool)
_TOKEN[[*range(48, 58), *range(65, 91), *range(97, 123), *b"+/_.-", *range(128, 256)]] = True
_KIND = np.zeros((5, 256), np.int32)
_KIND[0, 65:91] = _KIND[1, 97:123] = _KIND[2, 48:58] = _KIND[4, 128:] = 1
_KIND[3, list(b"+/_.-")] = 1
_HEXBYTE = np.zeros(256, np.int32)
_HEXBYTE[[*range(48, 58), *range(97, 103), *range(65, 71)]] = 1
#: Letter, digit or other, to count how often a token changes between them.
_CLASS = np.zeros(256, np.int8)
_CLASS[48:58], _CLASS[65:91], _CLASS[97:123], _CLASS[128:] = 1, 2, 3, 3
_LENGTHS = np.array([1, 2, 3, 4, 5, 7, 9, 12, 16, 20, 24, 32, 41, 65])
FEATURES = 9


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns, each kind's leftmost matches that do not overlap, without those too short."""
    out = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text) if m.end() - m.start() >= LEAST["hex"]]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def featurise(buf: np.ndarray, offs: np.ndarray):
    """(starts, ends, text numbers, features): tokens are runs of letters, digits and + / _ . -; features are FEATURES weight rows each."""
    starts, ends, doc = bo.spans(_TOKEN[buf], offs)
    n = len(starts)
    if not n:
        return starts, ends, doc, np.zeros((0, FEATURES), np.int64)
    size = ends - starts
    # Sums up to the next token would take in what lies between, so other bytes count as 0.
    inside = _TOKEN[buf]
    held = np.where(inside, buf, 0)
    up, low, digit, mark, wide, hexa = (np.add.reduceat(t[held], starts) for t in (*_KIND, _HEXBYTE))
    change = np.zeros(len(buf), np.int32)
    change[1:] = (_CLASS[buf[1:]] != _CLASS[buf[:-1]]) & inside[1:] & inside[:-1]
    turns = np.add.reduceat(change, starts)
    length = np.searchsorted(_LENGTHS, size, side="right")
    share = np.minimum(4, (digit * 5) // np.maximum(size, 1))
    word = bo.span_hashes(bo.LOWER[buf], starts, ends)
    joined = np.concatenate([[False], doc[1:] == doc[:-1]])
    gap_at = np.concatenate([[0], ends[:-1]])
    marks = {}
    for name, chars in (("assign", b"=:"), ("quote", b"\"'`"), ("break", b"\n"), ("other", b"@#$%&*|!?<>()[]{},;")):
        flag = np.zeros(256, np.int32)
        flag[list(chars)] = 1
        upto = np.concatenate([[0], np.cumsum(flag[buf])])
        marks[name] = np.where(joined, upto[starts] - upto[np.minimum(gap_at, starts)], 0) > 0
    gap = marks["assign"] + 2 * marks["quote"] + 4 * marks["break"] + 8 * marks["other"] + 16 * ~joined
    next_gap = np.concatenate([gap[1:], [16]])
    shape = ((np.minimum(up, 2) * 3 + np.minimum(low, 2)) * 3 + np.minimum(digit, 2)) * 16 + length
    mixed = np.minimum(turns, 7) * 32 + share * 4 + (hexa == size) * 2 + (wide > 0)
    stops = np.minimum(mark, 3) * 16 + length
    prev = lambda x, k=1: np.where(joined, np.concatenate([x[:k], x[:-k]]), x.dtype.type(0)) if n > k else x * 0
    after = np.where(np.concatenate([joined[1:], [False]]), np.concatenate([word[1:], word[:1]]), np.uint64(0))
    before = prev(word)
    # The file: how dense digits and assignment marks are, and how long it is.
    per = np.maximum(np.diff(offs), 1)
    count = lambda t: np.diff(np.concatenate([[0], np.cumsum(t[buf])])[offs])
    eq = np.zeros(256, np.int64)
    eq[list(b"=:")] = 1
    file = np.minimum(7, 100 * count(_KIND[2]) // per) * 64 + np.minimum(7, 400 * count(eq) // per) * 8 + np.minimum(7, np.log2(per).astype(np.int64) // 2)
    long_word = np.minimum(length, 9)
    rows = (
        shape,
        mixed * 16 + length,
        stops,
        gap * 16 + long_word,
        next_gap * 32 + gap,
        np.where(size <= 14, word, np.uint64(1)),
        np.where(prev(size) <= 14, before, np.uint64(1)),
        after,
        file[doc] * 8 + np.minimum(share * 2 + (size >= 12), 7),
    )
    # Word hashes are even already, and the other values lie below _SLOTS.
    return starts, ends, doc, np.stack([(np.asarray(r).astype(np.uint64) & np.uint64(_SLOTS - 1)).astype(np.int64) + k * _SLOTS for k, r in enumerate(rows)], 1)


def _word(rng, letters: str) -> str:
    return "".join(rng.choice(list(letters), rng.integers(1, 12)))


def _run(rng, letters: str, a: int, b: int) -> str:
    return "".join(rng.choice(list(letters), rng.integers(a, b)))


def training_text(rng) -> tuple[str, list[tuple[int, int]]]:
    """Invented words with invented secrets and look-alikes among them, and the spans of the secrets."""
    low, up, dig = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    alphabet = [low, low + "éèàçêïöüßñ", low, "aeiourstn"][rng.integers(4)]
    every = low + up + dig
    parts, spans, at = [], [], 0

    def put(s: str, secret: bool = False) -> None:
        nonlocal at
        if secret:
            spans.append((at, at + len(s)))
        parts.append(s)
        at += len(s)

    style = rng.integers(6)
    for _ in range(rng.integers(1, 45)):
        kind = rng.random()
        if kind < 0.06:
            value = [
                lambda: _run(rng, every, 16, 48),
                lambda: _run(rng, every + "+/", 30, 60),
                lambda: "AKIA" + _run(rng, up + dig, 16, 17),
                lambda: _run(rng, "0123456789abcdef", 24, 65),
                lambda: ["ghp_", "sk-", "xoxb-", "glpat-"][rng.integers(4)] + _run(rng, every, 20, 40),
                lambda: _run(rng, every, 3, 7) + _run(rng, dig, 2, 4) + _run(rng, every + "_.-", 3, 8),
            ][rng.integers(6)]
            head = ["password", "passwd", "secret", "token", "api_key", "apikey", "bearer", "credential", "key", "auth", "private_key", "access_key"][rng.integers(12)]
            put(head if rng.random() < 0.8 else head.upper())
            put(["=", ": ", " = ", " is ", ' = "', ":", " "][rng.integers(7)])
            put(value(), True)
            put(["", '"', ";", ","][rng.integers(4)] + " ")
        elif kind < 0.12:
            put(
                [
                    lambda: f"{_word(rng, low)}.{_run(rng, dig, 1, 4)}@{_word(rng, low)}.{['com', 'org', 'example'][rng.integers(3)]}",
                    lambda: _run(rng, dig, 4, 17),
                    lambda: ".".join(str(rng.integers(256)) for _ in range(4)),
                    lambda: f"+{_run(rng, dig, 2, 3)}-{_run(rng, dig, 3, 4)}-{_run(rng, dig, 4, 5)}",
                    lambda: f"https://{_word(rng, low)}.{_word(rng, low)}.com/{_word(rng, low)}/{_run(rng, dig, 1, 6)}",
                    lambda: f"/{_word(rng, low)}/{_word(rng, low)}-{_run(rng, dig, 1, 3)}.{_run(rng, low, 2, 4)}",
                    lambda: f"20{_run(rng, dig, 2, 3)}-{_run(rng, '01', 2, 3)}-{_run(rng, '012', 2, 3)}",
                    lambda: f"{_word(rng, low)}_{_word(rng, low)}_{_word(rng, low)}",
                    lambda: _word(rng, up) + _word(rng, up),
                    lambda: f"{['token', 'secret', 'password', 'key'][rng.integers(4)]}{[' ', ': ', ' = '][rng.integers(3)]}{_word(rng, low)}",
                    lambda: _word(rng, low) + _word(rng, alphabet) + _word(rng, low) + _word(rng, low),
                ][rng.integers(11)]()
                + " "
            )
        else:
            w = "".join(_word(rng, alphabet)[:4] for _ in range(rng.integers(1, 5)))
            w = w.upper() if style == 4 else w.capitalize() if rng.random() < 0.12 else w
            put(w + (["!!", "%%%", "###", "$$$", "***", "&&&"][rng.integers(6)] if style == 5 else " |" if style == 3 else "") + (". " if rng.random() < 0.08 else "\n" if rng.random() < 0.03 else " "))
    return "".join(parts), spans


class Field:
    """Emission weights by feature row and transition weights between the tags begin, inside, outside."""

    def __init__(self, emission: np.ndarray, transition: np.ndarray) -> None:
        self.emission, self.transition = emission, transition
        #: What two transitions can at most make up for.
        self.reach = 2 * (transition.max() - transition.min())

    def score(self, rows: np.ndarray) -> np.ndarray:
        out = self.emission[rows[:, 0]].copy()
        for k in range(1, rows.shape[1]):
            out += self.emission[rows[:, k]]
        return out

    def viterbi(self, e: np.ndarray, left: bool, right: bool) -> np.ndarray:
        """Best tags of a stretch; left, right: an outside token stands there."""
        step, states = self.transition.astype(float).tolist(), range(3)
        best = [x + (step[2][k] if left else 0) for k, x in enumerate(e[0].tolist())]
        back = []
        for own in e[1:].tolist():
            came = [max(states, key=lambda i: best[i] + step[i][k]) for k in states]  # noqa: B023
            back.append(came)
            best = [best[i] + step[i][k] + own[k] for k, i in enumerate(came)]
        tags = [max(states, key=lambda i: best[i] + (step[i][2] if right else 0))]
        for came in reversed(back):
            tags.append(came[tags[-1]])
        return np.array(tags[::-1])

    def spans(self, buf: np.ndarray, offs: np.ndarray):
        """(text number, first byte, end byte) of the secrets tagged."""
        starts, ends, doc, rows = featurise(buf, offs)
        if not len(starts):
            return []
        e = self.score(rows)
        open_ = np.flatnonzero(e[:, :2].max(1) + self.reach >= e[:, 2])
        out = []
        if not len(open_):
            return out
        for run in np.split(open_, np.flatnonzero((np.diff(open_) > 1) | (np.diff(doc[open_]) > 0)) + 1):
            a, b = int(run[0]), int(run[-1])
            tags = self.viterbi(e[a : b + 1], a > 0 and doc[a - 1] == doc[a], b + 1 < len(doc) and doc[b + 1] == doc[b])
            k = 0
            while k < len(tags):
                if tags[k] == 2:
                    k += 1
                    continue
                m = k + 1
                while m < len(tags) and tags[m] == 1:
                    m += 1
                out.append((int(doc[a]), int(starts[a + k]), int(ends[a + m - 1])))
                k = m
        return out


@functools.cache
def trained() -> Field:
    """Maximum likelihood by gradient ascent (adaptive steps) with forward-backward sums over padded sequences."""
    rng = np.random.default_rng(TRAIN_SEED)
    made = [training_text(rng) for _ in range(TRAIN_TEXTS)]
    data = []
    for text, spans in made:
        raw = np.frombuffer(text.encode(), np.uint8)
        starts, ends, _, rows = featurise(raw, np.array([0, len(raw)]))
        if not len(starts):
            continue
        at = np.cumsum([0, *(len(c.encode()) for c in text)])
        tags = np.full(len(starts), 2)
        for a, b in spans:
            own = np.flatnonzero((starts < at[b]) & (ends > at[a]))
            tags[own] = 1
            tags[own[:1]] = 0
        data.append((rows, tags))
    n, longest = len(data), max(len(t) for _, t in data)
    rows, tags, live = np.zeros((n, longest, FEATURES), np.int64), np.full((n, longest), 2), np.zeros((n, longest), bool)
    for i, (r, t) in enumerate(data):
        rows[i, : len(t)], tags[i, : len(t)], live[i, : len(t)] = r, t, True
    gold = np.eye(3)[tags] * live[:, :, None]
    pairs = np.einsum("nti,ntj->ij", gold[:, :-1], gold[:, 1:])
    w, tr = np.zeros((FEATURES * _SLOTS, 3)), np.zeros((3, 3))
    w2, tr2 = np.full(w.shape, 1e-3), np.full(tr.shape, 1e-3)
    flat = rows[live]
    # An end behaves like no neighbour at all: sequences carry no weight before their first or after their last token.
    for _ in range(ROUNDS):
        e = w[rows].sum(2)
        f, b = np.zeros_like(e), np.zeros_like(e)
        f[:, 0] = e[:, 0]
        lse = lambda x, axis: (m := x.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(x - m).sum(axis))
        for t in range(1, longest):
            f[:, t] = np.where(live[:, t, None], lse(f[:, t - 1, :, None] + tr, 1) + e[:, t], f[:, t - 1])
        for t in range(longest - 2, -1, -1):
            b[:, t] = np.where(live[:, t + 1, None], lse(tr[None] + (e[:, t + 1] + b[:, t + 1])[:, None, :], 2), 0)
        z = lse(f[:, -1], 1)
        p = np.exp(f + b - z[:, None, None]) * live[:, :, None]
        both = np.exp(f[:, :-1, :, None] + tr + (e[:, 1:] + b[:, 1:])[:, :, None, :] - z[:, None, None, None]) * live[:, 1:, None, None]
        diff = (gold - p)[live]
        g = np.stack([np.bincount(flat.ravel(), weights=np.repeat(diff[:, k], FEATURES), minlength=len(w)) for k in range(3)], 1) - 0.02 * w
        gt = pairs - both.sum((0, 1)) - 0.02 * tr
        w2 += g * g
        tr2 += gt * gt
        w += 0.35 * g / np.sqrt(w2)
        tr += 0.35 * gt / np.sqrt(tr2)
    return Field(w.astype(np.float32), tr.astype(np.float32))


def scan(buf: np.ndarray, offs: np.ndarray, field: Field) -> dict[int, tuple[str, list[tuple[int, int, str]], int]]:
    """{text number: (text, all spans, how many the field tagged)} of the texts in the buffer that hold any; spans by start, then kind
    as in KINDS. Spans of the field that lie wholly inside a base span are not listed again."""
    raw, low = buf.tobytes(), bo.LOWER[buf].tobytes()
    hit: set[int] = set()

    def mark(data: bytes, needle: bytes) -> None:
        at = data.find(needle)
        while at >= 0:
            i = int(np.searchsorted(offs, at, side="right")) - 1
            hit.add(i)
            at = data.find(needle, int(offs[i + 1]))

    for needle in _HINTS:
        mark(low, needle)
    mark(raw, b"AKIA")
    hexbyte = (_HEXBYTE[buf] > 0) & ~((buf >= 65) & (buf <= 70))
    s, e, d = bo.spans(hexbyte, offs)
    hit.update(d[(e - s) >= LEAST["hex"]].tolist())
    extra: dict[int, list] = {}
    for d, s, e in field.spans(buf, offs):
        extra.setdefault(d, []).append((s, e))
    # Code points before each byte.
    chars = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)]) if extra else None
    out = {}
    for i in sorted(hit | set(extra)):
        text = raw[offs[i] : offs[i + 1]].decode("utf-8", "replace")
        spans = base_spans(text) if i in hit else []
        found = [(int(chars[s] - chars[offs[i]]), int(chars[e] - chars[offs[i]]), "crf") for s, e in extra.get(i, ())]
        if spans or found:
            out[i] = text, sorted([*spans, *_beyond(found, spans)], key=lambda x: (x[0], KINDS.index(x[2]))), len(found)
    return out


def _beyond(found: list, spans: list) -> list:
    """Those of found that are not wholly inside one of spans (sorted by start)."""
    starts, reach = [s[0] for s in spans], list(itertools.accumulate((s[1] for s in spans), max))
    return [f for f in found if not (k := bisect.bisect_right(starts, f[0])) or reach[k - 1] < f[1]]


def _said(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


_NOTHING = hashlib.sha256(b"").hexdigest()


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_crf (spans of the field), n_tagged (with those inside base spans): a row per row."""
    field = docs.sparkSession.sparkContext.broadcast(trained())

    def run(batches):
        for batch in batches:
            for a, b, buf, offs in bo.chunks(batch.column(1)):
                n, digest, said = np.zeros((5, b - a), np.int64), [_NOTHING] * (b - a), [""] * (b - a)
                for i, (_, spans, n[4, i]) in scan(buf, offs, field.value).items():
                    for k, kind in enumerate(KINDS):
                        n[k, i] = sum(s[2] == kind for s in spans)
                    digest[i] = hashlib.sha256(_said(s for s in spans if s[2] != "crf").encode()).hexdigest()
                    said[i] = _said(spans)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *(pa.array(n[k]) for k in range(3)), pa.array(digest), pa.array(said), pa.array(n[3]), pa.array(n[4])], names=[id_col, "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_crf", "n_tagged"])

    return text_batches(docs).select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias(text_col)).mapInArrow(run, f"{id_col} long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_crf long, n_tagged long")


def redact(docs: DataFrame, text_col: str = "text", mask: str = "[SECRET]", count_col: str | None = "n_chars") -> DataFrame:
    """docs with every span replaced by `mask` (spans that overlap by one) and count_col, if there, set to the new length."""
    field = docs.sparkSession.sparkContext.broadcast(trained())
    at = docs.columns.index(text_col)
    own = docs.columns.index(count_col) if count_col in docs.columns else None

    def run(batches):
        for batch in batches:
            columns = list(batch.columns)
            texts, sizes = {}, {}
            for a, _, buf, offs in bo.chunks(columns[at]):
                for i, (text, spans, _) in scan(buf, offs, field.value).items():
                    out, done = [], 0
                    for s, e, _ in spans:
                        if s >= done:
                            out += [text[done:s], mask]
                        done = max(done, e)
                    texts[a + i] = "".join([*out, text[done:]])
            if texts:
                values = columns[at].to_pylist()
                counts = columns[own].to_pylist() if own is not None else []
                for i, text in texts.items():
                    values[i] = text
                    if counts:
                        counts[i] = len(text)
                columns[at] = pa.array(values, columns[at].type)
                if counts:
                    columns[own] = pa.array(counts, columns[own].type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return text_batches(docs).mapInArrow(run, docs.schema)
