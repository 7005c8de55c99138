"""Plain single-process versions of what the operators compute, for tests."""

from __future__ import annotations

import re
from collections import Counter, defaultdict


def shingle_set(text, width=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub(r"[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset()


def near_duplicates(rows, percent=85, width=5):
    """{doc_id: (n_shingles, component)} by a prefix-filtered exact join."""
    sets = {d: shingle_set(t, width) for d, t in rows}
    by_set = defaultdict(list)
    for d, s in sets.items():
        if s:
            by_set[s].append(d)
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def join(a, b):
        a, b = sorted((find(a), find(b)))
        parent[b] = a

    freq = Counter(x for s in by_set for x in s)
    index = defaultdict(list)
    for s, ids in by_set.items():
        for d in ids[1:]:
            join(ids[0], d)
        prefix = sorted(s, key=lambda x: (freq[x], x))[: len(s) - -(-len(s) * percent // 100) + 1]
        for t in {t for x in prefix for t in index[x]}:
            if find(by_set[t][0]) != find(ids[0]):
                both = len(s & t)
                if 100 * both >= percent * (len(s) + len(t) - both):
                    join(by_set[t][0], ids[0])
        for x in prefix:
            index[x].append(s)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def base_secrets(text):
    text, out = text or "", []
    rx = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    out += [(m.start(), m.end(), "assign") for m in rx.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out, key=lambda s: (s[0], ("assign", "access", "hex").index(s[2])))


def contained(docs, items, share=0.8):
    """(doc, item) where at least `share` of the item's five-word windows occur, punctuation and case aside."""
    norm = lambda t: [w for w in (re.sub(r"^\W+|\W+$", "", x).lower() for x in words(t)) if w]
    grams = lambda w: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    bench = {i: grams(norm(t)) for i, t in items}
    return {(d, i) for d, t in docs for own in [grams(norm(t))] for i, g in bench.items() if g and len(g & own) >= share * len(g)}


def url_rule(url):
    rest = (url or "").split("://", 1)[1] if "://" in (url or "") else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(h + p, v) for v, h, p in (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")) if (host == h or host.endswith("." + h)) and path.startswith(p)]
    rule, verdict = max(fits, key=lambda f: len(f[0]), default=(None, "allow"))
    return host, path, rule, verdict


def association_rules(baskets, bad, least, confidence):
    """Token sets that occur in at least `least` bad baskets, of which at least `confidence` are bad."""
    both, alone = Counter(), Counter()
    from itertools import combinations

    for b, x in zip(baskets, bad):
        for n in range(1, len(b) + 1):
            for c in combinations(sorted(b), n):
                alone[c] += 1
                both[c] += x
    return [frozenset(c) for c, n in both.items() if n >= least and n >= confidence * alone[c]]


def round_robin(totals, weights, window, quantum):
    """Tokens of each queue in each window, serving the queue that is due first one quantum at a time."""
    total = sum(weights.get(q, 0) for q in totals)
    share = {q: (weights.get(q, 0) or max(1e-9, total * 1e-6)) / total for q in totals}
    served, left, windows, places = Counter(), dict(totals), [], window // quantum
    while left:
        if not windows or places == 0:
            windows.append(Counter())
            places = window // quantum
        q = min(left, key=lambda q: ((served[q] + 0.5) / share[q], q))
        take = min(quantum, left[q])
        windows[-1][q] += take
        served[q] += 1
        places -= 1
        left[q] -= take
        if not left[q]:
            del left[q]
    return windows


def templates(docs, items, share=0.8):
    """(doc, item) by typed placeholders, windows of five and one-to-one slots, for texts of five tokens or more without punctuation
    whose first word is small."""
    kind = lambda w, before: "#" if w[0].isdigit() else "unit" if w == "km" and before[:1].isdigit() else "name" if w[0].isupper() else None

    def windows(text):
        w = text.split()
        t = [(kind(x, w[i - 1] if i else "") or x.lower(), x.lower() if kind(x, w[i - 1] if i else "") else None) for i, x in enumerate(w)]
        return [(tuple(c for c, _ in t[i : i + 5]), [v for _, v in t[i : i + 5]]) for i in range(len(t) - 4)]

    one_to_one = lambda m: len({a for a, _ in m}) == len(m) == len({b for _, b in m})
    strong = lambda w: sum(v is None for v in w[1]) >= 2
    out = set()
    seen = [(d, windows(t)) for d, t in docs]
    for item, text in items:
        every = windows(text)
        poor = 2 * sum(map(strong, every)) < len(every)
        need = [(i, w) for i, w in enumerate(every) if poor or strong(w)]
        for d, have in seen:
            lines = defaultdict(lambda: ([], set()))
            for p, h in enumerate(have):
                for i, w in need:
                    if h[0] == w[0] and (strong(w) or h[1] == w[1]):
                        lines[p - i][0].append(i)
                        lines[p - i][1].update((x, y) for x, y in zip(w[1], h[1]) if x)
            held, slots = set(), set()
            for at, own in sorted((x for x in lines.values() if one_to_one(x[1])), key=lambda x: (len(x[0]), x[0]), reverse=True):
                if one_to_one(slots | own):
                    held, slots = held | set(at), slots | own
            if need and len(held) >= share * len(need):
                out.add((d, item))
    return out


MASK = (1 << 64) - 1
BASE = 0x9E3779B97F4A7C15


def token_ids(texts):
    """Ids of whole texts by the tokenizer itself, each closed by id 0."""
    import public_tokenizers
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [[*whole.encode(t or "", add_special_tokens=False).ids, 0] for t in texts]


def mix(x):
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & MASK
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & MASK
    return x ^ x >> 31


def word_hash(raw):
    powers = [pow(0x9E3779B97F4A7C15, i + 1, 2**64) for i in range(64)]
    sums = [sum((c + 1) * p for c, p in zip(raw[k : k + 64], powers)) % 2**64 for k in range(0, len(raw), 64)]
    if len(raw) > 64:
        sums = [mix(x ^ mix((k + 0x9E3779B97F4A7C15) % 2**64)) for k, x in enumerate(sums)]
    return mix((sum(sums) + len(raw)) % 2**64)


def hashed_grams(text, buckets=1 << 16):
    """Distinct buckets of a text's words, word pairs and pairs of word shapes."""
    out, before, shape_before, word_before = set(), None, None, None
    for raw in (w.encode() for w in words(text)):
        h = word_hash(re.sub(rb"[A-Z]", lambda m: m[0].lower(), raw))
        up, digit, alpha = (sum(bool(re.match(p, raw[i : i + 1])) for i in range(len(raw))) for p in (rb"[A-Z]", rb"[0-9]", rb"[A-Za-z\x80-\xff]"))
        tail = 0 if re.match(rb"[A-Za-z0-9\x80-\xff]", raw[-1:]) else raw[-1]
        doubled = tail > 0 and len(raw) > 1 and raw[-2] == raw[-1] or tail > 0 and len(raw) == 1
        shape = mix(tail * 128 + doubled * 64 + min(up, 2) * 16 + (digit > 0) * 8 + (up >= alpha) * 4 + (alpha == 0) * 2 + (h == word_before) + 32768 * (len(raw) > 24) + 77)
        for kind, g in enumerate((h, mix((1 if before is None else before) * 3 + h & MASK), mix((1 if shape_before is None else shape_before) * 3 + shape & MASK))):
            out.add(kind * buckets + g % buckets)
        before = word_before = h
        shape_before = shape
    return out


def importance_weights(grams, good, prior, dead, sigmas, unit=4096):
    import math

    raw, target = Counter(g for x in grams for g in x), Counter(g for x, ok in zip(grams, good) if ok for g in x)
    share = sum(good) / len(good)

    def ratio(g):
        t, e = target[g], raw[g] * share
        r = math.log((t + prior) / (e + prior))
        deviance = 2 * ((t * math.log(t / e) if t else 0) - (t - e))
        return round(r * unit) / unit if abs(r) >= dead and deviance > sigmas * sigmas else 0

    return [sum(ratio(g) for g in x) for x in grams]


def centroid_cosines(text, idf, centroids, dim):
    """Cosines of a text's TF-IDF vector of hashed n-grams of one to three bytes to each centroid."""
    import math

    raw = re.sub(rb"[^a-z\x80-\xff]+", b" ", re.sub(rb"[A-Z]", lambda m: m[0].lower(), text.encode()))
    counts = Counter()
    for n in (1, 2, 3):
        for i in range(len(raw) - n + 1):
            h = raw[i] + 1
            for b in raw[i + 1 : i + n]:
                h = (h * 257 + b + 1) % (1 << 32)
            counts[((h * 2654435761 + (n - 1) * 40503) % (1 << 32)) >> 20] += 1
    v = {k: math.log1p(c) * float(idf[k]) for k, c in counts.items()}
    norm = math.sqrt(sum(x * x for x in v.values())) or 1
    return [sum(x * float(c[k]) for k, x in v.items()) / norm for c in centroids]


def without_repeats(rows, width):
    """(n_bytes, n_removed, n_spans, kept) of each (id, text), ids distinct: bytes under a string of `width` that starts earlier too are removed."""
    first, out = {}, {}
    for i, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - width + 1):
            if first.setdefault(raw[s : s + width], (i, s)) != (i, s):
                gone[s : s + width] = b"\1" * width
        spans = sum(gone[k] and not (k and gone[k - 1]) for k in range(len(raw)))
        out[i] = (len(raw), sum(gone), spans, bytes(b for b, g in zip(raw, gone) if not g))
    return out


def merkle(rows, arity):
    """(doc_id, leaf, subroot, root, proof, folded_root, verified) of rows (doc_id, source, lang, n_chars, text)."""
    import hashlib
    import zlib

    H = lambda x: hashlib.sha256(x.encode()).hexdigest()

    def leaf(doc_id, source, lang, n_chars, text):
        return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))

    def tree(hs):
        levels = [hs]
        while len(levels[-1]) > 1:
            levels.append([H("".join(levels[-1][i : i + arity])) for i in range(0, len(levels[-1]), arity)])
        return levels

    def path(levels, i):
        out = []
        for level in levels[:-1]:
            a = i // arity * arity
            out.append(("".join(level[a:i]), "".join(level[i + 1 : a + arity])))
            i //= arity
        return out

    trees = {}
    for r in rows:
        trees.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf(*r), r))
    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    levels = {}
    for name in names:
        trees[name].sort(key=lambda x: x[:3])
        levels[name] = tree([x[2] for x in trees[name]])
    top = tree([levels[n][-1][0] for n in names])
    out = []
    for k, name in enumerate(names):
        for i, (_, _, h, r) in enumerate(trees[name]):
            steps = path(levels[name], i) + path(top, k)
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None
            x = leaf(*r[:3], r[3] + 1, r[4]) if hit else h
            for a, b in steps:
                x = H(a + x + b)
            out.append((r[0], h, levels[name][-1][0], top[-1][0], H("".join(a + b for a, b in steps)), x, x == top[-1][0]))
    return out


def divergence(rows, least=10, top=10):
    """(lang, source, part, item, value, rank) of rows (text, lang, source)."""
    import re
    from collections import Counter, defaultdict

    docs, counts = defaultdict(Counter), defaultdict(lambda: defaultdict(Counter))
    for text, lang, source in rows:
        terms = [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        docs[lang or ""].update(set(terms))
        counts[lang or ""][source or ""].update(terms)
    out = []
    for lang, by_source in counts.items():
        kept = [t for t, n in docs[lang].items() if n >= least]

        def shares(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 2) // (n + 2 * len(kept)) for t in kept}

        p = {s: shares(c) for s, c in by_source.items()}
        q = shares(sum(by_source.values(), Counter()))
        add = lambda a, b: (a - b) ** 2 // (a + b)
        for s in by_source:
            pairs = [(sum(add(p[s][t], p[o][t]) for t in kept), o) for o in by_source if o != s]
            terms = [(add(p[s][t], q[t]), t) for t in kept if by_source[s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                for k, (v, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]):
                    out.append((lang, s, part, item, v, k + 1))
    return out
