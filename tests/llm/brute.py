"""Plain versions of the operators, for small tables."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import xxhash

WORDS = re.compile(r"[^\x20\x09-\x0D]+").findall
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WHITE = " \t\n\v\f\r"
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)


def sha(x):
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


def quality(text):
    w = WORDS(text or "")
    lines, seen, dup = (text or "").split("\n"), set(), 0
    for x in lines:
        if WORDS(x):
            dup += x in seen
            seen.add(x)
    win = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n = collections.Counter(win)
    hit = {i + k for i, x in enumerate(win) if n[x] > 1 for k in range(5)}
    out = len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(hit)
    return *out, len(w) < 10 or 100 * len(hit) > 20 * len(w)


def ratios(texts, buckets, smooth, threshold):
    """(log ratio a word, kept) of each text by counts of hashed words and pairs."""
    h = lambda x, seed=42: xxhash.xxh64_intdigest(x.encode(), seed)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    grams, n, g = [], [collections.Counter(), collections.Counter()], [collections.Counter(), collections.Counter()]
    for t in texts:
        w = WORDS(t or "")
        own = [signed(h(x)) % buckets for x in w], [signed(h(b, h(a))) % buckets for a, b in zip(w, w[1:])]
        lines = [x for x in (t or "").split("\n") if WORDS(x)]
        good = len(w) >= 30 and 1000 * sum(c in "#*$%&|<>" for c in t or "") <= len(t or "") and len(lines) == len(set(lines))
        for k in range(2):
            n[k].update(own[k])
            g[k].update(own[k] if good else ())
        grams.append(own)
    total = lambda c: sum(c.values()) + smooth * buckets
    out = []
    for t, own in zip(texts, grams, strict=True):
        s = sum(math.log((g[k][b] + smooth) / total(g[k])) - math.log((n[k][b] + smooth) / total(n[k])) for k in range(2) if g[k] for b in own[k])
        llr = round(s / len(own[0]), 6) if own[0] else 0.0
        out.append((llr, not quality(t)[5] and llr >= threshold))
    return out


def base_spans(text):
    t = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    return sorted(found + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24])


def secrets(text):
    s = base_spans(text)
    return *(sum(k == i for _, k, _ in s) for i in range(3)), sha(",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in s))


#: The further kinds of secrets: their expression and least length.
MORE = (
    (r"gh[pousr]_[A-Za-z0-9]+", 40), (r"xox[abprs]-[A-Za-z0-9-]+", 15), (r"AIza[A-Za-z0-9_-]+", 39), (r"[rs]k_live_[A-Za-z0-9]+", 24),
    (r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 40), (r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 1),
)


def spans(text):
    """All spans (start, kind, end), kinds numbered as the rules are."""
    found = base_spans(text)
    for k, (regex, least) in enumerate(MORE, 3):
        found += [(m.start(), k, m.end()) for m in re.finditer(regex, text or "") if len(m[0]) >= least]
    return sorted(found)


def redacted(text):
    """Each run of overlapping spans is one mark."""
    out, at = [], 0
    for s, _, e in spans(text):
        if s >= at:
            out += [text[at:s], "[SECRET]"]
        at = max(at, e)
    return "".join(out) + text[at:] if out else text


def key(line):
    return line.strip(WHITE).translate(LOWER)


def line_dedup(rows):
    by = collections.defaultdict(lambda: [0, -math.inf])
    ident = lambda d: -math.inf if d is None else d
    for doc, text in rows:
        for k in {key(x) for x in (text or "").split("\n")}:
            if len(k) >= 20:
                by[k] = [by[k][0] + 1, max(by[k][1], ident(doc))]
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not (len(key(x)) >= 20 and by[key(x)][0] >= 3 and by[key(x)][1] != ident(doc))]
        out.append((doc, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def fingerprint(text):
    w = WORDS((text or "").translate(LOWER))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def simhash(rows):
    fps = [fingerprint(t) for _, t in rows]
    parent = {f: f for f in fps}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    u = np.array(sorted(set(fps)), np.uint64)
    for a in u:
        for b in u[np.bitwise_count(u ^ a) <= 3]:
            parent[find(int(a))] = find(int(b))
    least = {}
    for (doc, _), f in zip(rows, fps, strict=True):
        if doc is not None:
            least[find(f)] = min(least.get(find(f), doc), doc)
    return [(doc, f"{f:016x}", least.get(find(f))) for (doc, _), f in zip(rows, fps, strict=True)]


def long_repeats(rows):
    """rows are distinct; in order of doc_id, then of the text's hash."""
    seen, out = set(), []
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    for doc, text in sorted(rows, key=lambda r: (-1 if r[0] is None else r[0], signed(xxhash.xxh64_intdigest((r[1] or "").encode(), 42)))):
        b = (text or "").encode()
        gone, end = bytearray(len(b)), 0
        for i in range(len(b) - 99):
            if b[i : i + 100] in seen:
                for j in range(max(i, end), i + 100):
                    gone[j] = 1
                end = i + 100
            else:
                seen.add(b[i : i + 100])
        out.append((doc, len(b), sum(gone), sum(gone[i] and not (i and gone[i - 1]) for i in range(len(b))), sha(bytes(c for c, g in zip(b, gone, strict=True) if not g))))
    return out


def unigram(rows):
    """(doc_id, held_out, n_tokens, n_known, N, base score)."""
    words = [[*WORDS((t or "").translate(LOWER)), 0] for _, t in rows]
    held = [d is not None and zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in rows]
    c = collections.Counter(w for x, h in zip(words, held, strict=True) if not h for w in x)
    n = sum(c.values())
    low = math.log10(n + len(c) + 1)
    return [(d, h, len(x), sum(c[w] > 0 for w in x), n, round(sum(math.log10(c[w] + 1) - low for w in x), 6)) for (d, _), x, h in zip(rows, words, held, strict=True)]
