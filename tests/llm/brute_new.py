"""Plain versions of sharding, periodic runs and the divergence audit."""

import collections
import hashlib
import itertools
import re
import zlib

from tests.llm.brute import LOWER, WORDS, sha


def jump(key: int, shards: int) -> int:
    b, j = -1, 0
    while j < shards:
        b, key = j, (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * (float(1 << 31) / ((key >> 33) + 1)))
    return b


def placements(rows, shards):
    """Rows (doc_id, size, checksum, shard, slot, shard among one more)."""
    out = []
    for doc, text in rows:
        key, raw = "" if doc is None else str(doc), (text or "").encode()
        k = int(hashlib.md5(key.encode()).hexdigest()[:16], 16)
        mark = hashlib.md5(f"{key}:{zlib.crc32(raw)}:{len(raw) + 1}".encode()).hexdigest()[:16]
        out.append((jump(k, shards), mark, key, (doc, len(raw) + 1, zlib.crc32(raw)), jump(k, shards + 1)))
    n = itertools.count
    slots = collections.defaultdict(n)
    return [(*row, shard, next(slots[shard]), grown) for shard, _, _, row, grown in sorted(out, key=lambda x: x[:3])]


def runs(w, least=12):
    """Runs (start, length, period) by stretches of equal words q apart."""
    best, n = {}, len(w)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            if i - s + q >= max(least, 2 * q):
                best.setdefault((s, i - s + q), q)
            i += 1
    return sorted((s, length, q) for (s, length), q in best.items())


def run_digest(doc, text):
    w = WORDS(text or "")
    h = zlib.crc32(str(doc).encode())
    g, n = h // 10, len(w)
    if doc is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = runs(w)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    best = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=(None,) * 3)
    milli = None if best[0] is None else 1000 * best[1] // best[2]
    return (doc, len(found), *best, milli, sha("".join("%d,%d,%d\n" % r for r in found)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def divergence(rows, least_docs=10, top=10):
    """rows of (lang, source, text)."""
    find = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+").findall
    count, held, groups = collections.Counter(), collections.Counter(), collections.defaultdict(set)
    for lang, source, text in ((a or "", b or "", c or "") for a, b, c in rows):
        words = find(text.translate(LOWER))
        groups[lang].add(source)
        count.update((lang, source, t) for t in words)
        held.update((lang, t) for t in set(words))
    out = []
    for lang, sources in groups.items():
        kept = [t for (x, t), n in held.items() if x == lang and n >= least_docs]
        v = len(kept)

        def share(c, v=v, kept=kept):
            n = sum(c(t) for t in kept)
            return {t: 1 + 10**9 * (c(t) + 2) // (n + 2 * v) for t in kept}

        f = lambda p, q: (p - q) ** 2 // (p + q)
        p = {s: share(lambda t, s=s: count[lang, s, t]) for s in sources}
        q = share(lambda t: sum(count[lang, s, t] for s in sources))
        for s in sources:
            pair = sorted((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in sources if o != s)
            term = sorted((-f(p[s][t], q[t]), t.encode()) for t in kept if count[lang, s, t] and p[s][t] > q[t])[:top]
            for part, found in (("pair", pair), ("term", term)):
                out += [(lang, s, part, item.decode(), -x, k) for k, (x, item) in enumerate(found, 1)]
    return out
