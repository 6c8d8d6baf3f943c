"""The same results the slow way, in plain Python."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import xxhash

UPPER = {i: i + 32 for i in range(65, 91)}
SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def crc(doc_id) -> int:
    return zlib.crc32(str(doc_id).encode())


class Sets:
    def __init__(self, items):
        self.up = {i: i for i in items}

    def find(self, x):
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def near_vectors(rows, cosine=0.93):
    """rows: (vec_id, embedding, label) with distinct ids."""
    ok = {}
    for i, v, label in rows:
        if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v):
            x = np.array(v, float)
            ok[i] = (label, x / np.linalg.norm(x))
    sets, links = Sets([r[0] for r in rows]), Counter()
    ids = list(ok)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            (la, x), (lb, y) = ok[i], ok[j]
            if la == lb and len(x) == len(y) and float(x @ y) >= cosine:
                links[i] += 1
                links[j] += 1
                sets.join(i, j)
    return {(i, links[i], sets.find(i), sets.find(i) == i) for i, _, _ in rows}


def license_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))


def base_licenses(text):
    w = license_words(text)
    found = []
    for phrase, label in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")):
        p = phrase.split()
        found += [(i, label) for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
    starts = [i for i, _ in found]
    return len(w), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in found}))


def base_scores(rows):
    """rows: (doc_id, text) -> per row (held_out, n_tokens, n_known, N, base_score)."""
    tokens = [SPACE.findall((t or "").translate(UPPER)) + [None] for _, t in rows]
    held = [i is not None and crc(i) % 5 == 1 for i, _ in rows]
    c = Counter(w for ws, h in zip(tokens, held) if not h for w in ws)
    n, v = sum(c.values()), len(c)
    unit = n + 0.5 * (v + 1)
    return [(h, len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 0.5) / unit) for w in ws)) for ws, h in zip(tokens, held)]


def cut_repeats(rows, size=20):
    """rows: (doc_id, text) with distinct ids -> doc_id: (n_words, n_removed, kept text)."""
    docs = sorted(((i, SPACE.findall(t or "")) for i, t in rows), key=lambda d: (d[0] is not None, d[0]))
    seen, out = set(), {}
    for i, w in docs:
        gone = [False] * len(w)
        for s in range(len(w) - size + 1):
            window = tuple(w[s : s + size])
            if window in seen:
                gone[s : s + size] = [True] * size
            seen.add(window)
        out[i] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g))
    return out


def targets(sizes, cap=3):
    """source -> total size; the contract's targets by repeated sharing."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    fixed, open_, total = {}, set(order), float(sum(sizes.values()))
    while open_:
        left, w = total - sum(fixed.values()), sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / w > cap * sizes[s]]
        if not over:
            return fixed | {s: left * weight[s] / w for s in open_}
        fixed |= {s: float(cap * sizes[s]) for s in over}
        open_ -= set(over)
    return fixed


def sainte_lague(weights, seats):
    got = dict.fromkeys(weights, 0)
    for _ in range(seats):
        best = max(weights, key=lambda k: (weights[k] / (2 * got[k] + 1), [-ord(x) for x in str(k)]))
        got[best] += 1
    return got


def fingerprint(text):
    w = SPACE.findall((text or "").translate(UPPER))
    if not w:
        return 0
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(prints, radius=3):
    """doc_id -> fingerprint; doc_id -> smallest reachable id."""
    sets, ids = Sets(prints), list(prints)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            if bin(prints[i] ^ prints[j]).count("1") <= radius:
                sets.join(i, j)
    return {i: sets.find(i) for i in ids}


def edited(rows):
    """rows: (doc_id, text) with distinct ids -> doc_id: (text, edited text, next text)."""
    docs = sorted(((i, t or "") for i, t in rows), key=lambda d: (d[0] is not None, d[0]))
    out = {}
    for n, (i, t) in enumerate(docs):
        k, after = len(t) // 4, docs[(n + 1) % len(docs)][1]
        out[i] = (t, t[: len(t) - k] + after[:k], after)
    return out


def shingles(text, size=5):
    w = SPACE.findall((text or "").translate(UPPER))
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} or ({tuple(w)} if w else set())


def jaccard(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def _signed(n):
    return n - (1 << 64) if n >= 1 << 63 else n


def mixed(rows, goal, block, shard_docs, seed):
    """rows: (doc_id, source, size), distinct ids; goal: source -> target. Per id: (words, places of the words) of each time it is taken.

    The targets are given, because equal quotients of different sources differ in the last bit by how the targets were rounded.
    """

    def draw(i, purpose):
        return int(hashlib.md5(f"{seed}:{purpose}:{i}".encode()).hexdigest()[:12], 16)

    def order(shard, number):
        h = 42
        for v in (seed, shard, number):
            h = xxhash.xxh64(v.to_bytes(8, "little"), seed=h).intdigest()
        return _signed(h), number

    sizes = {}
    for _, source, size in rows:
        sizes[source] = sizes.get(source, 0) + size
    named = {i: s for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    quotas = sainte_lague({f"{i:06d}": goal[s] for i, s in named.items()}, math.floor(sum(goal.values()) / block + 0.5))
    out = {i: [] for i, _, _ in rows}
    for number, source in named.items():
        mine = [(i, size) for i, s, size in rows if s == source]
        n = -(-len(mine) // shard_docs)
        shards = {}
        for i, size in mine:
            shards.setdefault(draw(i, "shard") % n, []).append((i, size))
        shares = sainte_lague({f"{k:06d}": sum(z for _, z in v) for k, v in shards.items()}, quotas[f"{number:06d}"])
        for k, members in shards.items():
            members.sort(key=lambda m: (draw(m[0], "pick"), m[0]))
            stream = [(i, p) for i, size in members for p in range(size)]
            if not stream:
                continue
            times, rest = divmod(min(shares[f"{k:06d}"] * block, 3 * len(stream)), len(stream))
            picked = {}
            for b in sorted(range(-(-len(stream) // block)), key=lambda b: order(k, b)):
                # A block that stands in several documents gives its words in their order.
                for i, p in stream[b * block : (b + 1) * block][:rest]:
                    picked.setdefault(i, []).append(p)
                    rest -= 1
            for i, size in members:
                out[i] += [(size, list(range(size)))] * times + [(len(picked.get(i, [])), sorted(picked.get(i, [])))]
    return out
