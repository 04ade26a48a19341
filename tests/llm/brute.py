"""Plain versions of the operators, one row at a time, for small tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import xxhash

from tessera.llm import lm_scoring as L
from tessera.llm.common import Rolling, byte_codes

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def substring(rows, width=50):
    least = {}
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - width + 1):
            key = tuple(w[k : k + width])
            least[key] = min(least.get(key, i), i)
    out = []
    for i, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            if least[tuple(w[k : k + width])] < i:
                gone[k : k + width] = [True] * width
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def suffix(rows, width=400):
    seen = Counter()
    for _, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - width + 1):
            seen[hashlib.md5(b[k : k + width]).digest()] += 1
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - width + 1):
            if seen[hashlib.md5(b[k : k + width]).digest()] > 1:
                gone[k : k + width] = b"\1" * width
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def simhash(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[k : k + 3]), 42) for k in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def simhash_groups(rows, radius=2):
    fp = [(i, simhash(t)) for i, t in rows]
    root = list(range(len(fp)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(fp)):
        for b in range(a):
            if (fp[a][1] ^ fp[b][1]).bit_count() <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    least = defaultdict(lambda: 1 << 63)
    for k, (i, _) in enumerate(fp):
        least[find(k)] = min(least[find(k)], i)
    return [(i, f"{f:016x}", least[find(k)]) for k, (i, f) in enumerate(fp)]


def rules(text):
    text = text or ""
    w = words(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    at = defaultdict(list)
    for k in range(len(w) - 7):
        at[tuple(w[k : k + 8])].append(k)
    covered = {j for v in at.values() if len(v) > 1 for k in v for j in range(k, k + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def leaks(rows, items, texts=False, share=0.8, width=5):
    """As the docstring of decontamination says, one row at a time."""
    from tessera.llm.decontamination import TAILS, UNITS

    capital = lambda c: c.lower() != c
    digit = lambda c: "0" <= c < ":"

    def template(w):
        out = []
        for i, x in enumerate(w):
            first, second = x[0], x[1:2]
            if digit(first) or not ("A" <= first < "[" or "a" <= first < "{") and second and digit(second):
                out.append("<number>")
            elif out and out[-1] == "<number>" and x.lower() in {u + t for u in UNITS for t in TAILS} and not (capital(first) and not capital(second)):
                out.append("<unit>")
            elif capital(first) and not capital(second):
                out.append("<name>")
            else:
                out.append(x.lower())
        return out

    typed = {"<number>", "<name>", "<unit>"}
    bare = lambda x: re.sub(r"^[\W_]+|[^\w%]+$", "", x.lower())

    def windows(w, t, n):
        slots = lambda k: [(t[j], bare(w[j])) for j in range(k, k + n) if t[j] in typed]
        return [(tuple(t[k : k + n]), k, slots(k)) for k in range(len(t) - n + 1)]

    known = []
    for item, text in {(i, t) for i, t in items}:
        w = words(text)
        if not w:
            continue
        own = [x for x in windows(w, template(w), width) if sum(c not in typed for c in x[0]) >= 2]
        literal = not own
        if literal:
            own = windows(w, [x.lower() for x in w], min(len(w), width))
        known.append((item, literal, own))
    out = []
    for doc, text in set(rows):
        w = words(text)
        for item, literal, own in known:
            t = [x.lower() for x in w] if literal else template(w)
            runs = defaultdict(list)
            for x, k, slots in windows(w, t, len(own[0][0])):
                for y, at, theirs in own:
                    if x == y:
                        runs[k - at].append((x, [(a[0], a[1], b[1]) for a, b in zip(theirs, slots)] if not literal else []))
            united, assigned = set(), set()
            usable = []
            for shift, hits in runs.items():
                pairs = {p for _, s in hits for p in s}
                split = {p[:2] for p in pairs if len({q for q in pairs if q[:2] == p[:2]}) > 1}
                if any(kind != "<name>" for kind, _ in split):
                    continue
                hits = [(x, s) for x, s in hits if not split & {p[:2] for p in s}]
                if hits:
                    usable.append((-len({x for x, _ in hits}), shift, {x for x, _ in hits}, {p for _, s in hits for p in s}))
            for _, _, found, pairs in sorted(usable, key=lambda r: r[:2]):
                if all(p[:2] != q[:2] or p[2] == q[2] for p in pairs for q in assigned):
                    united, assigned = united | found, assigned | pairs
            n = len({x for x, _, _ in own})
            if len(united) >= share * n:
                out.append((doc, item, n, len(united), len(united) / n, all(a == b for _, a, b in assigned)) + ((text,) if texts else ()))
    return out


def base_scores(rows):
    toks = lambda t: words(re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [None]
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    count = Counter(x for i, t in rows if not held(i) for x in toks(t))
    from math import log10

    n, v = sum(count.values()), len(count)
    return [
        (i, held(i), len(toks(t)), sum(count[x] > 0 for x in toks(t)), n, sum(log10((count[x] + 0.5) / (n + 0.5 * (v + 1))) for x in toks(t)))
        for i, t in rows
    ]


def model_scores(rows, topic, table):
    """Each text's log10 probability, token by token; a class stands for the hash of its words' first bytes."""
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    texts = [(i, [w.encode() for w in words(low(t))]) for i, t in rows]
    count = Counter(w for i, t in texts if zlib.crc32(b"%d" % i) % 5 != 1 for w in t)
    code = lambda w: int(Rolling(byte_codes(np.frombuffer(w, np.uint8))).of(np.array([0]), np.array([len(w)]))[0])
    rank = {w: k for k, w in enumerate(sorted(count, key=lambda w: (-count[w], np.uint64(code(w)).view(np.int64)))[: L.N_WORDS])}
    shared = {}
    for w in count:
        if w not in rank:
            shared.setdefault(code(w[: L.PREFIX_BYTES]) % L.N_PREFIX, []).append(count[w])

    def cls(w, own_classes):
        return own_classes + L.N_PREFIX if w is None else rank[w] if rank.get(w, own_classes) < own_classes else own_classes + code(w[: L.PREFIX_BYTES]) % L.N_PREFIX

    for i, tokens in texts:
        score, seen = 0.0, []
        for w in [*tokens, None]:
            near = Counter(seen[-L.WIDE :])
            context = (max(near, key=lambda k: (near[k], -k)), seen[-1]) if seen else (L.TOPICS, L.TOPICS)
            score += table[context[0] * (L.TOPICS + 1) + context[1], cls(w, L.N_WORDS)] / np.log(10)
            if w is not None and w not in rank:
                own = shared.get(code(w[: L.PREFIX_BYTES]) % L.N_PREFIX, [])
                score += np.log10((count[w] + 0.5) / (sum(own) + 0.5 * (len(own) + 1)))
            seen.append(int(topic[cls(w, L.COARSE_WORDS)]))
        yield i, score
