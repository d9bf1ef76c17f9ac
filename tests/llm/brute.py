"""Plain versions of the operators for small inputs."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np

UP = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
FOLD = str.maketrans(UP, UP.lower())
SPACE = r"[^\x20\x09-\x0D]+"


def crc(doc, mod):
    return zlib.crc32(str(doc).encode()) % mod


def exact(docs):
    by = collections.defaultdict(list)
    for d, t in docs:
        by[(t or "").translate(FOLD)].append(d)
    return {d: (max(ds), len(ds), d == max(ds), hashlib.sha256(t.encode()).hexdigest()) for t, ds in by.items() for d in ds}


def quality(t):
    t = t or ""
    w = re.findall(SPACE, t)
    seen = collections.defaultdict(list)
    for i in range(len(w) - 7):
        seen[tuple(w[i:i + 8])].append(i)
    hit = {j for v in seen.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
    lines = [x for x in t.split("\n") if re.search(SPACE, x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit),
            len(w) < 20 or 100 * len(hit) > 30 * len(w))


PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


def licenses(t):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(FOLD))
    at, names = [], set()
    for p, label in PHRASES.items():
        p = p.split()
        for i in range(len(w) - len(p) + 1):
            if w[i:i + len(p)] == p:
                at.append(i)
                names.add(label)
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(names))


def tokens(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return [e.ids + [1] for e in tk.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def id_crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def repeats(docs, size=200):
    """doc -> n_bytes, n_removed, n_spans, sha of the rest."""
    where = collections.Counter()
    raws = {d: (t or "").encode() for d, t in docs}
    for r in raws.values():
        where.update(r[i:i + size] for i in range(len(r) - size + 1))
    out = {}
    for d, r in raws.items():
        cut = bytearray(len(r))
        for i in range(len(r) - size + 1):
            if where[r[i:i + size]] > 1:
                cut[i:i + size] = b"\1" * size
        out[d] = (len(r), sum(cut), len(re.findall(b"\1+", bytes(cut))),
                  hashlib.sha256(bytes(c for c, x in zip(r, cut) if not x)).hexdigest())
    return out


def shingles(t, k=4):
    w = re.findall(SPACE, (t or "").translate(FOLD))
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def jaccard(docs, num=85, den=100, k=4):
    """doc -> set size, smallest doc linked."""
    sets = {d: shingles(t, k) for d, t in docs}
    holders = collections.defaultdict(list)
    for d, s in sets.items():
        for x in s:
            holders[x].append(d)
    up = {d: d for d in sets}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    common = collections.Counter((a, b) for v in holders.values() for i, a in enumerate(v) for b in v[i + 1:])
    for (a, b), n in common.items():
        if den * n >= num * (len(sets[a]) + len(sets[b]) - n):
            up[max(find(a), find(b))] = min(find(a), find(b))
    return {d: (len(sets[d]), find(d)) for d in sets}


def language(docs):
    """doc -> held_out, n_tokens, n_known, train_tokens, base_score."""
    toks = {d: [*re.findall(SPACE, (t or "").translate(FOLD)), None] for d, t in docs}
    c = collections.Counter(x for d, ts in toks.items() if crc(d, 10) for x in ts)
    n, v = sum(c.values()), len(c)
    return {d: (crc(d, 10) == 0, len(ts), sum(c[x] > 0 for x in ts), n,
                sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in ts)) for d, ts in toks.items()}


def simhash(docs, errors=2, words=3):
    """doc -> fingerprint, smallest doc reachable."""
    import xxhash

    fps = {}
    for d, t in docs:
        w = re.findall(SPACE, (t or "").translate(FOLD))
        n = min(words, len(w))
        hs = [xxhash.xxh64_intdigest(" ".join(w[i:i + n]).encode(), 42) for i in range(len(w) - n + 1)] if w else []
        fps[d] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))
    part = linked_numbers(sorted(set(fps.values())), errors)
    least = {}
    for d, f in fps.items():
        least[part[f]] = min(d, least.get(part[f], d))
    return {d: (f"{f:016x}", least[part[f]]) for d, f in fps.items()}


def linked_numbers(numbers, errors):
    """number -> a name of its component under differences of at most so many bits."""
    up = {f: f for f in numbers}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for i, a in enumerate(numbers):
        for b in numbers[i + 1:]:
            if (a ^ b).bit_count() <= errors:
                up[max(find(a), find(b))] = min(find(a), find(b))
    return {f: find(f) for f in numbers}


def resampling(docs, targets, buckets=10000, longest=2, share=(25, 100), least=20, seed=7):
    """doc -> n_features, weight, score, rank."""
    def of(t):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(FOLD))
        return len(w), [zlib.crc32(" ".join(w[i:i + n]).encode()) % buckets for n in range(1, longest + 1) for i in range(len(w) - n + 1)]

    held = {d: of(t) for d, t in docs}
    s = collections.Counter(b for _, f in held.values() for b in f)
    t = collections.Counter(b for x in targets for b in of(x)[1])
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in range(buckets)}
    out = {}
    for d, (n, f) in held.items():
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{d}".encode()).hexdigest()[:8], 16)
        out[d] = [len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + .5) / 4294967296))), None]
    fit = sorted((d for d in out if held[d][0] >= least), key=lambda d: (-out[d][2], d))
    for k, d in enumerate(fit[:share[0] * len(fit) // share[1]]):
        out[d][3] = k + 1
    return {d: tuple(v) for d, v in out.items()}


def manifest(rows, fan=3):
    """Rows of (doc_id, source, lang, n_chars, text) -> one of (doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) each."""
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    leaf = lambda r: digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r))

    def climb(nodes):
        """The last node, and each node's way up: (what stands left, what stands right) in its runs."""
        ways, at = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            for way, k in zip(ways, at):
                way.append(("".join(nodes[k - k % fan:k]), "".join(nodes[k + 1:k - k % fan + fan])))
            nodes, at = [digest("".join(nodes[k:k + fan])) for k in range(0, len(nodes), fan)], [k // fan for k in at]
        return nodes[0], ways

    by = collections.defaultdict(list)
    for r in rows:
        by[r[1]].append(r)
    sources = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    inner = {}
    for s in sources:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        inner[s] = climb([leaf(r) for r in by[s]])
    root, outer = climb([inner[s][0] for s in sources])
    out = []
    for s, way_up in zip(sources, outer):
        for r, way in zip(by[s], inner[s][1]):
            tampered = r if r[0] is None or crc(r[0], 2) or r[4] is None else (*r[:4], r[4].replace("\n", ""))
            node = leaf(tampered)
            for x, y in way + way_up:
                node = digest(x + node + y)
            out.append((r[0], leaf(r), inner[s][0], root, digest("".join(x + y for x, y in way + way_up)), node, node == root))
    return out
