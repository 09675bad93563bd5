"""Plain single-machine versions of the corpus operators, to hold their results against."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text.translate({c: c + 32 for c in range(65, 91)})) if text else []


def components(nodes, links):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def base_spans(text):
    out, text = [], text or ""
    assign = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
    out += [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    out.sort()
    joined = ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in out)
    n = Counter(k for _, k, _ in out)
    return n[0], n[1], n[2], hashlib.sha256(joined.encode()).hexdigest()


def token_rows(docs, path):
    from tokenizers import Tokenizer

    t, start, out = Tokenizer.from_file(path), 0, []
    for doc_id, text in sorted(docs, key=lambda r: r[0]):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def vector_rows(vectors, least=0.95):
    good = {i: np.array(v, float) for i, v in vectors if v is not None and len(v) and None not in v and np.isfinite(v).all() and np.linalg.norm(v) > 0}
    ids = sorted(good)
    x = np.stack([good[i] / np.linalg.norm(good[i]) for i in ids])
    near = x @ x.T >= least
    np.fill_diagonal(near, False)
    of = components(ids, [(ids[a], ids[b]) for a, b in zip(*np.nonzero(near), strict=True) if a < b])
    n = dict(zip(ids, near.sum(1).tolist(), strict=True))
    return sorted((i, n.get(i, 0), of.get(i, i), of.get(i, i) == i) for i, _ in vectors)


def chat_rows(turns):
    by = defaultdict(list)
    for conv, turn, role, text in turns:
        by[conv].append((turn, role or "", text or ""))
    out = []
    for conv, rows in by.items():
        rows.sort()
        loss = "".join(t for _, r, t in rows if r == "assistant")
        all_text = "".join(f"{r}\n{t}\n" for _, r, t in rows)
        out.append((conv, len(rows), hashlib.sha256(all_text.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()))
    return sorted(out)


def shingle_set(text, n):
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def similarity_rows(docs, n, percent):
    sets = {i: shingle_set(t, n) for i, t in docs}
    by = defaultdict(set)
    for i, s in sets.items():
        for g in s:
            by[g].add(i)
    shared = Counter()
    for ids in by.values():
        ids = sorted(ids)
        shared.update((a, b) for k, a in enumerate(ids) for b in ids[k + 1 :])
    links = [(a, b) for (a, b), c in shared.items() if 100 * c >= percent * (len(sets[a]) + len(sets[b]) - c)]
    of = components(sets, links)
    return sorted((i, len(sets[i]), of[i]) for i in sets)


def lm_rows(docs):
    """Interpolated modified Kneser-Ney trigrams, from dictionaries."""
    train = [words(t) + ["\n"] for i, t in docs if zlib.crc32(str(i).encode()) % 10]
    uni = Counter(w for t in train for w in t)
    tri = Counter(p for t in train for p in zip((["", ""] + t)[:-2], ([""] + t)[:-1], t, strict=True))
    bi = Counter((v, w) for _, v, w in tri)
    before = Counter(w for _, w in bi)

    def d(counts):
        n = [sum(c == k for c in counts) for k in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0
        raw = {k: k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] else 0 for k in (1, 2, 3)}
        return [0] + [x if 0 < x < k else k / 2 for k, x in raw.items()]

    def contexts(counts):
        total, followers = Counter(), defaultdict(Counter)
        for key, c in counts.items():
            total[key[:-1]] += c
            followers[key[:-1]][min(c, 3)] += 1
        return total, followers

    d1, N, V = d(list(before.values())), sum(uni.values()), len(uni)
    left = sum(d1[min(c, 3)] for c in before.values()) / len(bi)
    levels = [(x, *contexts(x), d(list(x.values()))) for x in (bi, tri)]

    def p(u, v, w):
        out = max(before[w] - d1[min(before[w], 3)], 0) / len(bi) + left / (V + 1)
        for (counts, total, followers, disc), key in zip(levels, ((v, w), (u, v, w)), strict=True):
            t = total[key[:-1]]
            if t:
                c = counts[key]
                out = max(c - disc[min(c, 3)], 0) / t + sum(disc[k] * followers[key[:-1]][k] for k in (1, 2, 3)) / t * out
        return out

    out = []
    for i, t in docs:
        w = words(t) + ["\n"]
        base = sum(math.log10((uni[x] + 0.1) / (N + 0.1 * (V + 1))) for x in w)
        score = sum(math.log10(p(*x)) for x in zip((["", ""] + w)[:-2], ([""] + w)[:-1], w, strict=True))
        out.append((i, zlib.crc32(str(i).encode()) % 10 == 0, len(w), sum(uni[x] > 0 for x in w), N, base, score))
    return sorted(out)


def alnum_words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", text.translate({c: c + 32 for c in range(65, 91)})) if text else []


def windows(items, width=13):
    """Windows of the benchmark's items, a shorter item being one."""
    found = [alnum_words(t) for t in items]
    return {tuple(w[k : k + width]) for w in found if w for k in range(max(1, len(w) - width + 1))}


def contaminated(text, found):
    w, hit = alnum_words(text), set()
    for n in {len(x) for x in found}:
        for k in range(len(w) - n + 1):
            if tuple(w[k : k + n]) in found:
                hit.update(range(k, k + n))
    return bool(hit) and 20 * len(hit) >= len(w)
