"""Plain single-machine versions of the operators' contracts, for small inputs."""

import hashlib
import math
import re
import zlib
from collections import defaultdict

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def shingles(text, k):
    w = SPACED.findall((text or "").translate(LOWER))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) or frozenset([tuple(w)])


def near_duplicates(rows, k, percent):
    """{doc_id: (n, component)} by comparing every pair that shares a shingle."""
    sets = {d: shingles(t, k) for d, t in rows}
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by_set = defaultdict(list)
    for d, s in sets.items():
        if s:
            by_set[s].append(d)
    for same in by_set.values():
        for d in same:
            a, b = sorted((root(d), root(same[0])))
            parent[b] = a
    reps = [(s, min(ds)) for s, ds in by_set.items()]
    holders = defaultdict(list)
    for i, (s, _) in enumerate(reps):
        for x in s:
            holders[x].append(i)
    for i, (s, d) in enumerate(reps):
        shared = defaultdict(int)
        for x in s:
            for j in holders[x]:
                if j < i:
                    shared[j] += 1
        for j, n in shared.items():
            if 100 * n >= percent * (len(s) + len(reps[j][0]) - n):
                a, b = sorted((root(d), root(reps[j][1])))
                parent[b] = a
    return {d: (len(s), root(d)) for d, s in sets.items()}


def decontaminated(docs, items, size=13):
    """[(doc_id, n_words, n_hit, n_items, sha, contaminated)]"""
    windows = defaultdict(set)
    for i, t in items:
        w = PLAIN.findall((t or "").translate(LOWER))
        if w and i is not None:
            k = min(size, len(w))
            for j in range(len(w) - k + 1):
                windows[tuple(w[j:j + k])].add(str(i))
    lengths = sorted({len(w) for w in windows})
    out = []
    for d, t in docs:
        w = PLAIN.findall((t or "").translate(LOWER))
        hit, got = [False] * len(w), set()
        for k in lengths:
            for j in range(len(w) - k + 1):
                if (x := tuple(w[j:j + k])) in windows:
                    hit[j:j + k] = [True] * k
                    got |= windows[x]
        n = sum(hit)
        out.append((d, len(w), n, len(got), sha(",".join(sorted(got))), n > 0 and 20 * n >= len(w)))
    return out


ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base_spans(text):
    text = text or ""
    spans = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 8]
    spans += [("access", m.start(), m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    spans += [("hex", m.start(), m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    order = ["assign", "access", "hex"]
    return sorted(spans, key=lambda s: (s[1], order.index(s[0])))


def joined(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def crc_fold(doc_id, parts):
    return zlib.crc32(str(doc_id).encode()) % parts


def auc(score, y):
    """Chance that a positive outranks a negative, ties half."""
    order = sorted(zip(score, y))
    rank, i, total = {}, 0, 0.0
    while i < len(order):
        j = i
        while j < len(order) and order[j][0] == order[i][0]:
            j += 1
        total += (i + 1 + j) / 2 * sum(v for _, v in order[i:j])
        i = j
    p = sum(y)
    n = len(y) - p
    return (total - p * (p + 1) / 2) / (p * n) if p and n else math.nan


def top_k(rows, k=20, wanted=lambda i: i % 20 == 0):
    """{(query row, rank): (vec_id, score)} over rows (vec_id, vector)."""
    whole = [(i, [math.floor(64 * x) for x in v]) for i, v in rows
             if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, (i, v) in enumerate(whole):
        if wanted(i):
            scores = sorted((-sum(a * b for a, b in zip(v, w)), j) for r, (j, w) in enumerate(whole) if r != q)
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scores[:k])]
    return sorted(out)


def conversations(rows):
    """{conv_id: (n_turns, turns_sha, loss_chars, loss_sha)} over rows (conv_id, turn, role, text)."""
    by = defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((t is not None, t or 0, r or "", x or ""))
    out = {}
    for c, turns in by.items():
        turns.sort()
        loss = "".join(x for _, _, r, x in turns if r == "assistant")
        out[c] = (len(turns), sha("".join(f"{r}\n{x}\n" for _, _, r, x in turns)), len(loss), sha(loss))
    return out


def sentences(text, anchor):
    """[(start, words)] of a text's sentences; anchor(word) ends one too."""
    found = list(SPACED.finditer(text or ""))
    out, now = [], []
    for i, m in enumerate(found):
        now.append(m)
        word = m[0]
        bare = word
        while len(bare) > 1 and bare[-1] in "\"')]":
            bare = bare[:-1]
        gap = text[m.end():found[i + 1].start()] if i + 1 < len(found) else "\n"
        if bare[-1] in ".!?" or "\n" in gap or "\r" in gap or anchor(word.translate(LOWER)):
            out.append((now[0].start(), tuple(x[0].translate(LOWER) for x in now)))
            now = []
    return out


def span_dedup(rows, anchor, run=2, least=16):
    """{doc_id: (n_sentences, n_removed, text left)}; rows: (doc_id, text) with distinct ids."""
    first, per = {}, {}
    for d, t in sorted(rows):
        s = sentences(t, anchor)
        spans = []
        for i in range(len(s)):
            j, n = i, 0
            while j < len(s) and (n < least or j - i < run):
                n += len(s[j][1])
                j += 1
            if n >= least and j - i >= run:
                key = sum((x[1] for x in s[i:j]), ())
                first.setdefault(key, (d, i))
                spans.append((i, j, key))
        per[d] = (s, spans)
    out = {}
    for d, t in rows:
        s, spans = per[d]
        gone = set()
        for i, j, key in spans:
            if first[key] != (d, i):
                gone |= set(range(i, j))
        left, last = [], 0
        text = t or ""
        for i in sorted(gone):
            end = s[i + 1][0] if i + 1 < len(s) else len(text)
            left.append(text[last:s[i][0]])
            last = end
        left.append(text[last:])
        out[d] = (len(s), len(gone), "".join(left) if t is not None else None)
    return out


def segments(scores):
    """All maximal-scoring segments by definition: the best segment (shortest, then leftmost), then either side of it."""
    best = None
    for i in range(len(scores)):
        total = 0.0
        for j in range(i, len(scores)):
            total += scores[j]
            if total > 1e-12 and (best is None or total > best[2] + 1e-9):
                best = (i, j + 1, total)
    if best is None:
        return []
    i, j, _ = best
    return segments(scores[:i]) + [best] + [(a + j, b + j, s) for a, b, s in segments(scores[j:])]


def shared_out(budget, children):
    """{name: grant} by rounds: who cannot use a share gives it to siblings; children: {name: (weight, capacity)}."""
    grant, left, open_ = {}, budget, {n: wc for n, wc in children.items() if wc[0] > 0}
    while open_:
        total = sum(w for w, _ in open_.values())
        full = [n for n, (w, c) in open_.items() if left > 0 and c * total <= left * w]
        if not full:
            for n, (w, _) in open_.items():
                grant[n] = max(left, 0) * w // total
            break
        spent = 0
        for n in full:
            grant[n] = open_.pop(n)[1]
            spent += grant[n]
        left -= spent
    return grant


def mixture(rows, weights, epochs, seed, budget):
    """{row number: (full_epochs, part_words)} of rows (doc_id, domain, lang, source, words); budget: words of all leaves -> words."""
    levels = ("domain", "lang", "source")
    leaf = defaultdict(int)
    for _, d, g, s, n in rows:
        if n:
            leaf[d, g, s] += n
    weight = lambda level, name: weights.get(levels[level], {}).get(name, 1)
    leaf = {k: v for k, v in leaf.items() if all(weight(i, k[i]) > 0 for i in range(3))}

    def down(level, prefix, grant):
        caps = defaultdict(int)
        for k, v in leaf.items():
            if k[:level] == prefix:
                caps[k[level]] += v * epochs
        got = shared_out(grant, {n: (weight(level, n), c) for n, c in caps.items()})
        if level == 2:
            return {(*prefix, n): g for n, g in got.items()}
        return {k: g for n, x in got.items() for k, g in down(level + 1, (*prefix, n), x).items()}

    cap = sum(v * epochs for v in leaf.values())
    grants = down(0, (), min(cap, budget(sum(leaf.values()))))
    out = {}
    for key, grant in grants.items():
        whole, rest = divmod(grant, leaf[key])
        mine = [(hashlib.md5(f"{seed}:{whole}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[4], i)
                for i, r in enumerate(rows) if r[1:4] == key and r[4]]
        at = 0
        for _, n, i in sorted(mine):
            out[i] = (whole, max(0, min(n, rest - at)))
            at += n
    return {i: v for i, v in out.items() if v[0] or v[1]}
