"""Plain forms of the operators, for small inputs."""

import hashlib
import math
import re
from collections import defaultdict

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
MARKED = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def dedup(docs, window=20):
    """(doc_id, n_words, n_removed, kept_sha256) of (doc_id, text) rows."""
    key = lambda d: -(1 << 63) if d is None else d
    least = {}
    words = [SPACED.findall(t or "") for _, t in docs]
    for (d, _), w in zip(docs, words):
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            least[k] = min(least.get(k, (math.inf, 0)), (key(d), i))
    out = []
    for (d, _), w in zip(docs, words):
        gone = set()
        for i in range(len(w) - window + 1):
            if least[tuple(w[i : i + window])] < (key(d), i):
                gone.update(range(i, i + window))
        out.append((d, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return out


def jaccard(docs, k=5, percent=80):
    """(doc_id, n_shingles, component_id) of (doc_id, text) rows."""
    sets = []
    for _, t in docs:
        w = SPACED.findall((t or "").translate(LOWER))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set()))
    ids = [d for d, _ in docs]
    root = {d: d for d in ids if d is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            holders[g].append(i)
    pairs = {(a, b) for h in holders.values() for x, a in enumerate(h) for b in h[x + 1 :]}
    for a, b in pairs:
        both = len(sets[a] & sets[b])
        if ids[a] is not None and ids[b] is not None and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((find(ids[a]), find(ids[b])))
            root[y] = x
    return [(d, len(s), None if d is None else find(d)) for d, s in zip(ids, sets)]


def decontaminate(docs, items, window=8):
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated)."""
    windows = defaultdict(set)
    for item, t in items:
        w = MARKED.findall((t or "").translate(LOWER))
        if w and item is not None:
            n = min(window, len(w))
            for i in range(len(w) - n + 1):
                windows[tuple(w[i : i + n])].add(str(item))
    sizes = {len(k) for k in windows}
    out = []
    for d, t in docs:
        w = MARKED.findall((t or "").translate(LOWER))
        hit, found = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if who := windows.get(tuple(w[i : i + n])):
                    hit.update(range(i, i + n))
                    found |= who
        out.append((d, len(w), len(hit), len(found), sha(",".join(sorted(found))), len(found) >= 2))
    return out


def neighbours(rows, top=10):
    """{query_id: [(vec_id, score)]} of (vec_id, vector) rows without bad vectors."""
    return {q: sorted((math.dist(v, x), i) for i, x in rows if i != q)[:top] for q, v in rows if q % 100 == 0}


def turns(rows, escape):
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) of (conv_id, turn, role, text) rows."""
    groups = defaultdict(list)
    for c, t, r, x in rows:
        groups[c].append((t is not None, t or 0, r or "", x or ""))
    marks = {"system": "[SYS]", "user": "[INST]", "assistant": "[/INST]"}
    out = []
    for c, g in groups.items():
        g.sort()
        loss = "".join(x for *_, r, x in g if r == "assistant")
        text = "".join("<s>" + marks.get(r, f"[ROLE]{escape(r)}[/ROLE]") + escape(x) + "</s>" for *_, r, x in g)
        out.append((c, len(g), sha("".join(f"{r}\n{x}\n" for *_, r, x in g)), len(loss), sha(loss), len(text)))
    return out
