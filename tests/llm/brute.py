"""Plain versions of the training-text operators, for small inputs."""

import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SPACE = re.compile(r"[\x20\x09-\x0D]")


def words(text):
    return WORD.findall(text or "")


def shingle_set(text, k):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def near(docs, k, percent):
    """{id: (set size, smallest id reachable)} of [(id, text)] with distinct ids."""
    sets = {i: shingle_set(t, k) for i, t in docs}
    parent = {i: i for i in sets}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((top(a), top(b)))
                parent[y] = x
    return {i: (len(sets[i]), top(i)) for i in ids}


def suffix(docs, length=100):
    """{id: (bytes, removed, spans, hash of the rest)} of [(id, text)] with distinct ids."""
    seen, out = set(), {}
    for i, text in sorted(docs, key=lambda d: (d[0] is not None, d[0])):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for j in range(len(raw) - length + 1):
            w = raw[j : j + length]
            if w in seen:
                gone[j : j + length] = b"\1" * length
            seen.add(w)
        spans = sum(1 for j in range(len(raw)) if gone[j] and not (j and gone[j - 1]))
        rest = bytes(c for c, g in zip(raw, gone, strict=True) if not g)
        out[i] = (len(raw), sum(gone), spans, hashlib.sha256(rest).hexdigest())
    return out


def rules(text):
    w = words(text)
    three = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    hit = {i + k for i, t in enumerate(three) if three.count(t) > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(hit)


def exact(docs):
    """{id: (keep id, group size, hash)} of [(id, text)] with distinct ids."""
    groups = {}
    for i, t in docs:
        groups.setdefault(SPACE.sub("", t or ""), []).append((-len(t or ""), i))
    return {i: (min(g)[1], len(g), hashlib.sha256(n.encode()).hexdigest()) for n, g in groups.items() for _, i in g}


def merkle(rows, tampered):
    """[(leaf, subroot, root, hash of the siblings, folded root)] of rows (doc_id, source, lang, n_chars, text), in their order."""

    def h(*values):
        text = "".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values)
        return hashlib.sha256(text.encode()).hexdigest()

    def climb(nodes):
        """The root, and for each node the (before, after) up to it."""
        paths, above = [[] for _ in nodes], [[i] for i in range(len(nodes))]
        while len(nodes) > 1:
            runs = [range(i, min(i + 3, len(nodes))) for i in range(0, len(nodes), 3)]
            for run in runs:
                for k in run:
                    for i in above[k]:
                        paths[i].append(("".join(nodes[j] for j in run if j < k), "".join(nodes[j] for j in run if j > k)))
            above = [[i for k in run for i in above[k]] for run in runs]
            nodes = [hashlib.sha256("".join(nodes[k] for k in run).encode()).hexdigest() for run in runs]
        return nodes[0], paths

    leaves = [h(*r) for r in rows]
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    members = {s: sorted((i for i, r in enumerate(rows) if r[1] == s), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0, leaves[i])) for s in sources}
    trees = {s: climb([leaves[i] for i in members[s]]) for s in sources}
    root, over = climb([trees[s][0] for s in sources])
    out = [None] * len(rows)
    for k, s in enumerate(sources):
        for i, path in zip(members[s], trees[s][1], strict=True):
            path = path + over[k]
            node = h(*tampered(rows[i]))
            for before, after in path:
                node = hashlib.sha256((before + node + after).encode()).hexdigest()
            proof = hashlib.sha256("".join(b + a for b, a in path).encode()).hexdigest()
            out[i] = leaves[i], trees[s][0], root, proof, node
    return out


def phrases(docs, least, top):
    """[(lang, rank, phrase, a, l, r, n, score)] of [(lang, text)]."""
    f, n = {}, {}
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] = n.get(lang, 0) + len(w)
            for k in range(1, 6):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] = f.get((lang, tuple(w[i : i + k])), 0) + 1
    often = {p: c for p, c in f.items() if len(p[1]) > 1 and c >= least}
    inside = {}
    for (lang, w), c in often.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                inside[lang, w[i : i + k]] = max(inside.get((lang, w[i : i + k]), 0), c)
    rows = []
    for (lang, w), a in often.items():
        if inside.get((lang, w), 0) < a:
            cuts = [(1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            rows.append((lang, -score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    out = []
    for lang in n:
        for rank, (_, score, a, phrase, left, right) in enumerate(sorted(r for r in rows if r[0] == lang)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)
