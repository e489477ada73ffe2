"""Plain versions of the operators, for small inputs."""

import re
from collections import Counter, defaultdict

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def words(text):
    return (text or "").encode().translate(LOWER).split()


def shingles(text, k):
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def components(texts, k, percent=80):
    """texts: id -> text; id -> least id reachable."""
    sets = {i: shingles(t, k) for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(texts)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def contained(docs, items, k=5, percent=80):
    """Pairs (doc, item) with their shared shingles."""
    d, q = {i: shingles(t, k) for i, t in docs.items()}, {i: shingles(t, k) for i, t in items.items()}
    return {(i, j): len(d[i] & q[j]) for i in d for j in q if q[j] and 100 * len(d[i] & q[j]) >= percent * len(q[j])}


def repeats(texts, window=200):
    """For each text's bytes: removed, spans, bytes that stay."""
    count = Counter(t[i : i + window] for t in texts for i in range(len(t) - window + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - window + 1):
            if count[t[i : i + window]] > 1:
                gone[i : i + window] = b"\1" * window
        spans = len(re.findall(b"\1+", bytes(gone)))
        out.append((sum(gone), spans, bytes(b for b, x in zip(t, gone, strict=True) if not x)))
    return out


def similar_lines(docs, percent=80):
    """docs: list of (key, text) in order; for each the places of lines that go."""
    seen, by_word, out = [], defaultdict(list), []
    for _, text in docs:
        gone = []
        for place, line in enumerate((text or "").split("\n")):
            s = set(re.findall(r"[^\x20\x09-\x0D]+", line.lower()))
            if s and any(100 * len(s & seen[j]) >= percent * len(s | seen[j]) for j in {j for w in s for j in by_word[w]}):
                gone.append(place)
            if s:
                for w in s:
                    by_word[w].append(len(seen))
                seen.append(s)
        out.append(gone)
    return out
