"""Plain versions of the operators' contracts, for small inputs."""

import hashlib
import math
import re
from collections import Counter

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def spaced(text, lower=False):
    data = (text or "").encode()
    return (data.lower() if lower else data).split()


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def union(links, ids):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def shingle_components(docs, percent=80):
    sets = {}
    for i, t in docs:
        w = spaced(t, True)
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    ids = [i for i in sets if i is not None]
    links = []
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                links.append((a, b))
    return {i: len(s) for i, s in sets.items()}, union(links, ids)


def removed_words(docs, window=50):
    first = {}
    for i, t in docs:
        w = spaced(t)
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            first[key] = min(i, first.get(key, i))
    out = {}
    for i, t in docs:
        w = spaced(t)
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                gone.update(range(k, k + window))
        out[i] = (len(w), len(gone), sha(b" ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


def contamination(docs, items, window=13):
    grams = {}
    for i, t in items:
        w = words(t)
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            grams.setdefault(n, {}).setdefault(tuple(w[k : k + n]), set()).add(str(i))
    out = {}
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for n, table in grams.items():
            for k in range(len(w) - n + 1):
                if x := table.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    found |= x
        out[i] = (len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w))
    return out


def language_losses(docs, good):
    """(id, words, mean target loss, mean background loss) of each row, from bigram counts over every word."""
    models = []
    for part in ([t for i, t in docs if i in good], [t for _, t in docs]):
        single, pair, before = Counter(), Counter(), Counter()
        for t in part:
            w = words(t)
            single.update(w)
            pair.update(zip(["", *w], w, strict=False))
            before.update(["", *w][: len(w)])
        models.append((single, pair, before, sum(single.values())))
    kinds, out = len(models[1][0]) + 1, []
    for i, t in docs:
        w, losses = words(t), []
        for single, pair, before, total in models:
            loss = 0.0
            for v, x in zip(["", *w], w, strict=False):
                p = (single[x] + 0.5) / (total + 0.5 * kinds)
                loss -= math.log(0.7 * pair[v, x] / before[v] + 0.3 * p if before[v] else p)
            losses.append(loss / max(1, len(w)))
        out.append((i, len(w), *losses))
    return out


def base_spans(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub(r"\D", "", m.group())
        total = sum(v - 9 * (v > 9) for v in (int(c) * (1 + k % 2) for k, c in enumerate(reversed(d))))
        if 13 <= len(d) <= 19 and total % 10 == 0:
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub(r"\D", "", m.group())) <= 15]
