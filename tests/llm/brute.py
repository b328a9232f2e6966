"""Plain-Python versions of the contracts, for small tables."""

import collections
import hashlib
import math
import re
import zlib


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def words(text):
    return (text or "").encode().split()


def secrets(text):
    text = text or ""
    assign = re.compile(
        r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    found = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [(["assign", "access", "hex"][k], a, b) for a, k, b in sorted(found)]


def repeated_removed(docs, size=50):
    """[(id, n_words, n_removed, kept)] of rows (id, text)."""
    least = {}
    for i, text in docs:
        w = words(text)
        for j in range(len(w) - size + 1):
            key = tuple(w[j:j + size])
            least[key] = min(least.get(key, i), i)
    out = []
    for i, text in docs:
        w = words(text)
        gone = set()
        for j in range(len(w) - size + 1):
            if least[tuple(w[j:j + size])] < i:
                gone.update(range(j, j + size))
        out.append((i, len(w), len(gone), b" ".join(x for j, x in enumerate(w) if j not in gone)))
    return out


def language_model(docs, mix, prior, order=2):
    """{id: (n_tokens, n_known, train_tokens, base, score)}."""
    tokens = {i: words(_lower(text)) + [None] for i, text in docs}
    grams, texts = collections.Counter(), 0
    for i, w in tokens.items():
        if zlib.crc32(str(i).encode()) % 10:
            w = [0] + w                                    # 0 is the start
            grams.update(tuple(w[t - n + 1:t + 1]) for n in range(1, order + 1) for t in range(max(1, n - 1), len(w)))
            texts += 1
    total, kinds = sum(c for g, c in grams.items() if len(g) == 1), sum(len(g) == 1 for g in grams)
    grams[0,] = texts

    def p(h, x):
        if not h:
            return (grams[x,] + 0.1) / (total + 0.1 * (kinds + 1))
        c = grams[h]
        share = mix * c / (c + prior)
        return (share * grams[h + (x,)] / c if c else 0) + (1 - share) * p(h[1:], x)

    out = {}
    for i, w in tokens.items():
        w = [0] + w
        score = sum(math.log10(p(tuple(w[max(0, t - order + 1):t]), w[t])) for t in range(1, len(w)))
        base = sum(math.log10(p((), x)) for x in w[1:])
        out[i] = (len(w) - 1, sum(grams[x,] > 0 for x in w[1:]), total, base, score)
    return out


def _lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def contamination(docs, items, size=10):
    """[(id, n_words, n_hit, ids)]."""
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = collections.defaultdict(set)
    for i, text in items:
        w = pattern.findall(_lower(text))
        k = min(size, len(w))
        for j in range(len(w) - k + 1 if k else 0):
            windows[tuple(w[j:j + k])].add(str(i))
    lengths = {len(k) for k in windows}
    out = []
    for i, text in docs:
        w = pattern.findall(_lower(text))
        hit, ids = set(), set()
        for k in lengths:
            for j in range(len(w) - k + 1):
                if found := windows.get(tuple(w[j:j + k])):
                    hit.update(range(j, j + k))
                    ids |= found
        out.append((i, len(w), len(hit), sorted(ids)))
    return out


def near_classes(docs, size=4, percent=85):
    """{id: (n_shingles, component)}."""
    sets = {}
    for i, text in docs:
        w = words(_lower(text))
        sets[i] = frozenset(tuple(w[j:j + size]) for j in range(max(1, len(w) - size + 1))) if w else frozenset()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def repeated_lines(docs, least=10, keep_first=False):
    """[(id, n_lines, n_dropped, kept)] of rows (id, text); ids differ."""
    blank = b" \t\n\r\x0b\x0c"
    split = {i: (text or "").encode().split(b"\n") for i, text in docs}
    having = collections.defaultdict(list)
    for i, rows in split.items():
        for k in {r.strip(blank).lower() for r in rows}:
            having[k].append(i)
    gone = {k: min(v) for k, v in having.items() if k and len(v) >= least}
    out = []
    for i, rows in split.items():
        kept, seen = [], set()
        for r in rows:
            k = r.strip(blank).lower()
            if k in gone and not (keep_first and gone[k] == i and k not in seen):
                seen.add(k)
                continue
            seen.add(k)
            kept.append(r)
        out.append((i, len(rows), len(rows) - len(kept), b"\n".join(kept)))
    return out


def source_divergence(docs, least=10, top=10):
    """[(lang, source, part, item, value, rank)] of rows (lang, source, text)."""
    pattern = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    groups, having = collections.defaultdict(collections.Counter), collections.Counter()
    for lang, source, text in docs:
        found = pattern.findall(_lower(text))
        groups[lang or "", source or ""].update(found)
        having.update((lang or "", t) for t in set(found))
    out = []
    for lang in {g for g, _ in groups}:
        kept = [t for (g, t), n in having.items() if g == lang and n >= least]
        counts = {s: {t: c[t] for t in kept} for (g, s), c in groups.items() if g == lang}

        def shares(c):
            n = sum(c.values()) + 2 * len(kept)
            return {t: 1 + 1_000_000_000 * (c[t] + 2) // n for t in kept}

        q = shares({t: sum(c[t] for c in counts.values()) for t in kept})
        p = {s: shares(c) for s, c in counts.items()}

        def f(a, b):
            return (a - b) ** 2 // (a + b)

        for s in counts:
            pairs = [(-sum(f(p[s][t], p[o][t]) for t in kept), o) for o in counts if o != s]
            terms = [(-f(p[s][t], q[t]), t) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, rows, limit in (("pair", pairs, len(pairs)), ("term", terms, top)):
                rows = sorted(rows, key=lambda r: (r[0], r[1].encode()))[:limit]
                out += [(lang, s, part, item, -v, k + 1) for k, (v, item) in enumerate(rows)]
    return out


def prefix_nodes(rows):
    """[(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256)] of rows (conv_id, turn, role, text)."""
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [r[2:] for r in sorted(v)] for c, v in own.items()}
    members, ends = collections.defaultdict(list), collections.defaultdict(list)
    for c, turns in sorted(own.items()):
        h = zlib.crc32(str(c).encode()) % 9
        turns = own.get(c - int(math.fmod(c, 5)), [])[:h] + turns[h:]
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    children = collections.defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[x] for x in children[node]) or 1
        own_bytes = (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
        saved[node] = own_bytes + sum(saved[x] for x in children[node])
    return [(min(m), len(node), min(members[node[:-1]]) if node else None, len(m), len(children[node]), leaves[node], saved[node],
             sha(",".join(map(str, sorted(ends[node]))).encode())) for node, m in members.items()]
