"""Plain versions of what the operators compute."""

import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0d]+")


def base(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    seen = Counter(windows)
    cover = {j for k, w in enumerate(windows) if seen[w] > 1 for j in range(k, k + 5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(cover)


def line_verdicts(rows, line_docs, line_share, left_share=0.1):
    """(words left, kept, text without frequent lines) of each (text, host)."""
    normal = lambda line: re.sub("[0-9]", "0", " ".join(WORD.findall(line.lower())))
    texts, holds = {}, {}
    for text, host in rows:
        texts.setdefault(host, set()).add(text)
        for line in (text or "").split("\n"):
            if normal(line):
                holds.setdefault((host, normal(line)), set()).add(text)
    often = {k for k, v in holds.items() if len(v) > line_docs and len(v) > line_share * len(texts[k[0]])}
    out = []
    for text, host in rows:
        lines = (text or "").split("\n")
        rest = [x for x in lines if (host, normal(x)) not in often]
        n, left = (len(WORD.findall("\n".join(x))) for x in (lines, rest))
        failed = n < 10 or 100 * base(text)[4] > 20 * n
        out.append((left, not failed and left >= left_share * n, "\n".join(rest)))
    return out


def shingles(text, width):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[k : k + width]) for k in range(len(words) - width + 1)} or ({tuple(words)} if words else set())


def components(texts, width, percent=80):
    """{id: (set size, component)} of {id: text}."""
    sets = {k: shingles(t, width) for k, t in texts.items()}
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
                both = len(x & y)
                if 100 * both >= percent * (len(x) + len(y) - both):
                    p, q = sorted((find(a), find(b)))
                    root[q] = p
    return {k: (len(sets[k]), find(k)) for k in ids}


def covered(texts, length):
    """{id: a flag for each byte that goes} of {id: text}."""
    seen, out = set(), {}
    for k in sorted(texts):
        raw = (texts[k] or "").encode()
        flags = bytearray(len(raw))
        for a in range(len(raw) - length + 1):
            s = raw[a : a + length]
            if s in seen:
                flags[a : a + length] = b"\1" * length
            seen.add(s)
        out[k] = flags
    return out


def runs(flags):
    return [m.span() for m in re.finditer(b"\1+", bytes(flags))]


def best_fit(pieces, capacity, per_source):
    """Bin of each (size, source, cluster): the tightest that has room and no conflict."""
    room, members, out = [], [], []
    for size, source, cluster in pieces:
        good = [(room[b], b) for b in range(len(room)) if room[b] >= size and sum(s == source for s, _ in members[b]) < per_source and (cluster is None or all(c != cluster for _, c in members[b]))]
        if good:
            b = min(good)[1]
        else:
            b = len(room)
            room.append(capacity)
            members.append([])
        room[b] -= size
        members[b].append((source, cluster))
        out.append(b)
    return out


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]
