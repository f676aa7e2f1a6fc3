"""Plain Python versions of the operators' contracts, for small inputs."""

import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BENCH_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode("utf-8", "surrogatepass")).hexdigest()


def shingles(text, size=5):
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1)))


def jaccard_components(rows):
    """{(doc_id, text): (n_shingles, component_id)} of (doc_id, text) rows, null ids apart."""
    sets = [(i, t, shingles(t)) for i, t in rows]
    root = {i: i for i, _ in rows if i is not None}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, (i, _, a) in enumerate(sets):
        for j, _, b in sets[:x]:
            if i is not None and j is not None and a and b and 100 * len(a & b) >= 75 * len(a | b):
                one, two = find(i), find(j)
                root[max(one, two)] = min(one, two)
    return {(i, t): (len(s), None if i is None else find(i)) for i, t, s in sets}


def repeated_bytes(texts, length):
    """For each text: (what is left, bytes removed, maximal runs)."""
    bodies = [(t or "").encode() for t in texts]
    seen = {}
    for b in bodies:
        for at in range(len(b) - length + 1):
            w = b[at : at + length]
            seen[w] = seen.get(w, 0) + 1
    out = []
    for b in bodies:
        gone = [False] * len(b)
        for at in range(len(b) - length + 1):
            if seen[b[at : at + length]] > 1:
                gone[at : at + length] = [True] * length
        runs = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((bytes(c for c, g in zip(b, gone, strict=True) if not g), sum(gone), runs))
    return out


def key_of(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(LOWER)


def dedup_lines(rows, min_chars=20, min_docs=3):
    """[(doc_id, text left, lines, lines dropped)] in the order of the rows; ids are not null."""
    holders = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(k := key_of(line)) >= min_chars:
                holders.setdefault(k, set()).add(i)
    gone = {k: max(h) for k, h in holders.items() if len(h) >= min_docs}
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if gone.get(key_of(x), i) == i]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def decontamination(docs, items, size=10):
    """[(doc_id, n_words, n_hit, item ids)] in the order of the rows."""
    windows = {}
    for item, text in items:
        words = tuple(BENCH_WORD.findall((text or "").translate(LOWER)))
        for s in range(max(1, len(words) - size + 1) if words else 0):
            windows.setdefault(words[s : s + size], set()).add(str(item))
    lengths = {len(w) for w in windows}
    out = []
    for i, text in docs:
        words = tuple(BENCH_WORD.findall((text or "").translate(LOWER)))
        hit, found = set(), set()
        for n in lengths:
            for s in range(len(words) - n + 1):
                if got := windows.get(words[s : s + n]):
                    hit.update(range(s, s + n))
                    found |= got
        out.append((i, len(words), len(hit), sorted(found)))
    return out
