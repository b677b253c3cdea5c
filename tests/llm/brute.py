"""Plain versions of the text operators, for comparison on small tables."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import xxhash


def ascii_lower(s):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), s)


def line_dedup(rows):
    """rows: (doc_id, text); ids are whole numbers, each once"""
    split = {d: (t or "").split("\n") for d, t in rows}
    key = lambda x: ascii_lower(re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", x))
    first = {}
    for d, lines in sorted(split.items()):
        for x in lines:
            first.setdefault(key(x), d)
    out = {}
    for d, lines in split.items():
        kept = [x for x in lines if len(key(x)) < 10 or first[key(x)] == d]
        out[d] = (len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


def quality_counts(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words"""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    count = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", ascii_lower(text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(fps, distance=4):
    """fps: {doc_id: fingerprint} -> {doc_id: smallest doc_id reachable}"""
    ids = sorted(fps)
    values = np.array([fps[d] for d in ids], np.uint64)
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(values[i + 1 :] ^ values[i]) <= distance):
            a, b = find(i), find(i + 1 + int(j))
            root[max(a, b)] = min(a, b)
    return {d: ids[find(i)] for i, d in enumerate(ids)}


def contamination(docs, items, window=10):
    """{doc_id: (n_words, n_hit, n_items, items_sha256, contaminated)}"""
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(t or ""))
    windows = {}
    for i, t in items:
        w = words(t)
        if w:
            k = min(window, len(w))
            for p in range(len(w) - k + 1):
                windows.setdefault(tuple(w[p : p + k]), set()).add(str(i))
    depths = sorted({len(w) for w in windows})
    out = {}
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for k in depths:
            for p in range(len(w) - k + 1):
                if x := windows.get(tuple(w[p : p + k])):
                    hit.update(range(p, p + k))
                    found |= x
        out[d] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    return out


def held_out(doc_id, folds, fold):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % folds == fold
