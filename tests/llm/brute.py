"""Plain versions of the corpus operators, on lists of rows (dicts)."""

import base64
import hashlib
import re
import zlib
from collections import Counter, defaultdict

WHITE = b" \t\n\r\x0b\x0c"


def crc(data: bytes) -> int:
    return zlib.crc32(data)


def shingles(text, k, lower=True):
    data = (text or "").encode()
    words = re.findall(rb"[^\x20\x09-\x0D]+", data.lower())
    if not words:
        return frozenset()
    if len(words) < k:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1))


def near(rows, k, num=80, den=100):
    """{row index: (n_shingles, component)}; an inverted index finds pairs that share anything."""
    sets = [shingles(r["text"], k) for r in rows]
    classes = defaultdict(list)
    for i, s in enumerate(sets):
        classes[s].append(i)
    keys = list(classes)
    where = defaultdict(list)
    for c, s in enumerate(keys):
        for x in s:
            where[x].append(c)
    shared = Counter((a, b) for cs in where.values() for i, a in enumerate(cs) for b in cs[i + 1 :])
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    def join(a, b):
        parent[max(find(a), find(b))] = min(find(a), find(b))

    for s, own in classes.items():
        if s:
            for i in own[1:]:
                join(own[0], i)
    for (a, b), n in shared.items():
        if den * n >= num * (len(keys[a]) + len(keys[b]) - n):
            join(classes[keys[a]][0], classes[keys[b]][0])
    members = defaultdict(list)
    for i, r in enumerate(rows):
        members[find(i)].append(r["doc_id"])
    return [(len(sets[i]), min((x for x in members[find(i)] if x is not None), default=None)) for i in range(len(rows))]


def lines(rows, min_docs=10, least=1):
    split = [(r["text"] or "").encode().split(b"\n") for r in rows]
    keys = [[x.strip(WHITE).lower() for x in s] for s in split]
    count = Counter(k for own in keys for k in set(own) if len(k.decode()) >= least)
    out = []
    for s, own in zip(split, keys, strict=True):
        keep = [x for x, k in zip(s, own, strict=True) if count[k] < min_docs or len(k.decode()) < least]
        out.append((len(s), len(s) - len(keep), hashlib.sha256(b"\n".join(keep)).hexdigest()))
    return out


def repeats(rows, width=400):
    """What each row loses: every byte in a string of ``width`` bytes that starts elsewhere too."""
    texts = [(r["text"] or "").encode() for r in rows]
    count = Counter(t[i : i + width] for t in texts for i in range(len(t) - width + 1))
    out = []
    for t in texts:
        bad = bytearray(len(t))
        for i in range(len(t) - width + 1):
            if count[t[i : i + width]] > 1:
                bad[i : i + width] = b"\1" * width
        spans = len(re.findall(b"\1+", bytes(bad)))
        kept = bytes(x for x, b in zip(t, bad, strict=True) if not b)
        out.append((len(t), sum(bad), spans, hashlib.sha256(kept).hexdigest()))
    return out


def warc(rows, least=0):
    payloads = [(r["html"] or "").encode() for r in rows]
    best = {}
    for r, p in zip(rows, payloads, strict=True):
        if len(p) >= least and r["page_id"] is not None:
            best[p] = max(best.get(p, r["page_id"]), r["page_id"])
    out = []
    for r, p in zip(rows, payloads, strict=True):
        to = best.get(p) if len(p) >= least else None
        to = None if to == r["page_id"] else to
        out.append((r["page_id"], len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if to is None else "revisit", to))
    return out
