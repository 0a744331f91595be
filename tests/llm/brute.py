"""Plain versions of the operators, for small inputs: one process, all pairs, no Spark."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from math import ceil, floor, log10

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def base_scores(rows):
    """rows: (doc_id, text). {doc_id: (held_out, n_tokens, n_known, N, base)}"""
    out = {d: zlib.crc32(("" if d is None else str(d)).encode()) % 10 == 0 for d, _ in rows}
    tokens = {d: words(lowered(t)) + ["\n"] for d, t in rows}
    c = Counter(t for d, _ in rows if not out[d] for t in tokens[d])
    n, v = sum(c.values()), len(c)
    return {d: (out[d], len(ts), sum(c[t] > 0 for t in ts), n, sum(log10((c[t] + 0.1) / (n + 0.1 * (v + 1))) for t in ts)) for d, ts in tokens.items()}


KINDS = (
    ("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII), 2, 6),
    ("access", re.compile(r"(AKIA[A-Z0-9]+)"), 1, 20),
    ("hex", re.compile(r"([0-9a-f]+)"), 1, 24),
)


def secret_spans(text):
    """Base spans (start, rank, end, kind, value)."""
    found = []
    for rank, (kind, pattern, group, least) in enumerate(KINDS):
        found += [(m.start(), rank, m.end(), kind, m[group]) for m in pattern.finditer(text or "") if len(m[group]) >= least]
    return sorted(found)


def looks_generated(v):
    return bool(re.search("[0-9]", v) and re.search("[A-Za-z]", v) and (len(set(v)) >= 8 or 3 * len(set(v)) >= 2 * len(v))) and not re.search("(?i)example|changeme|placeholder|dummy|xxxx|12345678", v)


def secrets(rows, most_owners=2):
    """rows: (doc_id, text, source). [(doc_id, base spans, live [(start, end)])] in order."""
    spans = [(d, secret_spans(t), s) for d, t, s in rows]
    holders = defaultdict(set)
    for d, found, s in spans:
        for x in found:
            holders[x[4]].add((s or "", "" if d is None else str(d)))
    owners = {v: len({o for o, _ in h}) for v, h in holders.items()}
    few = {v for v, h in holders.items() if owners[v] <= most_owners}
    return [(d, found, sorted({(x[2] - len(x[4]), x[2]) for x in found if x[4] in few and looks_generated(x[4])})) for d, found, _ in spans]


def redacted(text, live, mark="[REDACTED]"):
    out, at = "", 0
    for b, e in live:
        if b >= at:
            out += text[at:b] + mark
        at = max(at, e)
    return out + text[at:]


def targets(sizes, weights=(5, 2, 1), budget=1.5, most=2):
    """sizes: {source: words}. Shares by weight; what is above goes to those below, until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    rest, free, got = budget * sum(sizes.values()), set(order), {}
    while free:
        w = sum(weight[s] for s in free)
        over = [s for s in free if rest * weight[s] / w > most * sizes[s]]
        if not over:
            return got | {s: rest * weight[s] / w for s in free}
        for s in over:
            got[s] = most * sizes[s]
            free.discard(s)
        rest = budget * sum(sizes.values()) - sum(got.values())
    return got


def allowed_copies(target, source_size):
    rate = target / source_size if source_size else 0
    return {floor(rate + 1e-12), ceil(rate - 1e-12)}


def components(n, pairs):
    """Smallest index reachable, for each of n."""
    root = list(range(n))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, j in pairs:
        a, b = sorted((find(i), find(j)))
        root[b] = a
    return [find(i) for i in range(n)]


def cosine_links(rows, least=0.93):
    """rows: (id, vector or None, label), ids in order. {id: (links, component)}"""
    ok = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) and lab is not None for _, v, lab in rows]
    links, pairs = [0] * len(rows), []
    for i in range(len(rows)):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = (np.array(rows[k][1], dtype=np.float64) for k in (i, j))
                if a @ b / (np.sqrt(a @ a) * np.sqrt(b @ b)) >= least:
                    links[i] += 1
                    links[j] += 1
                    pairs.append((i, j))
    return {r[0]: (n, rows[c][0]) for r, n, c in zip(rows, links, components(len(rows), pairs))}


def simhash(text, size=3):
    ws = words(lowered(text))
    if not ws:
        return 0
    grams = [" ".join(ws[i : i + size]) for i in range(len(ws) - size + 1)] or [" ".join(ws)]
    hs = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def simhash_classes(rows):
    """rows: (doc_id, text), ids in order. {doc_id: (hex, component)}"""
    fps = [simhash(t) for _, t in rows]
    pairs = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3]
    return {r[0]: (f"{f:016x}", rows[c][0]) for r, f, c in zip(rows, fps, components(len(rows), pairs))}


def shard_of(rows, limit, bits=60):
    """rows: (doc_id, text). [(doc_id, bytes, shard, shard bytes)] by splitting buckets one bit at a time."""
    hashed = [(d, len((t or "").encode()), format(int(hashlib.md5(("" if d is None else str(d)).encode()).hexdigest()[:15], 16), "060b")) for d, t in rows]
    out, todo = [], [("", hashed)]
    while todo:
        name, bucket = todo.pop()
        total = sum(x[1] for x in bucket)
        if total <= limit or len(name) == bits:
            out += [(d, n, "s" + name, total) for d, n, _ in bucket]
        else:
            todo += [(name + b, part) for b in "01" if (part := [x for x in bucket if x[2].startswith(name + b)])]
    return out


def without_repeats(rows, size=50):
    """rows: (doc_id, text). [(n_words, n_removed, sha256 of what stays)] in order."""
    first = {}
    split = [words(t) for _, t in rows]
    ids = [float("inf") if d is None else d for d, _ in rows]
    for d, ws in zip(ids, split):
        for i in range(len(ws) - size + 1):
            w = tuple(ws[i : i + size])
            first[w] = min(d, first.get(w, d))
    out = []
    for d, ws in zip(ids, split):
        gone = set()
        for i in range(len(ws) - size + 1):
            if first[tuple(ws[i : i + size])] < d:
                gone.update(range(i, i + size))
        kept = [w for i, w in enumerate(ws) if i not in gone]
        out.append((len(ws), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return out


def token_pieces(text, tokenizer, room=2048):
    """[(piece, start, length, crc)] of a whole text's ids and a final 0."""
    ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
    return [(k, at, len(ids[at : at + room]), zlib.crc32(np.array(ids[at : at + room], dtype="<u4").tobytes())) for k, at in enumerate(range(0, len(ids), room))]


def plain_line(line):
    return re.sub("[0-9]", "0", " ".join(words(lowered(line))))


def quality(rows, min_docs=20, max_share=0.05, keep_share=0.5):
    """rows: (text, source). [(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, kept text)]"""
    hosts = defaultdict(set)
    for t, s in rows:
        hosts[s].add(t or "")
    often = {}
    for s, texts in hosts.items():
        n = Counter(x for t in texts for x in {plain_line(x) for x in t.split("\n") if words(x)})
        often[s] = {x for x, k in n.items() if k > min_docs and k > max_share * len(texts)}
    out = []
    for t, s in rows:
        ws, lines = words(t), [x for x in (t or "").split("\n")]
        full = [x for x in lines if words(x)]
        grams = Counter(zip(ws, ws[1:], ws[2:]))
        rep = {k for i in range(len(ws) - 2) if grams[tuple(ws[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
        failed = len(ws) < 50 or 100 * len(rep) > 50 * len(ws)
        left = [x for x in lines if not words(x) or plain_line(x) not in often[s]]
        rest = sum(len(words(x)) for x in left)
        facts = (len(ws), sum(map(len, ws)), sum((t or "").count(c) for c in "#*$%&|<>"), len(full) - len(set(full)), len(rep), failed)
        out.append((*facts, not failed and rest >= keep_share * len(ws), "\n".join(left)))
    return out


def best_fit_decreasing(counts, room):
    """Sequences that plain best-fit decreasing needs."""
    n, gaps = 0, [0] * (room + 1)
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            gap = next((g for g in range(length, room + 1) if gaps[g]), None)
            if gap is None:
                n, gap = n + 1, room
            else:
                gaps[gap] -= 1
            gaps[gap - length] += 1
    return n
