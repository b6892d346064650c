"""Plain versions of the operators that tests compare with."""

import re

import numpy as np
import xxhash


def brute_print(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 4]) for k in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, ids, radius=4):
    x, low = np.array(prints, np.uint64), np.array(ids)
    near = np.bitwise_count(x[:, None] ^ x[None, :]) <= radius
    while True:
        new = np.where(near, low[None, :], 1 << 60).min(axis=1)
        if (new == low).all():
            return low.tolist()
        low = new


def brute_units(rows, ud):
    """Earliest occurrence of each line and paragraph by (doc_id, place), with plain loops."""
    seen, out = set(), {}
    for doc, text in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        text, own, lines, at = text or "", [], [], 0
        for piece in re.findall(r"[^\n]*\n\s*|[^\n]+", text):
            lines.append((at, at + len(piece), piece))
            at += len(piece)
            if re.search(r"\n\s*\n", piece) or at == len(text):
                own.append(lines)
                lines = []
        spans = []
        for lines in own:
            whole = [(lines[0][0], lines[-1][1], "".join(x for _, _, x in lines))] if len(lines) > 1 else []
            gone = {}
            for unit in sorted(lines + whole):
                words = unit[2].lower().split()
                if sum(1 if len(w) <= 16 else len(w) // 2 for w in words) >= ud.LEAST_WORDS:
                    gone[unit[:2]] = " ".join(words) in seen
                    seen.add(" ".join(words))
            if whole and gone.get(whole[0][:2]):
                spans.append(whole[0][:2])
            else:
                spans += [x[:2] for x in lines if gone.get(x[:2])]
        kept, last = [], 0
        for a, b in [*spans, (len(text), len(text))]:
            kept.append(text[last:a])
            last = b
        out[doc] = ("".join(kept), spans)
    return out


def brute_score(item, text):
    a, b = re.findall(r"\w+", item.lower()), re.findall(r"\w+", text.lower())
    row, best = [0] * (len(b) + 1), 0
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(max(0, row[j] + (1 if x == y else -1), row[j + 1] - 1, new[-1] - 1))
        row, best = new, max(best, *new)
    return best / len(a)


def brute_trie(rows):
    """All nodes of the trie of rebuilt conversations from ``(conv_id, turn, role, text)``, with plain loops."""
    import hashlib
    import zlib

    def digest(r):
        role, text = r[2] or "", r[3] or ""
        return hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()

    turns = {}
    for r in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[1] is not None, r[1] or 0, digest(r))):
        turns.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    whole = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        whole[c] = tuple(turns.get(c - c % 100, [])[:h] + own[h:])
    members = {}
    for c, seq in whole.items():
        for d in range(len(seq) + 1):
            members.setdefault(seq[:d], []).append(c)
    out = {}
    for node, own in members.items():
        below = [n for n in members if n[: len(node)] == node]
        children = [n for n in below if len(n) == len(node) + 1]
        leaves = sum(1 for n in below if not any(len(m) == len(n) + 1 and m[: len(n)] == n for m in below))
        saved = sum((len(members[n]) - 1) * len(n[-1][1]) for n in below if n)
        last = ",".join(str(c) for c in sorted(c for c in own if len(whole[c]) == len(node)))
        out[min(own), len(node)] = (min(members[node[:-1]]) if node else None, len(own), len(children), leaves, saved, hashlib.sha256(last.encode()).hexdigest())
    return out
