"""The corpus operators again, plainly, in Python over lists of rows."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import regex

from credence.llm import line_dedup, mixing, quality_rules, secret_scan

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def count(text, characters):
    return sum(c in characters for c in text)


def line_fails(line):
    k, q = len(words(line)), quality_rules
    if not k:
        return False
    letters, capitals = len(regex.findall(r"\p{L}", line)), len(regex.findall(r"\p{Lu}", line))
    seps = count(line, q.SEPARATORS)
    after = re.sub(q.SENTENCES.replace(r"\z", r"\Z"), "", line)
    punctuation = len(words(after)) >= q.MIN_PLAIN_WORDS or count(line, q.NOISE) * 2 > k
    return punctuation or (seps >= 2 and seps * 3 >= k) or any(p in line.lower() for p in q.PHRASES) or (k >= q.MIN_SHOUT_WORDS and capitals * 2 > letters)


def quality(text, min_words=50):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, lost_chars, clean text)"""
    text = text or ""
    w, lines = words(text), text.split("\n")
    windows = Counter(zip(w, w[1:], w[2:]))
    repeat = {i + j for i in range(len(w) - 2) if windows[w[i], w[i + 1], w[i + 2]] > 1 for j in range(3)}
    solid = [line for line in lines if words(line)]
    chars = sum(map(len, w))
    good = [line for line in lines if not line_fails(line)]
    lost = chars - sum(len(x) for line in good for x in words(line))
    failed = len(w) < min_words or 100 * len(repeat) > 50 * len(w)
    return len(w), chars, count(text, "#*$%&|<>"), len(solid) - len(set(solid)), len(repeat), failed, not failed and lost * 100 <= chars * quality_rules.MAX_LOST_PERCENT, lost, "\n".join(good)


def dedup_lines(rows, ratio=line_dedup.MAX_RATIO, min_pages=line_dedup.MIN_PAGES, min_count=line_dedup.MIN_COUNT):
    """rows of (host, text) -> texts"""
    pages, seen = Counter(h for h, _ in rows), Counter()
    for h, t in rows:
        seen.update((h, x) for x in {x for x in (t or "").split("\n") if words(x)})
    bad = {k for k, n in seen.items() if pages[k[0]] >= min_pages and n >= min_count and n > ratio * pages[k[0]]}
    return [t if not any((h, x) in bad for x in (t or "").split("\n")) else "\n".join(x for x in t.split("\n") if (h, x) not in bad) for h, t in rows]


def license_differences(statements, block, most):
    """The fewest words by which a run of the block differs from a statement whose telling words all stand in it."""
    best = None
    for s, told in statements:
        for a in range(len(block)):
            row = [(0, 0)] * (len(s) + 1)  # telling words, words of the longest common subsequence
            for b in range(a, min(len(block), a + 2 * len(s))):
                new = [(0, 0)]
                for k, w in enumerate(s):
                    new.append(max(new[k], row[k + 1], (row[k][0] + (k in told), row[k][1] + 1) if w == block[b] else (0, 0)))
                row = new
                d = max(len(s), b - a + 1) - row[-1][1]
                if row[-1][0] == len(told) and d <= int(len(s) * most) and (best is None or d < best):
                    best = d
    return best


def shingles(text):
    w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def near(docs, threshold=85):
    """{id: text} -> {id: (number of shingles, component)}"""
    sets = {i: shingles(t) for i, t in docs.items()}
    root = {i: i for i in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(docs)
    for n, b in enumerate(ids):
        for a in ids[:n]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= threshold * len(sets[a] | sets[b]) and find(a) != find(b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def mix(rows):
    """rows of (id, source, text) -> [(size, source size, target, taken)]"""
    size = [len(words(t)) for _, _, t in rows]
    total = Counter()
    for (_, s, _), n in zip(rows, size):
        total[s] += n
    sources = sorted((s for s in total if s is not None), key=lambda s: s.encode()) + [None] * (None in total)
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(sources)}
    target, free = {}, set(sources)
    while True:
        left = 1.5 * sum(size) - sum(target.values())
        full = {s for s in free if weight[s] * left / sum(weight[x] for x in free) >= 2 * total[s]}
        if not full:
            break
        target |= {s: 2.0 * total[s] for s in full}
        free -= full
        if not free:
            break
    for s in free:
        target[s] = weight[s] * left / sum(weight[x] for x in free)
    digest = [hashlib.md5(f"{'' if i is None else i}:{t or ''}".encode()).hexdigest() for i, _, t in rows]
    n_rows = Counter(s for _, s, _ in rows)
    bucket = [int(d[:12], 16) % -(-n_rows[s] // mixing.ROWS_PER_BUCKET) for d, (_, s, _) in zip(digest, rows)]
    before, out = Counter(), [None] * len(rows)
    for k in sorted(range(len(rows)), key=lambda k: (bucket[k], digest[k], size[k])):
        s = rows[k][1]
        parts = [max(0, min(size[k], int(target[s] + 0.5) - before[s] - e * total[s])) for e in range(2)]
        out[k] = (size[k], total[s], target[s], parts)
        before[s] += size[k]
    return out


_ASSIGN = re.compile(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def secrets(text):
    """The base spans, by start and kind."""
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(out)


def spelled(spans):
    return ",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in spans)


def check_packing(rows, docs, encode):
    """rows of (doc_id, piece, start, length, crc, sequence, offset); docs: list of (id, text)."""
    want = Counter()
    for i, t in docs:
        ids = [*encode(t or ""), 0]
        first = len(ids) % 2048 or 2048
        cuts = [0, *range(first, len(ids), 2048), len(ids)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[i, k, a, b - a, zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[a:b]))] += 1
    assert Counter(tuple(r[:5]) for r in rows) == want
    by_sequence = defaultdict(list)
    for r in rows:
        by_sequence[r[5]].append((r[6], r[3]))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    return len(by_sequence)
