"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def quality(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    t = text or ""
    w = words(t)
    grams = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    many, covered = Counter(grams), set()
    for i, g in enumerate(grams):
        if many[g] > 1:
            covered.update(range(i, i + 8))
    seen, again = set(), 0
    for line in t.split("\n"):
        if words(line):
            again += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), again, len(covered)


def removed(rows, k):
    """(id, n_words, n_removed, kept) of rows (id, text)."""
    large = 1 << 70
    first, all_words = {}, []
    for d, t in rows:
        w = words(t)
        all_words.append(w)
        for i in range(len(w) - k + 1):
            g = tuple(w[i : i + k])
            first[g] = min(first.get(g, large + 1), large if d is None else d)
    out = []
    for (d, _), w in zip(rows, all_words, strict=True):
        off = set()
        for i in range(len(w) - k + 1):
            if first[tuple(w[i : i + k])] < (large if d is None else d):
                off.update(range(i, i + k))
        out.append((d, len(w), len(off), " ".join(x for i, x in enumerate(w) if i not in off)))
    return out


def shingles(text, k):
    w = words(lower(text))
    if len(w) >= k:
        return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    return frozenset([tuple(w)] if w else [])


def _joined(rows, k, percent):
    """The rows' sets, and which row stands for each row's component."""
    sets, holders, up = [shingles(t, k) for _, t in rows], defaultdict(list), list(range(len(rows)))

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for i, a in enumerate(sets):
        common = Counter(j for g in a for j in holders[g])
        for g in a:
            holders[g].append(i)
        for j, n in common.items():
            if 100 * n >= percent * (len(a) + len(sets[j]) - n):
                up[find(i)] = find(j)
    return sets, find


def n_components(rows, k, percent):
    sets, find = _joined(rows, k, percent)
    return len({find(i) for i, s in enumerate(sets) if s})


def near(rows, k, percent):
    """(id, set size, component, kept) of rows (id, text)."""
    sets, find = _joined(rows, k, percent)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [(d, len(sets[i]), least.get(find(i)), d == least.get(find(i))) for i, (d, _) in enumerate(rows)]


PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


def licenses(text):
    """n_words, n_base, first_word, last_word, base_labels."""
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    starts, labels = [], set()
    for phrase, label in PHRASES.items():
        p = phrase.split()
        at = [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
        starts += at
        labels |= {label} if at else set()
    return len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def targets(sizes):
    """Targets of {source: size} by weights 5, 2, 1 in order of the sources, None last, at most 3 times the size."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    capped = set()
    while True:
        rest = sum(sizes.values()) - sum(3 * sizes[s] for s in capped)
        free = sum(weight[s] for s in order if s not in capped)
        out = {s: 3.0 * sizes[s] if s in capped else rest * weight[s] / free for s in order}
        more = {s for s in order if s not in capped and out[s] > 3 * sizes[s]}
        if not more:
            return out
        capped |= more


def mixed(rows, slots):
    """{id: (taken, first slot)} of rows (id, source, size): the schedule's slots one by one."""
    phi = 2654435769  # the golden ratio's fraction of 2^32
    sizes = {}
    for _, s, n in rows:
        sizes[s] = sizes.get(s, 0) + n
    goals = targets(sizes)
    order = [s for s in sorted(sizes, key=lambda s: (s is None, s or "")) if goals[s] >= 0.5]
    tokens = max(1, -(-sum(sizes.values()) // slots))
    want = {s: min(int(goals[s] + 0.5), 3 * sizes[s]) for s in order}
    need = {s: want[s] // sizes[s] * -(-sizes[s] // tokens) + -(-(want[s] % sizes[s]) // tokens) for s in order}
    line = {}
    for s in order:
        line[s] = [i for i, _, n in sorted((r for r in rows if r[1] == s), key=lambda r: (hashlib.md5(str(r[0]).encode()).hexdigest()[:15], r[0])) for _ in range(n)]
    ends, total = [], 0
    for s in order:
        total += need[s]
        ends.append(total)
    ends = [e * 2**32 // total for e in ends]
    taken, first, rank = Counter(), {}, Counter()
    for t in range(100 * (slots + 100)):
        s = order[bisect(ends, t * phi % 2**32)]
        n = -(-sizes[s] // tokens)
        turn, block = divmod(rank[s], n)
        rank[s] += 1
        begin = turn * sizes[s] + block * tokens
        for i in line[s][block * tokens : (block + 1) * tokens][: max(0, want[s] - begin)]:
            taken[i] += 1
            first.setdefault(i, t)
        if all(rank[s] >= need[s] for s in order):
            break
    return {i: (taken[i], first.get(i)) for i, _, _ in rows}


def by_null(row):
    return tuple((x is None, x if x is not None else 0) for x in row)


def by_null_text(row):
    return tuple((x is None, str(x)) for x in row)
