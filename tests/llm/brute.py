"""Plain versions of the operators, for small tables."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np

EDGE = [
    (1, "a b c d e f g h i j k l m n o", "s", 1),
    (2, "a b c d e f g h i j k l m n o", "s", 2),
    (2, "a b c d e f g h i j k l m n o", "s", 2),
    (3, None, None, None),
    (4, "", "t", 0),
    (5, " \t\n", "t", 3),
    (6, "ä Ö\x0bß x\x1cy", None, 4),
    (None, "a b c d e f g h i j k l m n o p", "u", 5),
    (7, "lone", "u", 1),
    (8, "lone", "u", 1),
    (9, "q " * 30000 + "r", "v", 1),
    (10, "b c d e f g h i j k l m n o z", "s", 1),
]
#: documents with extra columns whose names an operator might use itself.
SCHEMA = "doc_id long, text string, source string, size long"


def words(text):
    return (text or "").encode().split()


def luhn(digits):
    twice = [2 * int(c) - 9 * (int(c) > 4) if i % 2 else int(c) for i, c in enumerate(reversed(digits))]
    return sum(twice) % 10 == 0


PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def pii(text):
    out = []
    for kind, pattern in PII.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {
                "email": True,
                "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")),
                "card": 16 <= len(digits) <= 19 and luhn(digits),
                "phone": 8 <= len(digits) <= 15,
            }[kind]
            if ok:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def secrets(text):
    out = []
    assign = r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
    for m in re.finditer(assign, text or ""):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end(), "assign"))
    for rank, kind, pattern, least in ((1, "access", "AKIA[A-Z0-9]+", 20), (2, "hex", "[0-9a-f]+", 24)):
        out += [(m.start(), rank, m.end(), kind) for m in re.finditer(pattern, text or "") if len(m[0]) >= least]
    return [f"{k}:{s}:{e}" for s, _, e, k in sorted(out)]


def linked_secrets(text, scope=400):
    """All spans: the base ones, and the weak ones with a complementary part within `scope` characters."""
    base = [(int(x.split(":")[1]), {"assign": 0, "access": 1, "hex": 2}[x.split(":")[0]], int(x.split(":")[2]), x.split(":")[0]) for x in secrets(text)]
    key = r"(?<![A-Za-z0-9+/_.=-])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/_.=-])"
    keys = [(m.start(), 3, m.end(), "key") for m in re.finditer(key, text or "") if re.search("[A-Z]", m[0]) and re.search("[a-z]", m[0]) and re.search("[0-9]", m[0])]
    link = r"(?<![A-Za-z0-9])(?:https?|postgres|mysql|mongodb|redis|amqp|s3)://[A-Za-z0-9._:@/-]{4,200}"
    ends = [(m.start(), 4, m.end(), "endpoint") for m in re.finditer(link, text or "")]
    near = lambda a, b: a[0] != b[0] and abs(a[0] - b[0]) <= scope
    keys = [k for k in keys if any(b[3] == "access" and near(k, b) for b in base)]
    ends = [e for e in ends if any(near(e, b) for b in base + keys)]
    return [f"{k}:{s}:{e}" for s, _, e, k in sorted(base + keys + ends)]


def sha(parts):
    return hashlib.sha256(",".join(parts).encode()).hexdigest()


def classes(rows, k, num, den):
    """doc_id -> (size, component) by all pairs of distinct sets."""
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append(frozenset(zip(*(w[i:] for i in range(k)))) if len(w) >= k else frozenset([tuple(w)] if w else []))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and den * len(a & b) >= num * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[find(i)] = min(least.get(find(i), key), key)
    return [(key, len(sets[i]), least.get(find(i), key) if sets[i] else key) for i, (key, _) in enumerate(rows)]


def repeats(rows, k=13):
    """(doc_id, words, removed, sha of the kept) of each row."""
    first = {}
    for key, text in rows:
        w = words(text)
        for i in range(len(w) - k + 1):
            if key is not None:
                g = tuple(w[i : i + k])
                first[g] = min(first.get(g, key), key)
    out = []
    for key, text in rows:
        w = words(text)
        gone = [False] * len(w)
        for i in range(len(w) - k + 1):
            if key is not None and first[tuple(w[i : i + k])] < key:
                gone[i : i + k] = [True] * k
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((key, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out


def lm_base(rows):
    """doc_id -> (tokens, known, N, base) with exact counts."""
    tokens = lambda t: (t or "").encode().lower().split() + [b" "]
    held = lambda key: key is not None and zlib.crc32(str(key).encode()) % 7 == 2
    c = Counter(w for key, text in rows if not held(key) for w in tokens(text))
    n, v = sum(c.values()), len(c)
    return [(key, held(key), len(t := tokens(text)), sum(c[w] > 0 for w in t), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t)) for key, text in rows]


def lm_scores(rows, pair, word):
    """log10 probability of each text, from quantised exact counts that are divided by their own sums."""
    tokens = lambda t: (t or "").encode().lower().split() + [b" "]
    held = lambda key: key is not None and zlib.crc32(str(key).encode()) % 7 == 2
    one, two, total = Counter(), Counter(), Counter()
    for key, text in rows:
        if not held(key):
            t = tokens(text)
            one.update(t)
            two.update(zip([b"  ", *t], t))
    middle = lambda n: (2 ** (n.bit_length() - 1) + 2 ** n.bit_length() - 1) / 2 if n else 0
    for (c, _), n in two.items():
        total[c] += middle(n)
    mass = sum(map(middle, one.values()))
    out = []
    for _, text in rows:
        s, t = 0.0, tokens(text)
        for c, w in zip([b"  ", *t], t):
            p = middle(one[w]) / mass
            p = pair * middle(two[c, w]) / total[c] + word * p if total[c] else (pair + word) * p
            s += math.log10(p + (1 - pair - word) / (len(one) + 1))
        out.append(s)
    return out


def top_k(rows, queries, k):
    v = {i: np.floor(256 * np.array(x, float)).astype(np.int64) for i, x in rows if x and all(y is not None and math.isfinite(y) for y in x)}
    out = []
    for q in queries:
        if q in v:
            best = sorted((-int(v[q] @ x), i) for i, x in v.items() if i != q)[:k]
            out += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    return out


def pareto(rows, target, size):
    """(probability, copies, taken) of one source's (row, words, hash): whole copies, then Pareto order sampling."""
    whole = int(target // size) if size else 0
    rest = target - whole * size
    x = [2.0 ** (math.floor(math.log2(math.sqrt(n)) * 8) / 8) if n else 0.0 for _, n, _ in rows]
    certain = set()
    while True:
        free = [i for i in range(len(rows)) if i not in certain and x[i]]
        held = sum(rows[i][1] for i in certain)
        scale = (rest - held) / sum(rows[i][1] * x[i] for i in free) if free else 0.0
        more = {i for i in free if scale * x[i] >= 1}
        if not more:
            break
        certain |= more
    p = [1.0 if i in certain else scale * x[i] for i in range(len(rows))]
    t = []
    for (_, _, h), q in zip(rows, p):
        u = (((h % 2**64) >> 11) + 0.5) / 2**53
        t.append(u * (1 - q) / (u * (1 - q) + (1 - u) * q) if q > 0 else 1.0)
    taken, filled = [0] * len(rows), 0
    for i in sorted(range(len(rows)), key=lambda i: (t[i], rows[i][2], rows[i][1])):
        if rest <= 0 or filled + rows[i][1] / 2 > rest:
            break
        filled += rows[i][1]
        taken[i] = 1
    return [(q, whole + n, (whole + n) * r[1]) for q, n, r in zip(p, taken, rows)]
