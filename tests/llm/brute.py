"""Plain Python versions of the operators, written from their definitions."""

import re
from collections import Counter
from hashlib import sha256

SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(s):
    return sha256(s.encode()).hexdigest()


def quality_base(text):
    text = text or ""
    w = SPACE_WORD.findall(text)
    wins = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    seen, mark = Counter(wins), set()
    for i, x in enumerate(wins):
        if seen[x] > 1:
            mark.update(range(i, i + 8))
    lines = [x for x in text.split("\n") if SPACE_WORD.search(x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(mark), len(w) < 20 or 100 * len(mark) > 30 * len(w))


def decontaminated(text, items):
    w = PLAIN_WORD.findall((text or "").translate(LOWER))
    hit, ids = set(), set()
    for item, t in items:
        iw = PLAIN_WORD.findall((t or "").translate(LOWER))
        if item is None or not iw:
            continue
        n = min(8, len(iw))
        wins = {tuple(iw[i : i + n]) for i in range(len(iw) - n + 1)}
        for i in range(len(w) - n + 1):
            if tuple(w[i : i + n]) in wins:
                hit.update(range(i, i + n))
                ids.add(item)
    return (len(w), len(hit), len(ids), sha(",".join(sorted(map(str, ids)))), len(ids) >= 2)


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def secrets_base(text):
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    kinds = ("assign", "access", "hex")
    return (*[sum(k == i for _, k, _ in found) for i in range(3)], sha(",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in sorted(found))))


def secrets_all(text, scope=200):
    text = text or ""
    base = [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    base += [(m.start(), "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    base += [(m.start(), "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    free = lambda s, e: not any(b[0] < e and s < b[2] for b in base)
    key = [(m.start(), "key", m.end()) for m in re.finditer(r"[A-Za-z0-9+/_-]{32,}={0,2}", text) if re.search("[0-9]", m[0]) and re.search("[A-Z]", m[0]) and re.search("[a-z]", m[0]) and free(*m.span())]
    user = [(m.start(), "user", m.end()) for m in re.finditer(r"""\b(?:user(?:_?name)?|login|account|client_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,}""", text, re.I | re.A) if free(*m.span())]
    end = [(m.start(), "endpoint", m.end()) for m in re.finditer(r"""\b(?:https?|ftp|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\s"'<>]+""", text, re.I | re.A)]
    ids, secrets = [x[0] for x in user + base if x[1] in ("user", "access")], [x[0] for x in key + base if x[1] != "access"]
    near = lambda x, there: any(abs(x[0] - y) <= scope for y in there)
    out = base + [x for x in user if near(x, secrets)] + [x for x in key if near(x, ids)] + [x for x in end if near(x, ids) and near(x, secrets)]
    order = ("assign", "access", "hex", "key", "user", "endpoint")
    return ",".join(f"{k}:{s}:{e}" for s, k, e in sorted(out, key=lambda x: (x[0], order.index(x[1]))))


def shingle_set(text):
    w = SPACE_WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def near_components(rows, percent):
    """doc_id -> (set size, component) of (doc_id, text); all pairs that share a shingle of the prefix are compared."""
    sets = [(d, shingle_set(t)) for d, t in rows]
    df = Counter(s for _, x in sets for s in x)
    comp = list(range(len(sets)))

    def root(i):
        while comp[i] != i:
            comp[i] = comp[comp[i]]
            i = comp[i]
        return i

    index, same = {}, {}
    for i, (_, x) in enumerate(sets):
        if not x:
            continue
        if (twin := same.setdefault(frozenset(x), i)) != i:
            comp[root(i)] = root(twin)
            continue
        prefix = sorted(x, key=lambda s: (df[s], s))[: len(x) - -(-percent * len(x) // 100) + 1]
        for j in {j for s in prefix for j in index.get(s, ())}:
            y = sets[j][1]
            if root(i) != root(j) and percent * max(len(x), len(y)) <= 100 * min(len(x), len(y)):
                n = len(x & y)
                if 100 * n >= percent * (len(x) + len(y) - n):
                    comp[root(i)] = root(j)
        for s in prefix:
            index.setdefault(s, []).append(i)
    least = {}
    for i, (d, _) in enumerate(sets):
        least[root(i)] = min(d, least.get(root(i), d))
    return {d: (len(x), least[root(i)]) for i, (d, x) in enumerate(sets)}
