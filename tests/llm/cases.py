"""A small table with every odd row, and brute-force versions of operators."""

from __future__ import annotations

import hashlib
import re
import zlib

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, n_words string, _doc string, token string"


def text_of(seed: int, n: int) -> str:
    return " ".join(f"w{(seed * 7919 + k * k * 31 + k) % 997}" for k in range(n))


def rows() -> list[tuple]:
    line = "The SAME long line that very many of the documents hold."
    base = text_of(1, 60)
    texts = [
        (1, base + "\n" + line),
        (2, base.replace("w", "W") + "\n  " + line.lower() + "\t"),  # equal keys and shingles
        (3, text_of(3, 80) + "\n" + line),
        (4, text_of(3, 78) + " other end\n" + line),
        (5, line + "\n" + line),
        (6, None),
        (7, ""),
        (8, " \t\n\n "),
        (9, "one two"),
        (10, "one two"),
        (11, "spam " * 40),
        (12, "Grüße, ÄÖÜ! naïve façadé ΣΑΣ 日本語 <|endoftext|> it's we'll"),
        (13, text_of(5, 4000) + "\n" + line),  # very long
        (14, base + " and then " + text_of(9, 50)),
        (15, "x" * 5000),
        (16, "123 456   789"),
    ]
    out = [(i, t, "de" if i % 3 == 0 else "en", None if i == 9 else f"src{i % 3}", 0, "s", "n", "d", "t") for i, t in texts]
    out.append(out[2])  # a repeated row
    out.append((None, base, None, "src0", 0, "s", "n", "d", "t"))
    return out


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def line_dedup(docs: list[tuple]) -> list[tuple]:
    """(id, n_lines, n_dropped, sha)"""
    blanks = " \t\n\x0b\x0c\r"
    key = lambda x: x.strip(blanks).translate({c: c + 32 for c in range(65, 91)})
    holders: dict[str, set] = {}
    for i, t in docs:
        for x in (t or "").split("\n"):
            if i is not None and len(key(x)) >= 40:
                holders.setdefault(key(x), set()).add(i)
    out = []
    for i, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (i is not None and len(holders.get(key(x), ())) >= 5 and max(holders[key(x)]) != i)]
        out.append((i, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    return out


def shingles(text: str | None, k: int) -> frozenset:
    w = words((text or "").translate({c: c + 32 for c in range(65, 91)}))
    if not w:
        return frozenset()
    return frozenset({tuple(w)} if len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)})


def ngram_join(docs: list[tuple], k: int, percent: int) -> list[tuple]:
    """(id, n, component)"""
    sets = [shingles(t, k) for _, t in docs]
    root = list(range(len(docs)))

    def find(a: int) -> int:
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(docs)):
        for b in range(a):
            if docs[a][0] is None or docs[b][0] is None or not sets[a] or not sets[b]:
                continue
            i = len(sets[a] & sets[b])
            if 100 * i >= percent * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least: dict[int, int] = {}
    for a, (i, _) in enumerate(docs):
        if i is not None:
            least[find(a)] = min(least.get(find(a), i), i)
    return [(i, len(sets[a]), None if i is None else least[find(a)]) for a, (i, _) in enumerate(docs)]


def substring_dedup(docs: list[tuple], k: int) -> list[tuple]:
    """(id, n_words, n_removed, sha)"""
    first: dict[tuple, int] = {}
    split = [words(t) for _, t in docs]
    for (i, _), w in zip(docs, split, strict=True):
        for s in range(len(w) - k + 1):
            if i is not None:
                first[tuple(w[s : s + k])] = min(first.get(tuple(w[s : s + k]), i), i)
    out = []
    for (i, _), w in zip(docs, split, strict=True):
        gone = set()
        for s in range(len(w) - k + 1):
            if i is not None and first[tuple(w[s : s + k])] < i:
                gone.update(range(s, s + k))
        out.append((i, len(w), len(gone), sha(" ".join(x for p, x in enumerate(w) if p not in gone))))
    return out


def crc(data: bytes) -> int:
    return zlib.crc32(data)


def quality(text: str | None) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)"""
    t = text or ""
    w = words(t)
    seen, dup = set(), 0
    for x in t.split("\n"):
        if words(x):
            dup += x in seen
            seen.add(x)
    at: dict[tuple, list[int]] = {}
    for s in range(len(w) - 7):
        at.setdefault(tuple(w[s : s + 8]), []).append(s)
    covered = {p for starts in at.values() if len(starts) > 1 for s in starts for p in range(s, s + 8)}
    failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(covered), failed


def suffix_dedup(docs: list[tuple], k: int) -> list[tuple]:
    """(id, n_bytes, n_removed, n_spans, sha)"""
    first: dict[bytes, int] = {}
    texts = [(i, (t or "").encode()) for i, t in docs]
    for i, b in texts:
        for s in range(len(b) - k + 1):
            if i is not None:
                first[b[s : s + k]] = min(first.get(b[s : s + k], i), i)
    out = []
    for i, b in texts:
        gone = bytearray(len(b))
        for s in range(len(b) - k + 1):
            if i is not None and first[b[s : s + k]] < i:
                gone[s : s + k] = b"\1" * k
        spans = sum(x and not y for x, y in zip(gone, b"\0" + gone, strict=False))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, y in zip(b, gone, strict=True) if not y)).hexdigest()))
    return out


def one_edit(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def spelling(docs: list[tuple]) -> list[tuple]:
    """(word, n, n_near, form, form_n, root)"""
    count: dict[str, int] = {}
    for i, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate({c: c + 32 for c in range(65, 91)})
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                count[run] = count.get(run, 0) + 1
    words = {w: n for w, n in count.items() if n >= 2}
    told = {}
    for w, n in words.items():
        near = sorted((-m, v) for v, m in words.items() if abs(len(v) - len(w)) <= 1 and one_edit(v, w))
        best = near[0] if near and -near[0][0] >= 10 * n else None
        told[w] = (n, len(near), best and best[1], best and -best[0])
    out = []
    for w, (n, m, form, form_n) in told.items():
        root = w
        while told[root][2]:
            root = told[root][2]
        out.append((w, n, m, form, form_n, root))
    return out


def filter_audit(docs: list[tuple], labels: dict[int, tuple[int, int]]) -> list[tuple]:
    """docs: (id, text, part); labels: id to (quality, toxic)."""
    from itertools import permutations

    least: dict[str, int] = {}
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    judged: dict[str, list[tuple]] = {}
    for i, t, part in docs:
        t = t or ""
        w = words(t)
        fails = (
            len(w) < 100,
            100 * len(set(w)) < 80 * len(w),
            100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
            bool(re.search(r"[#$%&*|]", t)),
            i is not None and i > least[t],
        )
        quality, toxic = labels.get(i, (0, 0))
        judged.setdefault(part or "", []).append((dict(zip("ABCDE", fails, strict=True)), quality == 1, toxic == 1))
    out = []
    for part, rows in judged.items():
        value = dict.fromkeys("ABCDE", 0)
        mine = []
        for order in permutations("ABCDE"):
            left = rows
            for k, f in enumerate(order, 1):
                gone = [r for r in left if r[0][f]]
                redundant = sum(r[0][f] for r in rows) - len(gone)
                left = [r for r in left if not r[0][f]]
                unique = sum(r[0][f] and sum(r[0].values()) == 1 for r in rows)
                value[f] += len(gone)
                mine.append((part, "".join(order), k, len(left), len(gone), redundant, unique, sum(r[1] for r in gone), sum(r[2] for r in gone)))
        out += [(*r, value[r[1][r[2] - 1]]) for r in mine]
    return out
