"""Small documents with every awkward case, and plain versions of what the operators compute."""

import random
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, _id string, n_words string, shard string"


def words(text):
    return WORD.findall(text or "")


def prose(rng, n):
    return " ".join("".join(rng.choice(("an", "the", "or", "ti", "ß", "é")) for _ in range(rng.randint(1, 4))) for _ in range(n))


def awkward_rows():
    """Nulls, empty and blank texts, a long text, ties, repeated rows, near copies; names that clash with operators' own."""
    rng = random.Random(5)
    base, other = prose(rng, 120), prose(rng, 90)
    near = base.split(" ")
    near[60] = "changed"
    rows = [
        (1, base), (2, base), (2, base), (3, " ".join(near)), (4, other + "\n" + base), (5, None), (6, ""), (7, " \t\n\r\x0b\x0c "),
        (8, "one two three"), (9, "ONE two three"), (None, base), (None, None), (10, other), (11, prose(rng, 4000)),
        (12, "same line\n" * 15 + prose(rng, 40)), (13, "a\nb\n\nc\n"), (14, "x" * 50_000), (15, "日本語 テキスト 😀 ́"),
    ]
    rows += [(20 + i, f"Shared footer line\n{prose(rng, 30)}\n  SHARED FOOTER LINE \n") for i in range(12)]
    return [(i, t, "en", "kept", "kept", "kept") for i, t in rows]


def brute_substrings(rows, length):
    """(doc_id, text) rows: list of (n_words, n_removed, kept words) per row, by comparing all windows."""
    order = lambda i: -(2**63) if i is None else i
    first, seen = {}, []
    for doc_id, text in rows:
        w = words(text)
        seen.append([tuple(w[i : i + length]) for i in range(len(w) - length + 1)])
        for x in seen[-1]:
            first[x] = min(first.get(x, order(doc_id)), order(doc_id))
    out = []
    for (doc_id, text), windows in zip(rows, seen, strict=True):
        w, own, gone = words(text), set(), set()
        for i, x in enumerate(windows):
            if first[x] < order(doc_id) or x in own:
                gone.update(range(i, i + length))
            own.add(x)
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def brute_classes(rows, threshold=0.8):
    """Least doc_id of each row's class under weighted Jaccard links of five-word shingles."""
    bags = []
    for _, text in rows:
        w = [x.lower() for x in words(text)]
        bags.append(Counter([tuple(w)] if 0 < len(w) < 5 else [tuple(w[i : i + 5]) for i in range(len(w) - 4)]))
    group = list(range(len(rows)))

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, a in enumerate(bags):
        for j in range(i):
            shared = sum((a & bags[j]).values())
            if shared and shared >= threshold * (sum(a.values()) + sum(bags[j].values()) - shared):
                group[top(i)] = top(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[top(i)] = min(least.get(top(i), doc_id), doc_id)
    return [least.get(top(i)) for i in range(len(rows))]


def brute_repeat_words(text):
    w = words(text)
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    times = Counter(windows)
    return len({i + k for i, x in enumerate(windows) if times[x] > 1 for k in range(5)})
