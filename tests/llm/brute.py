"""Plain versions of the operators' contracts, and small odd inputs."""

from __future__ import annotations

import collections
import hashlib
import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return WORD.findall(text or "")


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def odd_rows():
    """Nulls, blanks, repeats, ties, copies, near copies, shared passages and a long text."""
    rng = random.Random(4)
    base, passage = prose(rng, 200), prose(rng, 70, 100000)
    edited = base.split()
    edited[50] = "changed"
    rows = [
        (1, None, "en", "a", 0),
        (2, "", "en", "a", 0),
        (3, " \t\n\r ", None, "b", 5),
        (4, "one two", "en", "b", None),
        (5, "One TWO", "de", None, 7),
        (6, base, "en", "a", len(base)),
        (7, base, "en", "b", len(base)),
        (8, " ".join(edited), "fr", "c", 0),
        (9, prose(rng, 60) + " " + passage + " " + prose(rng, 30), "en", "a", 0),
        (10, passage + " " + prose(rng, 80), None, "c", 0),
        (11, prose(rng, 20) + "\n" + passage, "en", "é", 0),
        (12, prose(rng, 15000), "en", "a", 0),
        (13, "x " * 300, "en", "b", 0),
        (14, "ÄÖ é ß\n" * 40, "de", None, 0),
        (None, base, "en", "a", 0),
        (None, prose(rng, 120), None, None, None),
        (6, base, "en", "a", len(base)),
        (6, prose(rng, 90), "en", "a", 0),
    ]
    return rows + [(k, prose(rng, rng.randrange(1, 300)), "en", f"s{k % 4}", 1) for k in range(20, 60)]


def frame(spark, rows):
    """The rows with extra columns whose names the operators use themselves."""
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(rows, SCHEMA)
    names = ["size", "n_words", "key", "band", "comp", "kept", "score", "text_key", "copies", "chunk", "label", "h", "start", "place", "offset", "held_out", "n", "sig"]
    return docs.withColumns({name: F.lit("extra") for name in names})


def lower(text):
    return (text or "").translate({k: k + 32 for k in range(65, 91)})


def shingles(text, n=5):
    w = words(lower(text))
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def components(rows):
    """Component id of each row (by place), as smallest id that is not null."""
    sets = [shingles(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if sets[i] and 100 * shared >= 75 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = collections.defaultdict(list)
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)].append(r[0])
    return [r[0] if not sets[i] else min(least[find(i)], default=None) for i, r in enumerate(rows)], sets


def removed(rows, window=50):
    """(n_words, n_removed, sha256 of what is kept) of each row."""
    starts = collections.defaultdict(lambda: float("inf"))
    for r in rows:
        w = words(r[1])
        for k in range(len(w) - window + 1) if r[0] is not None else ():
            starts[tuple(w[k : k + window])] = min(starts[tuple(w[k : k + window])], r[0])
    out = []
    for r in rows:
        w = words(r[1])
        gone = [False] * len(w)
        for k in range(len(w) - window + 1) if r[0] is not None else ():
            if starts[tuple(w[k : k + window])] < r[0]:
                gone[k : k + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def repeat_words(text, n=5):
    w = words(text)
    seen = collections.Counter(tuple(w[k : k + n]) for k in range(len(w) - n + 1))
    covered = set()
    for k in range(len(w) - n + 1):
        if seen[tuple(w[k : k + n])] > 1:
            covered.update(range(k, k + n))
    return len(covered)


def mix_targets(sizes, weights=(3, 1, 2), share=1.5):
    """Target by source, by repeated resharing; ``sizes`` by source."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    left, free, out = share * sum(sizes.values()), set(names), dict.fromkeys(names, 0.0)
    while free:
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > 2 * sizes[s]]
        if not over:
            return out | {s: left * weight[s] / total for s in free}
        for s in over:
            out[s] = 2.0 * sizes[s]
            left -= 2 * sizes[s]
            free.discard(s)
    return out
