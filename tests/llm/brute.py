"""Plain versions of the operators, and the rows on which they are held against them."""

import random
import re

import xxhash

A_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORDS = "the of und que les ein rojo mesa haus casa house blue green river stone path über niño été año garçon".split()
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, _size string, shard string, fingerprint string, found string, language string"


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", ".", ",", "\n"]) for _ in range(n))


def odd_rows(seed: int = 3, n: int = 60) -> list[tuple]:
    """Prose, copies, near copies, nulls in every column, empty, blank and very long texts, one word of great length, repeated rows; extra columns that clash."""
    rng = random.Random(seed)
    texts = [prose(rng, rng.randrange(1, 120)) for _ in range(n)]
    texts += texts[:10] + [t + " end" for t in texts[10:16]] + [None, "", "   ", " \n\t ", "!!!", "123", "É", "x" * 70_000, prose(rng, 30_000)]
    rows = [(i * 7, t, rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", None, "é"]), len(t or ""), "s", None, "f", "g", "h") for i, t in enumerate(texts)]
    return rows + rows[:3] + [(None, "no id here", "en", "a", 3, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None), (-5, "negative id", "en", "b", 0, "", "", "", "", "")]


def simhash_words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(A_Z))


def simhash(text: str | None, shingle: int = 3) -> int:
    w = simhash_words(text)
    parts = [" ".join(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))] if w else []
    h = [xxhash.xxh64_intdigest(p.encode(), seed=42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def shingles(text: str | None, size: int = 5) -> frozenset:
    w = simhash_words(text)
    return frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset()


def alike(a: frozenset, b: frozenset, percent: int = 80) -> bool:
    return a == b or 100 * len(a & b) >= percent * len(a | b)


def components(prints: list[tuple], bits: int = 2, also: list[frozenset] | None = None) -> dict[int, set]:
    """Index of a row to the set of indices it reaches, by fingerprints of at most ``bits`` differing bits or, with shingle sets, by their likeness."""
    up = list(range(len(prints)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= bits or also and alike(also[i], also[j]):
                up[root(i)] = root(j)
    out: dict[int, set] = {}
    for i in range(len(prints)):
        out.setdefault(root(i), set()).add(i)
    return {i: group for group in out.values() for i in group}


def contamination(text: str | None, items: list[tuple], window: int = 10) -> tuple[int, int, set]:
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(A_Z))
    w, hit, names = split(text), set(), set()
    for key, item in items:
        v = split(item)
        size = min(len(v), window)
        for i in range(len(v) - size + 1 if size else 0):
            for j in range(len(w) - size + 1):
                if w[j : j + size] == v[i : i + size]:
                    hit |= set(range(j, j + size))
                    names.add(key)
    return len(w), len(hit), names
