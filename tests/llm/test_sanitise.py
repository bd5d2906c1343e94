import hashlib
import math
import random
import re
import time
from collections import defaultdict

import pytest

from evidex.llm import sanitise as sa

from .brute import DOCS, odd_rows, prose

#: The contract's forms as they are written there.
FORMS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(value):
    d = [int(c) for c in value if c.isdigit()]
    return sum(sum(divmod(2 * x, 10)) if i % 2 else x for i, x in enumerate(reversed(d))) % 10 == 0


def plain(text):
    out = []
    for rank, (kind, form) in enumerate(FORMS.items()):
        for m in re.finditer(form, text or ""):
            n = sum(c in "0123456789" for c in m[0])
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else 0, "card": kind == "card" and 14 <= n <= 19 and luhn(m[0]), "phone": 10 <= n <= 15}[kind]
            if ok:
                out.append((m.start(), rank, m.end(), kind))
    return [(kind, a, b) for a, _, b, kind in sorted(out)]


CARDS = ["4111 1111 1111 1111", "5500-0000-0000-0004", "378282246310005", "4111111111111112", "4111 1111 1111 1111 1", "30569309025904", "0000 0000 0000 00", "1" * 40]
PIECES = ["a@b.c", "@", "a.b+c%d_e-f@x-y.z.co", ".", "a@b", "@b.c", "a@b..c", "é@b.c", "1.2.3.4", "256.1.1.1", "001.2.3.0255", "1.2.3", "99999999999.1.1.1", "+1 (555) 010-9999", "+1", "+49 30 (0) 1.2.3-4 56789", "+ 1 2", "+123456789012345", "+12345678901234567", "(", ")", " ", "-", "\n", "é", "word", "٣٤٥٦٧٨٩٠١٢٣٤٥٦", *CARDS]


def test_base_spans_equal_the_contracts_forms():
    rng = random.Random(8)
    for n in range(4000):
        text = rng.choice(["", " "]).join(rng.choice(PIECES) for _ in range(rng.randrange(1, 9))) if n % 2 else "".join(rng.choice("a@.+1 -(9") for _ in range(rng.randrange(40)))
        assert sa.base_spans(text) == plain(text), text
    assert sa.base_spans(None) == sa.base_spans("") == []


@pytest.mark.parametrize("unit", ["a", "1", "1.", "a@", "@", "@b.", "+", "+1", "+1 ", "1 ", "1-", "a@b.c", "(", "+1(", "255."])
def test_time_is_linear_in_the_text(unit):
    def seconds(n):
        text, began = unit * n, time.process_time()
        sa.neighbourhoods(text)
        return time.process_time() - began

    seconds(1000)
    assert min(seconds(100_000) for _ in range(2)) < 6 * min(seconds(50_000) for _ in range(2)) + 0.1  # the square would be well over a second


def corpus():
    """A person whose name and file number stand next to a mail address in several texts; copies; a word near it everywhere; and odd rows."""
    rng = random.Random(3)
    texts = [f"{prose(rng, 30)} Quillfeather Zx-{7000 + i % 2} wrote the {'mail ' * 3} jane@corp.example {prose(rng, 30)}" for i in range(6)]
    texts += [f"{prose(rng, 25)} Quillfeather {prose(rng, 5)}" for _ in range(3)]  # half of the name's texts or more hold the entity
    texts += [f"once Rareword near +1 (555) 010-{i:04} and more {prose(rng, 20)}" for i in range(4)]  # four entities, one text each
    texts += [f"same copy Hapaxword 10.0.0.1 {prose(rng, 3)}"] * 9
    texts += ["ends with 4111 1111 1111 1111", "1.2.3.4 first Quillfeather"]
    own = [(i, t, None, None, len(t), None, None, None, None, None) for i, t in enumerate(texts, 5000)]
    return own + odd_rows(9, 50)


def expected(rows, window=10, support=3, residue=1.0):
    """The terms that exceed the threshold with what they become, counted in plain Python over distinct texts."""
    texts = {r[1] for r in rows if r[1] is not None}
    near, contexts, n_e, n_t = defaultdict(set), defaultdict(set), defaultdict(set), defaultdict(set)
    form = lambda w: re.sub("[0-9]", "#", w)
    for t in texts:
        base = plain(t)
        words = [(m[0].lower(), *m.span()) for m in re.finditer(r"\w+", t)]
        for w, _, _ in words:
            n_t[w].add(t)
            n_t[form(w)].add(t)
        free = [w for w in words if not any(a < w[2] and w[1] < b for _, a, b in base)]
        for kind, a, b in base:
            value = t[a:b].lower() if kind in ("email", "ip") else "".join(c for c in t[a:b] if c in "0123456789")
            e = (kind, value)
            n_e[e].add(t)
            by = [w[0] for w in [w for w in free if w[2] <= a][-window:] + [w for w in free if w[1] >= b][:window]]
            for w in set(by) | {form(w) for w in by}:
                near[e, w].add(t)
                contexts[e, w].add(tuple(by))
    n, over = len(texts), set()
    for (e, w), found in near.items():
        information = math.log2(n / len(n_e[e]))
        pmi = math.log2(n * len(found) / (len(n_e[e]) * len(n_t[w])))
        if len(contexts[e, w]) >= support and pmi >= information - residue - 1e-9:
            over.add(w)
    return {w: form(w) if form(w) != w and form(w) not in over else None for w in over if "#" not in w}


def digest(rows, terms):
    out = []
    for r in rows:
        base, text = plain(r[1]), r[1] or ""
        added = [("term", *m.span()) for m in re.finditer(r"\w+", text) if m[0].lower() in terms and not any(a < m.end() and m.start() < b for _, a, b in base)]
        order = ["email", "ip", "card", "phone", "term"]
        every = sorted(base + added, key=lambda s: (s[1], order.index(s[0]), s[2]))
        line = lambda found: ",".join(f"{k}:{a}:{b}" for k, a, b in found)
        out.append((r[0], *(sum(s[0] == k for s in every) for k in order), hashlib.sha256(line(base).encode()).hexdigest(), line(every)))
    return sorted(out, key=str)


def test_query_equals_brute_force(spark):
    rows = corpus()
    terms = expected(rows)
    assert "quillfeather" in terms and "hapaxword" not in terms and "rareword" not in terms and "the" not in terms
    got = sorted(map(tuple, sa.private_documents(spark.createDataFrame(rows, DOCS).repartition(4)).collect()), key=str)
    assert got == digest(rows, terms)


@pytest.mark.parametrize(("window", "support", "residue", "bits"), [(10, 3, 1.0, 22), (3, 2, 2.0, 22), (20, 1, 0.0, 5)])
def test_disclosing_terms_equal_brute_force(spark, window, support, residue, bits):
    rows = corpus()
    found = sa.disclosures(spark.createDataFrame(rows, DOCS).select("text").repartition(3), window=window, support=support, residue=residue, bits=bits)
    got = {r.term: r.becomes for r in sa.revealing(found).collect()}
    assert got == expected(rows, window, support, residue)


def test_bits_shared_by_other_words_do_not_count(spark):
    rows = [(i, f"word{i} other text {i}") for i in range(50)]
    terms = spark.createDataFrame([("word7", None), ("text", "t")], "term string, becomes string")
    got = sa.with_spans(spark.createDataFrame(rows, "doc_id int, text string"), terms, bits=5).collect()
    assert {r.doc_id: [(s.start, s.becomes) for s in r.spans] for r in got} == {i: ([(0, None)] if i == 7 else []) + [(rows[i][1].index("text"), "t")] for i in range(50)}


def test_sanitise_generalises_and_removes(spark):
    rng = random.Random(2)
    texts = [f"{prose(rng, 12)} Quillfeather badge77{i % 2} x{i} mail: j@corp.example {prose(rng, 12)}" for i in range(6)]
    rows = [(i, t, {"a": 1}) for i, t in enumerate([*texts, *[f"badge{i}{i}{i} other {prose(rng, 9)}" for i in range(9)], None, "", "clean text", *[prose(rng, 60) for _ in range(20)]])]
    got = {r.doc_id: r.text for r in sa.sanitise(spark.createDataFrame(rows, "doc_id int, text string, m map<string,int>"), support=3).collect()}
    assert len(got) == len(rows) and got[15] is None and got[16] == "" and got[17] == "clean text"
    for i in range(6):
        assert "Quillfeather" not in got[i] and "[email]" in got[i] and "badge###" in got[i] and "badge77" not in got[i]
    assert all(got[i] == rows[i][1] for i in range(6, len(rows)))


def test_no_rows_and_no_private_rows(spark):
    assert sa.private_documents(spark.createDataFrame([], DOCS)).collect() == []
    got = sa.private_documents(spark.createDataFrame([(1, "nothing here"), (None, None)], "doc_id bigint, text string")).collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert sorted(map(tuple, got), key=str) == [(1, 0, 0, 0, 0, 0, empty, ""), (None, 0, 0, 0, 0, 0, empty, "")]
