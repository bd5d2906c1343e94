"""Personal data found by form, and terms that give it away found by what they disclose.

Base spans are e-mail addresses, IPv4 addresses, payment cards and phone numbers. Each distinct value is a protected entity. A term is a word, lower-cased; a word with digits also counts as its general form,
with ``#`` for each digit. The corpus tells how strongly a term reveals an entity: with N distinct texts, of which n_e hold the entity, n_t the term, and n_et the term within ``WINDOW`` words of the
entity, the entity's information is log2(N / n_e) and the term discloses log2(N n_et / (n_e n_t)) of it. A term that leaves at most ``RESIDUE`` bits (one: whoever sees
the term is right about the entity at least every other time) and does so in ``SUPPORT`` different neighbourhoods or more exceeds the threshold, wherever it stands. It is generalised to its general form, unless that
exceeds the threshold too, or removed.

Copies of a text count once, and so do copies of a neighbourhood, so that groups of copies disclose nothing by themselves. Only terms seen near an entity are counted over the corpus: they set bits of
a table of fixed size, texts give the words whose bits are set, and joins by term remove what only shares a bit. Texts are never exchanged.

Defined results: a null text is empty and has no spans; matches that fail their check are dropped and not retried; spans are in code points; terms that overlap a base span aren't spans; equal spans of other kinds
stay side by side; a table without rows gives none; other columns are kept by ``sanitise`` and clash with nothing.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import unpacked, written

#: The kinds in their order, and the forms of the base spans.
KINDS = ("email", "ip", "card", "phone", "term")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT, WORD = re.compile("[0-9]"), re.compile(r"\w+")
WINDOW, SUPPORT, RESIDUE = 10, 3, 1.0
TABLE_BITS = 22

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[Span]:
    """From each ``@`` with a domain, back over the local part, but not into an earlier match or ``@``: the leftmost matches in time linear in the text."""
    free, at = 0, text.find("@")
    while at >= 0:
        domain = DOMAIN.match(text, at)
        if domain:
            before = text[free:at]
            local = len(before) - len(before.rstrip(LOCAL))
            if local:
                yield "email", at - local, domain.end()
                free = domain.end()
        free = max(free, at + 1)
        at = text.find("@", at + 1)


def base_spans(text: str | None) -> list[Span]:
    """The base spans by start, then kind."""
    if not text:
        return []
    out: list[Span] = list(emails(text))
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        if 14 <= m.end() - m.start() <= 37 and 14 <= len(digits := "".join(DIGIT.findall(m[0]))) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= len(DIGIT.findall(m[0])) <= 15:
                out.append(("phone", *m.span()))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def entity(kind: str, value: str) -> str:
    return f"{kind}:{value.lower()}" if kind in ("email", "ip") else f"{kind}:{''.join(DIGIT.findall(value))}"


def general(term: str) -> str | None:
    return re.sub("[0-9]", "#", term) if DIGIT.search(term) else None


def free_words(text: str, base: list[Span]) -> list[tuple[str, int, int]]:
    """(term, start, end) of the words that overlap no base span."""
    out, covered, k = [], 0, 0
    spans = sorted((a, b) for _, a, b in base)
    for m in WORD.finditer(text):
        a, b = m.span()
        while k < len(spans) and spans[k][0] < b:
            covered, k = max(covered, spans[k][1]), k + 1
        if covered <= a:
            out.append((m[0].lower(), a, b))
    return out


def neighbourhoods(text: str | None, window: int = WINDOW) -> list[tuple[str, int, list[str]]]:
    """(entity, hash of its neighbourhood, terms in it) for each base span of a text."""
    base = base_spans(text)
    if not base or text is None:
        return []
    words = free_words(text, base)
    starts, out = [w[1] for w in words], []
    for kind, a, b in base:
        near = [w[0] for w in words[max(0, bisect_left(starts, a) - window) : bisect_left(starts, b) + window]]
        terms = set(near) | {g for w in near if (g := general(w))}
        out.append((entity(kind, text[a:b]), xxhash.xxh64_intdigest("\n".join(near)) - (1 << 63), sorted(terms)))
    return out


def spread(rows: DataFrame, text: str, window: int) -> DataFrame:
    """(entity, context, terms, digest) of every base span of rows."""
    kind = pa.list_(pa.struct([("entity", pa.string()), ("context", pa.int64()), ("terms", pa.list_(pa.string()))]))

    @F.arrow_udf("array<struct<entity:string,context:bigint,terms:array<string>>>")
    def near(texts: pa.Array) -> pa.Array:
        return pa.array([[{"entity": e, "context": c, "terms": t} for e, c, t in neighbourhoods(x, window)] for x in texts.to_pylist()], kind)

    found = rows.select(F.md5(text).alias("digest"), near(F.col(text)).alias("near"))
    return found.select("digest", F.explode("near").alias("n")).select("digest", "n.entity", "n.context", "n.terms")


def _bit(term: Column, bits: int) -> Column:
    return F.xxhash64(term).bitwiseAND(F.lit((1 << bits) - 1))


def bit_table(terms: DataFrame, bits: int = TABLE_BITS) -> bytes:
    """A table of 2**bits bits, of which those of the terms are set; at most 2**(bits - 5) numbers reach the driver, whatever the terms' number."""
    slots = terms.select(_bit(F.col("term"), bits).alias("b")).groupBy(F.shiftright("b", 5).alias("slot")).agg(F.expr("bit_or(shiftleft(1L, cast(b & 31 as int)))").alias("word"))
    table = bytearray(1 << (bits - 3))
    for r in slots.toLocalIterator():
        table[4 * r["slot"] : 4 * r["slot"] + 4] = int(r["word"]).to_bytes(4, "little")
    return bytes(table)


class Known:
    """Whether a term's bit is set; answers are remembered up to a bounded number."""

    def __init__(self, table: bytes, bits: int = TABLE_BITS, limit: int = 200_000) -> None:
        self.table, self.mask, self.limit = table, (1 << bits) - 1, limit
        self.answers: dict[str, bool] = {}

    def __call__(self, term: str) -> bool:
        known = self.answers.get(term)
        if known is None:
            if len(self.answers) >= self.limit:
                self.answers.clear()
            b = xxhash.xxh64_intdigest(term.encode("utf-8", "surrogatepass"), seed=42) & self.mask  # what Spark's xxhash64 gives
            known = self.answers[term] = bool(self.table[b >> 3] >> (b & 7) & 1)
        return known


def _terms_of(text: str, known: Callable[[str], bool]) -> list[str]:
    terms = {w.lower() for w in set(WORD.findall(text))}
    terms |= {g for t in terms if (g := general(t))}
    return [t for t in terms if known(t)]


def counted(rows: DataFrame, text: str, terms: DataFrame, bits: int = TABLE_BITS) -> DataFrame:
    """(term, n_t): in how many distinct texts of rows each of the terms, or its general form, stands."""
    shared = rows.sparkSession.sparkContext.broadcast(bit_table(terms, bits))

    @F.arrow_udf("array<string>")
    def within(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = Known(shared.value, bits)
        for texts in batches:
            yield pa.array([_terms_of(t, known) if t else [] for t in texts.to_pylist()], pa.list_(pa.string()))

    found = rows.select(F.md5(text).alias("digest"), F.explode(within(F.col(text))).alias("term")).distinct()
    return found.groupBy("term").agg(F.count("*").alias("n_t")).join(terms, "term", "left_semi")


def disclosures(rows: DataFrame, *, text: str = "text", window: int = WINDOW, support: int = SUPPORT, residue: float = RESIDUE, bits: int = TABLE_BITS) -> DataFrame:
    """(term, entity, n_et, n_t, n_e, contexts, pmi, information, exceeds) of the terms seen near an entity in ``support`` different neighbourhoods that may exceed the threshold."""
    near = written(spread(rows, text, window), "neighbourhoods")
    held = near.groupBy("entity", "digest").agg(F.count("*").alias("_")).groupBy("entity").agg(F.count("*").alias("n_e"))
    pairs = near.select("entity", "digest", "context", F.explode("terms").alias("term"))
    texts = pairs.select("entity", "term", "digest").distinct().groupBy("entity", "term").agg(F.count("*").alias("n_et"))
    contexts = pairs.select("entity", "term", "context").distinct().groupBy("entity", "term").agg(F.count("*").alias("contexts")).where(F.col("contexts") >= support)
    # A term stands in at least the texts where it is near any entity, so pairs that these rule out need no count over the corpus.
    around = pairs.select("term", "digest").distinct().groupBy("term").agg(F.count("*").alias("least"))
    often = contexts.join(texts, ["entity", "term"]).join(around, "term").where(F.log2(F.col("least") / F.col("n_et")) <= residue + 1e-9)
    often = written(often.drop("least"), "near-terms")
    n_t = counted(rows, text, often.select("term").distinct(), bits)
    n = float(rows.select(F.md5(text).alias("digest")).where("digest is not null").distinct().count())
    both = often.join(n_t, "term").join(held, "entity")
    information = F.log2(F.lit(n) / F.col("n_e"))
    pmi = F.log2(F.lit(n) * F.col("n_et") / (F.col("n_e") * F.col("n_t")))
    both = both.select("term", "entity", "n_et", "n_t", "n_e", "contexts", pmi.alias("pmi"), information.alias("information"))
    return written(both.withColumn("exceeds", F.col("pmi") >= F.col("information") - residue - 1e-9), "disclosures")


def revealing(found: DataFrame) -> DataFrame:
    """(term, becomes): the terms that exceed the threshold, and the general form that stands for each, null where it is removed."""
    over = found.where("exceeds").select("term").distinct()
    form = F.when(F.col("term").rlike("[0-9]"), F.regexp_replace("term", "[0-9]", "#"))
    words = over.where(~F.col("term").contains("#")).select("term", form.alias("form"))
    risky = over.select(F.col("term").alias("form"), F.lit(True).alias("risky"))
    return words.join(risky, "form", "left").select("term", F.when(F.col("risky").isNull(), F.col("form")).alias("becomes"))


FOUND = "array<struct<kind:string,start:bigint,end:bigint,term:string>>"


def with_spans(rows: DataFrame, terms: DataFrame, *, text: str = "text", bits: int = TABLE_BITS) -> DataFrame:
    """rows with ``spans``: array<struct<kind, start, end, becomes>> by start, then kind, and ``digest``, the text's md5; the text isn't kept."""
    shared = rows.sparkSession.sparkContext.broadcast(bit_table(terms, bits))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("term", pa.string())]))

    @F.arrow_udf(FOUND)
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = Known(shared.value, bits)
        for texts in batches:
            yield pa.array([_candidates(t, known) for t in texts.to_pylist()], kind)

    marked = written(rows.withColumn("digest", F.md5(text)).withColumn("spans", found(F.col(text))).drop(text), "spans")
    asked = marked.select("digest", F.explode(F.filter("spans", lambda s: s["kind"] == "term")).alias("s")).select("digest", F.col("s.term").alias("term")).distinct()
    exact = asked.join(terms, "term").groupBy(F.col("digest").alias("same")).agg(F.collect_list(F.struct("term", "becomes")).alias("exact"))
    both = marked.join(exact, F.col("digest") == F.col("same"), "left")
    of = F.map_from_entries(F.transform("exact", lambda t: F.struct(t["term"], F.struct(t["becomes"].alias("to")))))
    becomes = lambda s: F.when(s["kind"] == "term", F.try_element_at(of, s["term"])["to"])
    counts = lambda s: (s["kind"] != "term") | F.coalesce(F.array_contains(F.map_keys(of), s["term"]), F.lit(False))
    exactly = F.transform(F.filter("spans", counts), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), becomes(s).alias("becomes")))
    return both.withColumn("spans", exactly).drop("same", "exact")


def _candidates(text: str | None, known: Callable[[str], bool]) -> list[dict]:
    """The base spans, and the words whose bit is set."""
    base = base_spans(text)
    out = [{"kind": k, "start": a, "end": b, "term": None} for k, a, b in base]
    if text and any(known(w.lower()) for w in set(WORD.findall(text))):
        out += [{"kind": "term", "start": a, "end": b, "term": w} for w, a, b in free_words(text, base) if known(w)]
        out.sort(key=lambda s: (s["start"], KINDS.index(s["kind"]), s["end"]))
    return out


def sanitise(docs: DataFrame, *, text: str = "text", window: int = WINDOW, support: int = SUPPORT, residue: float = RESIDUE) -> DataFrame:
    """docs with base values replaced by their kind in brackets, and revealing terms by their general form or, where that reveals too or isn't there, by nothing."""
    narrow = docs.select(F.col(text).alias("text")).where("text is not null")
    terms = written(revealing(disclosures(narrow, window=window, support=support, residue=residue)), "revealing")
    by_text = with_spans(narrow, terms).where(F.size("spans") > 0).dropDuplicates(["digest"]).select(F.col("digest").alias("key"), "spans")
    rows = docs.select(F.struct("*").alias("row"), F.col(text).alias("body"))
    both = rows.join(by_text, F.md5("body") == F.col("key"), "left")

    @F.arrow_udf("string")
    def replaced(texts: pa.Array, spans: pa.Array) -> pa.Array:
        out = []
        for t, found in zip(texts.to_pylist(), spans.to_pylist(), strict=True):
            parts, at = [], 0
            for s in found or []:
                if s["start"] >= at:
                    parts += [t[at : s["start"]], (s["becomes"] or "") if s["kind"] == "term" else f"[{s['kind']}]"]
                at = max(at, s["end"])
            out.append("".join([*parts, t[at:]]) if found else t)
        return pa.array(out, pa.string())

    return unpacked(both.withColumn("body", replaced("body", "spans")), "row", docs.columns, {text: F.col("body")})


def private_documents(docs: DataFrame) -> DataFrame:
    """The query: counts and spans of every document."""
    rows = docs.select("doc_id", "text")
    terms = written(revealing(disclosures(rows)), "revealing")
    found = with_spans(rows, terms)
    line = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    base = F.filter("spans", lambda s: s["kind"] != "term")
    number = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")
    counts = [number(kind).alias(f"n_{kind}") for kind in KINDS]
    return found.select("doc_id", *counts, F.sha2(F.array_join(F.transform(base, line), ","), 256).alias("base_sha256"), F.array_join(F.transform("spans", line), ",").alias("spans"))
