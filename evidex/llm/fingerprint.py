"""Homomorphic multiset fingerprints of documents, in DataFrame functions only.

Every paragraph (line) of a text is hashed to a wide vector of 14-bit lanes, packed four to a 64-bit word with two guard bits, and the
vectors are summed lane by lane modulo 2^14. The sum doesn't depend on the paragraphs' order, and adding or subtracting a
paragraph's vector inserts or deletes it. ``EXACT`` words carry hashed lanes (equality: 32 lanes of 14 bits); ``SKETCH`` words count set
hash bits of the paragraph's phrases (up to four words), from which the inner products of two texts' phrase multisets, and so a likeness, follow
(tug of war: a lane's count c of n phrases stands for 2c - n). These lanes are 32 bits wide, two to a word,
and the phrase count has a word of its own, so neither wraps. 64 such lanes leave a likeness an error of about 0.1.

Defined results: a null text is empty, an empty text is one empty paragraph; equal texts have equal fingerprints; likeness is 1 for equal
fingerprints and an estimate in [0, 1] otherwise, for texts of any length.
Documents are ordered by doc_id (null first), then text (null first), so ties and repeated rows have a defined neighbour.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, unpacked

EXACT, SKETCH = 8, 32
LANES = 0x3FFF3FFF3FFF3FFF
ONES = 0x0001000100010001
WIDE = 0x0000000100000001
SENTENCE = r"(?<=[.!?])\s+"
PHRASE = r"\S+(?:\s+\S+){0,3}"


def add(a: Column, b: Column) -> Column:
    """Lane sums of two words modulo 2^14."""
    return (a + b).bitwiseAND(F.lit(LANES))


def negate(a: Column) -> Column:
    return add(F.lit(LANES) - a, F.lit(ONES))


def _each(a: Column, b: Column, exact: Callable[[Column, Column], Column], wide: Callable[[Column, Column], Column]) -> Column:
    """``exact`` of the words of 14-bit lanes, ``wide`` of the rest."""
    rest = lambda x: F.slice(x, EXACT + 1, SKETCH + 1)
    return F.concat(F.zip_with(F.slice(a, 1, EXACT), F.slice(b, 1, EXACT), exact), F.zip_with(rest(a), rest(b), wide))


def insert(fingerprint: Column, part: Column) -> Column:
    return _each(fingerprint, part, add, lambda a, b: a + b)


def delete(fingerprint: Column, part: Column) -> Column:
    return _each(fingerprint, part, lambda a, b: add(a, negate(b)), lambda a, b: a - b)


def paragraphs(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def phrase_hashes(paras: Column) -> Column:
    """Hashes of the phrases of all paragraphs: runs of up to four words, counted from the start of each sentence."""
    phrases = lambda s: F.regexp_extract_all(s, F.lit(PHRASE), F.lit(0))
    return F.flatten(F.transform(paras, lambda p: F.flatten(F.transform(F.split(p, SENTENCE), lambda s: F.transform(phrases(s), lambda x: F.xxhash64(F.lit("phrase"), x))))))


def sums(paras: Column, hashes: Column) -> Column:
    """The fingerprint as an array of EXACT + SKETCH + 1 words."""
    zero = F.lit(0).cast("bigint")

    def exact(j: int) -> Column:
        return F.aggregate(paras, zero, lambda acc, p: add(acc, F.xxhash64(F.lit(j), p).bitwiseAND(F.lit(LANES))))

    def sketch(i: int) -> Column:
        return F.aggregate(hashes, zero, lambda acc, h: acc + F.shiftrightunsigned(h, i).bitwiseAND(F.lit(WIDE)))

    return F.array(*map(exact, range(EXACT)), *map(sketch, range(SKETCH)), F.size(hashes).cast("bigint"))


def with_fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """df with a column ``out`` of words, which replaces one of that name; the arrays it goes through are projected once."""
    rows = df.select(F.struct("*").alias("row"), paragraphs(F.col(text)).alias("paras"))
    rows = rows.select("row", "paras", phrase_hashes(F.col("paras")).alias("hashes"))
    return unpacked(rows, "row", df.columns, {out: sums(F.col("paras"), F.col("hashes"))})


def as_text(fingerprint: Column) -> Column:
    return F.array_join(F.transform(fingerprint, lambda w: F.lower(F.lpad(F.hex(w), 16, "0"))), "")


def _lanes(fingerprint: Column) -> Column:
    words = F.slice(fingerprint, EXACT + 1, SKETCH)
    return F.flatten(F.transform(words, lambda w: F.array(w.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(w, 32))))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard likeness of the phrase multisets behind two fingerprints."""
    n = EXACT + SKETCH + 1
    size_a, size_b = F.element_at(a, n), F.element_at(b, n)
    gap = size_a - size_b

    def power(lanes: Column, size: Column) -> Column:
        return F.aggregate(lanes, F.lit(0.0), lambda acc, c: acc + F.pow(2.0 * c - size, 2.0))

    apart = F.aggregate(F.zip_with(_lanes(a), _lanes(b), lambda x, y: F.pow(2.0 * (x - y) - gap, 2.0)), F.lit(0.0), lambda acc, x: acc + x)
    both = power(_lanes(a), size_a) + power(_lanes(b), size_b)
    shared = (both - apart) / 2
    return F.when(a == b, F.lit(1.0)).otherwise(F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.try_divide(shared, both - shared))), F.lit(0.0)))


def with_next(df: DataFrame, key: str, text: str, carried: list[str], out: str, buckets: int | None = None) -> DataFrame:
    """df with a struct ``out`` of the next row's ``carried`` columns, by key then text; the last row gets the first row's.

    Rows are dealt to key ranges whose bounds are keys that occur; the rows at a bound also go, as look-ahead, to the range before (the
    first key's to the last range), so one exchange gives every range its successor and no task sees more than one range.
    """
    k = F.coalesce(F.col(key).cast("bigint"), F.lit(-(1 << 63)))
    n = buckets or 4 * partitions(df.sparkSession)
    found = df.select(k.alias("k")).agg(F.min("k").alias("least"), F.percentile_approx("k", [i / n for i in range(1, n)] or [0.5], max(10_000, 10 * n)).alias("cuts")).first()
    bounds = sorted({found["least"], *(found["cuts"] or [])} - {None}) or [0]
    array = F.array(*[F.lit(b) for b in bounds]) if len(bounds) < 64 else F.expr("from_json('" + str(bounds) + "', 'array<bigint>')")
    steps = max(1, (len(bounds) - 1).bit_length())
    own = F.aggregate(
        F.array(*[F.lit(1 << s) for s in reversed(range(steps))]),
        F.lit(0),
        lambda lo, step: F.when((lo + step < len(bounds)) & (F.get(array, lo + step) <= F.col("k")), lo + step).otherwise(lo),
    )
    rows = df.select(F.struct("*").alias("row"), k.alias("k")).withColumn("own", own)
    ahead = F.when(F.get(array, F.col("own")) == F.col("k"), F.pmod(F.col("own") - 1, F.lit(len(bounds))))
    places = F.filter(F.array(F.struct(F.col("own").alias("b"), F.lit(0).alias("ahead")), F.struct(ahead.alias("b"), F.lit(1).alias("ahead"))), lambda p: p["b"].isNotNull())
    dealt = rows.select("row", "k", F.explode(places).alias("at")).select("row", "k", "at.b", "at.ahead")
    order = Window.partitionBy("b").orderBy("ahead", "k", F.col("row").getField(text))
    after = F.lead(F.struct(*[F.col("row").getField(c).alias(c) for c in carried])).over(order)
    return unpacked(dealt.withColumn("after", after).where(F.col("ahead") == 0), "row", df.columns, {out: F.col("after")})


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every document."""
    rows = with_fingerprint(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("body")), "body", "own")
    rows = with_next(rows, "doc_id", "body", ["body", "own"], "next")
    n = F.char_length("body")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("body"), F.lit(1), n - half), F.substring(F.col("next.body"), F.lit(1), half))
    rows = with_fingerprint(rows.select("doc_id", n.cast("bigint").alias("n_chars"), edited.alias("edited"), "own", F.col("next.own").alias("following")), "edited", "changed")
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("own")).alias("fingerprint"),
        as_text(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"),
        likeness(F.col("own"), F.col("following")).alias("near_next"),
    )
