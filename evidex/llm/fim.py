"""Fill-in-the-middle samples, cut at line ends that are found through memoised content-defined chunks.

A text's bytes are cut into chunks where a rolling hash of the last 32 bytes has its low bits zero, so a passage that recurs in other texts falls into the same
chunks wherever it stands. What a chunk contributes is kept in its boundary summary: bytes, code points, where its lines end, its first and last two bytes and whether it
holds a control string. Summaries are remembered in a task by the chunk's content, which a hit is compared with, so that a shared chunk is scanned once; the memory holds a
bounded number of bytes and forgets the oldest. Adding up the summaries gives a text's lines and code points, and the chunk in which the k-th line ends; no text is
split into lines.

Defined results: a null text is empty; an empty text, one that holds a control string and one whose draw is at or beyond ``rate`` stay plain; a null key is drawn as an empty
one; equal keys are drawn alike, whatever their text; a table without rows gives none; own columns of the names of new ones are replaced.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_bytes

#: The control strings before prefix, suffix and middle, the seed of the draws, and the percentages of texts that are cut and of those in suffix-first order.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, RATE, SUFFIX_FIRST = 7, 100, 50
LEAST, MOST, MEAN_BITS = 256, 8192, 10
REMEMBERED, SLICE = 16 << 20, 4 << 20

_GEAR = np.random.default_rng(12).integers(0, 1 << 32, 256, dtype=np.uint32)
_MARKS = tuple(m.encode() for m in (PREFIX, SUFFIX, MIDDLE))


class Summary(NamedTuple):
    """What a run of bytes contributes: its size, code points, ends of its lines, first and last two bytes, and whether a control string lies in it."""

    size: int
    chars: int
    breaks: np.ndarray
    head: bytes
    tail: bytes
    marked: bool


def summarise(content: bytes) -> Summary:
    body = np.frombuffer(content, np.uint8)
    return Summary(len(content), _chars(body), np.flatnonzero(body == 10) + 1, content[:2], content[-2:], any(m in content for m in _MARKS))


def _chars(body: np.ndarray) -> int:
    return int(np.count_nonzero((body & 0xC0) != 0x80))


class Memo:
    """Summaries by content, up to ``limit`` bytes of contents."""

    def __init__(self, limit: int = REMEMBERED) -> None:
        self.limit, self.held, self.hits = limit, 0, 0
        self.known: dict[bytes, Summary] = {}

    def __call__(self, content: bytes) -> Summary:
        found = self.known.get(content)
        if found is not None:
            self.hits += 1
            return found
        found = self.known[content] = summarise(content)
        self.held += len(content)
        while self.held > self.limit and len(self.known) > 1:
            oldest = next(iter(self.known))
            del self.known[oldest]
            self.held -= len(oldest)
        return found


def boundaries(body: np.ndarray, bits: int = MEAN_BITS) -> list[int]:
    """Places after which the hash of the last 32 bytes has ``bits`` low bits of zero, ascending."""
    h, width = _GEAR[body], 1
    while width < 32:
        wider = h.copy()
        wider[width:] += h[:-width] << np.uint32(width)
        h, width = wider, 2 * width
    # The low bits of a gear hash see the last bytes only; those of the top see all 32.
    return (np.flatnonzero((h >> np.uint32(32 - bits)) == 0) + 1).tolist()


def chunk_ends(found: list[int], start: int, end: int, least: int = LEAST, most: int = MOST) -> list[int]:
    """Ends of the chunks of [start, end): at boundaries, none shorter than ``least`` but the last, none longer than ``most``."""
    ends, last, i = [], start, 0
    while last < end:
        i = bisect_left(found, last + least, i)
        last = min(found[i] if i < len(found) else end, last + most, end)
        ends.append(last)
    return ends


class Cut(NamedTuple):
    size: int
    chars: int


class Chunked:
    """A text as its chunks' summaries."""

    def __init__(self, text: bytes, parts: list[Summary]) -> None:
        self.text, self.parts = text, parts
        self.breaks = sum(len(p.breaks) for p in parts)
        self.lines = self.breaks + (bool(text) and text[-1:] != b"\n")
        self.chars = sum(p.chars for p in parts)

    def marked(self) -> bool:
        """Whether a control string lies in a chunk or across chunks' edges."""
        edge = b""
        for p in self.parts:
            if p.marked or any(m in edge + p.head for m in _MARKS):
                return True
            edge = (edge + p.tail if p.size < 2 else p.tail)[-2:]
        return False

    def after(self, lines: int) -> Cut:
        """Where so many lines end."""
        if lines > self.breaks:
            return Cut(len(self.text), self.chars)
        at = chars = 0
        if lines:
            for p in self.parts:
                if lines <= len(p.breaks):
                    inside = int(p.breaks[lines - 1])
                    return Cut(at + inside, chars + _chars(np.frombuffer(self.text, np.uint8, inside, at)))
                lines, at, chars = lines - len(p.breaks), at + p.size, chars + p.chars
        return Cut(0, 0)


def chunked(body: np.ndarray, at: np.ndarray, memo: Memo) -> Iterator[Chunked]:
    """The texts of body[at[i] : at[i + 1]] in order; hashes are made for a few MB at a time."""
    i = 0
    while i < len(at) - 1:
        j = i + 1
        while j < len(at) - 1 and at[j + 1] - at[i] <= SLICE:
            j += 1
        base = int(at[i])
        held = body[base : int(at[j])]
        found, raw = boundaries(held), held.tobytes()
        for k in range(i, j):
            start, end = int(at[k]) - base, int(at[k + 1]) - base
            parts, last = [], start
            for stop in chunk_ends(found, start, end):
                parts.append(memo(raw[last:stop]))
                last = stop
            yield Chunked(raw[start:end], parts)
        i = j


def sample(text: Chunked, draws: tuple[int, int, int, int], rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> tuple:
    """(n, form, prefix_chars, middle_chars, output bytes) of a text under its four draws."""
    n = text.lines
    if not text.text or draws[2] % 100 >= rate or text.marked():
        return n, "plain", None, None, text.text
    one, two = sorted((draws[0] % (n + 1), draws[1] % (n + 1)))
    first, second = text.after(one), text.after(two)
    prefix, middle, suffix = text.text[: first.size], text.text[first.size : second.size], text.text[second.size :]
    p, s, m = _MARKS
    spm = draws[3] % 100 < suffix_first
    output = s + suffix + p + prefix + m + middle if spm else p + prefix + s + suffix + m + middle
    return n, "spm" if spm else "psm", first.chars, second.chars - first.chars, output


SAMPLE = "n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"


def fill_in_middle(docs: DataFrame, *, key: str = "doc_id", text: str = "text", out: str = "fim", seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """docs with a column ``out``: struct<n, form, prefix_chars, middle_chars, output>."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    draws = [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("bigint") for i in range(4)]
    kind = pa.struct([("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])

    @F.arrow_udf(SAMPLE)
    def cut(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        memo = Memo()
        for texts, *drawn in batches:
            each = zip(*(d.to_pylist() for d in drawn), strict=True)
            rows = [sample(t, d, rate, suffix_first) for t, d in zip(chunked(*text_bytes(texts), memo), each, strict=True)]
            n, form, prefix, middle, output = zip(*rows, strict=True) if rows else ((),) * 5
            columns = [pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.binary()).cast(pa.string())]
            yield pa.StructArray.from_arrays(columns, fields=list(kind))

    return docs.withColumn(out, cut(F.coalesce(F.col(text), F.lit("")), *draws))


def restore(output: Column, form: Column) -> Column:
    """The text that became ``output``."""
    part = F.split(output, "<[PSM]>", -1)
    return F.when(form == "plain", output).when(form == "psm", F.concat(part[1], part[3], part[2])).otherwise(F.concat(part[2], part[3], part[1]))


def fim_documents(docs: DataFrame) -> DataFrame:
    rows = fill_in_middle(docs.select("doc_id", "text"))
    fim = F.col("fim")
    return rows.select(
        "doc_id", fim["n"].alias("n"), fim["form"].alias("form"), fim["prefix_chars"].alias("prefix_chars"), fim["middle_chars"].alias("middle_chars"), F.sha2(fim["output"], 256).alias("output_sha256"),
        F.sha2(restore(fim["output"], fim["form"]), 256).alias("restored_sha256"),
    )


SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), k AS (
  SELECT *, len(u) AS n, ('0x' || substr(h, 1, 8))::BIGINT % (len(u) + 1) AS k1, ('0x' || substr(h, 9, 8))::BIGINT % (len(u) + 1) AS k2,
    ('0x' || substr(h, 17, 8))::BIGINT % 100 AS k3, ('0x' || substr(h, 25, 8))::BIGINT % 100 AS k4 FROM d
), f AS (
  SELECT *, coalesce(array_to_string(u[1:least(k1, k2)], ''), '') AS p, coalesce(array_to_string(u[least(k1, k2) + 1:greatest(k1, k2)], ''), '') AS m,
    coalesce(array_to_string(u[greatest(k1, k2) + 1:], ''), '') AS s,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR k3 >= 100 THEN 'plain' WHEN k4 < 50 THEN 'spm' ELSE 'psm' END AS form FROM k
)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM f
"""
