"""Conversation repair as shortest paths, found by the auction algorithm.

A conversation is a lattice: node (i, q) has i rows read and q written last (nothing, system, user or assistant). Arcs delete, keep or rerole the next row, or insert an empty
turn, at integer costs. The auction keeps a price on every node that never exceeds the cost from it to the end, and a path from the first node: the path is extended along
the arc of least cost plus price while that sum equals its last node's price; else the price is raised to that sum and the path contracted. When the path arrives, prices on it
are the true costs; the arcs on which a price equals cost plus next price are tight, and following the tight arc of least letter gives the least audit among the cheapest ones
(an arc that isn't tight by prices that only rise never becomes so).

Rows are dealt by ranges of (conversation, turn, role, text hash), so that a conversation of any length is spread over tasks, and numbered there. Runs of up to 64 rows make a block. Blocks
are solved apart: first the least costs between the states at their edges, then, once these are added up from the end of the conversation (a few numbers a block), the
block's own prices and letters from each state, of which one is chosen from the start. A lattice of 64 rows bounds the auction's steps, so time grows with the rows. Only digests of
a whole conversation read its rows in one task, streaming.

Defined results: null roles and texts are one space; null turns come first; rows of equal turn are ordered by role and then by the text's md5; equal rows are duplicates; a null key
is one conversation; a conversation without rows is legal as it is; tables without rows give none; further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from evidex.operators.folds import fold_rows

from .common import partitions, written

#: Costs of the edits, and the roles that may be written.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
ROLES = ("user", "assistant")
NOTHING, SYSTEM, USER, REPLY = range(4)
FINE, MUST_GO, CUT_SHORT = range(3)
BLOCK = 64
FAR = 1 << 40
#: What it costs to end in each state, and the letters that do it.
END, TAIL = (0, 2 * INSERT, INSERT, 0), ("", "II", "I", "")

Arc = tuple[str, int, int, int]


def _arcs(kind: int, fault: int, q: int) -> tuple[Arc, ...]:
    """(letter, cost, rows read, next state) of the arcs of a node whose next row is of a kind (0: another role) and fault, by letter."""
    due = REPLY if q == USER else USER
    out: list[Arc] = [("D", DELETE, 1, q), ("I", INSERT, 0, due)]
    if fault != MUST_GO:
        more = TRUNCATED if fault == CUT_SHORT else 0
        if kind == due or kind == SYSTEM and q == NOTHING:
            out.append(("K", KEEP + more, 1, kind))
        if kind != due:
            out.append(("R", REROLE + more, 1, due))
    return tuple(out)


#: By code (3 * kind + fault) and state.
ARCS = tuple(tuple(_arcs(code // 3, code % 3, q) for q in range(4)) for code in range(12))
_LEAST = tuple(min(a[1] for q in arcs for a in q if a[2]) for arcs in ARCS)


def first_prices(codes: Sequence[int], ends: Sequence[int]) -> list[int]:
    """Prices that exceed no cost: the least costs of the rows that are left, whatever the roles."""
    prices = list(ends)
    low = min(ends)
    for code in reversed(codes):
        low += _LEAST[code]
        prices[:0] = [low] * 4
    return prices


def auction(codes: Sequence[int], prices: list[int], origin: int, limit: int) -> int:
    """The least cost from the state ``origin`` before the first row; raises prices until a path arrives. FAR if there is none of at most ``limit``."""
    last, path = 4 * len(codes), [origin]
    while path[-1] < last:
        node = path[-1]
        i, q = divmod(node, 4)
        best, to = FAR, -1
        for _, cost, read, state in ARCS[codes[i]][q]:
            there = 4 * (i + read) + state
            if cost + prices[there] < best:
                best, to = cost + prices[there], there
        if prices[node] < best:
            prices[node] = best
            if len(path) > 1:
                path.pop()
            elif best > limit:
                return FAR
        else:
            path.append(to)
    return prices[origin] if prices[origin] <= limit else FAR


def trace(codes: Sequence[int], prices: list[int], origin: int) -> tuple[str, int]:
    """(letters, last state) along the tight arcs of least letter."""
    letters, i, q = [], 0, origin
    while i < len(codes):
        here = prices[4 * i + q]
        letter, _, read, q = next(a for a in ARCS[codes[i]][q] if here == a[1] + prices[4 * (i + a[2]) + a[3]])
        letters.append(letter)
        i += read
    return "".join(letters), q


def _limit(codes: Sequence[int], ends: Sequence[int]) -> int:
    """More than any path costs that exists: all rows deleted, two turns inserted, and the dearest end."""
    return DELETE * len(codes) + 3 * INSERT + max(e for e in ends if e < FAR)


def block_costs(codes: Sequence[int]) -> list[int]:
    """Least costs from each state before a block to each after it, FAR where there is no way; 16 numbers."""
    out = [FAR] * 16
    for to in range(4):
        ends = [0 if q == to else FAR for q in range(4)]
        prices = first_prices(codes, ends)
        for q in range(4):
            out[4 * q + to] = auction(codes, prices, q, _limit(codes, ends))
    return out


def block_letters(codes: Sequence[int], ends: Sequence[int]) -> list[tuple[str, int]]:
    """(letters, last state) of a block from each state before it, given the costs of ending in each state after it; ("", -1) where there is no way."""
    prices, out = first_prices(codes, ends), []
    for q in range(4):
        reached = auction(codes, prices, q, _limit(codes, ends)) < FAR
        out.append(trace(codes, prices, q) if reached else ("", -1))
    return out


def repair_codes(codes: Sequence[int]) -> tuple[int, str]:
    """(cost, audit) of a short conversation in one piece."""
    prices = first_prices(codes, END)
    cost = auction(codes, prices, NOTHING, _limit(codes, END))
    letters, q = trace(codes, prices, NOTHING)
    return cost, letters + TAIL[q]


def blank(text: Column) -> Column:
    return ~text.rlike(r"[^\x20\x09-\x0D]")


def cut_short(text: Column) -> Column:
    return ~text.rlike(r"[.!?][\x20\x09-\x0D]*\z")


def number_rows(rows: DataFrame, n: int, block: int) -> DataFrame:
    """rows (k, turn, role, text) in order within partitions by ranges, with the partition, the place in it and the number of the block."""
    kind = rows.select("*", F.lit(0).alias("part"), F.lit(0).cast("bigint").alias("seq"), F.lit(0).cast("bigint").alias("block")).schema
    arrow = to_arrow_schema(kind)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        seq = at = -1
        key, inside = object(), 0
        for batch in batches:
            seqs, blocks = [], []
            for k in batch.column("k").to_pylist():
                seq += 1
                if k != key or inside == block:
                    key, inside, at = k, 0, at + 1
                inside += 1
                seqs.append(seq)
                blocks.append(at)
            columns = [*batch.columns, pa.array([part] * batch.num_rows, pa.int32()), pa.array(seqs, pa.int64()), pa.array(blocks, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    order = [F.col("k"), F.col("turn").asc_nulls_first(), F.col("role"), F.md5("text")]
    return rows.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(number, kind)


def with_faults(turns: DataFrame) -> DataFrame:
    """turns with ``fault`` (blank, duplicate, truncated or null): a row is a duplicate if role and text were seen earlier in its conversation."""
    digest = F.md5("text")
    narrow = turns.select("k", "turn", "role", digest.alias("digest"), "part", "seq", "block", blank(F.col("text")).alias("blank"), cut_short(F.col("text")).alias("cut"))
    seen = narrow.groupBy(F.col("k").alias("k2"), F.col("role").alias("role2"), F.col("digest").alias("digest2")).agg(F.min(F.struct("part", "seq")).alias("first"))
    both = narrow.join(seen, F.col("k").eqNullSafe(F.col("k2")) & (F.col("role") == F.col("role2")) & (F.col("digest") == F.col("digest2")))
    fault = F.when(F.col("blank"), "blank").when(F.struct("part", "seq") > F.col("first"), "duplicate").when(F.col("cut"), "truncated")
    return both.select("k", "turn", "role", "part", "seq", "block", fault.alias("fault"))


def row_code() -> Column:
    initial, kind = F.substring("role", 1, 1), F.lit(0)
    for letter, k in (("s", SYSTEM), ("u", USER), ("a", REPLY)):
        kind = F.when(initial == letter, k).otherwise(kind)
    return 3 * kind + F.when(F.col("fault").isin("blank", "duplicate"), MUST_GO).when(F.col("fault") == "truncated", CUT_SHORT).otherwise(FINE)


def chosen_edits(faults: DataFrame) -> DataFrame:
    """One row an edit of each conversation: k, part, seq, sub (order), edit, as_role (of rerole and insert)."""
    key = faults.schema["k"].dataType.simpleString()
    blocks = faults.groupBy("k", "part", "block").agg(F.min("seq").alias("start"), F.sort_array(F.collect_list(F.struct("seq", row_code().alias("code")))).alias("x"))
    blocks = blocks.select("k", "part", "block", "start", F.transform("x", lambda r: r["code"]).alias("codes"), (-F.col("part")).alias("part_back"), (-F.col("block")).alias("block_back"))

    def each(frame: DataFrame, schema: str, make: Any) -> DataFrame:
        kind = to_arrow_schema(frame.sparkSession.createDataFrame([], schema).schema)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_pylist([make(row) for row in batch.to_pylist()], schema=kind)

        return frame.mapInArrow(run, schema)

    place = f"k {key}, part int, block bigint, start bigint, codes array<int>"
    costs = each(blocks, place + ", part_back int, block_back bigint, costs array<bigint>", lambda r: r | {"costs": block_costs(r["codes"])})

    def back(ends: list[list[int]], r: dict[str, Any]) -> list[tuple]:
        after = ends[0]
        ends[0] = [min(FAR, *(r["costs"][4 * q + to] + after[to] for to in range(4))) for q in range(4)]
        return [(r["k"], r["part"], r["block"], r["start"], r["codes"], after)]

    priced = fold_rows(costs, ["k"], ["part_back", "block_back"], place + ", ends array<bigint>", lambda: [list(END)], back)
    letters = each(priced, place + ", ways array<struct<letters:string,state:int>>", lambda r: r | {"ways": [{"letters": a, "state": q} for a, q in block_letters(r["codes"], r["ends"])]})

    def forth(state: list[int], r: dict[str, Any]) -> list[tuple]:
        way = r["ways"][state[0]]
        out, seq, sub, q = [], r["start"], 0, state[0]
        for letter in way["letters"]:
            due = REPLY if q == USER else USER
            out.append((r["k"], r["part"], seq, sub, letter, ROLES[due - USER] if letter in "IR" else None))
            if letter != "D":
                q = SYSTEM if letter == "K" and r["codes"][seq - r["start"]] // 3 == SYSTEM else due
            seq, sub = (seq, sub + 1) if letter == "I" else (seq + 1, 0)
        state[0] = way["state"]
        return out

    def finish(state: list[int], r: dict[str, Any]) -> list[tuple]:
        return [(r["k"], (1 << 31) - 1, 0, i, letter, ROLES[(state[0] == USER) ^ (i % 2)]) for i, letter in enumerate(TAIL[state[0]])]

    return fold_rows(letters, ["k"], ["part", "block"], f"k {key}, part int, seq bigint, sub int, edit string, as_role string", lambda: [NOTHING], forth, finish)


def repair(messages: DataFrame, *, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", block: int = BLOCK) -> DataFrame:
    """The edits of every conversation in order of (part, seq, sub): k, part, seq, sub, edit, turn, from_role, fault, role, text (null for deleted rows).

    Rows whose edit isn't D, in that order, are the repaired conversation.
    """
    space = lambda c: F.coalesce(F.col(c), F.lit(" "))
    rows = messages.select(F.col(key).alias("k"), F.col(turn).alias("turn"), space(role).alias("role"), space(text).alias("text"))
    turns = written(number_rows(rows, partitions(messages.sparkSession), block), "turns")
    faults = written(with_faults(turns), "turn-faults")
    edits = chosen_edits(faults)
    marked = faults.select(F.col("part").alias("p"), F.col("seq").alias("s"), "turn", F.col("role").alias("from_role"), "fault")
    texts = turns.select(F.col("part").alias("p2"), F.col("seq").alias("s2"), "text")
    of_row = F.col("edit") != "I"
    out = edits.join(marked, (F.col("part") == F.col("p")) & (F.col("seq") == F.col("s")) & of_row, "left")
    out = out.join(texts, (F.col("part") == F.col("p2")) & (F.col("seq") == F.col("s2")) & F.col("edit").isin("K", "R"), "left")
    kept = F.when(F.col("edit") == "I", "").when(F.col("edit") != "D", F.col("text"))
    return out.select("k", "part", "seq", "sub", "edit", "turn", "from_role", "fault", F.when(F.col("edit") != "D", F.coalesce("as_role", "from_role")).alias("role"), kept.alias("text"))


def damage(rows: DataFrame) -> DataFrame:
    """conversations (conv_id, turn, role, text) as the query's contract damages them."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    how = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20
    text = F.when(F.col("how") == 1, "").when(F.col("how") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    hurt = rows.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), how.alias("how")).where("how <> 0")
    hurt = hurt.select("conv_id", "turn", F.when(F.col("how") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(F.col("how") == 3, 2).otherwise(1).alias("times"))
    return hurt.select("conv_id", "turn", "role", "text", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("copy")).drop("copy")


NUMBERS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_COSTS = {"K": KEEP, "R": REROLE, "D": DELETE, "I": INSERT}


def digests(edits: DataFrame) -> DataFrame:
    """k, NUMBERS, audit and repaired_sha256 of each conversation; a task streams through a conversation's edits with counters and a hash."""
    key = edits.schema["k"].dataType.simpleString()

    def begin() -> dict[str, Any]:
        return dict.fromkeys(NUMBERS, 0) | {"first": None, "last": None, "turns": 0, "before": None, "audit": [], "sha": hashlib.sha256(), "any": False}

    def step(s: dict[str, Any], r: dict[str, Any]) -> list[tuple]:
        letter = r["edit"]
        s["audit"].append(letter)
        s["cost"] += _COSTS[letter] + (TRUNCATED if r["fault"] == "truncated" and letter != "D" else 0)
        if letter != "I":
            if r["fault"]:
                s[r["fault"]] += 1
            if (turn := r["turn"]) is not None and turn != s["last"]:
                s["first"], s["last"], s["turns"] = turn if s["first"] is None else s["first"], turn, s["turns"] + 1
            initial = r["from_role"][:1]
            s["illegal"] += s["before"] is not None and s["before"] + initial not in ("su", "ua", "au")
            s["before"] = initial
        if letter != "D":
            s["sha"].update(f"{chr(10) if s['any'] else ''}{r['role']}:{r['text']}".encode())
            s["any"] = True
        return []

    def end(s: dict[str, Any], r: dict[str, Any]) -> list[tuple]:
        gaps = s["last"] - s["first"] + 1 - s["turns"] if s["turns"] else 0
        return [(r["k"], gaps, *(s[n] for n in NUMBERS[1:]), "".join(s["audit"]), s["sha"].hexdigest())]

    schema = f"k {key}, {', '.join(f'{n} bigint' for n in NUMBERS)}, audit string, repaired_sha256 string"
    return fold_rows(edits, ["k"], ["part", "seq", "sub"], schema, begin, step, end)


def repaired_conversations(conversations: DataFrame) -> DataFrame:
    """The query: conversations are damaged, repaired, and each original one described."""
    rows = conversations.select("conv_id", "turn", "role", "text")
    found = digests(repair(damage(rows)))
    every = rows.select("conv_id").distinct()
    both = every.join(found, F.col("conv_id").eqNullSafe(F.col("k")), "left")
    zero = F.lit(0).cast("bigint")
    return both.select("conv_id", *[F.coalesce(n, zero).alias(n) for n in NUMBERS], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def _sql() -> str:
    def grown(state: str, letter: str, cost: str, line: str) -> str:
        return f"CASE WHEN {state} IS NOT NULL THEN {{'k': lpad((left({state}.k, 9)::INT + {cost})::VARCHAR, 9, '0') || substr({state}.k, 10) || '{letter}', 't': {state}.t || {line}}} END"

    due = lambda state, who: grown(state, "I", "5", f"chr(10) || '{who}:'")
    more = "CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END"
    line = "chr(10) || role || ':' || text"

    def kept(state: str, initial: str) -> str:
        return f"CASE WHEN first = '{initial}' AND live THEN {grown(state, 'K', more, line)} END"

    def reroled(state: str, who: str) -> str:
        return f"CASE WHEN first <> '{who[0]}' AND live THEN {grown(state, 'R', '1 + ' + more, f"chr(10) || '{who}:' || text")} END"

    gone = lambda state: grown(state, "D", "2", "''")
    def closed(table: str) -> str:
        """The states of a table after an insertion or two, where that is cheaper."""
        one = f"""SELECT g, i, x0 AS y0, x1 AS y1, least(x2, {due("x0", "user")}, {due("x1", "user")}, {due("x3", "user")}) AS y2, x3 FROM {table}"""
        return f"""SELECT g, i, y0, y1, y2, least(x3, {due("y2", "assistant")}) AS y3 FROM ({one}) AS c"""

    to_user = ", ".join(f"{kept(s, 'u')}, {reroled(s, 'user')}" for s in ("y0", "y1", "y3"))
    crc = "xor(list_reduce(list_transform(range(1, length(s) + 1), lambda j: ascii(substr(s, j::INT, 1))::BIGINT), lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, (x & 1) * 3988292384)), 4294967295), 4294967295)"
    return rf"""
WITH RECURSIVE h AS MATERIALIZED (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc} % 20 AS how
  FROM (SELECT *, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS s FROM conversations)
), d AS (
  SELECT conv_id, turn, CASE how WHEN 4 THEN 'user' ELSE role END AS role, CASE how WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM h, unnest(range(0, CASE how WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS u(copy)
), o AS (
  SELECT *, dense_rank() OVER (ORDER BY conv_id NULLS LAST) AS g, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS i, left(role, 1) AS first FROM d
), f AS MATERIALIZED (
  SELECT *, lag(first) OVER (PARTITION BY g ORDER BY i) AS before, fault IS NULL OR fault = 'truncated' AS live FROM (
    SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN i > min(i) OVER (PARTITION BY g, role, text) THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' END AS fault FROM o)
), w AS (
  SELECT DISTINCT g, 0::BIGINT AS i, {{'k': '000000000', 't': ''}} AS x0, NULL::STRUCT(k VARCHAR, t VARCHAR) AS x1, NULL::STRUCT(k VARCHAR, t VARCHAR) AS x2, NULL::STRUCT(k VARCHAR, t VARCHAR) AS x3 FROM f
  UNION ALL
  SELECT g, f.i, {gone("y0")}, least({gone("y1")}, {kept("y0", "s")}), least({gone("y2")}, {to_user}), least({gone("y3")}, {kept("y2", "a")}, {reroled("y2", "assistant")})
  FROM ({closed("w")}) AS p JOIN f USING (g) WHERE f.i = p.i + 1
), e AS (
  SELECT g, least(y0, y3) AS z FROM ({closed("(SELECT * FROM w QUALIFY i = max(i) OVER (PARTITION BY g)) AS w")}) AS q
), n AS (
  SELECT conv_id, g, CASE WHEN count(turn) = 0 THEN 0 ELSE max(turn) - min(turn) + 1 - count(DISTINCT turn) END AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
    count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE before IS NOT NULL AND before || first NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id, g
)
SELECT a.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  coalesce(left(z.k, 9)::BIGINT, 0) AS cost, coalesce(substr(z.k, 10), '') AS audit, sha256(coalesce(substr(z.t, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) AS a LEFT JOIN n ON a.conv_id IS NOT DISTINCT FROM n.conv_id LEFT JOIN e USING (g)
"""


SQL = _sql()
