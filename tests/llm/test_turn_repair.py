import hashlib
import heapq
import itertools
import random
import re
import zlib

import duckdb

from evidex.llm import turn_repair as tr

from .brute import prose

SCHEMA = "conv_id bigint, turn bigint, role string, text string, part string, seq string, k string, fault string, m map<string,int>"


def cheapest(codes):
    """Least (cost, audit) over the whole lattice, by a search over costs that knows nothing of prices or blocks."""
    heap, done = [(0, "", 0, 0)], set()
    while heap:
        cost, audit, i, q = heapq.heappop(heap)
        if i == len(codes) and q in (0, 3):
            return cost, audit
        if (i, q) in done:
            continue
        done.add((i, q))
        due = 3 if q == 2 else 2
        heapq.heappush(heap, (cost + 5, audit + "I", i, due))
        if i < len(codes):
            kind, fault = divmod(codes[i], 3)
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, q))
            if fault != 1:
                more = 5 if fault == 2 else 0
                if kind == due or (kind == 1 and q == 0):
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, kind))
                if kind != due:
                    heapq.heappush(heap, (cost + more + 1, audit + "R", i + 1, due))
    raise AssertionError


def test_auction_finds_the_cheapest_least_audit():
    for n in range(4):
        for codes in itertools.product(range(12), repeat=n):
            assert tr.repair_codes(codes) == cheapest(codes), codes
    rng = random.Random(4)
    for _ in range(600):
        codes = [rng.choice([3, 6, 9, 6, 9, rng.randrange(12)]) for _ in range(rng.randrange(40))]
        assert tr.repair_codes(codes) == cheapest(codes), codes


def test_blocks_join_to_the_same_audit():
    rng = random.Random(6)
    for _ in range(150):
        codes = [rng.choice([3, 6, 9, 6, 9, rng.randrange(12)]) for _ in range(rng.randrange(1, 30))]
        size = rng.randrange(1, 8)
        blocks = [codes[i : i + size] for i in range(0, len(codes), size)]
        ends = [list(tr.END)]
        for b in reversed(blocks):
            costs = tr.block_costs(b)
            ends.insert(0, [min(tr.FAR, *(costs[4 * q + to] + ends[0][to] for to in range(4))) for q in range(4)])
        audit, q = "", 0
        for b, after in zip(blocks, ends[1:], strict=True):
            letters, q = tr.block_letters(b, after)[q]
            audit += letters
        assert (ends[0][0], audit + tr.TAIL[q]) == cheapest(codes)


def test_steps_are_bounded_in_a_block():
    for code in range(12):
        codes = [code] * tr.BLOCK
        assert tr.repair_codes(codes) == cheapest(codes)
        assert tr.block_costs(codes)[0] == 2 * tr.BLOCK  # nothing written stays so by deleting all


def rows(seed=2):
    rng = random.Random(seed)
    text = lambda: rng.choice(["Yes.", "No!", "why?", "cut off", "", " \n", "Ends. \n", "é.", prose(rng, 5) + ".", None])
    out = [(c, t, rng.choice(["user", "assistant", "assistant", "system", "tool", "", None]), text()) for c in range(60) for t in range(rng.randrange(1, 12))]
    out += [(100, t, ("user", "assistant")[t % 2], f"Turn {t}.") for t in range(700)]  # many blocks
    out += [(101, None, "user", "a."), (101, None, "assistant", "b."), (101, 5, "user", "c."), (101, 5, "user", "c."), (101, 9, "assistant", "d.")] + [(102, None, "user", "x." + "y" * 90_000)]
    out += [(None, i, "user", "q.") for i in range(4)] + [(103, 1, "user", "same.")] * 150
    return out + [(c, 0, "user", "gone?") for c in range(200, 260)]


def contract(found):
    """The contract for each conversation, read word by word."""
    out = {}
    space = lambda v: " " if v is None else v
    by: dict = {}
    for r in found:
        by.setdefault(r[0], []).append(r)
    for conv, own in by.items():
        kept = []
        for _, turn, role, text in own:
            role, text, how = space(role), space(text), zlib.crc32(f"{space(conv)}:{space(turn)}".encode()) % 20
            text = "" if how == 1 else re.sub("[.!?]", "", text) if how == 2 else text
            kept += [(turn, "user" if how == 4 else role, text)] * (0 if how == 0 else 2 if how == 3 else 1)
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
        seen, faults = set(), []
        for _, role, text in kept:
            last = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
            faults.append("blank" if not last else "duplicate" if (role, text) in seen else "" if last[-1] in ".!?" else "truncated")
            seen.add((role, text))
        turns = {t for t, _, _ in kept if t is not None}
        codes = [3 * (" sua".index(r[:1]) if r[:1] in ("s", "u", "a") else 0) + (1 if f in ("blank", "duplicate") else 2 if f else 0) for (_, r, _), f in zip(kept, faults, strict=True)]
        cost, audit = cheapest(codes)
        lines, i, q = [], 0, ""
        for letter in audit:
            due = "assistant" if q == "u" else "user"
            if letter == "I":
                lines.append(f"{due}:")
            elif letter in "KR":
                lines.append(f"{kept[i][1] if letter == 'K' else due}:{kept[i][2]}")
            q = lines[-1][:1] if letter != "D" else q
            i += letter != "I"
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(kept))
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def test_query_equals_contract_and_sql(spark, tmp_path):
    own = rows()
    spark.createDataFrame([(*r, "p", "s", "k", "f", {"a": 1}) for r in own], SCHEMA).repartition(5).write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: tuple(r)[1:] for r in tr.repaired_conversations(spark.read.parquet(str(tmp_path / "conversations.parquet"))).collect()}
    assert got == contract(own)
    assert any(g[6] == "" for g in got.values()) and len(got[100][6]) > 600  # at these costs no insertion is ever cheaper than a deletion
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    assert {r[0]: r[1:] for r in con.sql(tr.SQL).fetchall()} == got


def test_repair_keeps_texts_and_roles_in_order(spark):
    df = spark.createDataFrame([(1, 2, "assistant", "B."), (1, 1, "user", "A."), (1, 3, "user", "C."), (2, 1, "system", "S."), (3, 1, "user", "only cut")], "conv_id int, turn int, role string, text string")
    for block in (1, 2, 64):
        got = {}
        for r in sorted(tr.repair(df, block=block).collect(), key=lambda r: (r.k, r.part, r.seq, r.sub)):
            got.setdefault(r.k, []).append((r.edit, r.role, r.text))
        assert got == {1: [("K", "user", "A."), ("K", "assistant", "B."), ("D", None, None)], 2: [("D", None, None)], 3: [("D", None, None)]}


def test_no_rows(spark):
    assert tr.repaired_conversations(spark.createDataFrame([], SCHEMA)).collect() == []
