import random

import pytest

from evidex.llm import simhash as sh

from .brute import DOCS, components, odd_rows, simhash


def spread(seed=6, n=120):
    rng = random.Random(seed)
    base = [rng.randrange(1 << 64) for _ in range(n)]
    out = list(base)
    for b in base[:60]:
        for _ in range(3):
            for _ in range(rng.randrange(4)):
                b ^= 1 << rng.randrange(64)
            out.append(b)
    centre = rng.randrange(1 << 64)  # a crowded ball
    out += [centre ^ 1 << i ^ 1 << j for i in range(12) for j in range(12)] + [0, (1 << 64) - 1]
    return sorted(set(out))


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("dense", [2, 8, 1000])
@pytest.mark.parametrize("bits", [1, 2])
def test_links_connect_as_brute_force(spark, dense, bits):
    prints = spread()
    df = spark.createDataFrame([(signed(p),) for p in prints], "fp bigint").repartition(4)
    edges = sh.links(df, bits=bits, dense=dense)
    assert all(bin((r.a ^ r.b) & (1 << 64) - 1).count("1") <= bits for r in edges.collect())
    roots = {r.node: r.root for r in sh.components(edges).collect()}
    groups = components(prints, bits)
    for i, p in enumerate(prints):
        assert roots.get(signed(p), signed(p)) == min(signed(prints[j]) for j in groups[i])


def test_documents_equal_brute_force(spark):
    rows = odd_rows()
    got = sh.component_documents(spark.createDataFrame(rows, DOCS).repartition(3)).collect()
    prints = [simhash(r[1]) for r in rows]
    groups = components(prints)
    want = []
    for i, r in enumerate(rows):
        ids = [rows[j][0] for j in groups[i] if rows[j][0] is not None]
        want.append((r[0], f"{prints[i]:016x}", min(ids, default=None)))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_one_document_of_each_group_stays(spark):
    rows = odd_rows()
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    kept = sh.drop_near_duplicates(df)
    groups = components([simhash(r[1]) for r in rows])
    assert kept.columns == df.columns
    assert kept.count() == len({id(g) for g in groups.values()})


def test_long_chain(spark):
    x, chain = 0, []
    for i in range(60):
        x ^= 1 << i
        chain.append(x)
    roots = {r.node: r.root for r in sh.components(sh.links(spark.createDataFrame([(signed(c),) for c in chain], "fp bigint"))).collect()}
    assert set(roots.values()) == {min(signed(c) for c in chain)} and len(roots) == 60


def test_empty_table(spark):
    assert sh.component_documents(spark.createDataFrame([], DOCS)).collect() == []
    assert sh.drop_near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def test_every_linked_pair_shares_a_viable_key():
    rng = random.Random(3)
    for bits in (1, 2):
        masks = sh.key_masks(bits)
        for _ in range(3000):
            x = sum(1 << b for b in rng.sample(range(64), bits))
            assert any(x & m == 0 for _, m in masks)
