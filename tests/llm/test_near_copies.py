import random

import numpy as np
import pytest

import corpus_pipeline
from evidex.llm import near_copies as nc
from evidex.llm import simhash

from .brute import shingles

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def likeness(a, b):
    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y)


def planted(seed=5, n=30):
    """(text, copy, likeness): copies with words replaced until their likeness falls to a level from 0.95 down to 0.6."""
    rng, out = random.Random(seed), []
    for i in range(n):
        goal = (0.95, 0.9, 0.85, 0.81, 0.7, 0.6)[i % 6]
        words = [f"w{i}x{rng.randrange(4000)}" for _ in range(rng.randrange(150, 500))]
        copy, last = list(words), list(words)
        while likeness(" ".join(words), " ".join(copy)) >= goal:
            last = list(copy)
            copy[rng.randrange(len(copy))] = f"new{rng.randrange(10**6)}"
        if goal < 0.8:
            last = copy
        out.append((" ".join(words), " ".join(last), likeness(" ".join(words), " ".join(last))))
    return out


def test_the_stage_drops_planted_copies_of_likeness_080_and_more(spark):
    pairs = planted()
    rows = [(2 * i + k, p[k], "en", "a", 1) for i, p in enumerate(pairs) for k in (0, 1)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    kept = dict(corpus_pipeline.STAGES)["simhash_dedup"](spark, docs, "")
    want = {2 * i for i in range(len(pairs))} | {2 * i + 1 for i, p in enumerate(pairs) if p[2] < 0.8}
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == want
    assert sum(p[2] >= 0.8 for p in pairs) == 20


@pytest.mark.parametrize("dense", [4, 1000])
def test_one_large_group_of_near_copies(spark, dense):
    rng = random.Random(8)
    base = [f"b{rng.randrange(3000)}" for _ in range(300)]
    texts = []
    for i in range(90):
        words = list(base)
        for _ in range(3):
            words[rng.randrange(300)] = f"own{i}y{rng.randrange(99)}"
        texts.append(" ".join(words))
    rows = [(i, t, i, i) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "id int, t string, h bigint, fp bigint")
    nodes = nc.with_sets(docs, 5)
    sets = lambda wanted: nc.with_hashes(docs.join(nodes.select("id", "node"), "id").join(wanted, "node"), 5)
    found = nc.simhash.components(nc.links(nodes, sets, dense=dense)).collect()
    assert len(found) == 90 and len({r.root for r in found}) == 1


def test_a_crowded_band_of_unlike_texts_loses_no_pair(spark):
    """A hundred nodes share one band; two pairs of them are alike, and no node is like a hub."""
    rng = random.Random(3)
    sets = {i: [rng.getrandbits(60) for _ in range(40)] for i in range(100)}
    sets[41], sets[83] = [*sets[7][:38], 1], [*sets[22][:37], 2, 3]
    sets = {i: [x << 3 for x in s] for i, s in sets.items()}
    rows = [(i, len(x), [5, *(1000 * b + i for b in range(1, nc.BANDS))], nc.cells(np.array(x, np.uint64)).tolist()) for i, x in sets.items()]
    nodes = spark.createDataFrame(rows, "node bigint, n int, bands array<bigint>, cells array<bigint>")
    hashes = spark.createDataFrame(list(sets.items()), "node bigint, hashes array<bigint>")
    found = nc.links(nodes, lambda wanted: hashes.join(wanted, "node"), dense=4)
    assert {tuple(r) for r in found.distinct().collect()} == {(7, 41), (22, 83)}


def test_no_step_plans_many_operators(spark, monkeypatch):
    """The driver keeps each plan's text at every stage that ends, so its memory follows the largest plan."""
    sizes = []

    def noted(df, name, write=simhash.written):
        plan = df._jdf.queryExecution().executedPlan().toString()
        sizes.append((len([x for x in plan.splitlines() if x.strip(" :+-")]), name))
        return write(df, name)

    monkeypatch.setattr(simhash, "written", noted)
    monkeypatch.setattr(nc, "written", noted)
    pairs = planted(n=6)
    nc.drop_near_copies(spark.createDataFrame([(2 * i + k, p[k], "en", "a", 1) for i, p in enumerate(pairs) for k in (0, 1)], SCHEMA)).collect()
    assert max(sizes)[0] < 80, sorted(sizes)[-3:]


def one_band(spark, sets):
    """links' arguments for sets of hashes that share one band and no other."""
    rows = [(i, len(x), [5, *(1000 * b + i for b in range(1, nc.BANDS))], nc.cells(np.array(sorted(x), np.uint64)).tolist()) for i, x in sets.items()]
    nodes = spark.createDataFrame(rows, "node bigint, n int, bands array<bigint>, cells array<bigint>")
    hashes = spark.createDataFrame([(i, sorted(x)) for i, x in sets.items()], "node bigint, hashes array<bigint>")
    return nodes, lambda wanted: hashes.join(wanted, "node")


def edited(rng, base, most):
    """base with up to so many runs of five members replaced, some cut off, some added."""
    out = list(base)
    for _ in range(rng.randrange(most + 1)):
        at = rng.randrange(len(base) - 5)
        out[at : at + 5] = [rng.getrandbits(62) for _ in range(5)]
    return set(out[: len(out) - rng.choice([0, 0, 3, 20])]) | {rng.getrandbits(62) for _ in range(rng.choice([0, 0, 8]))}


@pytest.mark.parametrize(("seed", "percent", "dense"), [(1, 80, 4), (2, 80, 1000), (3, 65, 4), (4, 90, 4)])
def test_a_crowded_band_has_the_components_of_all_its_pairs(spark, seed, percent, dense):
    """Sets around three centres, the second half like the first, the third unlike; their likeness lies about the bound."""
    rng = random.Random(seed)
    first, third = ([rng.getrandbits(62) for _ in range(100)] for _ in range(2))
    centres = [first, first[:60] + [rng.getrandbits(62) for _ in range(40)], third]
    sets = {i: edited(rng, centres[i % 3], 7) for i in range(150)}
    found = {tuple(sorted(r)) for r in nc.links(*one_band(spark, sets), percent=percent, dense=dense).collect()}
    links = {(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])}

    def roots(pairs):
        at = {i: i for i in sets}
        while moved := [(a, b) for a, b in pairs if at[a] != at[b]]:
            for a, b in moved:
                at[a] = at[b] = min(at[a], at[b])
        return at

    assert found <= links and roots(found) == roots(links)
    assert 10 < len(set(roots(links).values())) < 140


def test_the_rows_of_a_crowded_band_grow_with_its_members(spark):
    """Copies of one text with five edits of their own each: none is a link, and all of them share a band."""

    def made(m):
        rng = random.Random(6)
        base = [rng.getrandbits(62) for _ in range(150)]
        store, sets = spark._jsparkSession.sharedState().statusStore(), {}
        for i in range(m):
            sets[i] = list(base)
            for at in rng.sample(range(0, 150, 5), 5):
                sets[i][at : at + 5] = [rng.getrandbits(62) for _ in range(5)]
        before = store.executionsCount()
        assert nc.links(*one_band(spark, sets), dense=4).count() == 0
        most = 0
        for x in range(before, store.executionsCount()):
            x = store.executionsList().apply(x).executionId()
            values, nodes = store.executionMetrics(x), store.planGraph(x).allNodes()
            for node in (nodes.apply(j) for j in range(nodes.size())):
                for metric in (node.metrics().apply(k) for k in range(node.metrics().size())):
                    if metric.name() == "number of output rows" and values.contains(metric.accumulatorId()):
                        most = max(most, int(values.apply(metric.accumulatorId()).replace(",", "")))
        return most

    assert made(480) <= 2.5 * made(240)
