import math
import random

import numpy as np
import pytest

from evidex.llm import langid

from .brute import DOCS, odd_rows, prose

SCHEMA = "doc_id bigint, text string, lang string"


def languages(n=400, seed=1):
    rng = random.Random(seed)
    words = {"en": "the of and thing with house water".split(), "de": "der die und ein haus wasser über".split(), "fr": "le les est une maison été garçon".split()}
    out = []
    for i in range(n):
        lang = rng.choice(sorted(words))
        out.append((i, " ".join(rng.choice(words[lang]) for _ in range(rng.randrange(3, 60))), lang))
    return out


def test_held_out_accuracy(spark):
    rows = {r[0]: r[2] for r in languages()}
    got = langid.identify_documents(spark.createDataFrame(languages(), SCHEMA)).collect()
    held = [r for r in got if r.held_out]
    assert len(got) == 400 and len(held) > 80
    assert sum(r.lang_pred == rows[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got)


def test_labels_of_held_out_rows_are_never_learnt(spark):
    df = spark.createDataFrame(languages(150), SCHEMA)
    from pyspark.sql import functions as F

    changed = df.withColumn("lang", F.when(langid.held_out(F.col("doc_id")), "xx").otherwise(F.col("lang")))
    a, b = (sorted(map(tuple, langid.identify_documents(x).collect())) for x in (df, changed))
    assert a == b


def test_odd_rows(spark):
    df = spark.createDataFrame(odd_rows(), DOCS)
    got = langid.identify_documents(df).collect()
    assert len(got) == len(odd_rows())
    letters = {r[0]: any(c.isalpha() for c in r[1] or "") for r in odd_rows() if r[0] is not None}
    for r in got:
        assert r.lang_pred in ("de", "en", "und")
        if r.doc_id is not None:
            assert (r.lang_pred != "und") == letters[r.doc_id] and (r.score > 0) == letters[r.doc_id]
    by_text = {}
    for r, x in zip(langid.predict(df, langid.train(df), out="language_").collect(), odd_rows(), strict=True):
        first = by_text.setdefault(x[1], r["language_"])
        assert first["lang"] == r["language_"]["lang"] and abs(first["score"] - r["language_"]["score"]) < 1e-4
        assert (r["language_"]["lang"] == "und") == (x[1] is None or not any(c.isalpha() for c in x[1]))
    kept = langid.keep_identified(df)
    assert kept.columns == df.columns
    assert all(r.text and any(c.isalpha() for c in r.text) for r in kept.collect())


@pytest.mark.parametrize("rows", [[], [(1, "word", None)], [(1, None, None)]])
def test_nothing_to_learn(spark, rows):
    got = langid.identify_documents(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [(r.lang_pred, r.score) for r in got] == [("und", 0.0)] * len(rows)


def test_windows_cover_whole_texts(spark):
    """A long text whose language shows only at its end."""
    rows = languages() + [(1000, "1 2 3 " * 200 + " ".join("der die und ein haus wasser".split() * 200), "de")]
    df = spark.createDataFrame(rows, SCHEMA)
    model = langid.train(df)
    got = langid.predict(df.where("doc_id = 1000"), model).collect()[0]
    assert got.language.lang == "de"
    assert prose(random.Random(1), 3)


def plain_network(model, window: bytes) -> list[float]:
    """The network over one window, place by place and filter by filter."""
    span = max(langid.WIDTHS)
    symbols = list(window) + [langid.PAD] * (langid.WINDOW - len(window) + span - 1)
    best = np.full(model.conv.shape[1], -np.inf)
    for at in range(langid.WINDOW):
        seen = np.concatenate([model.embed[s] for s in symbols[at : at + span]])
        best = np.maximum(best, [float(seen @ model.conv[:, f]) for f in range(model.conv.shape[1])])
    z = np.maximum(best + model.bias, 0) @ model.dense + model.shift
    e = [math.exp(x - max(z)) for x in z]
    return [x / sum(e) for x in e]


def test_predictions_equal_brute_force(spark):
    rng = random.Random(4)
    texts = [prose(rng, n) for n in (1, 3, 20, 21, 22, 40, 90)] + [None, "", "...", "É", "ab" * 64, "ab" * 64 + "c", "x" * 300, "ÀÉ" * 40]
    model = langid.train(spark.createDataFrame(languages(120), SCHEMA))
    got = langid.predict(spark.createDataFrame(list(enumerate(texts)), "i int, text string").repartition(3), model, batch=3).orderBy("i").collect()
    for text, r in zip(texts, got, strict=True):
        body = (text or "").encode()
        if not any(c.isalpha() for c in text or ""):
            assert tuple(r.language) == ("und", 0.0)
            continue
        windows = [body[k : k + langid.WINDOW] for k in range(0, len(body), langid.WINDOW)]
        mean = sum(np.array(plain_network(model, w)) * len(w) for w in windows) / len(body)
        assert r.language.lang == model.langs[int(mean.argmax())] and abs(r.language.score - mean.max()) < 1e-4
