import json
import os

import numpy as np
import pytest

import math

import pyarrow as pa
from pyspark.sql import functions as F

from echolattice.llm.reading import CONNECTIVES, FOLDS, NAMES, OWN, Words, _STOP, extract, fit_ordinal, measure, prose, reading_levels, split, words_of

EASY, HARD = "The cat is on the mat. We see it now. It is red.", "Notwithstanding the epistemological heterogeneity of the underlying estimator, any regularisation precludes a discretisation whose identifiability, insofar as it remains asymptotic, exacerbates the parameterisation upon which interpretability was predicated."
CODE = "for i in range(3):\n    print(i)  # a comment in code"


def book(cells):
    return json.dumps({"cells": [{"cell_type": k, "source": [line + "\n" for line in s.split("\n")]} for k, s in cells], "nbformat": 4})


def test_forms_give_the_same_prose():
    script = "# %% [markdown]\n# # Title 3\n# \n# " + EASY + "\n\n# %%\n" + CODE + "\n\n# Out[1]:\n# 12.5\n"
    markdown = "# Title 3\n\n" + EASY + "\n\n```python\n" + CODE + "\n```\n\n    12.5  out\n"
    console = "# Title 3\n\n" + EASY + "\n\nIn [1]: for i in range(3):\n   ...:     print(i)\n\nOut[1]: 12.5\n     3   4\n\nsmooth: 12 rows in 3.1 s\nDone.\n\nTraceback (most recent call last):\n  File \"x.py\", line 3\nKeyError: 4\n"
    notebook = book([("markdown", "# Title 3\n\n" + EASY), ("code", CODE)])
    for text in (script, markdown, console, notebook, "﻿" + script.replace("\n", "\r\n"), markdown.replace("\n", "\r\n")):
        assert prose(text).split() == EASY.split(), text


def test_what_is_not_own_prose():
    text = f"{EASY}\n\n> {HARD}\n> {HARD}\n{HARD}\n\n| a | b |\n|---|---|\n| {HARD} | 2 |\n\n$$ {HARD} $$\n\n## {HARD}\n\n<table><td>{HARD}</td></table>\n\n![{HARD}](x.png)\n\n- {EASY}\n"
    assert prose(text).split() == (EASY + " " + EASY).split()


@pytest.mark.parametrize("text", [None, "", "  \n\t", "{", '{"cells": [', '{"cells": [{"cell_type": "code", "source": "x"}]}', '{"cells": [1, null]}', "# %%\nx = 1\n", "In [1]: x\n\nOut[1]: 3", "```\nx\n"])
def test_no_prose(text):
    assert prose(text).strip() in ("", "{")


def test_ordinal_regression_recovers_order():
    r = np.random.default_rng(0)
    x = r.normal(size=(1500, 3))
    z = x[:, 0] * 2 - x[:, 1]
    noisy = z + r.logistic(size=1500) * 0.3
    y = 1 + (noisy > -0.5) + (noisy > 1.2)
    best = 1 + (z[1000:] > -0.5).astype(int) + (z[1000:] > 1.2)
    m = fit_ordinal(x[:1000], y[:1000].astype(float))
    got = 1 + (m.above(x[1000:]) >= 0.5).sum(1)
    assert (got == best).mean() > 0.95 and m.cuts[0] < m.cuts[1] and abs(m.weight[2]) < 0.3


def brute(text, rarity, grade, middle):
    """All features of one text, from its definition."""
    sentences = [w for x in _STOP.split(text) if (w := words_of(x))]
    flat = [w for x in sentences for w in x]
    n, k = len(flat), len(sentences)
    rare, by = [rarity[w] for w in flat], sorted(sum(grade.get(w, middle) for w in x) / len(x) for x in sentences)
    ties, breaks = sum(w in CONNECTIVES for w in flat), sum(text.count(c) for c in ",;:")
    return dict(
        sentence=math.log(n / k), longest=math.log(max(map(len, sentences))), word=sum(map(len, flat)) / n, long_words=sum(len(w) >= 10 for w in flat) / n, very_long=sum(len(w) >= 14 for w in flat) / n, diversity=len(set(flat)) / math.sqrt(2 * n),
        rarity=sum(rare) / n, rare=sum(x > 12 for x in rare) / n, connectives=ties / n, depth=ties / k, commas=breaks / k, grade=sum(by) / k, grade_high=by[3 * k // 4], amount=math.log(n),
    )


def test_features_equal_their_definition():
    texts = [EASY, HARD, "word", "x " * 50_000, EASY + " " + HARD + "; which, because: one. Two!", "É, é. Ünïcode-wörd d'été 12 naïve"]
    r = np.random.default_rng(1)
    vocabulary = sorted({w for t in texts for w in words_of(t)})
    rarity = {w: float(r.uniform(1, 20)) for w in vocabulary}
    grade = {w: r.uniform(1, 3, FOLDS + 1) for w in vocabulary[::2]}
    known = Words({w: i for i, w in enumerate(vocabulary)}, np.array([rarity[w] for w in vocabulary]), np.array([grade.get(w, np.full(FOLDS + 1, 1.7)) for w in vocabulary]), 1.7)
    found = [split(t) for t in ["", *texts, "... !? 12"]]
    assert found[0] is None and found[-1] is None
    own, words, counts, ids, lengths = zip(*found[1:-1])
    fold = np.arange(len(texts)) % (FOLDS + 1)
    size, bits, rare, mean, high = measure(*(pa.array(x) for x in (words, ids, lengths)), fold, known)
    for i, t in enumerate(texts):
        want = brute(t, rarity, {w: g[fold[i]] for w, g in grade.items()}, 1.7)
        got = dict(zip(NAMES, [*own[i], bits[i] / size[i], rare[i] / size[i], mean[i], high[i]]))
        assert OWN == 10 and got == pytest.approx(want) and sum(counts[i]) == size[i]


def docs(spark):
    rows, judged = [], []
    for i in range(60):
        level = 1 + i % 3
        text = {1: EASY, 2: "The plot below shows how the average changes in a normal week, so we compare it with the station from the first part.", 3: HARD}[level]
        rows.append((i, (text + "\n\n") * (1 + i % 4), "x"))
        if i % 2 == 0:
            judged += [(i, 1, level), (i, 2, level)] if i % 4 == 0 else [(i, 1, level)]
    rows += [(100, None, "x"), (101, "", "x"), (102, "# %%\nx = 1", "x"), (103, HARD * 200, "x"), (103, HARD, "x")]
    judged += [(100, 1, 3), (1, 1, None), (None, 1, 2)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, prose string"), spark.createDataFrame(judged, "doc_id bigint, rater int, reading_level int")


def test_levels(spark):
    df, judged = docs(spark)
    got = reading_levels(df, judged, "doc_id", "text", "reading_level").collect()
    assert len(got) == 62 and all(r.level == 1 + r.doc_id % 3 for r in got if r.doc_id < 60) and [r.level for r in got if r.doc_id == 103] == [3, 3]
    assert all(1 <= r.score <= 3 and 0 <= r.p_demanding <= 1 for r in got)


def test_without_documents_or_judgements(spark):
    df, judged = docs(spark)
    assert reading_levels(df.limit(0), judged, "doc_id", "text", "reading_level").count() == 0
    got = reading_levels(df, judged.limit(0), "doc_id", "text", "reading_level").collect()
    assert len(got) == 62 and all(r.level is None and r.score is None for r in got)
    for n in (1, 2):  # as few as one judgement make a model
        got = reading_levels(df, judged.where("reading_level IS NOT NULL AND doc_id < 60").orderBy("doc_id").limit(n), "doc_id", "text", "reading_level").collect()
        assert len(got) == 62 and all(r.level in (1, 2, 3) for r in got)
    assert extract(df, "doc_id", "text").count() == 62


def test_every_word_keeps_its_own_rarity(spark):
    """However many words are sent to the tasks, none or all, the levels and scores are the same."""
    df, judged = docs(spark)
    run = lambda n: sorted(map(tuple, reading_levels(df, judged, "doc_id", "text", "reading_level", table_words=n).select("doc_id", "level", F.round("score", 9), F.round("p_demanding", 9)).collect()))
    assert run(0) == run(7) == run(50_000)


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.1"), reason="no tables")
def test_held_out_accuracy(spark):
    """Fitted on half of the judged documents, checked on the other half; some judgements are wrong, so not all can agree."""
    docs, judged = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "reading_levels"))
    judged = judged.where("reading_level IS NOT NULL")
    seen = docs.join(judged, "doc_id", "left_semi")
    got = {r.doc_id: r.level for r in reading_levels(seen, judged.where("doc_id % 2 = 0"), "doc_id", "text", "reading_level").collect()}
    held = [(r.doc_id, r.reading_level) for r in judged.where("doc_id % 2 = 1").collect() if r.doc_id in got]
    assert len(held) > 150 and sum(got[i] == level for i, level in held) / len(held) > 0.9
    strict = [got[i] == 3 for i, level in held if level == 3]
    assert sum(strict) / len(strict) > 0.9
