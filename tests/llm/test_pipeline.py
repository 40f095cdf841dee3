"""The pipeline's stages in a row against brute force, on the smallest documents."""

import os
import struct

import pytest
import xxhash

corpus_pipeline = pytest.importorskip("corpus_pipeline")
DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def draw(doc_id):
    """The draw in (0, 1) that decides whether a document stays."""
    h = xxhash.xxh64_intdigest(b"mix", seed=xxhash.xxh64_intdigest(struct.pack("<q", doc_id), seed=42))
    return ((h >> 11) + 0.5) * 2.0**-53


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id0 int, th string, d int, row int, rep int, label string, prob double, kept boolean, first int, shard int"
OTHERS = (1, "t", 2, 3, 4, "l", 0.5, False, 6, 7)


def test_pipeline_of_odd_rows(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows and columns whose names the operators use."""
    text = "the of and to in that with for this from one more word here"
    rows = [(i, f"{text} {i} {i * 7} the end of it", "en", "s", 10, *OTHERS) for i in range(12)]
    rows += [(20, None, "en", "s", None, *OTHERS), (21, "", None, None, 0, *OTHERS), (None, f"{text} without id", "en", "s", 1, *OTHERS), (22, f"{text} " * 20_000, "en", None, 1, *OTHERS)]
    rows += [rows[0]] * 3 + [(30, rows[1][1], "en", "other", 1, *OTHERS), (31, rows[2][1].replace(" ", "  "), "en", "s", 1, *[None] * 10)]
    docs = spark.createDataFrame(rows, SCHEMA)
    names = docs.columns
    from skyloom.llm import common

    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.store(stage(spark, docs, ""), name)
        assert docs.columns == names
        seen.append(sorted((r.doc_id for r in docs.collect()), key=str))
    assert seen[0] == sorted([*range(12), None, 22, 0, 0, 0, 30, 31], key=str)  # no letters: 20 and 21 go
    assert seen[1] == sorted([*range(12), None, 22], key=str)  # one row of each text
    assert set(seen[2]) <= set(seen[1]) and 22 in seen[2] and None in seen[2]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
    assert {r.doc_id for r in packed} == set(seen[3])


def test_pipeline_of_nothing(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.collect() == [] and out.columns == docs.columns
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").collect() == []


def test_pipeline(spark):
    from skyloom.llm import common, mixing
    from tests.llm.test_ops import brute_components, brute_mix

    docs = common.documents(spark, DATA)
    names = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = common.store(stage(spark, docs, DATA), name)
        assert docs.columns == names
        kept[name] = (before.collect(), docs.collect())
    ids = lambda x: {r.doc_id for r in x}
    before, after = kept["language_id"]
    assert ids(before) == ids(after)  # all of these have a language
    before, after = kept["exact_dedup"]
    first = {}
    for r in before:
        t = " ".join(r.text.split()) if r.text.isascii() else r.text
        first[t] = min(first.get(t, r.doc_id), r.doc_id)
    assert ids(after) == set(first.values())
    before, after = kept["ngram_jaccard"]
    assert ids(after) == {c for _, c in brute_components([(r.doc_id, r.text) for r in before], 5, 80).values()}
    before, after = kept["mixing"]
    cells = mixing.mix(spark.createDataFrame(before)).collect()
    prob, _ = brute_mix(cells, {}, mixing.BUDGET)
    far = {r.doc_id: draw(r.doc_id) - prob[r.source, r.lang, r.topic] for r in cells}
    assert all((x < 0) == (d in ids(after)) for d, x in far.items() if abs(x) > 1e-5) and len(after) < len(before)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, DATA).collect()
    assert ids(packed) == ids(docs.collect())
    for d in ids(packed):
        own = [r for r in packed if r.doc_id == d]
        assert sum(r.length for r in own) == own[0].doc_tokens
