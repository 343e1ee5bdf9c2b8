"""Each stage of the pipeline against a brute-force version, on rows that share ids, have none, or clash."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from tessera.llm import decontamination
from tessera.llm.op_queries.op4 import held_out
from tessera.llm.tokenizer_files import tokenizer_path
from tessera.llm.tokens import alnum_hashes
from tessera.llm.toxicity import fit

from .helpers import corpus, documents, words
from .test_model_operators import edits, plain_score, toxic_corpus
from .test_text_operators import components, stripped

STAGES = dict(corpus_pipeline.STAGES)
CLASH = {"row": "x", "a.b": "y", "kept": "z", "d": "w"}


def rows_of(df):
    """Rows as (doc_id, text, n_chars), with how often."""
    return Counter((r["doc_id"], r["text"], r["n_chars"]) for r in df.collect())


def tables(spark, tmp_path, labels=(), items=()):
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(list(items), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


@pytest.fixture(scope="module")
def rows():
    some = corpus(seed=21, n=90)
    return [*some, (None, "without an id"), (None, None), (None, some[30][1]), some[20], (some[20][0], "another text of the same id"), (some[40][0], some[50][1])]


def test_names_and_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "substrings", "decontamination", "packing"]


def test_toxicity(spark, tmp_path):
    texts, labels = toxic_corpus(300)
    docs = documents(spark, [*texts, (None, texts[0][1]), texts[1], (500, None), (501, "")], CLASH)
    sf = tables(spark, tmp_path, labels)
    out = STAGES["toxicity"](spark, docs, sf)
    model = fit(docs, spark.read.parquet(sf + "/labels.parquet").where(~held_out()))
    assert out.dtypes == docs.dtypes
    assert rows_of(out) == Counter({k: v for k, v in rows_of(docs).items() if plain_score(model, k[1]) < corpus_pipeline.TOXIC})


def test_near_duplicates(spark, rows):
    docs = documents(spark, rows, CLASH)
    out = STAGES["near_duplicates"](spark, docs, "")
    assert out.dtypes == docs.dtypes
    groups: dict = {}
    for n, (_, root) in components([(n, t) for n, (_, t) in enumerate(rows)]).items():
        groups.setdefault(root, []).append(n)
    got = rows_of(out)
    assert sum(got.values()) == len(groups)
    for members in groups.values():  # one row of the least id; of several such, any
        least = min((rows[n][0] is None, rows[n][0] or 0) for n in members)
        assert sum(got[(rows[n][0], rows[n][1], len(rows[n][1] or ""))] for n in members if (rows[n][0] is None, rows[n][0] or 0) == least) >= 1


def test_substrings(spark, rows):
    docs = documents(spark, rows, CLASH)
    out = STAGES["substrings"](spark, docs, "")
    assert out.dtypes == docs.dtypes
    expected: Counter = Counter()
    for (i, t), (n, gone, _), left in zip(rows, stripped(rows), remains(rows), strict=True):
        if not gone:
            expected[(i, t, len(t or ""))] += 1
        elif gone < n:
            expected[(i, left, len(left))] += 1
    assert rows_of(out) == expected


def remains(rows, length=35):
    places: dict = {}
    for n, (_, t) in enumerate(rows):
        w = words(t)
        for k in range(len(w) - length + 1):
            places.setdefault(tuple(w[k : k + length]), []).append((n, k))
    gone: dict = {}
    for found in places.values():
        for n, k in found if len(found) > 1 else ():
            gone.setdefault(n, set()).update(range(k, k + length))
    return [" ".join(x for k, x in enumerate(words(t)) if k not in gone.get(n, ())) for n, (_, t) in enumerate(rows)]


def test_decontamination(spark, tmp_path, rows):
    r = random.Random(3)
    items = [(k, " ".join(words(t)[5:25])) for k, (_, t) in enumerate(rows) if len(words(t)) > 60][:6] + [(90, None), (91, "")]
    some = [*rows, *((300 + k, " ".join(["lead"] * r.randint(0, 9)) + " " + (t or "").upper()) for k, t in items)]
    docs = documents(spark, some, CLASH)
    out = STAGES["decontamination"](spark, docs, tables(spark, tmp_path, (), items))
    assert out.dtypes == docs.dtypes
    hashed = [h for h in (alnum_hashes(t or "").tolist() for _, t in items) if h]
    leaks = lambda t: any(edits(h, alnum_hashes(t or "").tolist()) <= int(len(h) * decontamination.EDIT_RATE + 1e-9) for h in hashed)
    assert rows_of(out) == Counter({k: v for k, v in rows_of(docs).items() if not leaks(k[1])})


def test_packing(spark, rows):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    pieces = STAGES["packing"](spark, documents(spark, rows, CLASH), "").collect()
    ids = [(i, *tokenizer.encode(t or "", add_special_tokens=False).ids, 1) for i, t in rows]
    assert sum(p.length for p in pieces) == sum(len(x) - 1 for x in ids)
    assert Counter(x for p in pieces for x in np.frombuffer(bytes(p.ids), "<u4").tolist()) == Counter(x for d in ids for x in d[1:])
    ends: Counter = Counter()
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert p.offset == ends[p.sequence_id]
        ends[p.sequence_id] += p.length
    assert all(n == 2048 for k, n in ends.items() if k < max(ends))


def test_empty_tables(spark, tmp_path):
    docs = documents(spark, [])
    sf = tables(spark, tmp_path)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).count() == 0
