"""The stages against what brute force says about their own input."""

import re
from collections import defaultdict

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from gleanery.llm import mixing
from gleanery.llm.store import table, written
from tests.llm.test_near_dup import brute


@pytest.fixture(scope="module")
def steps(spark, tables):
    docs, out = table(spark, tables, "documents"), []
    for _, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, tables))
        out.append(docs)
    return out


def test_names_and_columns(spark, tables, steps):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "near dedup", "mixing", "bpe"]
    columns = table(spark, tables, "documents").columns
    assert all(s.columns == columns for s in steps[:-1]) and corpus_pipeline.ORACLE_SQL is None


def test_clean_documents_stay(steps):
    kept = {r.doc_id for r in steps[0].collect()}
    assert len(kept & set(range(400))) >= 396 and len(kept & set(range(400, 480))) <= 16


def test_lines(steps):
    a, b = ({(r.doc_id, r.source): r for r in s.collect()} for s in steps[:2])
    assert set(a) == set(b)
    shared = [b[600 + i, "s3"].text for i in range(5)]
    assert len(shared[0].split("\n")) == 10 and all(len(t.split("\n")) == 6 for t in shared[1:])
    assert all(r.n_chars == len(r.text) for k, r in b.items() if r.text is not None and r.text != a[k].text)


def test_one_of_each_group(steps):
    before = [(r.doc_id, r.text) for r in steps[1].collect()]
    groups = brute(before, 5)
    assert steps[2].count() == len({c for _, n, c in groups if n}) + sum(1 for _, n, _ in groups if not n)


def test_mix_and_encoding(steps):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    before, after = defaultdict(int), defaultdict(int)
    for r in steps[2].collect():
        before[r.source] += size(r.text)
    for r in steps[3].collect():
        after[r.source] += size(r.text)
    names = sorted(before, key=lambda s: (s is None, s or ""))
    goal = dict(zip(names, mixing.targets([before[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))]), strict=True))
    # Documents go whole; the one of 30,000 words in s1 is left out of the comparison.
    assert all(abs(after[s] - goal[s]) <= 0.1 * goal[s] + 200 for s in names if s != "s1")
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = defaultdict(list)
    for r in steps[3].collect():
        texts[r.doc_id].append(library.encode(r.text or "", add_special_tokens=False).ids)
    rows = steps[4].collect()
    assert len(rows) == steps[3].count() and all(r.ids in texts[r.doc_id] and r.n_tokens == len(r.ids) for r in rows)


def test_run(spark, tables, steps):
    got = corpus_pipeline.run(spark, tables)
    assert got.columns == steps[-1].columns
    assert sorted(r.ids_sha256 for r in got.collect()) == sorted(r.ids_sha256 for r in steps[-1].collect())


def test_run_leaves_only_its_result(spark, tables, tmp_path, monkeypatch):
    from gleanery.llm import store

    monkeypatch.setattr(store, "shared_dir", lambda spark: f"file://{tmp_path}")
    got = corpus_pipeline.run(spark, tables)
    assert [str(p) for p in tmp_path.iterdir()] == [got._gleanery_path.removeprefix("file://")] and got.count() > 0
