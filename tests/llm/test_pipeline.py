"""The stages over small tables, each held against plain Python on its own input."""

import re
from collections import defaultdict

import pytest
from test_ngram_join import brute as components
from test_substring_dedup import brute as repeats

import corpus_pipeline
from gaugelake.llm.common import read_table
from gaugelake.session import stage

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@pytest.fixture(scope="module")
def steps(spark):
    docs = read_table(spark, SF, "documents")
    out = [docs.collect()]
    for name, step in corpus_pipeline.STAGES:
        docs = stage(step(spark, docs, SF), name)
        out.append(docs.collect())
    return out


def texts(rows):
    return [(r.doc_id, r.text) for r in rows]


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_filters_keep_columns_and_rows(spark, steps):
    columns = read_table(spark, SF, "documents").columns
    for before, after in zip(steps[:4], steps[1:5], strict=True):
        assert {r.doc_id for r in after} <= {r.doc_id for r in before}
        assert all(list(r.asDict()) == columns for r in after)
    toxic = {r.doc_id for r in read_table(spark, SF, "labels").where("toxic = 1").collect()}
    gone = {r.doc_id for r in steps[0]} - {r.doc_id for r in steps[1]}
    labelled = {r.doc_id for r in read_table(spark, SF, "labels").collect()}
    assert len(gone & toxic) >= 0.5 * len((gone & labelled) | toxic)


def test_one_of_each_group_stays(steps):
    want = sorted(doc for doc, _, root in components(texts(steps[1])) if doc == root)
    assert sorted(r.doc_id for r in steps[2]) == want


def test_repeats_are_cut(steps):
    want = repeats(texts(steps[2]), 20)
    after = dict(texts(steps[3]))
    for (doc, text), (n, removed, _) in want.items():
        assert len(after[doc].split()) == n - removed if removed else after[doc] == text


def test_contaminated_documents_go(spark, steps):
    windows = defaultdict(set)
    for r in read_table(spark, SF, "benchmark").collect():
        w = words(r.text)
        for i in range(max(1, len(w) - 12) if w else 0):
            windows[len(w[i:i + 13])].add(tuple(w[i:i + 13]))
    want = []
    for r in steps[3]:
        w, hit = words(r.text), set()
        for n, found in windows.items():
            for i in range(len(w) - n + 1):
                if tuple(w[i:i + n]) in found:
                    hit |= set(range(i, i + n))
        if not hit or 20 * len(hit) < len(w):
            want.append(r.doc_id)
    assert sorted(r.doc_id for r in steps[4]) == sorted(want)


def test_pieces_tile_every_document(steps):
    pieces = defaultdict(list)
    for p in steps[5]:
        pieces[p.doc_id].append((p.start, p.length, p.doc_tokens))
    assert set(pieces) == {r.doc_id for r in steps[4]}
    for found in pieces.values():
        place = 0
        for start, length, total in sorted(found):
            assert start == place
            place += length
        assert place == total
