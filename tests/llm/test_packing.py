import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from llm_cases import awkward, frame
from tokenizers import Tokenizer

from gaugelake.llm import packing as op
from gaugelake.llm.tokens import Encoder

PATH = public_tokenizers.path("word_bpe_49k.json")


def check(spark, rows, window, shard):
    tokenizer = Tokenizer.from_file(PATH)
    out = op.pack(frame(spark, rows, True), PATH, 1, window, shard).collect()
    want = sorted(tuple(tokenizer.encode(t or "", add_special_tokens=False).ids + [1]) for _, t in rows)
    got, sequences = defaultdict(list), defaultdict(list)
    for r in out:
        got[r.rest.doc_id, r.doc_tokens].append(r)
        sequences[r.sequence_id].append(r)
        assert len(r.ids) == 4 * r.length and r.rest.place == "x"
    # Pieces tile every document: with repeated rows, as often as the rows.
    ids = sum(r.length for r in out)
    assert ids == sum(map(len, want))
    whole = []
    for (_, n), pieces in got.items():
        at = defaultdict(list)
        for p in pieces:
            at[p.start].append(p)
        while at[0]:
            place, tokens = 0, []
            while place < n:
                p = at[place].pop()
                tokens += np.frombuffer(p.ids, "<u4").tolist()
                place += p.length
            assert place == n
            whole.append(tuple(tokens))
    assert sorted(whole) == want
    for pieces in sequences.values():
        pieces.sort(key=lambda p: p.offset)
        total = 0
        for p in pieces:
            assert p.offset == total
            total += p.length
        assert total == window or total & (total - 1) == 0
    return out


def test_awkward_rows(spark):
    rows = [(i, t[:4000] if t else t) for i, t in awkward()]
    check(spark, rows, 64, 300)
    check(spark, rows, 2048, 1_000_000)
    assert op.pack(frame(spark, []), PATH).collect() == []


def test_windows_hold_related_texts(spark):
    topics = ["whale ocean ship sailor harbor", "proof theorem lemma algebra ring", "flour butter oven sugar dough"]
    rows = [(i, " ".join([topics[i % 3]] * 6)) for i in range(90)]
    texts = [np.frombuffer(x, "<u2") for x in Encoder(PATH).encode([t for _, t in rows])]
    idf = np.ones(50_000)
    left: list = []
    windows = list(op.fill(texts, idf, 30.0, left, 128))
    mixed = sum(len({i % 3 for i, _, _ in w}) > 1 for w in windows)
    assert len(windows) > 15 and mixed <= 3
    check(spark, rows, 128, 1000)


def test_crc(spark):
    r = op.pack(frame(spark, [(1, "hello, world")]), PATH).selectExpr("crc32(ids) c", "ids").collect()
    assert all(x.c == zlib.crc32(x.ids) for x in r)


def test_cached_words_encode_as_the_tokenizer_does():
    encoder, tokenizer = Encoder(PATH), Tokenizer.from_file(PATH)
    texts = ["It's ''tion !'s 12é²", "<|endoftext|> x", "İstanbul ſ ǅ ﬁ é", "", "a b\x85c\x1cd", "ÄÖ ß — “q” …"]
    for text, ids in zip(texts * 2, encoder.encode(texts * 2), strict=True):
        assert np.frombuffer(ids, "<u2").tolist() == tokenizer.encode(text, add_special_tokens=False).ids
