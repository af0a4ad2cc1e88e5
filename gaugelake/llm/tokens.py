"""Token ids of whole texts by a tokenizer file, with a cache of words in each worker.

The tokenizer's own pattern never crosses white space, so words are encoded independently of
each other and most come from a cache. A text with a character whose normalisation could
differ between the two libraries, or with the text of a special token, is encoded whole.
"""

from __future__ import annotations

import json
import os
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from gaugelake.llm import common

CACHE_WORDS = 700_000
# Characters that both libraries normalise, lower-case and classify alike.
_PLAIN = regex.compile(r"[\t\n\r -~¡-įı-ňŊ-ž‐-‧‰-⁞€]*")
_NORMALIZERS = ["NFC", "Replace", "Lowercase"]


class _Cache(dict):
    """Values found by ``find`` on first use."""

    def __init__(self, find):
        self.find = find

    def __missing__(self, key: str) -> bytes:
        found = self[key] = self.find(key)
        return found


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others follow at 256."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.dtype = np.dtype("<u2" if self.whole.get_vocab_size() <= 1 << 16 else "<u4")
        self.specials = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.letters = _byte_letters()
        self.words = _Cache(self._word)
        with open(path, encoding="utf-8") as file:
            parts = json.load(file)
        first, second = parts.get("normalizer") or {}, parts.get("pre_tokenizer") or {}
        kinds = [n["type"] for n in first.get("normalizers", [])]
        steps = second.get("pretokenizers") or [{}]
        self.pattern = None
        if kinds == _NORMALIZERS and [s.get("type") for s in steps] == ["Split", "ByteLevel"]:
            if steps[0]["invert"] and steps[0]["behavior"] == "Removed" and not steps[1]["add_prefix_space"]:
                self.pattern = regex.compile(steps[0]["pattern"]["Regex"])

    def _piece(self, piece: str) -> bytes:
        if not piece.isascii():
            piece = piece.encode().decode("latin-1").translate(self.letters)
        return array(self.code, [t.id for t in self.model.tokenize(piece)]).tobytes()

    def _word(self, word: str) -> bytes:
        pieces = self.pattern.findall(word)
        if len(pieces) == 1:
            return self._piece(pieces[0])
        # Of a word with signs around it the middle may be known by itself.
        words = self.words
        return b"".join([words[p] if p != word else self._piece(p) for p in pieces])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian ids of every text."""
        if len(self.words) > CACHE_WORDS:
            self.words.clear()
        of, out = self.words.__getitem__, []
        for text in texts:
            if self.pattern is not None and _PLAIN.fullmatch(text) and not any(s in text for s in self.specials):
                out.append(b"".join(map(of, text.lower().split())))
            else:
                found = self.whole.encode(text, add_special_tokens=False)
                out.append(np.array(found.ids, self.dtype).tobytes())
        return out


@lru_cache(maxsize=2)
def encoder_of(path: str) -> Encoder:
    """One encoder a worker process: its words stay known from task to task."""
    return Encoder(path)


def forget() -> None:
    """Give up this worker's encoders, before work that needs the memory for itself."""
    encoder_of.cache_clear()


def encoded(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """place, text_key, rest, n and ids (packed) of every document, ``end_id`` last; null text is empty.

    rare_1 and rare_2 are its two largest ids. A merge list grows from frequent to rare, so
    texts that share them share rare words.
    """
    texts = common.keyed(docs)
    rest = texts.schema["rest"].dataType.simpleString()

    def task(batches):
        encoder = encoder_of(path)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("text"))
            out: list[bytes] = []
            for first, last, _, _ in common.text_blocks(batch):
                out += encoder.encode([t or "" for t in column.slice(first, last - first).to_pylist()])
            end = np.array([end_id], encoder.dtype).tobytes()
            arrays = [np.frombuffer(x, encoder.dtype) for x in out]
            tops = [int(a.max(initial=0)) for a in arrays]
            seconds = [int(a[a < t].max(initial=0)) for a, t in zip(arrays, tops, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(3),
                 pa.array([len(a) + 1 for a in arrays], pa.int64()),
                 pa.array(tops, pa.int32()), pa.array(seconds, pa.int32()),
                 pa.array([x + end for x in out], pa.binary())],
                names=["place", "text_key", "rest", "n", "rare_1", "rare_2", "ids"],
            )

    return texts.mapInArrow(
        task, f"place long, text_key long, rest {rest}, n long, rare_1 int, rare_2 int, ids binary"
    )


def width_of(path: str) -> np.dtype:
    return encoder_of(path).dtype
