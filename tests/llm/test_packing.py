"""Packing: exact tokens, gapless sequences, as few as a sequential best fit needs (nearly)."""

import bisect
import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from fixtures import docs, empty
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerlens.llm import packing

TOKENIZER = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))


def ids_of(text):
    return [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, packing.END_TOKEN]


@pytest.mark.parametrize("text", [
    "Plain words, don't  they?\n\nYes\tthey\r\ndo", "", "  ", "ΟΔΟΣ İstanbul ẞ ﬁne", "a\x1cb c\x85d e\xa0f g h i​j k﻿",
    "é ́x ño", "<|startoftext|> <|endoftext|>x <|end oftext|>", "1234 5.6% $7 日本語 текст", "it's I'LL we've o'clock '' ''s"])
def test_tokens_of_words_are_those_of_the_text(text):
    data = packing.WordTokens(public_tokenizers.path(packing.VOCABULARY))(text)
    assert np.frombuffer(data, dtype="<u4").tolist() == ids_of(text)[:-1]


@pytest.mark.parametrize("at_once", [1 << 22, 12])
def test_texts_together_ask_for_each_word_once(monkeypatch, at_once):
    monkeypatch.setattr(packing, "TEXT_AT_ONCE", at_once)
    tokens = packing.WordTokens(public_tokenizers.path(packing.VOCABULARY))
    texts = ["skipped", "One two\ttwo ", None, "", " \n", " two, İ two", "12 12 12\r\n12", "two" * 9, None]
    asked = []
    monkeypatch.setattr(packing.WordTokens, "_distinct", lambda self, words, of=packing.WordTokens._distinct: asked.append(words.to_pylist()) or of(self, words))
    assert [np.frombuffer(x, dtype="<u4").tolist() for x in tokens.each(pa.array(texts).slice(1))] == [ids_of(t)[:-1] for t in texts[1:]]
    assert sum(map(len, asked)) == sum(len(set(words)) for words in asked)
    assert len(asked) == (1 if at_once > 12 else 4)
    assert list(tokens.each(pa.array([], type=pa.string()))) == []


def best_fit(lengths, capacity):
    gaps, n = [], 0
    for s in sorted(lengths, reverse=True):
        i = bisect.bisect_left(gaps, s)
        gap = gaps.pop(i) if i < len(gaps) else capacity
        n += gap == capacity
        if gap > s:
            bisect.insort(gaps, gap - s)
    return n


def check(rows, lengths, capacity):
    assert sorted(r.id for r in rows) == list(range(len(lengths)))
    at = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.place)):
        assert r.place == at.get(r.sequence_id, 0)
        at[r.sequence_id] = r.place + lengths[r.id]
    assert all(x <= capacity for x in at.values())
    return len(at)


@pytest.mark.parametrize("kind,ranges", [("mixed", 200), ("same", 100), ("pairs", 10**6)])
def test_pack(spark, kind, ranges):
    rng = random.Random(5)
    lengths = {"mixed": [rng.randint(1, 100) for _ in range(300)], "same": [30] * 200, "pairs": [60] * 60 + [40] * 60}[kind]
    items = spark.createDataFrame(list(enumerate(lengths)), "id long, length long")
    n = check(packing.pack(items, 100, ranges).collect(), lengths, 100)
    assert n <= best_fit(lengths, 100) * 1.05 + 1


def test_successors_take_the_nearest_larger_gaps_by_rank():
    plan = packing.successors([(0, 0, 0, 2, 90), (1, 0, 0, 3, 50), (2, 7, 40, 1, 10)])
    assert plan == [(2, 0, 3, 1, 0, 1, 0), (2, 3, 7, 0, 0, 2, 3)]


def test_documents(spark):
    df = docs(spark)
    rows = packing.pack_documents(df, capacity=64).collect()
    tokens = [(r.doc_id, ids_of(r.text)) for r in df.collect()]
    want = sorted((str(i), p // 64, p, len(t[p:p + 64]), zlib.crc32(np.array(t[p:p + 64], dtype="<u4").tobytes()))
                  for i, t in tokens for p in range(0, len(t), 64))
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    at = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at.get(r.sequence_id, 0)
        at[r.sequence_id] = r.offset + r.length
    assert max(at.values()) <= 64
    assert len(at) <= best_fit([r.length for r in rows], 64) + 1
    only = packing.pack_documents(df.where("doc_id in (4, 5)")).orderBy("offset").collect()
    assert [(r.length, r.ids_crc32) for r in only] == [(1, zlib.crc32(b"\0\0\0\0"))] * 2 and only[0].sequence_id == only[1].sequence_id


def test_empty(spark):
    assert packing.pack_documents(empty(spark)).count() == 0


def test_whole_table_is_packed_well(spark):
    found = packing.op2_packing(spark, "/root/testdata/sf0.001")
    n, tokens, half = found.agg(F.countDistinct("sequence_id"), F.sum("length"), F.sum((F.col("length") > 1024).cast("int"))).first()
    assert n <= 1.02 * max(-(-tokens // 2048), half) + 1
