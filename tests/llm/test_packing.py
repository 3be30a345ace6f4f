"""Packing: its contract, a serial best fit, and the token ids of the tokenizers library."""

import random
import zlib
from bisect import bisect_left, insort
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventlens.llm import packing
from eventlens.llm.common import stored


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(packing.tokenizer_path())
    whole.no_truncation()
    whole.no_padding()
    return whole


def serial(lengths, capacity):
    """Sequences that best fit by falling length opens."""
    gaps, opened = [], 0
    for length in sorted(lengths, reverse=True):
        at = bisect_left(gaps, length)
        if at < len(gaps):
            free = gaps.pop(at)
        else:
            free, opened = capacity, opened + 1
        if free > length:
            insort(gaps, free - length)
    return opened


def packed(spark, lengths, capacity):
    items = stored(spark.createDataFrame(list(enumerate(lengths)), "id long, length long"), "items")
    rows = packing.pack(items, capacity).collect()
    assert sorted(r["id"] for r in rows) == list(range(len(lengths)))
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], lengths[r["id"]]))
    for pieces in sequences.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= capacity
    return len(sequences)


@pytest.mark.parametrize("kind", ["mixed", "hot", "small", "large", "halves"])
@pytest.mark.parametrize("ranges", [1, 7])
def test_as_few_sequences_as_serial_best_fit(spark, monkeypatch, kind, ranges):
    random.seed(kind)
    lengths = {
        "mixed": [random.choice([1, 3, random.randint(1, 64), random.randint(1, 256), random.randint(1, 40)]) for _ in range(1200)],
        "hot": [100] * 500 + [random.randint(1, 256) for _ in range(700)],
        "small": [random.randint(1, 9) for _ in range(1500)],
        "large": [random.randint(129, 256) for _ in range(300)],
        "halves": [random.choice([128, 127, 86, 85, 64]) for _ in range(600)],
    }[kind]
    monkeypatch.setattr(packing, "SMALL", 1200 // ranges)
    few, best = packed(spark, lengths, 256), serial(lengths, 256)
    assert few <= best * 1.02 + 1
    assert few >= -(-sum(lengths) // 256)


def test_one_length_and_empty(spark):
    assert packed(spark, [1] * 600, 256) == 3
    assert packed(spark, [256] * 3, 256) == 3
    assert packed(spark, [], 256) == 0


def test_crossings_pair_the_nearest_earlier_gaps():
    """Against a stack of single places."""
    random.seed(3)
    for _ in range(50):
        totals = [(part, random.randint(0, 4), random.randint(0, 4)) for part in range(6)]
        stack, pairs = [], []
        for part, docs, places in totals:
            for at in range(docs):
                if stack:
                    pairs.append((part, at, *stack.pop()))
            stack += [(part, p) for p in reversed(range(places))]
        found = [(p, a + i, q, b + i) for p, a, q, b, n in packing.crossings(totals) for i in range(n)]
        assert sorted(found) == sorted(pairs)


def test_ids_of_every_character(library):
    encode = packing.encoder(packing.tokenizer_path())
    signs = [chr(c) for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{c}1{c} {c}\n" for c in signs[at : at + 300]) for at in range(0, len(signs), 300)]
    wrong = [t for t in texts if encode(t) != library.encode(t, add_special_tokens=False).ids]
    assert not wrong


def test_ids_of_odd_texts(library):
    encode = packing.encoder(packing.tokenizer_path())
    texts = ["", " ", "\n\n  x", "a<|endoftext|>b <|endoftext|>", "<|endoftext", "don't they'LL", "x" * 50_000, " " * 5000, "é́日本 🙂‍" * 50, "\x00\x1c\x85  a"]
    for text in texts:
        assert encode(text) == library.encode(text, add_special_tokens=False).ids


def test_query(spark, make_docs, tmp_path, library):
    """The contract from the library's ids, with nulls, repeats, long texts and other columns."""
    long_text = " ".join(f"w{i}" for i in range(4000))
    rows = [(1, "one two"), (1, "one two"), (2, None), (3, ""), (None, "x y"), (4, long_text), (5, "<|endoftext|>"), (6, "z " * 2047), (7, "z " * 4095)]
    rows += [(100 + i, f"some text {i} " * (i % 60)) for i in range(200)]
    frame = make_docs(rows)
    for name in ("id", "length", "piece", "crcs", "free", "match", "sequence_id"):
        frame = frame.withColumn(name, F.lit("x"))
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    got = packing.op11_packing(spark, str(tmp_path)).collect()
    expected = Counter()
    for doc, text in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        first = (len(ids) - 1) % 2048 + 1
        for piece, start in enumerate([0, *range(first, len(ids), 2048)]):
            part = ids[start : start + (first if piece == 0 else 2048)]
            expected[doc, piece, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == expected
    filled = defaultdict(list)
    for r in got:
        filled[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in filled.values():
        assert [o for o, _ in sorted(pieces)] == [0, *np.cumsum([n for _, n in sorted(pieces)])[:-1]]
        assert sum(n for _, n in pieces) <= 2048
    assert len(filled) <= -(-sum(r["length"] for r in got) // 2048) + 1


def test_sequences_hold_the_ids(spark, make_docs, library):
    docs = [(i, f"text {i} " * (i * 40 + 1)) for i in range(30)]
    rows = packing.packed_ids(make_docs(docs)).collect()
    assert all(len(r["ids"]) <= 2048 for r in rows)
    total = sum(len(library.encode(t, add_special_tokens=False).ids) + 1 for _, t in docs)
    assert sum(len(r["ids"]) for r in rows) == total


def test_empty_table(spark, make_docs, tmp_path):
    make_docs([]).write.parquet(f"{tmp_path}/documents.parquet")
    assert packing.op11_packing(spark, str(tmp_path)).collect() == []
