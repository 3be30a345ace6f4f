"""I-Match against a brute-force version, and its grading in large groups of near copies."""

import random
import re
from collections import Counter

import pytest
import xxhash

from eventlens.llm import fingerprints as prints

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def hashed(value, seed=42, width=8):
    raw = value.encode() if isinstance(value, str) else value.to_bytes(width, "little", signed=True)
    number = xxhash.xxh64_intdigest(raw, seed=seed & (1 << 64) - 1)
    return number - (1 << 64) if number >> 63 else number


def chain(values):
    seed = 42
    for value in values:
        seed = hashed(value, seed)
    return seed


def brute(docs):
    """doc_id: (fingerprint, terms of the lexicon) from the definition."""
    terms = {i: {hashed(w.lower()) for w in WORD.findall(text or "")} for i, text in docs}
    counts = Counter(t for found in terms.values() for t in found)
    band = {t for t, n in counts.items() if prints.MIN_SHARE <= n / len(docs) <= prints.MAX_SHARE}

    def inside(term, part):
        return hashed(part, hashed(term), 4) & ((1 << prints.RATES[part]) - 1) == 0

    out = {}
    for i, found in terms.items():
        mine = found & band
        mine = sorted(mine if len(mine) >= prints.FEW else found)
        parts = []
        for part in range(len(prints.RATES)):
            chosen = [t for t in mine if inside(t, part)]
            parts.append(f"{chain(chosen) & prints.MASK:08x}" if chosen else "0" * 8)
        out[i] = "".join(parts)
    return out


def test_fingerprints_by_brute_force(spark, make_docs, tmp_path):
    random.seed(5)
    docs = [(i, " ".join(random.choice([f"w{random.randrange(400)}", f"c{random.randrange(5)}"]) for _ in range(random.randrange(60)))) for i in range(120)]
    docs += [(200, None), (201, "Été été ß"), (202, docs[3][1])]
    make_docs(docs).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["fingerprint"] for r in prints.op1_fingerprints(spark, str(tmp_path)).collect()}
    assert got == brute(docs)


@pytest.mark.parametrize("family", [8, 80])
def test_near_copies_are_graded_however_many_there_are(spark, make_docs, tmp_path, family):
    """Of 200 documents a family of one text with one word of 200 changed in each."""
    random.seed(9)
    base = [f"word{i}" for i in range(200)]
    docs = []
    for i in range(family):
        words = list(base)
        words[random.randrange(200)] = f"other{i}"
        docs.append((i, " ".join(words)))
    docs += [(i, " ".join(f"x{random.randrange(3000)}" for _ in range(150))) for i in range(family, 200)]
    make_docs(docs).write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r["doc_id"]: r for r in prints.op1_fingerprints(spark, str(tmp_path)).collect()}
    near = [rows[i]["near_next"] for i in range(1, family)]
    assert min(near) >= 0.6
    assert max(rows[i]["near_next"] for i in range(family + 1, 200)) < 0.3
