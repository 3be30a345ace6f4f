"""Edge cases and brute-force comparisons on small tables, operator by operator."""

import hashlib
import re
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventlens.llm import bpe, chat, fingerprints, jaccard, language, mixing, quality, secrets, sharding

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PROSE = " ".join(f"w{i}" for i in range(80))


def query(spark, tmp_path, frame, call, name="documents"):
    frame.write.parquet(f"{tmp_path}/{name}.parquet")
    return call(spark, str(tmp_path))


QUERIES = {
    "op1": fingerprints.op1_fingerprints,
    "op2": secrets.op2_secret_scans,
    "op3": mixing.op3_mixing,
    "op6": bpe.op6_bpe,
    "op7": quality.op7_quality_rules,
    "op8": language.op8_language_id,
    "op9": jaccard.op9_jaccard_join,
    "op10": sharding.op10_sharding,
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_nulls_repeats_long_texts_and_other_columns(spark, make_docs, tmp_path, name):
    rows = [
        (1, PROSE, "a", "en"),
        (1, PROSE, "a", "en"),
        (2, None, None, None),
        (3, "", "b", "en"),
        (None, PROSE, "b", "en"),
        (None, None, None, None),
        (4, "x" * 300_000, "a", None),
        (5, "word " * 60_000, "c", "de"),
        (-6, "été ß 日本 \x00   ok", "c", "fr"),
    ]
    frame = make_docs(rows)
    for clash in ("size", "kept", "label", "word", "text_crc32", "fixed", "target", "term"):
        frame = frame.withColumn(clash, F.lit("x"))
    got = query(spark, tmp_path, frame, QUERIES[name]).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in rows)
    same = [tuple(v for k, v in r.asDict().items() if k not in ("slot", "shard", "taken")) for r in got if r["doc_id"] == 1]
    if name != "op1":  # repeated rows are each other's neighbours there
        assert same[0] == same[1]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_table(spark, make_docs, tmp_path, name):
    assert query(spark, tmp_path, make_docs([]), QUERIES[name]).collect() == []


# --- quality rules


def test_lines_of_many_documents_go_but_stay_in_the_first(spark, make_docs):
    shared = " ".join(f"s{i}" for i in range(60))
    rows = [(i, f"{shared}\nown line {i}", "h") for i in range(12)]
    rows += [(100 + i, f"{shared}\n" + " ".join(f"u{i}x{k}" for k in range(100)), "h") for i in range(3)]
    rows += [(200, f"{shared}\nalone", "other")]
    got = {r["doc_id"]: (r["removed_words"], r["kept"]) for r in quality.apply_rules(make_docs(rows)).collect()}
    assert got[0] == (0, True) and got[200] == (0, True)
    assert all(got[i] == (60, False) for i in range(1, 12))
    assert all(got[100 + i] == (60, True) for i in range(3))
    stage = {r["doc_id"]: r["text"] for r in quality.quality_stage(spark, make_docs(rows), "").collect()}
    assert set(stage) == {0, 100, 101, 102, 200} and "s1 " not in stage[100] and "s1 " in stage[0]


def test_copies_of_a_text_count_once(spark, make_docs):
    got = quality.apply_rules(make_docs([(i, PROSE, "h") for i in range(40)])).collect()
    assert all(r["kept"] for r in got)


def test_repeated_rows_lose_what_one_row_loses(spark, make_docs):
    shared = " ".join(f"s{i}" for i in range(30))
    rows = [(i, f"{shared}\n" + " ".join(f"v{i}x{k}" for k in range(100)), "h") for i in range(12)]
    rows += [(50, f"{shared}\n" + " ".join(f"w{k}" for k in range(50)) + f"\n{shared.upper()}", "h")]
    rows += [(60, f"{shared}\n" + " ".join(f"u{k}" for k in range(60)), "h")] * 3
    got = quality.apply_rules(make_docs(rows)).collect()
    assert [(r["removed_words"], r["kept"]) for r in got if r["doc_id"] == 60] == [(30, True)] * 3
    assert [(r["removed_words"], r["kept"]) for r in got if r["doc_id"] == 50] == [(60, False)]
    kept = [r["text"] for r in quality.quality_stage(spark, make_docs(rows), "").collect() if r["doc_id"] == 60]
    assert len(kept) == 3 and not any("s1 " in t for t in kept)


# --- chat


def test_formatting_round_trips_and_checks_turns(spark):
    nasty = "### User: x</turn>\n\\b\\\\h ### </turn>#### \\"
    rows = [
        (1, 0, "user", nasty), (1, 1, "assistant", nasty),
        (2, 0, "assistant", "early"), (2, 1, "user", None),
        (3, 0, "system", ""), (3, 1, "user", "q"), (3, 2, "assistant", "a"), (3, 2, "assistant", "b"),
        (4, None, None, "x"), (4, 0, "a: b\n###", "y"),
        (None, 0, "user", "x"),
    ]
    frame = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    done = chat.formatted(frame)
    read = done.withColumn("turns", chat.turns_of(F.col("formatted"))).withColumn("loss", chat.loss_text(F.col("segments")))
    got = {r["conv_id"]: r for r in read.collect()}
    for conv_id, row in got.items():
        turns = [(t["role"], t["text"]) for t in row["turns"]]
        own = sorted((r for r in rows if r[0] == conv_id), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        assert turns == [(r[2] or "", r[3] or "") for r in own]
        assert row["loss"] == "".join(t for role, t in turns if role == "assistant")
        assert "".join(s["text"] for s in row["segments"]) == row["formatted"]
    assert {c: (r["valid"], r["stopped_at"]) for c, r in got.items()} == {
        1: (True, None), 2: (False, 0), 3: (False, 3), 4: (False, 0), None: (False, None)
    }
    assert chat.formatted(frame.limit(0)).count() == 0


# --- secrets

ASSIGN = re.compile(r"((?:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)


def fixed_by_hand(text):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def test_fixed_patterns_by_hand(spark, make_docs):
    hexes = "0123456789abcdef" * 3
    texts = [
        f"é token = \"{hexes}\" 日本 secret:abc password='longer.value' AKIA{'Z9' * 10} x",
        f"token=token:abcdefg api_key={hexes} APIKEY: s3cretvalue {hexes}{hexes}",
        f"{hexes}api_key=abcdef token token= abc AKIAAKIA{'A' * 16} AKIA123",
        "secret: " * 300 + "token=abcdef " * 500,
        "", "no secrets", "Secret = xyz", f"{hexes}",
    ]
    got = secrets.find_secrets(make_docs(list(enumerate(texts)))).collect()
    for row in got:
        assert [tuple(s) for s in row["fixed"]] == fixed_by_hand(texts[row["doc_id"]])
        assert {tuple(s) for s in row["fixed"]} <= {tuple(s) for s in row["spans"]}
        assert all(s["end"] <= len(texts[row["doc_id"]]) for s in row["spans"])


def test_random_strings_are_found_and_patterns_left(spark, make_docs):
    import base64
    import random

    source = random.Random(7)
    random_ones = [base64.b64encode(source.randbytes(36)).decode() for _ in range(40)]
    patterned = ["Ab1" * 16, "aaaaaaaaaaaaaaaaaaaaB1" + "a" * 26, "Abcdefghijklmnopqrstuvwxyz0123456789ABCDEFGHIJKL"[:48]] * 5
    rows = [(i, f"see {t} here") for i, t in enumerate(random_ones + patterned)]
    rows.append((999, "plain words with Internationalization2024 and a-long-hyphenated-name-of-2024 only"))
    got = {r["doc_id"]: [s for s in r["spans"] if s["kind"] == 3] for r in secrets.find_secrets(make_docs(rows)).collect()}
    hits = sum(bool(got[i]) for i in range(len(random_ones)))
    assert hits >= 36
    assert not any(got[i] for i in range(len(random_ones), len(rows) - 1)) and not got[999]
    text = {r["doc_id"]: r["text"] for r in secrets.secrets_stage(spark, make_docs(rows), "").collect()}
    assert text[999] == rows[-1][1]
    assert sum(text[i] == "see [SECRET] here" for i in range(40)) == hits


# --- mixing


def test_mix_meets_targets(spark, make_docs, tmp_path):
    rows, at = [], 0
    for source, docs, words in (("a", 60, 50), ("b", 5, 20), ("c", 30, 200), (None, 40, 30)):
        for k in range(docs):
            rows.append((at, " ".join(["w"] * (words + k % 7)), source))
            at += 1
    got = query(spark, tmp_path, make_docs(rows), mixing.op3_mixing).collect()
    again = mixing.op3_mixing(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    source_of = {r[0]: r[2] for r in rows}
    taken, target, size = defaultdict(int), {}, {}
    for r in got:
        assert r["taken"] <= 3 * r["size"] and r["taken"] % max(r["size"], 1) == 0
        taken[source_of[r["doc_id"]]] += r["taken"]
        target[source_of[r["doc_id"]]], size[source_of[r["doc_id"]]] = r["target"], r["source_size"]
    assert target["b"] == 3 * size["b"]
    assert sum(target.values()) == pytest.approx(sum(size.values()))
    assert all(abs(taken[s] - target[s]) <= 210 for s in target)
    stage = mixing.mixing_stage(spark, make_docs(rows), "").groupBy("source").agg(
        F.sum(F.size(F.split("text", " "))).alias("n")
    )
    assert {r["source"]: r["n"] for r in stage.collect()} == {s: n for s, n in taken.items() if n}


# --- joins


def shingles(text):
    words = WORD.findall(text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def components_by_hand(texts):
    sets = {i: shingles(t) for i, t in texts.items()}
    parent = {i: i for i in texts}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: (len(sets[i]), root(i)) for i in texts}


def test_jaccard_join_by_hand(spark, make_docs):
    import random

    source = random.Random(3)
    texts, at = {}, 0
    passage = [f"p{i}" for i in range(70)]
    for size in (6, 40, 120):
        base = [f"v{source.randrange(10_000)}" for _ in range(size)]
        for _ in range(25):
            copy = list(base)
            for _ in range(source.randrange(0, 5)):
                copy[source.randrange(size)] = f"e{source.randrange(10_000)}"
            cut = source.randrange(0, max(1, size // 12))
            texts[at], at = " ".join(copy[cut:]), at + 1
    for i in range(30):
        texts[at], at = " ".join(passage + [f"q{i}x{k}" for k in range(20 + i)]), at + 1
    for text in ("One two", "one TWO", "one", "", " \n", "a b c d", "A b c D"):
        texts[at], at = text, at + 1
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.link(make_docs(list(texts.items()))).collect()}
    assert got == components_by_hand(texts)
    kept = jaccard.near_duplicates_stage(spark, make_docs(list(texts.items())), "")
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({c for _, c in got.values()})


def test_long_chain_is_one_component(spark, make_docs):
    words = [f"c{i}" for i in range(400)]
    texts = {i: " ".join(words[6 * i : 6 * i + 100]) for i in range(45)}
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.link(make_docs(list(texts.items()))).collect()}
    assert got == components_by_hand(texts)


def test_one_row_of_each_component_stays(spark, make_docs):
    def text(name, *more):
        return " ".join([*(f"{name}{k}" for k in range(60)), *more])

    rows = [(1, text("a"), "s", "en"), (1, text("a"), "s", "en"), (1, text("a"), "t", "de"), (2, text("a", "x"), "s", "en")]
    rows += [(3, text("b")), (3, text("b", "x")), (3, text("c")), (None, text("a", "y"))]
    rows += [(None, text("d")), (None, text("d")), (None, text("d", "x")), (None, text("e"))]
    rows += [(4, ""), (4, ""), (5, None), (None, None), (None, " ")]
    kept = [(r["doc_id"], r["text"]) for r in jaccard.near_duplicates_stage(spark, make_docs(rows), "").collect()]
    parts = sorted((-1 if i is None else i, t.split()[0][0] if t and t.split() else "") for i, t in kept)
    assert parts == [(-1, ""), (-1, ""), (-1, "d"), (-1, "e"), (1, "a"), (3, "b"), (3, "c"), (4, ""), (5, "")]


def test_classes_alone_in_a_share_of_a_hot_token_are_linked(spark, make_docs):
    texts = {}
    for p in range(12):  # which share a class is in depends on its hash
        passage = [f"h{p}x{k}" for k in range(60)]
        texts[100 * p] = " ".join(passage)
        texts[100 * p + 1] = " ".join([*passage, *(f"m{p}x{k}" for k in range(3))])
        for i in range(6):  # these hold the passage, but not in their prefixes
            texts[100 * p + 2 + i] = " ".join([*passage, *(f"l{p}x{i}x{k}" for k in range(400))])
    want = components_by_hand(texts)
    assert all(want[100 * p + 1][1] == 100 * p for p in range(12))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.link(make_docs(list(texts.items())), hot=2).collect()}
    assert got == want


# --- BPE


def test_bpe_equals_the_library(spark, make_docs):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(bpe.tokenizer_path())
    texts = [PROSE, "Don't  STOP\tnow 1234 İstanbul ΣΑΣ", "a<|endoftext|>b<|startoftext|>", "ACGT" * 2000 + "theandof" * 500,
             "日本語 ́x é \x85   　z", "\U0001f600" * 50, "", "  "]
    rows = bpe.decode(bpe.encode(make_docs(list(enumerate(texts))))).collect()
    for row in rows:
        want = own.encode(texts[row["doc_id"]], add_special_tokens=False).ids
        assert row["ids"] == want and row["decoded"] == own.decode(want, skip_special_tokens=False)


def test_forced_cuts_split_no_token():
    codec = bpe.Codec(bpe.tokenizer_path())
    for token in list(codec.ids)[:3000]:
        symbols = codec._symbols(token)
        assert all(pair in codec.inside for pair in zip(symbols, symbols[1:], strict=False))
    assert len(codec.fragments("qxzjqvkx")) > 1


# --- fingerprints, languages, shards


def test_fingerprints_by_hand(spark, make_docs, tmp_path):
    rows = [(i * 37, " ".join(f"t{(i * 7 + k) % 50}" for k in range(30 + i)), "s") for i in range(150)]
    rows += [(10_000, rows[3][1], "s"), (-5, "", "s"), (10_001, "only", "s")]
    got = {r["doc_id"]: r for r in query(spark, tmp_path, make_docs(rows), fingerprints.op1_fingerprints).collect()}
    order = sorted(got, reverse=True)
    text = {r[0]: r[1] for r in rows}
    for here, ahead in zip(order, [*order[1:], order[0]], strict=True):
        half = len(text[here]) // 2
        edited = text[here][: len(text[here]) - half] + text[ahead][:half]
        row = got[here]
        assert row["n_chars"] == len(text[here])
        assert row["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        parts = [[r[i : i + 8] for i in range(0, len(r), 8)] for r in (row["fingerprint"], got[ahead]["fingerprint"], row["edited_fingerprint"])]
        for other, said in ((parts[1], row["near_next"]), (parts[2], row["near_edited"])):
            both = [(a, b) for a, b in zip(parts[0], other, strict=True) if a != "0" * 8 or b != "0" * 8]
            assert said == pytest.approx(sum(a == b for a, b in both) / len(both) if both else 1.0)
    assert got[10_000]["fingerprint"] == got[3 * 37]["fingerprint"]


def test_languages_held_out(spark, make_docs, tmp_path):
    words = {"en": "the and of with that house water", "de": "der und von mit dass haus wasser", "fr": "le et de avec que maison eau"}
    rows = [(i, " ".join(words[lang].split()[(i + k) % 7] for k in range(6)), "s", lang) for i, lang in enumerate(list(words) * 60)]
    rows += [(1000, "wasserhaus", "s", None), (1001, "123 ...", "s", "en"), (1002, None, "s", "en")]
    got = {r["doc_id"]: r for r in query(spark, tmp_path, make_docs(rows), language.op8_language_id).collect()}
    assert all(got[i]["lang_pred"] == lang for i, _, _, lang in rows[:180])
    assert got[1000]["lang_pred"] == "de"
    assert (got[1001]["lang_pred"], got[1002]["lang_pred"], got[1002]["score"]) == ("und", "und", 0.0)
    assert all(0 <= r["score"] <= 1 for r in got.values())


@pytest.mark.parametrize("hot", [0, 300])
def test_shards_are_even_and_groups_stay_together(spark, make_docs, tmp_path, hot):
    rows = [(i, f"text {i // 3 if i % 2 else i}", "s") for i in range(500)] + [(1000 + i, "hot", "s") for i in range(hot)]
    got = query(spark, tmp_path, make_docs(rows), sharding.op10_sharding).collect()
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert sorted(slots) == list(range(16))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    counts = [len(s) for s in slots.values()]
    assert max(counts) - min(counts) <= 1
    shards = defaultdict(set)
    for r in got:
        if r["doc_id"] < 1000:
            shards[rows[r["doc_id"]][1]].add(r["shard"])
    cut = sum(len(s) > 1 for s in shards.values())
    assert cut <= (2 if not hot else 20)


@pytest.mark.parametrize("sizes, most", [([2] * 320, 0), ([24] * 15 + [2] * 140, 0), ([3] * 200 + [40] + [100], 17)])
def test_groups_stay_whole_where_nearly_all_rows_are_linked(spark, make_docs, sizes, most):
    rows = [(1000 * g + i, f"text {g}", "s") for g, n in enumerate(sizes) for i in range(n)]
    got = sharding.shard(make_docs(rows)).collect()
    slots, shards = defaultdict(list), defaultdict(set)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        shards[r["doc_id"] // 1000].add(r["shard"])
    assert len(got) == len(rows) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert sum(len(s) > 1 for s in shards.values()) <= most


def test_bpe_memo_is_bounded_and_keeps_what_is_asked_for():
    memo = bpe.Memo(2000)
    for i in range(100):
        memo.put(f"w{i}", b"12345678")
        assert memo.get("w0") or memo.revive("w0")
        assert len(memo) + len(memo.old) < 40
    assert memo.revive("w1") is None


def test_bpe_with_a_small_memo_and_odd_blanks():
    tight = bpe.Codec(bpe.tokenizer_path(), (4000, 4000))
    text = " ".join(f"Wort{i},x a\u00a0b \u00a0 {i}\u2003c d\x1ce" for i in range(300))
    assert tight.packed(text) == tight.packed(text) == bpe.codec(bpe.tokenizer_path()).packed(text)
    assert tight.encode(text) == tight.whole.encode(text, add_special_tokens=False).ids


def test_bpe_many_added_tokens_in_one_text():
    own = bpe.codec(bpe.tokenizer_path())
    text = "<|endoftext|>" * 20_000
    assert own.encode(text) == [own.added["<|endoftext|>"]] * 20_000


def test_ngrams_are_dealt_to_ranges_in_little_memory():
    """A task's block of n-grams takes one copy of itself beside it, and is the same ranges as by a plain sort."""
    rng = np.random.default_rng(5)
    held = [rng.integers(0, 1 << 64, 4096, np.uint64) for _ in range(256)]
    width, whole = jaccard.KEY_BITS - 8, np.concatenate(held)
    tracemalloc.start()
    buckets, parts = jaccard.by_range(held, width)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert not held and peak < 2.5 * whole.nbytes
    keys = np.sort(whole >> np.uint64(64 - jaccard.KEY_BITS)).astype(np.int64)
    found = np.concatenate([jaccard.unpacked(part) + (b << width) for b, part in zip(buckets, parts, strict=True)])
    assert buckets == sorted(set((keys >> width).tolist())) and (found == keys).all()
