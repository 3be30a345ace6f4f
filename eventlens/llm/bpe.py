"""BPE encoding and decoding with forced-boundary splitting.

Two neighbouring symbols that are next to each other in no vocabulary token can never come to lie in one
token, so the place between them is a certain cut. A piece of text is cut at all such places and
its fragments are encoded independently, each distinct fragment once while it stays in the memo, and their ids are
concatenated. The result is that of merging the whole piece: no merge reaches over a certain cut,
so merges on either side do not see each other.

The tokenizer file gives normaliser, pre-tokeniser, vocabulary, merges and added tokens; the tokenizers
library runs the first two. The memos of a worker are bounded by bytes (`Memo`), and texts go through it in parts of batches
of at most `PART` characters beyond one text.

Nulls: a null text is empty and has no tokens. Repeated rows get equal results, other columns come
through, an empty table gives an empty result, and texts are encoded whole.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import struct
import sys
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import accumulate
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventlens.llm.common import table

TOKENIZER = "word_bpe_49k.json"
#: Bytes of a generation of the memos of chunks and of pieces, of which there are two each: for a job of its own,
#: and for a stage whose executors hold what other stages left.
ROOMY, TIGHT = (150 << 20, 50 << 20), (30 << 20, 10 << 20)
#: Characters of texts that are worked on at a time.
PART = 1 << 21
#: Symbols of a fragment from which pairs are kept in a heap.
LONG = 64


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Memo(dict):
    """What was found for strings, in bounded memory: what was not asked for during a whole generation goes."""

    def __init__(self, most: int):
        super().__init__()
        self.most, self.held, self.old = most, 0, {}

    def put(self, key: str, value: Any) -> None:
        if self.held >= self.most:
            self.old = dict(self)
            self.clear()
            self.held = 0
        self[key] = value
        # two objects and their places in a dict
        self.held += sys.getsizeof(key) + sys.getsizeof(value) + 104

    def revive(self, key: str) -> Any:
        """The value from the generation before, which then belongs to this one; None if it is not there."""
        value = self.old.get(key)
        if value is not None:
            self.put(key, value)
        return value


class Codec:
    """One tokenizer file: `encode` to ids and `decode` to text."""

    def __init__(self, path: str, room: tuple[int, int] = ROOMY):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.ids: dict[str, int] = model["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.ranks = {pair: rank for rank, pair in enumerate(merges)}
        self.tokens = {i: t for t, i in self.ids.items()}
        self.added = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.tokens |= {i: t for t, i in self.added.items()}
        self.inside = {pair for token in self.ids for pair in self._pairs(token)}
        contents = sorted(self.added, key=len, reverse=True)
        self.added_at = re.compile("|".join(map(re.escape, contents))) if contents else None
        self.memo, self.pieces = Memo(room[0]), Memo(room[1])

    def _symbols(self, token: str) -> list[str]:
        """A token's symbols: characters, the last one with the end-of-word suffix."""
        if self.suffix and token.endswith(self.suffix) and len(token) > len(self.suffix):
            bare = token[: -len(self.suffix)]
            return [*bare[:-1], bare[-1] + self.suffix]
        return list(token)

    def _pairs(self, token: str) -> Iterator[tuple[str, str]]:
        symbols = self._symbols(token)
        return zip(symbols, symbols[1:], strict=False)

    def fragments(self, piece: str) -> list[tuple[str, ...]]:
        """The piece's symbols, cut at every forced boundary."""
        symbols = self._symbols(piece + self.suffix)
        inside = self.inside
        cuts = [i for i, pair in enumerate(zip(symbols, symbols[1:]), 1) if pair not in inside]  # noqa: B905
        if not cuts:
            return [tuple(symbols)]
        return [tuple(symbols[a:b]) for a, b in zip([0, *cuts], [*cuts, len(symbols)], strict=True)]

    def merged(self, fragment: tuple[str, ...]) -> list[int]:
        """Ids of one fragment: the pair of lowest rank is joined, leftmost first, until none is left."""
        if len(fragment) > LONG:
            return self._merged_long(fragment)
        rank, never = self.ranks.get, len(self.ranks)
        parts = list(fragment)
        ranks = [rank(pair, never) for pair in zip(parts, parts[1:])]  # noqa: B905
        while ranks and (best := min(ranks)) < never:
            i = ranks.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = rank((parts[i], parts[i + 1]), never)
            if i:
                ranks[i - 1] = rank((parts[i - 1], parts[i]), never)
        return [self.ids[p] for p in parts if p in self.ids]

    def _merged_long(self, fragment: tuple[str, ...]) -> list[int]:
        """As `merged`, with a heap of pairs and linked neighbours, for fragments of any length."""
        parts: list[str | None] = list(fragment)
        after = list(range(1, len(parts) + 1))
        before = list(range(-1, len(parts) - 1))
        heap: list[tuple[int, int, str, str]] = []

        def offer(i: int, j: int) -> None:
            pair = (parts[i], parts[j])
            if pair in self.ranks:
                heapq.heappush(heap, (self.ranks[pair], i, *pair))

        for i in range(len(parts) - 1):
            offer(i, i + 1)
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i]
            if parts[i] != left or j >= len(parts) or parts[j] != right:
                continue  # one of the two has been joined to something else since
            parts[i], parts[j], after[i] = left + right, None, after[j]
            if after[j] < len(parts):
                before[after[j]] = i
                offer(i, after[j])
            if before[i] >= 0:
                offer(before[i], i)
        return [self.ids[p] for p in parts if p is not None and p in self.ids]

    def piece_ids(self, piece: str) -> tuple[int, ...]:
        found = self.pieces.get(piece) or self.pieces.revive(piece)
        if found is None:
            found = tuple(i for fragment in self.fragments(piece) for i in self.merged(fragment))
            self.pieces.put(piece, found)
        return found

    def _joined(self, pieces: list[str]) -> bytes:
        ids = self.piece_ids(pieces[0]) if len(pieces) == 1 else [i for p in pieces for i in self.piece_ids(p)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def learn(self, chunks: set[str]) -> dict[str, bytes]:
        """Packed ids of stretches without blanks or line ends; no piece and no normal form reaches over those.

        All unknown ones go through normaliser and pre-tokeniser as one string.
        """
        found = {c: self.memo.revive(c) for c in chunks}
        new = [c for c, ids in found.items() if ids is None]
        whole = self._normal(" ".join(new))
        # a chunk with other white space can have blanks of its own in its normal form
        alike = whole.count(" ") == max(0, len(new) - 1) and len(" ".join(new).split()) == len(new)
        for group in [new] if alike else [[c] for c in new]:
            pieces: list[list[str]] = [[] for _ in group]
            normal = whole if alike else self._normal(group[0])
            ends = [end - 1 for end in accumulate(len(c) + 1 for c in normal.split(" "))] if len(group) > 1 else []
            at = 0
            for piece, (begin, _) in self.whole.pre_tokenizer.pre_tokenize_str(normal):
                while at < len(ends) and begin > ends[at]:
                    at += 1
                pieces[at].append(piece)
            for chunk, own in zip(group, pieces, strict=True):
                found[chunk] = self._joined(own)
                self.memo.put(chunk, found[chunk])
        return found

    def _normal(self, text: str) -> str:
        return self.whole.normalizer.normalize_str(text) if self.whole.normalizer else text

    def _sections(self, text: str) -> Iterator[tuple[str, int | None]]:
        """The text around added tokens (id None) and those tokens."""
        at = 0
        for hit in self.added_at.finditer(text) if self.added_at else ():
            yield text[at : hit.start()], None
            yield hit[0], self.added[hit[0]]
            at = hit.end()
        yield text[at:], None

    def packed(self, text: str) -> bytes:
        """The text's ids as little-endian unsigned 32-bit integers."""
        parts: list[bytes] = []
        known = self.memo.get
        for section, added in self._sections(text):
            if added is not None:
                parts.append(struct.pack("<I", added))
            else:
                chunks = [c for c in section.replace("\n", " ").split(" ") if c]
                values = list(map(known, chunks))
                if None in values:
                    fresh = self.learn({c for c, value in zip(chunks, values, strict=True) if value is None})
                    values = [fresh[c] if value is None else value for c, value in zip(chunks, values, strict=True)]
                parts += values
        return b"".join(parts)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.packed(text), "<u4").tolist()

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by blanks, as the library does for a file without a decoder; unknown ids go."""
        try:
            return " ".join(map(self.tokens.__getitem__, ids))
        except KeyError:
            return " ".join(self.tokens[i] for i in ids if i in self.tokens)


@lru_cache(maxsize=2)
def codec(path: str, room: tuple[int, int] = ROOMY) -> Codec:
    return Codec(path, room)


def parts_of(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Begin and end of runs of rows whose texts have about `PART` characters, a longer text being a run of its own."""
    sizes = pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False)
    begin, held = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if held and held + size > PART:
            yield begin, i
            begin, held = i, 0
        held += size
    if begin < len(sizes):
        yield begin, len(sizes)


def per_text(docs: DataFrame, text: str, schema: str, figures: Callable[[Codec, str], dict], path: str, room: tuple[int, int] = ROOMY) -> DataFrame:
    """`docs` with the `figures` of each text; one codec serves a Python worker."""
    names = [part.split()[0] for part in schema.split(", ")]
    types = [_TYPES[part.split()[1]] for part in schema.split(", ")]
    kept = docs.drop(*names)
    place = kept.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, room)
        for batch in batches:
            for begin, end in parts_of(batch.column(place)):
                rows = batch.slice(begin, end - begin)
                told = [figures(own, value.as_py() or "") for value in rows.column(place)]
                made = [pa.array([t[n] for t in told], kind) for n, kind in zip(names, types, strict=True)]
                yield pa.RecordBatch.from_arrays([*rows.columns, *made], [*batch.schema.names, *names])

    whole = T.StructType([*kept.schema.fields, *T._parse_datatype_string(schema).fields])
    return kept.mapInArrow(run, whole)


_TYPES = {"array<int>": pa.list_(pa.int32()), "long": pa.int64(), "string": pa.string()}


def _ids(own: Codec, text: str) -> dict:
    return {"ids": np.frombuffer(own.packed(text), "<i4")}


def _digest(own: Codec, text: str) -> dict:
    packed = own.packed(text)
    ids = np.frombuffer(packed, "<u4").tolist()
    return {
        "n_tokens": len(ids),
        "ids_sha256": hashlib.sha256(packed).hexdigest(),
        "decoded_sha256": hashlib.sha256(own.decode(ids).encode()).hexdigest(),
    }


def encode(docs: DataFrame, text: str = "text", path: str | None = None, room: tuple[int, int] = ROOMY) -> DataFrame:
    """`docs` with `ids`, the token ids of each whole text."""
    return per_text(docs, text, "ids array<int>", _ids, path or tokenizer_path(), room)


def decode(rows: DataFrame, ids: str = "ids", path: str | None = None) -> DataFrame:
    """`rows` with `decoded`, the text that the ids stand for."""
    path = path or tokenizer_path()

    @F.arrow_udf("string")
    def run(column: pa.Array) -> pa.Array:
        own = codec(path)
        return pa.array([own.decode(x or []) for x in column.to_pylist()], pa.string())

    return rows.withColumn("decoded", run(F.col(ids)))


def digests(docs: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """`docs` with the number and digest of each text's ids and the digest of their decoded text."""
    return per_text(docs, text, "n_tokens long, ids_sha256 string, decoded_sha256 string", _digest, path or tokenizer_path())


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return digests(docs).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document that is left, with its token ids."""
    rows = encode(docs.select("doc_id", "lang", "source", "n_chars", "text"), room=TIGHT)
    return rows.withColumn("n_tokens", F.size("ids").cast("long")).select("doc_id", "source", "lang", "n_chars", "n_tokens", "ids")
