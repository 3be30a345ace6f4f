"""Document fingerprints by I-Match.

The lexicon is the set of terms whose inverse document frequency lies in a band: very common terms say
nothing about a document, very rare ones are often slips. A text's distinct lexicon terms, sorted, are hashed
once whole and once for each of several randomised subsets of the lexicon, in which a term stays with a chance
of 1/4 to 1/4096. A changed text keeps the parts whose subsets miss the change, so the share of equal
parts among those that are not empty in both (`likeness`) falls gradually.

Terms are lower-case words and stand for their 64-bit hashes. The lexicon is broadcast: a term in a share of
at least `MIN_SHARE` of the documents takes that share of all (document, term) pairs, so it has at most
(mean distinct terms of a document) / MIN_SHARE rows, however many documents there are.

A text with fewer than `FEW` lexicon terms takes all its terms through the same subsets: short texts, and members of
a group of near copies so large that the group's own terms are too common for the band. Texts without terms have empty parts,
and two such are alike. Nulls: a null text is empty; a row without doc_id has no neighbours, its edited text
is its first half and `near_next` is null. Rows of equal doc_id follow each other by their text's digest. Other columns are
ignored; an empty table gives an empty result; texts are read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventlens.llm.common import WORD, let, table

#: The band: a term's share of all documents, i.e. idf from ln 10 to ln 2000.
MIN_SHARE, MAX_SHARE = 0.0005, 0.1
#: Bits that have to be zero for a term to stay in a subset; the first part is the whole lexicon. Dense
#: subsets tell small changes, sparse ones are what long texts keep in common after large changes.
DENSE = [0, 2, 2, 4, 4]
SPARSE = [bits for bits in range(6, 13) for _ in range(8)]
RATES = DENSE + SPARSE
MASK = (1 << 32) - 1
#: A text with fewer lexicon terms is signed by all its terms.
FEW = 16
#: Neighbouring documents are dealt in groups of 2**GROUP_BITS ids.
GROUP_BITS = 6
_STEPS = [4, 8, 16, 16, 14]


def terms(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)))


def lexicon(docs: DataFrame, min_share: float = MIN_SHARE, max_share: float = MAX_SHARE) -> DataFrame:
    """(term, parts): hashes of the band's terms, and as bits the subsets that each is in."""
    total = docs.agg(F.count("*")).scalar()
    counts = docs.select(F.explode(terms(F.col("text"))).alias("word")).groupBy(F.xxhash64("word").alias("term")).count()
    share = F.col("count") / total
    band = counts.filter((share >= min_share) & (share <= max_share))
    return band.select("term", subsets(F.col("term")).alias("parts"))


def subsets(term: Column) -> Column:
    """As bits, the subsets that a term is in."""
    bits = F.lit(0).cast("long")
    for part, rate in enumerate(RATES):
        stays = F.xxhash64(term, F.lit(part)).bitwiseAND((1 << rate) - 1) == 0
        bits = bits + F.when(stays, F.lit(1 << part)).otherwise(0)
    return bits


def parts_of(found: Column, rest: Column) -> Column:
    """The parts of a text from its lexicon terms (array of (term, parts)) and its other terms."""

    def some(ordered: Column, first: int, count: int) -> Column:
        def part(i: Column) -> Column:
            chosen = F.filter(ordered, lambda t: F.getbit(t["parts"], i) == 1)
            mark = F.xxhash64(F.transform(chosen, lambda t: t["term"])).bitwiseAND(MASK)
            return F.when(F.size(chosen) > 0, mark).otherwise(0)

        return F.transform(F.sequence(F.lit(first), F.lit(first + count - 1)), part)

    def signed(ordered: Column) -> Column:
        # few terms are in a sparse subset at all
        few = F.filter(ordered, lambda t: F.shiftright(t["parts"], len(DENSE)) != 0)
        sparse = let(few, lambda rest_: some(rest_, len(DENSE), len(SPARSE)))
        return F.concat(some(ordered, 0, len(DENSE)), sparse)

    whole = F.concat(found, F.transform(rest, lambda t: F.struct(t.alias("term"), subsets(t).alias("parts"))))
    return F.when(F.size(found) >= FEW, let(F.sort_array(found), signed)).otherwise(let(F.sort_array(whole), signed))


def likeness(a: Column, b: Column) -> Column:
    both = F.zip_with(a, b, lambda x, y: F.when((x != 0) | (y != 0), F.when(x == y, 1).otherwise(0)))
    return let(
        F.filter(both, lambda x: x.isNotNull()),
        lambda said: F.when(F.size(said) == 0, 1.0).otherwise(
            F.aggregate(said, F.lit(0), lambda s, x: s + x) / F.size(said)
        ),
    )


def as_text(parts: Column) -> Column:
    return F.array_join(F.transform(parts, lambda p: F.lpad(F.lower(F.hex(p)), 8, "0")), "")


def fingerprints(rows: DataFrame, words: DataFrame, key: list[str], texts: dict[str, str], keep: list[str]) -> DataFrame:
    """Fingerprint parts of several texts of each row, without a shuffle if rows are dealt by one of `key`.

    `texts` maps column names of texts to those of their parts; `keep` are columns to take along.
    """
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.col(c).alias("text")) for i, c in enumerate(texts))))
    split = rows.select(*key, *keep, each.alias("t")).filter(F.col("t.text").isNotNull())
    split = split.select(*key, *keep, F.col("t.i").alias("i"), F.posexplode_outer(terms(F.col("t.text"))).alias("at", "word"))
    # what is taken along stays on the first term's row
    first = F.coalesce(F.col("at"), F.lit(0)) == 0
    split = split.select(
        *key, *(F.when(first, F.col(c)).alias(c) for c in keep), "i", F.when(F.col("word").isNotNull(), F.xxhash64("word")).alias("term")
    )
    found = split.join(F.broadcast(words), "term", "left")
    sums = [F.max(c).alias(c) for c in keep]
    for i in range(len(texts)):
        mine = F.col("i") == i
        entry = F.when(mine & F.col("parts").isNotNull(), F.struct("term", "parts"))
        other = F.when(mine & F.col("parts").isNull(), F.col("term"))
        sums += [F.collect_list(entry).alias(f"_found{i}"), F.collect_list(other).alias(f"_rest{i}")]
    done = found.groupBy(*key).agg(*sums)
    made = [parts_of(F.col(f"_found{i}"), F.col(f"_rest{i}")).alias(name) for i, name in enumerate(texts.values())]
    return done.select(*key, *keep, *made)


def previous(groups: DataFrame) -> DataFrame:
    """(grp, before): for each number its predecessor among them; the smallest gets the greatest.

    Numbers are compared within growing ranges, so no task sees them all.
    """
    level = groups.select("grp", F.col("grp").alias("top")).distinct()
    chain = []
    for bits in _STEPS:
        level = level.withColumn("up", F.shiftright("grp", bits))
        window = Window.partitionBy("up").orderBy("grp")
        chain.append(level.select("grp", "up", F.lag("top").over(window).alias("before")))
        level = level.groupBy(F.col("up").alias("grp")).agg(F.max("top").alias("top"))
    last = Window.orderBy("grp")  # two rows at most, for numbers below and from 0
    top = F.coalesce(F.lag("top").over(last), F.max("top").over(Window.partitionBy()))
    found = level.select("grp", top.alias("before"))
    for step in reversed(chain):
        above = found.select(F.col("grp").alias("up"), F.col("before").alias("else"))
        found = step.join(above, "up").select("grp", F.coalesce("before", "else").alias("before"))
    return found


def with_next(docs: DataFrame) -> DataFrame:
    """`docs` (`doc_id`, `text`) with the next document's text in descending order of doc_id.

    Adds `grp` (rows are dealt by it), `place` in it, `next`, and `tail`, which is `next` for the first of a group. Texts are
    shuffled once; only the last text of each group goes to the group above as well.
    """
    dealt = docs.withColumn("grp", F.shiftright("doc_id", GROUP_BITS)).withColumn("digest", F.md5("text"))
    # the filter is what the join below asks of `last`; with it on both sides there is one exchange of texts
    dealt = dealt.filter(F.col("grp").isNotNull()).repartition("grp")
    order = Window.partitionBy("grp").orderBy("doc_id", "digest")
    rows = dealt.withColumns(
        {"place": F.row_number().over(order).cast("long"), "next": F.lag("text").over(order), "after": F.lead("doc_id").over(order)}
    )
    before = previous(docs.select(F.shiftright("doc_id", GROUP_BITS).alias("grp")))
    last = rows.filter(F.col("after").isNull()).select(F.col("grp").alias("before"), F.col("text").alias("tail"))
    tails = before.join(last, "before").select(F.col("grp").alias("g"), "tail")
    rows = rows.join(tails, (F.col("grp") == F.col("g")) & (F.col("place") == 1), "left")
    return rows.select("doc_id", "text", "grp", "place", F.coalesce("next", "tail").alias("next"), "tail")


def edited(text: Column, other: Column) -> Column:
    """`text` with its last half replaced by as much of the start of `other`."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(other, F.lit(1), half))


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    words = lexicon(docs)
    alone = F.monotonically_increasing_id()
    bare = docs.filter(F.col("doc_id").isNull()).select(
        "doc_id", "text", alone.alias("grp"), alone.alias("place"), F.lit("").alias("next"), F.lit(None).cast("string").alias("tail")
    )
    rows = with_next(docs.filter(F.col("doc_id").isNotNull()))
    return compared(rows, words).unionByName(compared(bare, words))


def compared(rows: DataFrame, words: DataFrame) -> DataFrame:
    rows = rows.withColumn("edited", edited(F.col("text"), F.col("next"))).withColumns(
        {"n_chars": F.length("text").cast("long"), "edited_sha256": F.sha2(F.col("edited").cast("binary"), 256)}
    )
    texts = {"text": "own", "edited": "changed", "tail": "ahead"}
    done = fingerprints(rows, words, ["grp", "place", "doc_id"], texts, ["n_chars", "edited_sha256"])
    lagged = F.lag("own").over(Window.partitionBy("grp").orderBy("place"))
    following = F.coalesce(lagged, F.col("ahead"))
    return done.withColumn("following", following).select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_text(F.col("own")).alias("fingerprint"),
        as_text(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"),
        likeness(F.col("own"), F.col("following")).alias("near_next"),
    )
