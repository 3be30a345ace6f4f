"""Language identification: words first, then ever shorter character n-grams.

The model is counted from labelled documents: the `max_words` most frequent words of each language with
their log frequencies, and the `max_grams` most frequent character n-grams (up to `LONGEST` characters, word
ends marked) of those words. A text's score for a language is the sum over its words: a known word gives its log
frequency; an unseen one gives the mean log frequency of its known n-grams of the greatest length
for which any is known. The highest sum wins; ties go to the language first in code point order.

Counts cover all training documents. The two maxima bound what reaches the driver and the tasks; a
histogram of counts decides which words are above them, so no language is sorted in one task.

Nulls: a text that is null or has no letter is `und` with score 0, as is every text if there is nothing to
learn from; rows without text, language or doc_id teach nothing. Repeated rows and ties give equal results; other columns
come through; an empty table gives an empty result. Texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlens.llm.common import stored, table

MAX_WORDS, MAX_GRAMS = 30_000, 40_000
LONGEST = 5
#: Added to every count, so that a word unseen in one language does not exclude it.
SMOOTHING = 0.5
#: Unseen words whose scores a task keeps.
MEMO = 200_000
_LETTERS = regex.compile(r"\p{L}+")


def most_frequent(counts: DataFrame, item: str, most: int) -> DataFrame:
    """Rows of (lang, `item`, n) with the largest n of each language, at most `most` of each.

    All rows of one n are in or out, in steps of 32 to a power of two.
    """
    step = F.floor(F.log2("n") * 32).cast("int")
    least: dict[str, int] = {}
    full: set[str] = set()
    total: dict[str, int] = {}
    histogram = counts.groupBy("lang", step.alias("step")).count().collect()
    for row in sorted(histogram, key=lambda r: -r["step"]):
        lang = row["lang"]
        total[lang] = total.get(lang, 0) + row["count"]
        if total[lang] > most:
            full.add(lang)
        if lang not in full:
            least[lang] = row["step"]
    if not least:
        return counts.filter(F.lit(False))
    bounds = F.create_map(*(F.lit(x) for pair in least.items() for x in pair))
    return counts.filter(step >= F.try_element_at(bounds, "lang"))


def word_counts(labelled: DataFrame) -> DataFrame:
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))
    return labelled.select("lang", F.explode(words).alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n"))


def gram_counts(words: DataFrame) -> DataFrame:
    """How many of each language's words hold each n-gram, repeats counted."""
    marked = F.concat(F.lit("^"), F.col("word"), F.lit("$"))
    size = F.length("word") + 2
    grams = F.flatten(
        F.transform(
            F.sequence(F.lit(1), F.least(F.lit(LONGEST), size)),
            lambda n: F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.substring(marked, i, n)),
        )
    )
    return words.select("lang", F.explode(grams).alias("gram")).groupBy("lang", "gram").agg(F.count("*").alias("n"))


class Model:
    """Log frequencies by language of words and n-grams; bounded by the two maxima."""

    def __init__(self, words: list[tuple[str, str, int]], grams: list[tuple[str, str, int]]):
        self.langs = sorted({lang for lang, _, _ in words})
        self.words, self.word_scores = self._table(words)
        self.grams, self.gram_scores = self._table(grams)

    def _table(self, rows: list[tuple[str, str, int]]) -> tuple[dict[str, int], np.ndarray]:
        names = {item: i for i, item in enumerate(sorted({item for _, item, _ in rows}))}
        at = {lang: i for i, lang in enumerate(self.langs)}
        counts = np.full((len(names), len(self.langs)), SMOOTHING)
        for lang, item, n in rows:
            counts[names[item], at[lang]] += n
        return names, np.log(counts / counts.sum(axis=0))

    def unseen(self, word: str) -> np.ndarray:
        marked = f"^{word}$"
        for n in range(min(LONGEST, len(marked)), 0, -1):
            known = [i for k in range(len(marked) - n + 1) if (i := self.grams.get(marked[k : k + n])) is not None]
            if known:
                return self.gram_scores[known].mean(axis=0)
        return np.zeros(len(self.langs))


class Scorer:
    """Scores texts with a model, keeping unseen words' scores up to a bound."""

    def __init__(self, model: Model):
        self.model = model
        self.known = model.words
        self.memo: dict[str, int] = {}
        self.extra: list[np.ndarray] = []

    def _unseen(self, word: str) -> int:
        at = self.memo.get(word)
        if at is None:
            at = self.memo[word] = len(self.extra)
            self.extra.append(self.model.unseen(word))
        return at

    def score(self, text: str | None) -> tuple[str, float]:
        words = _LETTERS.findall(text.lower()) if text else []
        if not words or not self.model.langs:
            return "und", 0.0
        if len(self.memo) > MEMO:
            self.memo, self.extra = {}, []
        find = self.known.get
        known, extra = [], []
        for word in words:
            at = find(word)
            if at is None:
                extra.append(self._unseen(word))
            else:
                known.append(at)
        total = self.model.word_scores[known].sum(axis=0)
        if extra:
            seen, times = np.unique(extra, return_counts=True)
            total = total + times @ np.array([self.extra[i] for i in seen])
        # the sum grows with the text; its root keeps the score from being 1 for every longer text
        scaled = (total - total.max()) / np.sqrt(len(words))
        chance = np.exp(scaled) / np.exp(scaled).sum()
        best = int(np.argmax(chance))
        return self.model.langs[best], float(chance[best])


def fit(labelled: DataFrame, max_words: int = MAX_WORDS, max_grams: int = MAX_GRAMS) -> Model:
    """The model of `labelled` (`text`, `lang`, without nulls)."""
    words = stored(most_frequent(stored(word_counts(labelled), "word-counts"), "word", max_words), "lang-words")
    grams = most_frequent(stored(gram_counts(words), "gram-counts"), "gram", max_grams)
    as_rows = lambda frame: [tuple(r) for r in frame.collect()]  # noqa: E731  at most a maximum per language
    return Model(as_rows(words.select("lang", "word", "n")), as_rows(grams.select("lang", "gram", "n")))


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """`docs` with `lang_pred` and `score`, from the text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(shared.value)
        for texts in batches:
            yield pd.DataFrame([scorer.score(x) for x in texts], columns=["lang_pred", "score"])

    return docs.withColumn("found", run(F.col(text))).select("*", "found.*").drop("found")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    mine = F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull()
    model = fit(docs.filter(mine & ~held_out(F.col("doc_id"))).select("text", "lang"))
    rows = predict(docs.select("doc_id", "text"), model)
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
