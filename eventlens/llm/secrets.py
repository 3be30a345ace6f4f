"""Secret scans: fixed patterns, and a battery of randomness tests with false-discovery control.

Fixed patterns give the kinds `assign`, `access` and `hex`. The battery adds the kind `random`: runs of
encoding characters whose encoding (hexadecimal, base32, base64) is inferred from the
characters that occur. Under the hypothesis that such a run is uniformly random, three tests give a p-value each:

* chi-squared of the counts of its alphabet's characters, scaled by the exact variance for its length,
* the number of runs above and below the middle of the alphabet (Wald and Wolfowitz),
* the serial correlation of neighbouring characters.

Fisher's method combines them. Word-like, patterned or repetitive strings get small values. Within each
encoding and length class, where the tests have alike power, the procedure of Benjamini
and Hochberg over all candidates of the table rejects randomness at the rate `fdr`; what is left counts
as a secret. Its counts are taken over p-values in steps of 1/`P_STEPS`, so a few bounded rows
decide. A found run is a span unless it touches a span of a fixed pattern.

Positions are code points, ends exclusive. Nulls: a null text is empty. Repeated rows and ties give equal
results; other columns come through; an empty table gives an empty result. Long texts with many hits are
handled in linear steps (`offsets`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventlens.llm.common import let, table

#: The fixed patterns, in the order in which spans of one start are listed.
ASSIGN = (
    r"(?i:password|passwd|secret|token|api_?key)[\x22']?\x20*[:=]\x20*[\x22']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
MIN_VALUE, MIN_ACCESS, MIN_HEX = 6, 20, 24
KINDS = ["assign", "access", "hex", "random"]

CANDIDATE = r"[A-Za-z0-9+/_-]{20,}"
#: name, pattern of the whole run, alphabet in order of value, shortest run with power
ENCODINGS = [
    ("hex", r"(?:[0-9A-F]+|[0-9a-f]+)", "0123456789abcdef", 24),
    ("base32", r"[A-Z2-7]+", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 24),
    ("base64", r"[A-Za-z0-9+/_-]+", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 20),
]
#: Lower bounds of the length classes.
LENGTHS = [20, 28, 40, 64, 128, 512]
FDR = 0.05
P_STEPS = 1000
_BLOCK = 128


def offsets(lengths: Column) -> Column:
    """For an array of longs, the sum before each element and, last, the whole sum.

    Blocks are summed first, so the work is _BLOCK per element instead of the array's length.
    """
    count = F.size(lengths)
    blocks = F.transform(
        F.sequence(F.lit(0), F.floor(count / _BLOCK).cast("int")),
        lambda b: F.aggregate(F.slice(lengths, b * _BLOCK + 1, F.lit(_BLOCK)), F.lit(0).cast("long"), lambda s, x: s + x),
    )

    def place(sums: Column) -> Column:
        before = F.transform(
            sums,
            lambda _, b: F.aggregate(F.slice(sums, F.lit(1), b), F.lit(0).cast("long"), lambda s, x: s + x),
        )
        return let(
            before,
            lambda starts: F.transform(
                F.sequence(F.lit(0), count),
                lambda i: F.get(starts, F.floor(i / _BLOCK).cast("int"))
                + F.aggregate(
                    F.slice(lengths, F.floor(i / _BLOCK).cast("int") * _BLOCK + 1, i % _BLOCK),
                    F.lit(0).cast("long"),
                    lambda s, x: s + x,
                ),
            ),
        )

    return let(blocks, place)


def matches(text: Column, pattern: str, kind: str) -> Column:
    """All leftmost, non-overlapping matches: array of (start, end, kind, hit).

    What lies between the matches gives their places; an element is a gap and the match after it.
    """
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def placed(gaps: Column, found: Column) -> Column:
        lengths = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, h: (F.length(g) + F.length(h)).cast("long"))

        def spans(ends: Column) -> Column:
            return F.transform(
                found,
                lambda h, i: F.struct(
                    (F.get(ends, i + 1) - F.length(h)).alias("start"),
                    F.get(ends, i + 1).alias("end"),
                    F.lit(KINDS.index(kind)).alias("kind"),
                    h.alias("hit"),
                ),
            )

        return let(let(lengths, offsets), spans)

    none = F.array().cast("array<struct<start:bigint,end:bigint,kind:int,hit:string>>")
    return let(
        hits,
        lambda found: F.when(F.size(found) == 0, none).otherwise(
            let(F.split(text, pattern, -1), lambda gaps: placed(gaps, found))
        ),
    )


def fixed_spans(text: Column) -> Column:
    """Spans of the fixed patterns, in order of start, then kind."""
    assign = F.filter(
        matches(text, ASSIGN, "assign"), lambda m: F.length(F.regexp_extract(m["hit"], ASSIGN, 1)) >= MIN_VALUE
    )
    # Within these classes a longest run that is too short hides no other match.
    access = matches(text, r"AKIA[A-Z0-9]{%d,}" % (MIN_ACCESS - 4), "access")
    found = F.concat(assign, access, matches(text, r"[0-9a-f]{%d,}" % MIN_HEX, "hex"))
    return F.array_sort(F.transform(found, lambda m: F.struct(m["start"], m["kind"], m["end"], m["hit"])))


def normal_tail(z: Column) -> Column:
    """P(Z > z) by a logistic approximation, good to 0.0002."""
    z = F.greatest(F.least(z, F.lit(8.0)), F.lit(-8.0))
    return 1 / (1 + F.exp(1.5976 * z + 0.070566 * z * z * z))


def battery(run: Column, alphabet: Column) -> Column:
    """The combined p-value of the three tests for one run of `alphabet`'s characters."""
    size = F.length(alphabet)
    half = (size - 1) / 2

    def chi(n: Column) -> Column:
        counts = F.transform(
            F.filter(F.split(alphabet, ""), lambda c: c != ""),
            lambda c: F.length(run) - F.length(F.replace(run, c, F.lit(""))),
        )
        squares = F.aggregate(counts, F.lit(0.0), lambda s, c: s + c * c.cast("double"))
        statistic = squares * size / n - n
        # one-sided: random text is not too even, and a surplus of one character is what words have
        return normal_tail((statistic - (size - 1)) / F.sqrt(2.0 * (size - 1) * (1 - 1 / n)))

    def neighbours(v: Column, n: Column) -> Column:
        mean = F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / n
        spread = F.aggregate(v, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean))
        lagged = F.aggregate(
            F.zip_with(F.slice(v, F.lit(1), F.size(v) - 1), F.slice(v, F.lit(2), F.size(v) - 1), lambda a, b: (a - mean) * (b - mean)),
            F.lit(0.0),
            lambda s, x: s + x,
        )
        serial = F.when(spread > 0, (lagged / spread + 1 / n) * F.sqrt(n)).otherwise(F.lit(8.0))
        above = F.aggregate(v, F.lit(0.0), lambda s, x: s + F.when(x > half, 1.0).otherwise(0.0))
        changes = F.aggregate(
            F.zip_with(
                F.slice(v, F.lit(1), F.size(v) - 1),
                F.slice(v, F.lit(2), F.size(v) - 1),
                lambda a, b: F.when((a > half) != (b > half), 1.0).otherwise(0.0),
            ),
            F.lit(1.0),
            lambda s, x: s + x,
        )
        both = 2 * above * (n - above)
        variance = both * (both - n) / (n * n * (n - 1))
        runs = F.when(variance > 0, (changes - both / n - 1) / F.sqrt(variance)).otherwise(F.lit(8.0))
        return F.array(2 * normal_tail(F.abs(serial)), 2 * normal_tail(F.abs(runs)))

    def combined(n: Column) -> Column:
        letters = F.transform(F.filter(F.split(run, ""), lambda c: c != ""), lambda c: F.position(c, alphabet) - F.lit(1.0))
        parts = F.concat(F.array(chi(n)), let(letters, lambda v: neighbours(v, n)))
        half_sum = -F.aggregate(parts, F.lit(0.0), lambda s, p: s + F.log(F.greatest(F.least(p, F.lit(1.0)), F.lit(1e-12))))
        return let(half_sum, lambda x: F.exp(-x) * (1 + x + x * x / 2))

    return let(F.length(run).cast("double"), combined)


def candidates(text: Column) -> Column:
    """Runs with an inferred encoding: array of (start, end, encoding, class, p)."""
    runs = matches(text, CANDIDATE, "random")
    digit, letter = r"[0-9]", r"[A-Za-z]"
    runs = F.filter(runs, lambda m: m["hit"].rlike(digit) & m["hit"].rlike(letter))

    def encoding(hit: Column) -> Column:
        which = F.lit(None).cast("int")
        for i, (name, pattern, _, least) in reversed(list(enumerate(ENCODINGS))):
            # letters of one case and digits are words and numbers, not base64
            both = "(?=.*[a-z])(?=.*[A-Z])" if name == "base64" else ""
            which = F.when(hit.rlike(f"^{both}{pattern}$") & (F.length(hit) >= least), i).otherwise(which)
        return which

    alphabets = F.split(F.lit(" ".join(e[2] for e in ENCODINGS)), " ")

    def judged(m: Column, which: Column) -> Column:
        plain = F.when(which == 0, F.lower(m["hit"])).otherwise(F.translate(m["hit"], "-_", "+/"))
        return F.struct(
            m["start"],
            m["end"],
            which.alias("encoding"),
            F.size(F.filter(F.lit(LENGTHS), lambda least: m["end"] - m["start"] >= least)).alias("class"),
            F.when(which.isNotNull(), battery(plain, F.get(alphabets, which))).alias("p"),
        )

    found = F.transform(runs, lambda m: let(encoding(m["hit"]), lambda which: judged(m, which)))
    return F.filter(found, lambda m: m["encoding"].isNotNull())


def cuts(scanned: DataFrame, fdr: float = FDR) -> DataFrame:
    """Per encoding and length class with candidates, the p-value up to which randomness is rejected.

    At most len(ENCODINGS) * len(LENGTHS) rows, whatever the table's size.
    """
    steps = (
        scanned.select(F.explode("runs").alias("m"))
        .groupBy(
            F.col("m.encoding").alias("encoding"),
            F.col("m.class").alias("class"),
            F.ceil(F.col("m.p") * P_STEPS).cast("int").alias("step"),
        )
        .agg(F.count("*").alias("n"))
    )
    group = Window.partitionBy("encoding", "class")
    upto = group.orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    ranked = steps.withColumn("rank", F.sum("n").over(upto)).withColumn("all", F.sum("n").over(group))
    passes = F.col("step") / P_STEPS <= fdr * F.col("rank") / F.col("all")
    return ranked.groupBy("encoding", "class").agg(
        (F.coalesce(F.max(F.when(passes, F.col("step"))), F.lit(-1)) / P_STEPS).alias("cut")
    )


def find_secrets(docs: DataFrame, fdr: float = FDR, text: str = "text") -> DataFrame:
    """`docs` with `fixed` and `spans`, arrays of (start, kind, end); `kind` counts along KINDS."""
    whole = F.coalesce(F.col(text), F.lit(""))
    runs = candidates(whole)
    entry = F.struct(F.col("encoding") * (len(LENGTHS) + 1) + F.col("class"), F.col("cut"))
    limits = cuts(docs.select(runs.alias("runs")), fdr).agg(F.map_from_entries(F.collect_list(entry)))

    def as_span(m: Column) -> Column:
        return F.struct(m["start"], F.lit(KINDS.index("random")).alias("kind"), m["end"])

    def free(m: Column) -> Column:
        return ~F.exists("fixed", lambda f: (f["start"] < m["end"]) & (m["start"] < f["end"]))

    rows = docs.withColumns({"fixed": fixed_spans(whole), "runs": runs, "limits": limits.scalar()})
    random = F.filter(
        "runs",
        lambda m: (m["p"] > F.coalesce(F.try_element_at("limits", m["encoding"] * (len(LENGTHS) + 1) + m["class"]), F.lit(-1.0)))
        & free(m),
    )
    fixed = F.transform("fixed", lambda m: F.struct(m["start"], m["kind"], m["end"]))
    return (
        rows.withColumn("found", F.transform(random, as_span))
        .withColumn("fixed", fixed)
        .withColumn("spans", F.array_sort(F.concat("fixed", "found")))
        .drop("runs", "limits", "found")
    )


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda m: F.concat_ws(":", F.get(names, m["kind"]), m["start"], m["end"])), ",")


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")

    def number(kind: str) -> Column:
        return F.size(F.filter("fixed", lambda m: m["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")

    return find_secrets(docs).select(
        "doc_id",
        number("assign"),
        number("access"),
        number("hex"),
        F.sha2(listed(F.col("fixed")).cast("binary"), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )


def redacted(text: Column, spans: Column, mask: str = "[SECRET]") -> Column:
    """`text` with each stretch that spans cover, touching ones together, replaced by `mask`."""
    start = F.struct(F.array().cast("array<string>").alias("parts"), F.lit(0).cast("long").alias("at"))

    def step(state: Column, m: Column) -> Column:
        gap = F.substring(text, (state["at"] + 1).cast("int"), (m["start"] - state["at"]).cast("int"))
        new = m["start"] >= state["at"]
        parts = F.when(new, F.concat(state["parts"], F.array(gap, F.lit(mask)))).otherwise(state["parts"])
        return F.struct(parts.alias("parts"), F.greatest(state["at"], m["end"]).alias("at"))

    def joined(state: Column) -> Column:
        return F.concat(F.array_join(state["parts"], ""), F.substring(text, (state["at"] + 1).cast("int"), F.length(text)))

    return F.when(F.size(spans) > 0, let(F.aggregate(spans, start, step), joined)).otherwise(text)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced in their texts."""
    rows = find_secrets(docs).withColumn("text", redacted(F.col("text"), F.col("spans")))
    return rows.withColumn("n_chars", F.length("text").cast("long")).select("doc_id", "text", "lang", "source", "n_chars")
