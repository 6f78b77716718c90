"""Rule filter and hashed n-gram likelihood ratio, in DataFrame functions only.

Method: words (lower case) and pairs of adjacent words are hashed into ``buckets``.
Two multinomials over the buckets are counted: one from all trusted documents (labelled
good), one from all documents.  A document's score is the sum over its n-grams of
log(p_trusted / p_raw), divided by their number; p_trusted is smoothed with ``PRIOR``
pseudo-counts a bucket, shared out as in p_raw, so small samples give ratios near 0; every document is kept or not by
comparing that score with a fixed threshold, so reruns decide alike.  Rules on counts
of words, symbols and repetitions come first.

Scale: three passes over the texts.  Those of trusted documents are told by ``membership``, which
shuffles ids, and texts only where hashes of ids leave it open.  Counting shuffles at most one row
per bucket and task; the ratios are an array of ``buckets`` doubles that
reaches the executors as a scalar subquery.  All work on a text is linear or n log n
in its length (repeated windows are found by sorting their hashes), inside one row.

Cases: a null or empty text has no words: counts 0, base_failed, not kept; documents
of any length are read whole; repeated rows are counted and judged each; ties with the
threshold are kept; with no trusted documents or an empty bucket the smoothing
defines all ratios; null labels are no trust; an empty table gives no rows; columns
other than the id and the text are ignored (``filter_documents`` returns them).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import let, words
from quillon.llm.membership import marked

BUCKETS = 10_000
THRESHOLD = -0.08
PRIOR = 5
WINDOW = 5
_SYMBOLS = r"[^#*$%&|<>]+"


def _grams(h: Column, n: int, body) -> Column:
    """body(hash) of each run of n elements of an array of hashes; h must be a lambda variable of n elements or more."""
    return F.transform(F.slice(h, 1, F.size(h) - (n - 1)), lambda x, i: body(F.xxhash64(x, *[F.get(h, i + k) for k in range(1, n)])))


def repeated_words(h: Column, window: int = WINDOW) -> Column:
    """Words that lie in a window of ``window`` words found twice or more, of an array of words' hashes.

    Windows are compared by a 64-bit hash of those; most texts repeat none, which one
    look at the different ones tells.  ``h`` must be a lambda variable, see ``let``.
    """
    def starts(s: Column) -> Column:
        # sorted by hash: a window is repeated if a neighbour has the same hash
        same = F.filter(s, lambda x, k: (F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"]))
        return F.array_sort(F.transform(same, lambda x: x["i"]))

    def covered(at: Column) -> Column:
        return F.aggregate(
            F.transform(at, lambda x, k: F.least(F.lit(window), F.coalesce(F.get(at, k + 1) - x, F.lit(window)))),
            F.lit(0).cast("long"),
            lambda a, x: a + x,
        )

    def count(a: Column) -> Column:
        keyed = F.transform(a, lambda x, i: F.struct(x.alias("h"), i.alias("i")))
        return F.when(F.size(F.array_distinct(a)) == F.size(a), F.lit(0).cast("long")).otherwise(let(let(F.sort_array(keyed), starts), covered))

    return F.when(F.size(h) < window, F.lit(0).cast("long")).otherwise(let(_grams(h, window, lambda x: x), count))


def ngram_buckets(w: Column, buckets: int) -> Column:
    """Buckets of all words and all pairs of adjacent words of an array, in lower case."""

    def hashed(h: Column) -> Column:
        one = F.transform(h, lambda x: F.pmod(x, F.lit(buckets)).cast("int"))
        two = _grams(h, 2, lambda x: F.pmod(x, F.lit(buckets)).cast("int"))
        return F.when(F.size(h) > 1, F.concat(one, two)).otherwise(one)

    return let(F.transform(w, lambda x: F.xxhash64(F.lower(x))), hashed)


def measures(text: Column, ratios: Column, buckets: int = BUCKETS) -> Column:
    """Struct of the counts, the sum of log ratios and the number of n-grams of a text.

    One expression that splits the text once, however the optimizer moves it.
    """

    def of_words(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.aggregate(w, F.lit(0).cast("long"), lambda a, x: a + F.char_length(x)).alias("word_chars"),
            let(F.transform(w, lambda x: F.xxhash64(x)), lambda h: repeated_words(h)).alias("n_repeat_words"),
            F.aggregate(ngram_buckets(w, buckets), F.lit(0.0), lambda a, b: a + F.get(ratios, b)).alias("total"),
        )

    return let(words(text), of_words)


def trusted_ids(labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """The ids of all documents labelled good."""
    return labels.filter(F.col(label_col) == 1).select(F.col(id_col).alias("_trusted")).filter("_trusted IS NOT NULL").distinct()


def log_ratios(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row, one array: log(p_trusted / p_raw) of each bucket, smoothed."""
    texts = marked(docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")), trusted)
    grams = texts.select(F.col("_in").cast("int").alias("_t"), F.explode(ngram_buckets(words(F.col("_text")), buckets)).alias("b"))
    counts = grams.groupBy("b").agg(F.count(F.lit(1)).alias("raw"), F.sum("_t").alias("good"))
    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("b")).join(counts, "b", "left").select("b", F.coalesce("raw", F.lit(0)).alias("raw"), F.coalesce("good", F.lit(0)).alias("good"))
    one = every.agg(F.array_sort(F.collect_list(F.struct("b", "raw", "good"))).alias("c"), F.sum("raw").alias("n_raw"), F.sum("good").alias("n_good"))
    prior = float(PRIOR * buckets)

    def ratio(x: Column) -> Column:
        p_raw = (x["raw"] + 1) / (F.col("n_raw") + buckets)
        return F.log((x["good"] + prior * p_raw) / (F.col("n_good") + prior)) - F.log(p_raw)

    return one.select(F.transform("c", ratio).alias("ratios"))


def judge(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, buckets: int = BUCKETS, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the counts, base_failed, kept and score of every document, and the columns named in ``keep``."""
    ratios = log_ratios(docs, trusted_ids(labels, id_col), buckets, id_col, text_col).scalar()
    text = F.coalesce(F.col("_text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("_text"), *keep).withColumn("_ratios", ratios)
    measured = source.select(
        "doc_id",
        *keep,
        measures(F.col("_text"), F.col("_ratios"), buckets).alias("_m"),
        F.char_length(F.regexp_replace(text, _SYMBOLS, "")).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    )
    judged = measured.withColumn("_v", let(F.col("_m"), lambda m: F.struct(m["n_words"].alias("n_words"), m["word_chars"].alias("word_chars"), m["n_repeat_words"].alias("n_repeat_words"), F.when(m["n_words"] > 0, m["total"] / (2 * m["n_words"] - 1)).otherwise(F.lit(0.0)).alias("score"), ((m["n_words"] < 10) | (100 * m["n_repeat_words"] > 20 * m["n_words"])).alias("base_failed"))))
    return judged.select(
        "doc_id",
        *keep,
        "_v.n_words",
        "_v.word_chars",
        "n_symbols",
        "n_dup_lines",
        "_v.n_repeat_words",
        "_v.base_failed",
        let(F.col("_v"), lambda v: ~v["base_failed"] & (v["score"] >= threshold)).alias("kept"),
        "_v.score",
    )


def filter_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents kept, with their own columns."""
    packed = docs.select(F.col(id_col).alias("_i"), F.col(text_col).alias("_t"), F.struct(*[F.col(c) for c in docs.columns]).alias("_row"))
    own = labels.select(F.col(id_col).alias("_i"), F.col("quality"))
    return judge(packed, own, threshold, id_col="_i", text_col="_t", keep=("_row",)).filter("kept").select("_row.*")
