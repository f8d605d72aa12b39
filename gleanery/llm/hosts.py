"""Quality rules judged per document and per host (native)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions.text import let
from gleanery.llm.common import only, texts, written

# Fixed values of the contract: what ends a word, what counts as a symbol.
WORD_BREAK = r"[\x20\x09-\x0D]+"
WORD_BREAKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"

#: Rules counted per host; each is a failure of one document.
RULES = ("few_words", "repeats", "symbols", "dup_lines")
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
MAX_SYMBOLS_PER_100_WORDS = 100
MAX_DUP_LINE_PERCENT = 50
#: A host is rejected where the shrunk share of its failing documents exceeds this.
MAX_HOST_RATE = 0.5


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, WORD_BREAK), "")


def without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def repeated_words(words: Column, width: int = 5) -> Column:
    """Words that lie in a window of ``width`` words found twice or more."""

    def covered(hashes: Column) -> Column:
        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def twice(p: Column) -> Column:
            near = lambda i: F.get(p, i)["h"]
            return F.filter(p, lambda e, i: (e["h"] == near(i - 1)) | (e["h"] == near(i + 1)))

        def span(starts: Column) -> Column:
            steps = F.transform(starts, lambda s, i: F.least(F.lit(width), F.coalesce(F.get(starts, i + 1) - s, F.lit(width))))
            return F.aggregate(steps, F.lit(0), lambda acc, x: acc + x)

        return let(ordered, lambda p: let(F.sort_array(F.transform(twice(p), lambda e: e["i"])), span))

    def count(hashes: Column) -> Column:
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(covered(hashes))

    windows = F.transform(F.sequence(F.lit(1), F.size(words) - (width - 1)), lambda i: F.xxhash64(F.slice(words, i, width)))
    return F.when(F.size(words) < width, F.lit(0)).otherwise(let(windows, count))


def measures(docs: DataFrame) -> DataFrame:
    """``doc_id, host``, a hash ``_h`` of the text and the counts that the rules look at, one row per input row."""
    rows = texts(docs, F.col("source").alias("host"))
    text, words = F.col("text"), F.col("_words")
    rows = rows.select("doc_id", "host", "text", words_of(text).alias("_words"))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(WORD_BREAKS)) != "")
    return rows.select(
        "doc_id",
        "host",
        F.xxhash64("text").alias("_h"),
        F.size(words).cast("long").alias("n_words"),
        F.length(without(text, WORD_BREAKS)).cast("long").alias("word_chars"),
        (F.length(text) - F.length(without(text, SYMBOLS))).cast("long").alias("n_symbols"),
        let(lines, lambda a: F.size(a) - F.size(F.array_distinct(a))).cast("long").alias("n_dup_lines"),
        let(lines, F.size).cast("long").alias("n_lines"),
        repeated_words(words).cast("long").alias("n_repeat_words"),
    )


def failures() -> dict[str, Column]:
    n = F.col("n_words")
    return {
        "few_words": n < MIN_WORDS,
        "repeats": 100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * n,
        "symbols": 100 * F.col("n_symbols") > MAX_SYMBOLS_PER_100_WORDS * n,
        "dup_lines": 100 * F.col("n_dup_lines") > MAX_DUP_LINE_PERCENT * F.col("n_lines"),
    }


def beta_prior(hosts: DataFrame, failed: str) -> tuple[float, float]:
    """Beta prior of a rule's failure rate over hosts, by the method of moments.

    ``hosts`` has ``n`` documents and ``failed`` failing ones per host.  What the
    rates vary beyond binomial noise sets how strongly a host is pulled to the
    common rate: without such variation fully, in effect.  One row of sums
    reaches the driver.
    """
    f, n = F.col(failed).cast("double"), F.col("n").cast("double")
    row = hosts.agg(F.sum("n").alias("n"), F.sum(failed).alias("f"), F.sum(f * f / n).alias("q"), F.count(F.lit(1)).alias("k")).first()
    if not row["n"] or not row["f"] or row["f"] == row["n"]:
        rate = (row["f"] or 0) / row["n"] if row["n"] else 0.0
        return rate, 1.0 - rate
    p = row["f"] / row["n"]
    between = row["q"] / row["n"] - p * p - p * (1 - p) * row["k"] / row["n"]
    strength = min(1e6, max(1.0, p * (1 - p) / between - 1)) if between > 1e-12 else 1e6
    return p * strength, (1 - p) * strength


def host_verdicts(judged: DataFrame, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """``host, host_docs, host_rate, host_failed`` from rows with ``host`` and a boolean per rule.

    ``host_rate`` is the largest shrunk rate of any rule.
    """
    hosts = judged.groupBy("host").agg(F.count(F.lit(1)).alias("n"), *(F.count_if(F.col(r)).alias(r) for r in RULES))
    hosts = written(hosts, "host-failures")
    priors = {r: beta_prior(hosts, r) for r in RULES}
    rates = [(F.col(r) + a) / (F.col("n") + a + b) for r, (a, b) in priors.items()]
    rate = F.greatest(*rates)
    return hosts.select("host", F.col("n").alias("host_docs"), rate.alias("host_rate"), (rate > max_rate).alias("host_failed"))


def _judged(docs: DataFrame, max_rate: float) -> DataFrame:
    rules = failures()
    judged = written(measures(docs).select("*", *(c.alias(r) for r, c in rules.items())), "document-rules")
    verdicts = host_verdicts(judged, max_rate).withColumnRenamed("host", "_host")
    failed = F.col("few_words") | F.col("repeats")
    joined = judged.join(verdicts, F.col("host").eqNullSafe(F.col("_host")))
    return joined.select(
        "_h", "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & ~F.col("host_failed")).alias("kept"), "host", "host_docs", "host_rate"
    )


def quality_rules(docs: DataFrame, *, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """The document's measures, its own verdict and, joined back, its host's.

    The host is the ``source`` column; NULL is a host of its own.  A document
    fails by itself (``base_failed``) with fewer than ten words or when over a
    fifth of its words repeat; it is ``kept`` if it does not and its host does
    not fail either.  NULL and empty texts have no words and fail.  Repeated
    rows are judged each; other columns are left out; an empty table gives no
    rows.  Only counts are shuffled, never texts: hosts meet as partial sums,
    and a host with very many documents is split by the adaptive join.
    """
    return _judged(docs, max_rate).drop("_h")


def drop_failing(docs: DataFrame, *, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """``docs`` without the rows that :func:`quality_rules` does not keep, all columns kept."""
    kept = _judged(docs, max_rate).filter("kept").select(F.col("doc_id").alias("id"), "host", F.col("_h").alias("hash"))
    return only(docs, kept, id=docs["doc_id"], host=docs["source"], hash=F.xxhash64(F.coalesce(docs["text"], F.lit(""))))
