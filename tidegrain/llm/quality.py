"""Quality rules: base counts, then a hashed n-gram likelihood ratio.

Words and word pairs hash to a fixed number of buckets.  Two multinomials over
the buckets are counted, one from trusted documents and one from all of them;
a document's score is the mean of log(trusted / raw) over its n-grams, and it
is kept when the score reaches a fixed threshold.  Documents are in two halves
and each half is scored with the counts of the other.  Only DataFrame
functions are used: nothing leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrain.llm.common import need, quoted, words

#: Buckets of the two multinomials; the table of ratios has so many doubles, whatever the input.
BUCKETS = 16384
#: Mean log ratio that a document must reach.
THRESHOLD = -0.08
#: Occurrences added to what a bucket has and to what it should have.
SMOOTHING = 16.0
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50


def _pairs(a: Column, skip: int, make) -> Column:
    """make(x[i], x[i + skip]) over an array."""
    n = F.greatest(F.size(a) - skip, F.lit(0))
    return F.zip_with(F.slice(a, 1, n), F.slice(a, F.lit(1 + skip), n), make)


def _tokens(text: Column) -> Column:
    """Words and the hash of each word pair."""
    return F.transform(F.array(words(text)), lambda w: F.struct(w.alias("w"), _pairs(w, 1, lambda a, b: F.xxhash64(a, b)).alias("pairs")))[0]


def ngram_buckets(w: Column, pairs: Column, buckets: int = BUCKETS) -> Column:
    """Bucket of each word and each word pair."""
    n = F.lit(buckets)
    return F.concat(F.transform(w, lambda x: F.pmod(F.xxhash64(x), n).cast("int")), F.transform(pairs, lambda x: F.pmod(x, n).cast("int")))


def _repeat_words(w: Column, pairs: Column) -> Column:
    """Words in 3-word windows that the text has twice or more."""
    n = F.greatest(F.size(w) - 2, F.lit(0))
    triples = F.zip_with(F.slice(pairs, 1, n), F.slice(w, F.lit(3), n), lambda p, c: F.xxhash64(p, c))

    def places(t: Column) -> Column:
        ordered = F.sort_array(F.transform(t, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        both = F.transform(F.array(ordered), lambda s: _pairs(s, 1, lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>"))))[0]
        return F.sort_array(F.array_distinct(F.flatten(both)))

    def covered(p: Column) -> Column:
        steps = _pairs(p, 1, lambda a, b: F.least(b - a, F.lit(3)).cast("long"))
        return F.when(F.size(p) == 0, F.lit(0).cast("long")).otherwise(F.aggregate(steps, F.lit(3).cast("long"), lambda acc, x: acc + x))

    repeated = lambda t: F.when(F.size(F.array_distinct(t)) == F.size(t), F.lit(0).cast("long")).otherwise(F.transform(F.array(places(t)), covered)[0])
    return F.transform(F.array(triples), repeated)[0]


def _dup_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return F.transform(F.array(lines), lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))[0]


def fold_of(doc_id: Column) -> Column:
    """One of two halves of all documents; rows with one doc_id are in the same half."""
    return F.pmod(F.xxhash64(doc_id.cast("long")), F.lit(2)).cast("int")


def trusted_ids(labels: DataFrame, most: int | None = None) -> DataFrame:
    """Ids of which a label has quality 1: all of them; with ``most``, which no query gives, about so many, chosen by a hash of the id."""
    ids = labels.filter("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("trusted_id")).distinct()
    known = 0 if most is None else ids.count()
    if most is None or known <= most:
        return ids
    return ids.filter(F.pmod(F.xxhash64("trusted_id", F.lit("fit")), F.lit(1 << 30)) < F.lit(int(most / known * (1 << 30))))


def _slot_counts(rows: DataFrame, buckets: int, name: str) -> DataFrame:
    """Occurrences by slot, a bucket of the half that the counts are for."""
    grams = rows.select((1 - fold_of(F.col("own_id"))).alias("half"), _tokens(F.col("own_text")).alias("k"))
    slots = grams.select("half", F.explode(ngram_buckets(F.col("k.w"), F.col("k.pairs"), buckets)).alias("bucket")).select((F.col("half") * buckets + F.col("bucket")).cast("long").alias("slot"))
    return slots.groupBy("slot").agg(F.count("*").alias(name))


def log_ratios(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """One row with ``ratios``: for each half and bucket, log((target + S) / (expected + S)).

    target counts n-grams of trusted documents, expected is what the raw
    corpus would have among as many, and S (SMOOTHING) shrinks the ratio to 0
    where little is known.  The table of a half is counted in the other half,
    so no document's own n-grams are in its score.  Raw counts cover all rows
    and target counts all trusted ones; both sides of that join are shuffled
    by id, so the ids are in no single place.
    Without trusted documents or without any, the ratios are 0.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("own_id"), F.col("text").alias("own_text"))
    trusted = rows.join(trusted_ids(labels).hint("shuffle_hash"), F.col("own_id") == F.col("trusted_id"), "left_semi")
    # From here on there are 2 * buckets rows, whatever the input.
    every = docs.sparkSession.range(2 * buckets).withColumnRenamed("id", "slot")
    for counts in (_slot_counts(trusted, buckets, "target"), _slot_counts(rows, buckets, "raw")):
        every = every.join(counts, "slot", "left")
    every = every.na.fill(0)
    half = Window.partitionBy(F.floor(F.col("slot") / buckets))
    target, raw = F.sum("target").over(half), F.sum("raw").over(half)
    expected = F.col("raw") * (target / F.greatest(raw, F.lit(1)))
    ratio = F.when((target > 0) & (raw > 0), F.log((F.col("target") + SMOOTHING) / (expected + SMOOTHING))).otherwise(0.0)
    one = every.select("slot", ratio.alias("ratio")).groupBy().agg(F.sort_array(F.collect_list(F.struct("slot", "ratio"))).alias("all"))
    return one.select(F.col("all.ratio").alias("ratios"))


def _judged(rows: DataFrame, table: Column, buckets: int, threshold: float) -> DataFrame:
    """Counts, score and verdict of rows with doc_id and text; a struct ``own`` is carried along."""
    split = rows.select("own", "doc_id", "text", _tokens(F.col("text")).alias("k"), table.alias("ratios"), (fold_of(F.col("doc_id")) * buckets).alias("first"))
    counted = split.select(
        "own",
        "doc_id",
        F.size("k.w").cast("long").alias("n_words"),
        F.length(F.translate("text", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        _dup_lines(F.col("text")).alias("n_dup_lines"),
        _repeat_words(F.col("k.w"), F.col("k.pairs")).alias("n_repeat_words"),
        F.aggregate(ngram_buckets(F.col("k.w"), F.col("k.pairs"), buckets), F.lit(0.0), lambda acc, b: acc + F.get(F.col("ratios"), b + F.col("first"))).alias("total"),
    )
    grams = F.greatest(2 * F.col("n_words") - 1, F.lit(1))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    mean = F.col("total") / grams
    return counted.select("own", "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & (mean >= threshold)).alias("kept"), mean.alias("score"))


def _rows(docs: DataFrame, own: Column) -> DataFrame:
    return docs.select(own.alias("own"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def score(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, base counts, score and the verdict, one row for each row of docs.

    Null and empty texts have no words: they fail the base rule and score 0.
    Repeated rows are counted and returned each; an empty table gives an empty
    one; columns other than doc_id and text are not read, and labels may name
    a document several times or not at all.
    """
    need(docs, "doc_id", "text")
    need(labels, "doc_id", "quality")
    table = log_ratios(docs, labels, buckets).select("ratios").scalar()
    return _judged(_rows(docs, F.lit(0)), table, buckets, threshold).drop("own")


def keep(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, threshold: float = THRESHOLD) -> DataFrame:
    """The rows and columns of docs that score() keeps."""
    need(docs, "doc_id", "text")
    need(labels, "doc_id", "quality")
    table = log_ratios(docs, labels, buckets).select("ratios").scalar()
    return _judged(_rows(docs, F.struct(*[docs[quoted(c)] for c in docs.columns])), table, buckets, threshold).filter("kept").select("own.*")
