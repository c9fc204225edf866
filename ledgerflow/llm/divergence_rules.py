"""Quality rules by distribution divergence, in DataFrame functions only (operator 13).

Base measures of a whole text are array expressions inside its row. The verdict
compares two histograms of a document with those of its language by Jensen-Shannon
distance (0 same, 1 disjoint): character classes (upper-case letters, other letters,
white space, symbols, the rest) and common words (each word that makes up at least one
in ``COMMON`` of a language's words, and one bin for all other words).

References count all documents of ``MIN_CHARS`` characters or more. Common words are found
in two passes of bounded aggregates: words are first counted by hash bucket, and only
words of buckets heavy enough to hold a common word are then counted by themselves, so
no vocabulary is ever shuffled. A language gets a reference when it has at least one in
``MIN_SHARE`` of all words; that bounds the references to MIN_SHARE languages of
COMMON words each, and only they are broadcast. Documents of other languages, or
without one, are compared with the reference over all documents. Measures are stored
once; class references are sums over that table, so no text is measured twice.

Guards: a document that fails the base rules is not kept whatever its distances; both
histograms are judged from ``GUARD`` words on, and their limits grow with the distance
that so short a sample has by chance, about sqrt(bins / (8 * size)); where no document
can serve as a reference nothing is judged.

Cases: a null text has no words (and fails the base rules), as has an empty one; every
row gets its own result, so repeated rows get equal ones, and null ids are kept as they
are; long texts take no more than sorting their words; an empty table gives an empty
result; only the columns named are read, so others may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerflow.llm.common import stored

COMMON = 200        # a common word is one in so many of its language's words, or more
MIN_SHARE = 1000    # a language needs one in so many of all words to have a reference
MIN_CHARS = 300     # a document needs so many characters to count in a reference
GUARD = 100         # words from which the histograms are judged
CHAR_LIMIT = 0.2    # largest distance of character classes that is kept, in a long text
WORD_LIMIT = 0.2    # largest distance of common words that is kept, in a long text
BUCKETS = 1 << 16

SPACE = " \t\n\x0b\x0c\r"
CLASSES = ("upper", "lower", "space", "symbol", "rest")
ALL = "*all"  # key of the reference over all documents; languages are keyed "=" + lang


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body reads it."""
    return F.transform(F.array(value), body)[0]


def flat(text: Column) -> Column:
    """All ASCII white space as spaces."""
    for c in SPACE[1:]:
        text = F.replace(text, F.lit(c), F.lit(" "))
    return text


def words(text: Column) -> Column:
    """Runs of characters other than ASCII white space."""
    return F.array_remove(F.split(flat(text), " "), "")


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    return let(lines, lambda a: F.size(a) - F.size(F.array_distinct(a))).cast("long")


def repeated_words(ws: Column) -> Column:
    """Words that stand in a 3-word window which the text has twice or more. Windows are
    hashed; those whose hash comes twice are sorted as text with their positions, and
    neighbours compared. (With many such hashes all windows are sorted: looking each
    window up among them would cost more.)"""
    at = lambda a, i: F.get(a, i)
    # the last two have no window and hash as nothing else does, or are sorted out as text
    hashes = lambda a: F.transform(a, lambda w, i: F.xxhash64(w, at(a, i + 1), at(a, i + 2)))
    twice = lambda h: let(F.sort_array(h), lambda s: F.array_distinct(
        F.filter(s, lambda x, j: (j > 0) & (at(s, j - 1) == x))))
    starts = lambda a: F.sequence(F.lit(0), F.size(a) - 3)
    # words hold no space, so equal windows are neighbours in the order of these strings
    key = lambda a, i: F.concat(at(a, i), F.lit(" "), at(a, i + 1), F.lit(" "), at(a, i + 2), F.lit(" "),
                                F.lpad(i.cast("string"), 10, "0"))
    window = lambda s: F.substring(s, F.lit(1), F.length(s) - 10)
    place = lambda s: F.substring(s, F.length(s) - 9, F.lit(10)).cast("int")

    def neighbours(s):
        same = lambda x, j: at(s, j).isNotNull() & (window(at(s, j)) == window(x))
        return F.filter(s, lambda x, j: ((j > 0) & same(x, j - 1)) | ((j < F.size(s) - 1) & same(x, j + 1)))

    def covered(p):  # each window covers three words, or as many as there are up to the next one
        return F.aggregate(F.transform(p, lambda x, j: F.when(
            j < F.size(p) - 1, F.least(F.lit(3), at(p, j + 1) - x)).otherwise(3)), F.lit(0), lambda s, x: s + x)

    def exact(a, h, d):
        of = F.when(F.size(d) <= 64, F.filter(starts(a), lambda i: F.array_contains(d, at(h, i)))).otherwise(starts(a))
        keys = let(of, lambda p: F.sort_array(F.transform(p, lambda i: key(a, i))))
        return let(F.sort_array(F.transform(let(keys, neighbours), place)), covered)

    return let(ws, lambda a: F.when(F.size(a) < 4, 0).otherwise(let(hashes(a), lambda h: F.when(
        F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(let(twice(h), lambda d: exact(a, h, d)))))).cast("long")


def _keyed(df: DataFrame) -> DataFrame:
    """Each row under its language's key and under that of all documents."""
    keys = F.when(F.col("lang").isNull(), F.array(F.lit(ALL))).otherwise(
        F.array(F.lit(ALL), F.concat(F.lit("="), "lang")))
    return df.withColumn("key", F.explode(keys)).drop("lang")


def word_references(docs: DataFrame) -> DataFrame:
    """(key, common, shares) of every language that gets a reference: its common words
    and their shares of its words, in the same order."""
    long_enough = docs.where(F.length("text") >= MIN_CHARS)
    each = long_enough.select("lang", F.explode(F.split(flat(F.col("text")), " ")).alias("word")).where("word <> ''")
    bucket = F.pmod(F.xxhash64("word"), F.lit(BUCKETS)).cast("int")
    by_bucket = stored(each.groupBy("lang", bucket.alias("b")).agg(F.count("*").alias("n")), "word-buckets")
    by_key = _keyed(by_bucket)
    totals = by_key.groupBy("key").agg(F.sum("n").alias("total"))
    held = F.col("total") * MIN_SHARE >= by_bucket.agg(F.sum("n")).scalar()
    totals = stored(totals.where(held), "word-totals")  # MIN_SHARE + 1 rows at most
    heavy = stored(by_key.groupBy("key", "b").agg(F.sum("n").alias("n")).join(F.broadcast(totals), "key")
                   .where(F.col("n") * COMMON >= F.col("total")).select("key", "b", "total"), "heavy-buckets")
    # COMMON rows a key at most
    counted = each.withColumn("b", bucket).join(F.broadcast(heavy.select("b").distinct()), "b", "left_semi")
    by_word = _keyed(counted.groupBy("lang", "word", "b").agg(F.count("*").alias("n")))
    common = by_word.groupBy("key", "word", "b").agg(F.sum("n").alias("n")).join(
        F.broadcast(heavy), ["key", "b"]).where(F.col("n") * COMMON >= F.col("total"))
    pairs = F.sort_array(F.collect_list(F.struct("word", (F.col("n") / F.col("total")).alias("share"))))
    shares = common.groupBy("key").agg(pairs.alias("p"))
    return stored(totals.join(F.broadcast(shares), "key", "left").select(
        "key", F.coalesce("p.word", F.array().cast("array<string>")).alias("common"),
        F.coalesce("p.share", F.array().cast("array<double>")).alias("shares")), "word-references")


def measures(docs: DataFrame, refs: DataFrame) -> DataFrame:
    """(doc_id, lang, text) -> key of its reference, base measures, counts per character
    class, distance of its common words from the reference."""
    own = refs.select("key", F.struct("key", "common", "shares").alias("own"))
    whole = refs.where(F.col("key") == ALL).select(F.struct("key", "common", "shares")).scalar()
    df = docs.select("doc_id", F.concat(F.lit("="), "lang").alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    df = df.join(F.broadcast(own), "key", "left").withColumn("ref", F.coalesce("own", whole))
    text = F.col("text")
    removed = lambda pattern: (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("long")
    df = df.select("doc_id", "text", "ref", words(text).alias("ws")).withColumns({
        "n_words": F.size("ws").cast("long"), "n_chars": F.length(text).cast("long"),
        "word_chars": F.length(F.replace(flat(text), F.lit(" "), F.lit(""))).cast("long"),
        "n_dup_lines": duplicate_lines(text), "n_repeat_words": repeated_words(F.col("ws")),
        "symbol": removed(r"[#*$%&|<>]+"), "upper": removed(r"\p{Lu}+"), "other": removed(r"[^\p{L}\x20\x09-\x0D]+"),
        "word_distance": F.when(F.size("ws") >= GUARD, word_distance(
            F.col("ws"), F.col("ref.common"), F.col("ref.shares")))})
    classes = [F.col("upper"), F.col("word_chars") - F.col("other") - F.col("upper"),
               F.col("n_chars") - F.col("word_chars"), F.col("symbol"), F.col("other") - F.col("symbol")]
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return df.select("doc_id", F.col("ref.key").alias("key"), "n_words", "word_chars",
                     F.col("symbol").alias("n_symbols"), "n_dup_lines", "n_repeat_words",
                     failed.alias("base_failed"), F.array(*classes).alias("classes"), "word_distance",
                     F.size("ref.common").alias("n_common"))


def class_references(measured: DataFrame) -> DataFrame:
    """(key, ref): counts per character class of the documents long enough, of each
    language that has a reference, and of all."""
    sums = F.array(*(F.sum(F.col("classes")[i]) for i in range(len(CLASSES)))).alias("ref")
    counted = measured.where(F.aggregate("classes", F.lit(0).cast("long"), lambda s, x: s + x) >= MIN_CHARS)
    return stored(counted.groupBy("key").agg(sums).where(F.col("key") != ALL).unionByName(
        counted.agg(sums).select(F.lit(ALL).alias("key"), "ref")), "class-references")


def _term(p: Column, q: Column) -> Column:
    """A bin's part of the divergence, in bits, doubled."""
    half = lambda x, y: F.when(x > 0, x * F.log2(2 * x / (x + y))).otherwise(0.0)
    return half(p, q) + half(q, p)


def _total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def _distance(doubled: Column) -> Column:
    return F.sqrt(F.least(F.greatest(doubled / 2, F.lit(0.0)), F.lit(1.0)))


def class_distance(doc: Column, ref: Column) -> Column:
    """Jensen-Shannon distance of two arrays of counts."""
    share = lambda a: let(F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x),
                          lambda n: F.transform(a, lambda x: F.when(n > 0, x / n).otherwise(0.0)))
    return _distance(_total(F.zip_with(share(doc), share(ref), _term)))


def word_distance(toks: Column, common: Column, shares: Column) -> Column:
    """Jensen-Shannon distance of a text's words, as bins of ``common`` and one of all
    others, from their shares. Bins that the text lacks add their share each."""
    def runs(hits):  # sorted words -> (word, count) of each
        first = F.filter(F.sequence(F.lit(0), F.size(hits) - 1),
                         lambda i: (i == 0) | (F.get(hits, i - 1) != F.get(hits, i)))
        return let(first, lambda f: F.transform(f, lambda i, j: F.struct(
            F.get(hits, i).alias("word"), (F.coalesce(F.get(f, j + 1), F.size(hits)) - i).alias("n"))))

    def distance(t, c, s, joined):
        n = F.size(t)
        # words hold no space, so a word between spaces is found only where it is one of them
        hits = F.sort_array(F.filter(t, lambda w: F.contains(joined, F.concat(F.lit(" "), w, F.lit(" ")))))

        def bins(h):
            seen = F.when(F.size(h) > 0, runs(h)).otherwise(F.array().cast("array<struct<word:string,n:int>>"))
            pq = let(seen, lambda r: F.transform(r, lambda x: F.struct(
                (x["n"] / n).alias("p"), F.get(s, F.array_position(c, x["word"]).cast("int") - 1).alias("q"))))
            rest_p, rest_q = (n - F.size(h)) / n, F.greatest(1 - _total(s), F.lit(0.0))
            return let(pq, lambda a: _total(F.transform(a, lambda x: _term(x["p"], x["q"])))
                       + F.greatest(_total(s) - _total(F.transform(a, lambda x: x["q"])), F.lit(0.0))
                       + _term(rest_p, rest_q))

        return F.when(n > 0, _distance(let(hits, bins)))

    joined = F.concat(F.lit(" "), F.array_join(common, " "), F.lit(" "))
    return let(F.struct(toks.alias("t"), common.alias("c"), shares.alias("s"), joined.alias("j")),
               lambda x: distance(x["t"], x["c"], x["s"], x["j"]))


def judged(docs: DataFrame, char_limit: float = CHAR_LIMIT, word_limit: float = WORD_LIMIT,
           id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    kept, char_distance, word_distance); distances are null where nothing was judged."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("lang"),
                       F.col(text_col).cast("string").alias("text"))
    measured = stored(measures(docs, word_references(docs)), "measures")
    df = measured.join(F.broadcast(class_references(measured)), "key", "left")
    df = df.withColumn("char_distance", F.when(F.col("n_words") >= GUARD, class_distance(F.col("classes"), F.col("ref"))))
    chance = lambda bins, size: F.sqrt(bins / (8.0 * size))
    near = lambda d, limit, bins, size: F.col(d).isNull() | (F.col(d) <= limit + chance(bins, F.col(size)))
    kept = (~F.col("base_failed") & near("char_distance", char_limit, F.lit(len(CLASSES)), "word_chars")
            & near("word_distance", word_limit, F.col("n_common"), "n_words"))
    return df.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                     kept.alias("kept"), "char_distance", "word_distance")
