"""Operator 1 [native]: base rules and a hashed n-gram log-likelihood ratio, length-normalised.

Everything here is a DataFrame or SQL expression. A text is split once; its words are hashed once; all that is counted
within a text (repeated windows, repeated lines, the ratio) is counted in its own row, so the only shuffle carries the
bucket counts of the two multinomials. Arrays that are used more than once are columns of a projection each: inside a lambda Spark
interprets what it compiles outside of one, sorting and finding distinct numbers above all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import free_name, let, others, words

#: Buckets of the hashed n-grams; bounds the model, whatever the corpus.
BUCKETS = 1 << 16
#: Pseudo-count of every bucket in either multinomial.
SMOOTH = 1.0
#: Packs that the ids of the trusted target are broadcast in, by hash: an id takes its own bytes only (8 for a long), not a row's. Texts
#: stay where they are; dealt out to meet their ids, they would be shuffled twice, whole.
PACKS = 1 << 14
#: A text's own n-grams are taken off every bucket of at most so many in all the corpus: off every one, whatever the corpus. (The plain
#: count of the tests reads it.)
OFTEN = float("inf")
#: A text is kept from this mean log-likelihood ratio (nats an n-gram) on.
LEAST_RATIO = -0.2
SYMBOLS = "[#*$%&|<>]"
OUTPUTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "ratio", "base_failed", "kept"]


def _hashes(w: Column) -> Column:
    return F.transform(w, lambda x: F.xxhash64(x))


def _pairs(h: Column) -> Column:
    """A 64-bit hash of every pair of neighbouring words."""
    return F.transform(F.slice(h, 1, F.greatest(F.size(h) - 1, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(h, i + 1)))


def _bucket(x: Column, buckets: int) -> Column:
    # Never null, and said so: Spark sorts an array as plain numbers only if it can hold no null.
    return F.coalesce(F.pmod(x, F.lit(buckets)).cast("int"), F.lit(0))


def _windows(h: Column, p: Column) -> Column:
    """A 64-bit hash of each window of five words, in order; ``h`` of the words, ``p`` of the pairs."""
    return F.transform(F.slice(p, 1, F.greatest(F.size(h) - 4, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(p, i + 2), F.get(h, i + 4)))


def _repeat_words(win: Column, k: int = 5) -> Column:
    """Words that lie in a ``k``-word window found twice or more in the text, the first included."""
    pairs = F.sort_array(F.transform(win, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))

    def of(s: Column) -> Column:
        m = F.size(s)
        twice = F.filter(
            s,
            lambda e, j: ((j > 0) & (F.get(s, j - 1)["x"] == e["x"])) | ((j < m - 1) & (F.get(s, j + 1)["x"] == e["x"])),
        )
        starts = F.sort_array(F.transform(twice, lambda e: e["i"]))
        zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
        add = lambda a, p: F.struct((a["n"] + p + k - F.greatest(p, a["end"])).cast("long").alias("n"), (p + k).alias("end"))
        return F.aggregate(starts, zero, add)["n"]

    return F.when(F.size(F.array_distinct(win)) == F.size(win), F.lit(0).cast("long")).otherwise(let(pairs, of))


def _dup_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    return let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def _value(t: Column, r: Column, q: Column) -> Column:
    """The log ratio of a bucket that ``t`` of the target's and ``r`` of all other n-grams are in; ``q``: the target's share of all.

    The raw counts are brought to the target's total, so that a bucket of little evidence has a ratio near 0 at any size of
    corpus; and the ratio is less the mean that it has by chance where target and raw text are alike (to the second
    order), so that texts like the target come out at 0.
    """
    mean = r * q + SMOOTH
    return F.log((t + SMOOTH) / mean) + r * q * (1 - q) / (2 * mean * mean)


def bucket_model(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """One row: t and r (array<long>, the n-grams in each bucket of the trusted documents and of all), q (the trusted n-grams' share of
    all), and raw and own (array<double>, the log ratio of each bucket without one n-gram of a raw and of a trusted text).

    The raw multinomial counts the n-grams of every document; the target those of the documents whose id is in ``trusted``
    (doc_id), all of them. Without any of these every ratio is 0.
    """
    # The outer form, as the plain one would have the array computed twice, to filter empty ones; their null is in no bucket below.
    counted = (
        _flagged(docs.select("doc_id", "text"), trusted, "target")
        .select("target", _hashes(words(F.col("text"))).alias("h"))
        .select("target", F.concat("h", _pairs(F.col("h"))).alias("grams"))
        .select("target", F.explode_outer("grams").alias("gram"))
        .groupBy(F.pmod("gram", F.lit(buckets)).cast("int").alias("bucket"))
        .agg(F.sum(F.col("target").cast("long")).alias("t"), F.count(F.lit(1)).alias("r"))
    )
    every = docs.sparkSession.range(0, buckets, 1, 1).select(F.col("id").cast("int").alias("bucket"))
    every = every.join(counted, "bucket", "left").select("bucket", F.coalesce("t", F.lit(0)).alias("t"), F.coalesce("r", F.lit(0)).alias("r"))
    rows = every.agg(F.array_sort(F.collect_list(F.struct("bucket", "t", "r"))).alias("c"), F.sum("t").alias("nt"), (F.sum("t") / F.greatest(F.sum("r"), F.lit(1))).alias("q"))
    less = lambda x: F.greatest(x - 1, F.lit(0))
    table = lambda t: F.transform("c", lambda x: F.when(F.col("nt") == 0, F.lit(0.0)).otherwise(_value(t(x), less(x["r"]), F.col("q"))))
    return rows.select(
        F.transform("c", lambda x: x["t"]).alias("t"),
        F.transform("c", lambda x: x["r"]).alias("r"),
        F.when(F.col("nt") > 0, F.col("q")).alias("q"),
        table(lambda x: x["t"]).alias("raw"),
        table(lambda x: less(x["t"])).alias("own"),
    )


def _flagged(docs: DataFrame, trusted: DataFrame, name: str) -> DataFrame:
    """``docs`` with whether their id is among those of ``trusted``."""
    # Ids of two types meet in the wider one, as in a join: equal ids then have equal hashes.
    kind = docs.select("doc_id").union(trusted.select("doc_id")).schema[0].dataType
    pack = lambda i: F.pmod(F.xxhash64(i), F.lit(PACKS)).cast("int")
    ids = trusted.select(F.col("doc_id").cast(kind).alias("id")).where("id is not null")
    packs = ids.groupBy(pack(F.col("id")).alias("pack")).agg(F.collect_set("id").alias("ids"))
    mine = docs["doc_id"].cast(kind)
    joined = docs.join(F.broadcast(packs), pack(mine) == packs["pack"], "left")
    return joined.select(*(docs[f"`{c}`"] for c in docs.columns), F.coalesce(F.array_contains(packs["ids"], mine), F.lit(False)).alias(name))


def _again(s: Column) -> Column:
    """Of sorted buckets those that are equal to the one before."""
    # Before the first there is none: null, which isn't kept.
    return F.filter(s, lambda x, i: F.get(s, i - 1) == x)


def _heads(e: Column) -> Column:
    """Where in sorted buckets a new one begins."""
    at = F.when(F.size(e) == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), F.size(e) - 1))
    # Compared with null at the first.
    return F.filter(at, lambda i: ~F.get(e, i - 1).eqNullSafe(F.get(e, i)))


def _apart(df: DataFrame, name: str) -> DataFrame:
    """``df`` with column ``name`` dealt out of an array of one: Spark moves nothing that uses it, and merges no projection, across this."""
    rest = [F.col(f"`{x}`") for x in df.columns if x != name]
    return df.select(*rest, F.explode(F.array(f"`{name}`")).alias(name))


def _ratio(grams: Column, again: Column, model: Column, target: Column) -> Column:
    """The mean log ratio over ``grams`` (sorted buckets of a text's n-grams), the text's own n-grams taken off both multinomials that hold
    them: one by the tables of the model, all where a bucket comes more than once in the text (``again``)."""

    def of(heads: Column, m: Column, table: Column, t: Column, r: Column) -> Column:
        def one(i: Column, j: Column) -> Column:
            def corrected(b: Column, count: Column) -> Column:
                left = F.get(t, b) - F.when(target, count).otherwise(0)
                return count * (_value(left, F.get(r, b) - count, m["q"]) - F.get(table, b))

            return let(F.coalesce(F.get(heads, j + 1), F.size(again)) - i + 1, lambda c: let(F.get(again, i), lambda b: corrected(b, c)))

        add = lambda a, x: a + x
        once = F.aggregate(grams, F.lit(0.0), lambda a, b: a + F.get(table, b))
        sums = once + F.aggregate(F.transform(heads, one), F.lit(0.0), add)
        return F.when((F.size(grams) == 0) | m["q"].isNull(), F.lit(0.0)).otherwise(sums / F.size(grams))

    def with_tables(m: Column) -> Column:
        table = F.when(target, m["own"]).otherwise(m["raw"])
        return let(table, lambda x: let(m["t"], lambda t: let(m["r"], lambda r: let(_heads(again), lambda i: of(i, m, x, t, r)))))

    return let(model, with_tables)


def quality_rules(
    docs: DataFrame,
    trusted: DataFrame,
    least_ratio: float = LEAST_RATIO,
    buckets: int = BUCKETS,
) -> DataFrame:
    """``docs`` (doc_id, text, ...) with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long), ratio (double),
    base_failed and kept (boolean); an input column of one of these names is replaced, all others pass through.

    base_failed: fewer than 10 words, or over a fifth of the words in repeated 5-word windows. kept: not base_failed, and the
    mean log-likelihood ratio of the text's words and word pairs under the hashed multinomials of the trusted target
    and of the raw corpus is at least ``least_ratio``, a constant. A text is judged by the counts of all others: its own
    n-grams are taken off both multinomials, all of them, at any size of corpus. So equal texts get equal verdicts, but that a trusted text is not held by itself.

    - A null, empty or blank text has no words: all counts 0, ratio 0, base_failed, not kept.
    - Windows are compared by 64-bit hashes within one text.
    - Repeated rows and ids: each row is judged by its own text; each counts in the raw multinomial.
    - An empty table gives an empty result; without trusted rows every ratio is 0 and only the base rules decide.
    """
    model = bucket_model(docs, trusted, buckets).select(F.struct("t", "r", "q", "raw", "own").alias("model"))
    held, w, h, p, grams, win, again, n, chars, counts, found = (
        free_name(docs, f"quality_{x}") for x in ("held", "words", "hashes", "pairs", "grams", "windows", "again", "n", "chars", "model", "found")
    )
    c = lambda name: F.col(f"`{name}`")
    mine = [c(x) for x in docs.columns]

    # Each step uses columns of the one before more than once, so that Spark doesn't merge them and compute these again.
    split = _flagged(docs, trusted, held).select(*mine, held, words(F.col("text")).alias(w))
    hashed = split.select("*", _hashes(c(w)).alias(h)).select("*", _pairs(c(h)).alias(p))
    arrays = hashed.select(
        *mine,
        held,
        F.size(h).cast("long").alias(n),
        F.length(F.array_join(w, "")).cast("long").alias(chars),
        F.sort_array(F.transform(F.concat(h, p), lambda x: _bucket(x, buckets))).alias(grams),
        _windows(c(h), c(p)).alias(win),
    )
    # The model is one row, of a size that BUCKETS fixes. Where its column is used, once and by the next projection, each task has it as a
    # constant; merged with the projection before instead, it would be copied into every row.
    ready = _apart(arrays.select("*", _again(c(grams)).alias(again)), again).withColumn(counts, model.scalar())
    ratio = _ratio(c(grams), c(again), c(counts), c(held))
    judged = ready.select(*mine, F.struct(c(n).alias("n"), c(chars).alias("chars"), _repeat_words(c(win)).alias("repeat"), ratio.alias("ratio")).alias(found))
    # A filter on an output ends here: pushed below, it would compute all of this again.
    judged = _apart(judged, found)

    x, text = c(found), F.coalesce(F.col("text"), F.lit(""))
    failed = (x["n"] < 10) | (100 * x["repeat"] > 20 * x["n"])
    outputs = {
        "n_words": x["n"],
        "word_chars": x["chars"],
        "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)).cast("long"),
        "n_dup_lines": _dup_lines(text),
        "n_repeat_words": x["repeat"],
        "ratio": x["ratio"],
        "base_failed": failed,
        "kept": ~failed & (x["ratio"] >= least_ratio),
    }
    return judged.select(*others(docs, OUTPUTS), *(outputs[o].alias(o) for o in OUTPUTS))


def trusted_ids(labels: DataFrame) -> DataFrame:
    """The ids that the labelled table marks as good."""
    return labels.where("quality = 1").select("doc_id")
