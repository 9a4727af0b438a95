"""Quality rules: how far a document's histograms diverge from its language's.

Two histograms of each document, of character classes and of its language's common words, are compared with the
language's own, gathered from all documents of that language, by the Jensen-Shannon distance (base 2: 0 equal, 1 disjoint).
Documents too short for a histogram to mean much, languages with too few words for a reference and documents without a language
are judged by the base rules alone.

Only DataFrame functions. Words are counted by language with map-side sums, and those with at least `word_share` of their language's
words, 1 / `word_share` at most, are its common words. One more pass over the texts makes each row's figures: a text is split once and
its words are hashed, so that counts within it are array functions over numbers. These rows are written, without the texts if the caller
does not want them; the references of the classes are sums over them, and the verdict is a projection of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from petrilake.llm.common import WS, written

#: Fixed values of the contract.
SYMBOLS = "#*$%&|<>"
SPACES = r"[ \t\n\x0B\f\r]+"

CLASSES = ["lower", "upper", "digit", "symbol", "other_ascii", "beyond_ascii"]
#: Languages whose references are broadcast (a few KB each); more are joined.
MOST_LANGUAGES = 10_000


def words_of(text: Column) -> Column:
    """The runs of characters that are no white space."""
    return F.array_remove(F.split(text, SPACES), "")


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with more columns, which later expressions read instead of evaluating them again: a generator's output is not inlined."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def let(value: Column, body) -> Column:
    """body(value), with the value evaluated once within an expression."""
    return F.get(F.transform(F.array(value), body), 0)


def rest_of(text: Column) -> Column:
    """What is neither a-z nor white space."""
    return F.regexp_replace(text, "[a-z \\t\\n\\x0B\\f\\r]+", "")


def class_counts(rest: Column, word_chars: Column) -> Column:
    """A text's characters by CLASSES, from its word characters and from those that are neither a-z nor white space."""
    gone = lambda t, cls: F.char_length(t) - F.char_length(F.regexp_replace(t, cls, ""))

    def counts(ascii_rest: Column) -> Column:
        upper, digit, symbol = gone(ascii_rest, "[A-Z]+"), gone(ascii_rest, "[0-9]+"), gone(ascii_rest, f"[{SYMBOLS}]+")
        plain = F.char_length(ascii_rest)
        found = (word_chars - F.char_length(rest), upper, digit, symbol, plain - upper - digit - symbol, F.char_length(rest) - plain)
        return F.array(*[x.cast("double") for x in found])

    return let(F.regexp_replace(rest, "[^\\x00-\\x7F]+", ""), counts)


def _repeat_words(hashes: Column) -> Column:
    """Words inside 3-word windows found twice or more; hashes: the windows'."""
    repeated = lambda s: F.array_distinct(F.filter(s, lambda x, i: (i > 0) & (x == F.get(s, i - 1))))
    few = lambda d: F.filter(F.transform(hashes, lambda x, i: F.when(F.array_contains(d, x), i)), lambda i: i.isNotNull())

    def like_a_neighbour(s: Column) -> Column:
        same = lambda p, q: F.coalesce(p["h"] == q["h"], F.lit(False))
        beside = lambda p, j: same(p, F.get(s, j + 1)) | ((j > 0) & same(p, F.get(s, F.greatest(j - 1, F.lit(0)))))
        return F.transform(F.filter(s, beside), lambda p: p["i"])

    many = let(F.sort_array(F.transform(hashes, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), like_a_neighbour)
    places = let(let(F.sort_array(hashes), repeated), lambda d: F.when(F.size(d) <= 24, few(d)).otherwise(many))
    covered = lambda p: F.size(F.array_union(F.array_union(p, F.transform(p, lambda i: i + 1)), F.transform(p, lambda i: i + 2)))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(let(places, covered)).cast("long")


def half(a: Column, b: Column) -> Column:
    """One cell's part in the divergence of a from the mean of both, halved."""
    return F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(0.0) / 2


def js_distance(p: Column, q: Column) -> Column:
    """The Jensen-Shannon distance of two histograms of the same length that sum to 1, base 2; null if one is."""
    total = F.aggregate(F.zip_with(p, q, lambda a, b: half(a, b) + half(b, a)), F.lit(0.0), lambda s, x: s + x)
    return F.when(total.isNotNull(), F.sqrt(F.greatest(total, F.lit(0.0))))


def common_words_distance(hashes: Column, n_words: Column, common: Column, shares: Column) -> Column:
    """The Jensen-Shannon distance of a text's words, by hash, from a language's common words and all its others.

    Only the common words that the text has are counted in it; each other one adds half its share.
    """
    whole = F.greatest(n_words, F.lit(1))

    def add(s: Column, w: Column) -> Column:
        p, q = F.get(shares, F.array_position(common, w).cast("int") - 1), (F.size(hashes) - F.size(F.array_remove(hashes, w))) / whole
        return F.struct((s["js"] + half(p, q) + half(q, p) - p / 2).alias("js"), (s["q"] + q).alias("q"))

    def finish(s: Column) -> Column:
        known = F.aggregate(shares, F.lit(0.0), lambda a, x: a + x)
        p, q = F.greatest(1 - known, F.lit(0.0)), 1 - s["q"]
        return F.sqrt(F.greatest(s["js"] + known / 2 + half(p, q) + half(q, p), F.lit(0.0)))

    return F.aggregate(F.array_intersect(hashes, common), F.struct(F.lit(0.0).alias("js"), F.lit(0.0).alias("q")), add, finish)


def _by_language(rows: DataFrame, refs: DataFrame, how: str = "left") -> DataFrame:
    """rows with their language's row of refs, which is broadcast where there are few languages."""
    return rows.join(F.broadcast(refs) if refs.count() <= MOST_LANGUAGES else refs, "lang", how)


def word_references(docs: DataFrame, word_share: float = 0.005, min_reference: int = 1000) -> DataFrame:
    """(lang, common, shares): of each language with at least min_reference words its common words in order and their shares."""
    words = docs.where("lang is not null").select("lang", F.explode(words_of(F.coalesce(F.col("text"), F.lit("")))).alias("word"))
    words = written(words.groupBy("lang", "word").agg(F.count("*").alias("n")), "words")
    sums = words.groupBy("lang").agg(F.sum("n").alias("total")).where(F.col("total") >= min_reference)
    sums = written(sums, "sums")
    often = _by_language(words, sums, "inner").where(F.col("n") >= word_share * F.col("total")).select("lang", F.struct("word", (F.col("n") / F.col("total")).alias("share")).alias("w"))
    packed = often.groupBy("lang").agg(F.sort_array(F.collect_list("w")).alias("c"))  # at most 1 / word_share words each
    none = F.array().cast("array<struct<word: string, share: double>>")
    return sums.join(packed, "lang", "left").select("lang", F.coalesce("c", none).alias("c")).select("lang", F.col("c.word").alias("common"), F.col("c.share").alias("shares"))


def class_references(features: DataFrame, min_reference: int = 1000) -> DataFrame:
    """(lang, class_shares) of each language with at least min_reference words, from features(lang, n_words, classes)."""
    sums = features.where("lang is not null").groupBy("lang").agg(F.sum("n_words").alias("total"), *[F.sum(F.get("classes", F.lit(i))).alias(f"k{i}") for i in range(len(CLASSES))])
    chars = F.greatest(sum(F.col(f"k{i}") for i in range(len(CLASSES))), F.lit(1.0))
    return sums.where(F.col("total") >= min_reference).select("lang", F.array(*[F.col(f"k{i}") / chars for i in range(len(CLASSES))]).alias("class_shares"))


def features(docs: DataFrame, word_refs: DataFrame, columns: list[str]) -> DataFrame:
    """columns of docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, classes and word_distance.

    The last is null where the language has no reference. A null text has no words and one empty line.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    refs = written(word_refs, "references").select("lang", F.transform("common", lambda w: F.xxhash64(w)).alias("_common"), F.col("shares").alias("_shares"))
    rows = _by_language(docs, refs)
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.btrim(x, F.lit(WS))) > 0)
    rows = once(rows, _words=words_of(text), _rest=rest_of(text), _lines=lines)
    rows = once(rows, _hashes=F.transform("_words", lambda w: F.xxhash64(w)), word_chars=F.char_length(F.array_join("_words", "")).cast("long"))
    three = lambda w, i: F.xxhash64(w, F.get("_hashes", i + 1), F.get("_hashes", i + 2))
    rows = once(rows, _windows=F.transform(F.slice("_hashes", F.lit(1), F.greatest(F.size("_hashes") - 2, F.lit(0))), three), classes=class_counts(F.col("_rest"), F.col("word_chars")))
    n_words = F.size("_words").cast("long")
    rows = rows.select(
        *columns,
        n_words.alias("n_words"),
        "word_chars",
        F.get("classes", F.lit(3)).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("_windows")).alias("n_repeat_words"),
        "classes",
        common_words_distance(F.col("_hashes"), n_words, F.col("_common"), F.col("_shares")).alias("word_distance"),
    )
    return rows.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def references(docs: DataFrame, word_share: float = 0.005, min_reference: int = 1000) -> DataFrame:
    """(lang, common, shares, class_shares): what `judge` compares documents with, from docs(lang, text)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    found = once(docs.select("lang", "text"), _words=words_of(text), _rest=rest_of(text))
    found = found.select("lang", F.size("_words").alias("n_words"), class_counts(F.col("_rest"), F.char_length(F.array_join("_words", ""))).alias("classes"))
    return word_references(docs, word_share, min_reference).join(class_references(found, min_reference), "lang")


def judge(docs: DataFrame, max_word_distance: float = 0.4, max_class_distance: float = 0.32, min_words: int = 80, min_reference: int = 1000, refs: DataFrame | None = None, columns: list[str] | None = None) -> DataFrame:
    """docs with the base features, `word_distance`, `class_distance`, `base_failed` and `kept`.

    A document that fails the base rules is not kept. One of fewer than min_words words is kept if it does not; a longer one
    if both distances from its language are small enough, or if it has no language (null) or one of fewer than min_reference words, whose
    distances are null. Documents without a word have distance 0. Rows are judged one by one, repeated rows alike. An empty table gives an
    empty result. Columns of docs named like the results or `classes` are replaced; docs needs lang and text.
    refs: `references`, of this or another corpus; then nothing is written and the texts are read once. Without, docs' own are taken, and each
    row's figures are written between. columns: those of docs that the result has, all by default.
    """
    made = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "word_distance", "class_distance"]
    docs = docs.drop(*made, "classes", "class_shares", "_words", "_lines", "_windows", "_hashes", "_rest", "_common", "_shares")
    names = [c for c in docs.columns if columns is None or c in columns]
    found = features(docs, refs.select("lang", "common", "shares") if refs is not None else word_references(docs, min_reference=min_reference), list(dict.fromkeys([*names, "lang"])))
    found = found if refs is not None else written(found, "features")
    rows = _by_language(found, written(refs.select("lang", "class_shares") if refs is not None else class_references(found, min_reference), "classes"))
    chars = F.greatest(F.aggregate("classes", F.lit(0.0), lambda a, x: a + x), F.lit(1.0))
    empty = (F.col("n_words") == 0) & F.col("class_shares").isNotNull()
    rows = rows.withColumn("class_distance", F.when(empty, 0.0).otherwise(js_distance(F.col("class_shares"), F.transform("classes", lambda x: x / chars)))).withColumn("word_distance", F.when(empty, 0.0).otherwise(F.col("word_distance")))
    far = (F.col("n_words") >= min_words) & (F.coalesce(F.col("word_distance") > max_word_distance, F.lit(False)) | F.coalesce(F.col("class_distance") > max_class_distance, F.lit(False)))
    return once(rows, kept=~F.col("base_failed") & ~far).select(*names, *made)
