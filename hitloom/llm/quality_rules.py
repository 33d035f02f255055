"""Line-first cleaning: rules per line, failing lines removed, then documents that lost too much text rejected.

Everything is a column expression on the row itself: no shuffle, no Python on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hitloom.llm.common import SPACES, fresh, let

#: Least share of the characters (of lines that hold a word) that the kept lines must hold.
MIN_KEPT = 0.5
#: A line of fewer words needs a sign that ends a sentence.
MIN_WORDS_UNPUNCTUATED = 5
#: A longer line is prose, even if it mentions what a notice says.
NOTICE_BYTES = 300
WINDOW = 8

# What a boilerplate line says.
BOILERPLATE = (
    r"(?i)\b(all rights reserved|terms of (use|service)|privacy policy|cookie policy|use of cookies|uses cookies"
    r"|accept (all )?cookies|enable javascript|javascript is (disabled|required)|lorem ipsum|click here to"
    r"|sign up for (our|the) newsletter|subscribe to (our|the)|share (this )?on (facebook|twitter)"
    r"|powered by wordpress|skip to (main )?content|alle rechte vorbehalten|tous droits réservés"
    r"|todos los derechos reservados|this work is licensed under|licensed under the|spdx-license-identifier)"
)
#: Rules for one line, each an expression that a bad line matches. Each begins with what few places of a line hold, so
#: that matching takes time in proportion to the line.
LINE_RULES = {
    "navigation": r"(?:\s[|»›•·>]\s[^|»›•·>]*){3}",
    "symbols": r"(?:[#*$%&<>~^_=+\\{}]{2,}[^#*$%&<>~^_=+\\{}]{0,12}){4}",
    "shouting": r"(?:[!?]{2,}[^!?]{0,40}){4}",
    "repeated_word": r"(?<!\S)(\S++)(?:\s++\1(?!\S)){5}",
}
#: A text without any of these meets none of the first three rules.
MARKED = r"[|»›•·>#*$%&<~^_=+\\{}]|[!?]{2}"
MARKED_RULES = ("navigation", "symbols", "shouting")
ENDED = r"[.!?:;…。！？][\"'”’»)\]]*[\x20\x09-\x0D]*$"
LONG_ENOUGH = r"(?:[^\x20\x09-\x0D]+[\x20\x09-\x0D]+){%d}[^\x20\x09-\x0D]" % (MIN_WORDS_UNPUNCTUATED - 1)


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACES), "")


def line_passes(line: Column, marked: Column) -> Column:
    """Whether a line that holds a word stays: it meets no rule, and it is long or ends like a sentence.

    ``marked`` says whether the line's text holds what MARKED asks for.
    """
    ok = line.rlike(LONG_ENOUGH) | line.rlike(ENDED)
    for name, rule in LINE_RULES.items():
        ok = ok & ~((marked & line.rlike(rule)) if name in MARKED_RULES else line.rlike(rule))
    return ok & ~((F.octet_length(line) <= NOTICE_BYTES) & line.rlike(BOILERPLATE))


def repeated_words(tokens: Column) -> Column:
    """How many words lie in a window of WINDOW words found twice or more."""

    def covered(starts: Column) -> Column:
        last = F.size(starts) - 1
        return F.aggregate(
            F.sequence(F.lit(0), last), F.lit(0).cast("long"),
            lambda n, j: n + F.when(j < last, F.least(F.lit(WINDOW), F.get(starts, j + 1) - F.get(starts, j)))
            .otherwise(WINDOW),
        )

    def found_twice(ranked: Column) -> Column:
        def same(a, b):
            return F.coalesce(F.get(ranked, a)["h"] == F.get(ranked, b)["h"], F.lit(False))

        hits = F.filter(F.sequence(F.lit(0), F.size(ranked) - 1), lambda j: same(j, j - 1) | same(j, j + 1))
        return let(F.array_sort(F.transform(hits, lambda j: F.get(ranked, j)["i"])), covered)

    def ranked(hashes: Column) -> Column:
        pairs = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(
            let(F.array_sort(pairs), found_twice)
        )

    def doubled(hashes: Column, reach: int) -> Column:
        """Hashes of twice as many words: each entry with the one ``reach`` places on (null at the end: shorter)."""
        return F.transform(hashes, lambda h, i: F.xxhash64(h, F.get(hashes, i + reach)))

    def of_eight(four: Column) -> Column:
        eight = F.slice(doubled(four, 4), F.lit(1), F.size(tokens) - (WINDOW - 1))
        fours = F.slice(four, F.lit(1), F.size(tokens) - 3)
        # Without a repeated run of four words there is none of eight.
        return F.when(F.size(F.array_distinct(fours)) == F.size(fours), F.lit(0).cast("long")).otherwise(let(eight, ranked))

    def of_four(single: Column) -> Column:
        return let(let(doubled(single, 1), lambda h: doubled(h, 2)), of_eight)

    hashes = F.transform(tokens, lambda w: F.xxhash64(w))
    return F.when(F.size(tokens) <= WINDOW, F.lit(0).cast("long")).otherwise(let(hashes, of_four))


def clean(
    docs: DataFrame, text_column: str = "text", min_kept: float = MIN_KEPT, output: str = "quality"
) -> DataFrame:
    """All rows and columns, and a struct ``output``: the measures, the kept text and the verdict.

    Fields: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_lines_kept, cleaned (the lines
    that stay, empty ones included), base_failed, kept. A null text counts as empty: no words, so it is rejected.
    Repeated rows get equal results. A column of the name ``output`` is replaced.
    """
    text, tokens, lines, filled, marked = fresh("text", "tokens", "lines", "filled", "marked")
    has_word = r"[^\x20\x09-\x0D]"
    df = docs.withColumn(text, F.coalesce(F.col(text_column), F.lit("")))
    df = df.withColumn(tokens, words(F.col(text))).withColumn(lines, F.split(F.col(text), "\n"))
    df = df.withColumn(marked, F.col(text).rlike(MARKED))
    df = df.withColumn(filled, F.filter(F.col(lines), lambda x: x.rlike(has_word)))
    (kept_lines,) = fresh("kept")
    df = df.withColumn(kept_lines, F.filter(F.col(lines), lambda x: ~x.rlike(has_word) | line_passes(x, F.col(marked))))
    measures = F.struct(
        F.size(tokens).cast("long").alias("n_words"),
        F.char_length(F.array_join(F.col(tokens), "")).cast("long").alias("word_chars"),
        F.char_length(F.regexp_replace(F.col(text), "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size(filled) - F.size(F.array_distinct(F.col(filled)))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col(tokens)).alias("n_repeat_words"),
        F.size(filled).cast("long").alias("n_lines"),
        F.char_length(F.array_join(F.col(filled), "")).cast("long").alias("line_chars"),
        F.array_join(F.col(kept_lines), "\n").alias("cleaned"),
        F.char_length(F.array_join(F.col(kept_lines), "")).cast("long").alias("kept_chars"),
        (F.size(lines) - F.size(kept_lines)).cast("long").alias("n_removed"),
    )

    def verdict(m: Column) -> Column:
        fields = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "cleaned"]
        base_failed = (m["n_words"] < 20) | (100 * m["n_repeat_words"] > 30 * m["n_words"])
        return F.struct(
            *[m[f].alias(f) for f in fields],
            (m["n_lines"] - m["n_removed"]).alias("n_lines_kept"),
            base_failed.alias("base_failed"),
            (~base_failed & (m["kept_chars"] >= F.lit(float(min_kept)) * m["line_chars"])).alias("kept"),
        )

    return df.withColumn(output, let(measures, verdict)).drop(text, tokens, lines, filled, marked, kept_lines)


def filter_documents(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """The kept documents with their cleaned text; the columns stay as they are (``n_chars``, if there, follows)."""
    (q,) = fresh("quality")
    # Out of a generator, so that the filter is not pushed down to evaluate the rules again for every use.
    df = clean(docs, text_column, output=q).withColumn(q, F.explode(F.array(q))).filter(F.col(q)["kept"])
    df = df.withColumn(text_column, F.col(q)["cleaned"])
    if "n_chars" in docs.columns:
        df = df.withColumn("n_chars", F.char_length(F.col(text_column)).cast(docs.schema["n_chars"].dataType))
    return df.select(*[F.col(f"`{c}`") for c in docs.columns])


def report(docs: DataFrame) -> DataFrame:
    """The digest of every document: measures, base_failed, kept, and how many of its lines stay."""
    (q,) = fresh("quality")
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_lines_kept"]
    df = clean(docs.select("doc_id", "text"), output=q)
    return df.select("doc_id", *[F.col(q)[n].alias(n) for n in names])
