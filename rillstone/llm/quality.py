"""Operator 9: line-first quality rules, in built-in functions only.

Each line is judged by itself (punctuation, navigation, symbols, shouting, boilerplate); lines that
fail are removed, and a document that loses too much of its text is rejected. Statistics of the
whole text reject a document by themselves. All work is within a row: there is no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, text_or_empty
from .native import SPACE, let, words

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

#: A document is rejected if its failing lines hold more than this share of its lines' characters.
MAX_LOST = 0.5

#: Fixed phrases of pages' frames, in English, German, French and Spanish.
BOILERPLATE = (
    r"(?i)\b(?:all rights reserved|accept (?:all )?cookies|cookie policy|privacy policy|terms of (?:use|service)|"
    r"sign up for our|subscribe to our|log in to|enable javascript|licensed under|lorem ipsum|powered by|share this|"
    r"alle rechte vorbehalten|cookies (?:akzeptieren|ablehnen)|datenschutzerkl|nutzungsbedingungen|newsletter abonnieren|"
    r"tous droits r.serv.s|accepter (?:les|tous les) cookies|politique de confidentialit|conditions d.utilisation|"
    r"todos los derechos reservados|aceptar (?:las|todas las) cookies|pol.tica de (?:privacidad|cookies)|condiciones de uso)|©"
)
SYMBOLS = r"[#*$%&|<>~^{}\\]"
SEPARATORS = r"[|»›•·]"
TERMINAL = (".", "!", "?", "…", ":", ";", ",", '"', "'", "”", "»", ")", "]")

#: One symbol in so many characters, or a separator, makes a line of symbols or of navigation.
SYMBOL_CHARS, SEPARATOR_CHARS = 12, 20

#: A line under so many characters that ends without punctuation is a menu entry or a scrap.
SCRAP_CHARS = 20


def line_fails(line: Column) -> Column:
    """Whether a line (with a word in it) breaks a rule."""
    size = F.char_length(line)
    separators = F.regexp_count(line, F.lit(SEPARATORS))
    navigation = (separators >= 2) & (separators * SEPARATOR_CHARS >= size)
    symbols = F.regexp_count(line, F.lit(SYMBOLS)) * SYMBOL_CHARS >= size
    shouting = ~line.rlike(r"\p{Ll}") & line.rlike(r"\p{Lu}.*\p{Lu}")
    scrap = (size < SCRAP_CHARS) & ~F.right(F.rtrim(line), F.lit(1)).isin(*TERMINAL)
    return navigation | symbols | shouting | scrap | line.rlike(BOILERPLATE)


def repeated_words(items: Column, width: int = WINDOW) -> Column:
    """How many of the words stand in a window of ``width`` that the text has twice or more.

    Windows are told apart by 64-bit hashes. Only a text that has a window twice is sorted; its
    repeated windows' places, in order, then cover ``min(width, distance to the next)`` words each.
    """

    def covered(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))

        def places(s: Column) -> Column:
            same = lambda x, i: F.coalesce(F.get(s, i)["h"] == x["h"], F.lit(False))
            return F.sort_array(F.transform(F.filter(s, lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x["p"]))

        def total(at: Column) -> Column:
            parts = F.transform(at, lambda p, i: F.least(F.lit(width), F.coalesce(F.get(at, i + 1) - p, F.lit(width))))
            return F.aggregate(parts, F.lit(0), lambda x, y: x + y)

        return let(let(pairs, places), total)

    def body(h: Column) -> Column:
        found = F.transform(F.sequence(F.lit(0), F.size(h) - width), lambda i: F.xxhash64(*[F.get(h, i + n) for n in range(width)]))
        return F.when(F.size(h) > width, let(found, lambda f: F.when(F.size(F.array_distinct(f)) < F.size(f), covered(f)).otherwise(0))).otherwise(0)

    return let(F.transform(items, lambda w: F.xxhash64(w)), body)


def judge(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` (longs), ``base_failed``,
    ``kept`` and ``clean_text``.

    Null and empty texts have no words, so they fail; repeated rows are judged each; no column needs
    a name of its own but the seven, which replace columns of these names. ``clean_text`` is the text
    without its failing lines, unchanged if there are none.
    """
    content = text_or_empty(text)
    with_word = lambda line: F.length(F.regexp_replace(line, SPACE, "")) > 0
    split = df.withColumn("__words", words(content)).withColumn("__lines", F.split(content, "\n"))
    full = F.filter("__lines", with_word)
    split = split.withColumn("__full", full).withColumn("__good", F.filter("__lines", lambda line: ~(with_word(line) & line_fails(line))))
    chars = lambda lines: F.char_length(F.array_join(lines, ""))
    stats = split.withColumns(
        {
            "n_words": F.size("__words").cast("long"),
            "word_chars": F.char_length(F.array_join("__words", "")).cast("long"),
            "n_symbols": F.regexp_count(content, F.lit(r"[#*$%&|<>]")).cast("long"),
            "n_dup_lines": (F.size("__full") - F.size(F.array_distinct("__full"))).cast("long"),
            "n_repeat_words": repeated_words(F.col("__words")).cast("long"),
            "__lost": chars("__lines") - chars("__good"),
            "__chars": chars("__lines"),
            "clean_text": F.array_join("__good", "\n"),
        }
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    judged = stats.withColumn("base_failed", failed)
    judged = judged.withColumn("kept", ~F.col("base_failed") & (F.col("__lost") <= MAX_LOST * F.col("__chars")))
    return judged.drop("__words", "__lines", "__full", "__good", "__lost", "__chars")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract 9."""
    found = judge(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
