"""Quality rules by line-first cleaning, in DataFrame operations only.

Every line is tried by the punctuation, navigation and boilerplate rules; lines that fail are
removed; a document that loses too much of its text is rejected. The base rules (number of words,
words in repeated windows) count over the whole text as it came.

Nulls: a null text has no words and no lines. An empty text is rejected by the base rule. Rows are
judged one by one, so ties, repeated rows, other columns and their names do not matter, and an empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlens.llm.common import SPACE, WORD, document, restored, text_or_empty

#: Phrases of notices and menus, in lower case.
BOILERPLATE = (
    "all rights reserved",
    "cookie policy",
    "enable javascript",
    "javascript is disabled",
    "lorem ipsum",
    "privacy policy",
    "subscribe to our newsletter",
    "terms of service",
    "terms of use",
    "uses cookies",
    "we use cookies",
)
NAVIGATION = ("about us", "back to top", "click here", "contact us", "home", "log in", "login", "menu", "next page", "previous page", "read more", "share this", "sign in", "sign up", "skip to content")
#: Marks that may end a sentence (Latin, Greek, CJK, Indic, Arabic, Urdu, Burmese, Ethiopic, Armenian), letters of
#: scripts whose sentences have no final mark (Thai, Lao, Khmer, Tibetan), and the closing quotes and brackets that may follow.
MARKS = ".!?…。！？．।॥؟۔၊။።፧։:;：；"
UNMARKED = "\u0e00-\u0eff\u0f00-\u0fff\u1780-\u17ff"
CLOSING = "\"'”’»)]）」』】〉》］"
ASCII_SPACE = " \t\n\x0b\x0c\r"
BASE_WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
MAX_SYMBOLS_A_WORD = 0.3
MAX_SHOUTS_A_WORD = 0.3
MAX_SEPARATORS_A_WORD = 0.2
SHORT_LINE = 12  # words; notices and menus are no longer than this
MAX_LOST = 0.5  # of the characters in lines
SYMBOLS = r"[#*$%&<>{}~^=\\]"
SEPARATORS = "[|»›•·]"
MENU = "(^|[^a-z])(" + "|".join(NAVIGATION) + ")($|[^a-z])"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def _more_words_than(line: Column, n: int) -> Column:
    """Whether a line has more than n words; it is read no further than that."""
    return line.rlike(rf"^{SPACE[:-1]}*+(?:{WORD}+{SPACE}+){{{n}}}{WORD[:-1]}")


def line_fails(line: Column, low: Column, has: dict[str, Column]) -> Column:
    """Whether a line that has a word breaks one of the rules for lines.

    low: the line in lower case; has: whether the whole text has any symbols, marks of emphasis, separators or notices,
    so that most texts answer for all their lines at once. What costs little is asked first.
    """
    words = _count(line, WORD)
    # punctuation: a short line in which no sentence ends, or marks other than letters make up much of the line
    ends, last = f"[{MARKS}{UNMARKED}]", F.substring(line, -1, 1)
    bare = F.substring(F.rtrim(F.rtrim(line, F.lit(ASCII_SPACE)), F.lit(CLOSING)), -1, 1)
    endless = ~_more_words_than(line, SHORT_LINE) & ~last.rlike(ends) & ~bare.rlike(ends)
    symbols = has["symbols"] & (_count(line, SYMBOLS + "+") > words * MAX_SYMBOLS_A_WORD)
    shouts = has["shouts"] & line.rlike("[!?]") & (_count(line, "[!?]+") > F.greatest(words * MAX_SHOUTS_A_WORD, F.lit(2)))
    # navigation: separators between items, or a short line with the words of a menu
    separators = has["separators"] & (_count(line, SEPARATORS) > F.greatest(words * MAX_SEPARATORS_A_WORD, F.lit(1)))
    menu = ~_more_words_than(line, SHORT_LINE // 3) & low.rlike(MENU)
    notice = has["notices"] & ~_more_words_than(line, 3 * SHORT_LINE) & _any_of(low, BOILERPLATE)
    return endless | symbols | shouts | separators | menu | notice


def _any_of(low: Column, phrases: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for phrase in phrases:
        found = found | low.contains(phrase)
    return found


def measured(rows: DataFrame) -> DataFrame:
    """rows (text, and document or doc_id) with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept and cleaned."""
    carried = [c for c in rows.columns if c != "text"]
    df = rows.select(*carried, text_or_empty().alias("text"))
    df = df.withColumn("words", F.array_remove(F.split("text", SPACE, -1), ""))
    df = df.withColumn("n_words", F.size("words").cast("long"))
    # a hash of each window of words, in order
    df = df.withColumn("each", F.transform("words", lambda w: F.xxhash64(w)))
    many = F.greatest(F.size("each") - BASE_WINDOW + 1, F.lit(0))
    df = df.withColumn("hashes", F.transform(F.arrays_zip(*[F.slice("each", k + 1, many).alias(f"w{k}") for k in range(BASE_WINDOW)]), lambda w: F.xxhash64(w)))
    # only where a window comes twice: places of such windows, in order
    twice = F.size(F.array_distinct("hashes")) < F.size("hashes")
    df = df.withColumn("sorted", F.when(twice, F.array_sort(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = lambda j, k: F.col("sorted")[j]["h"] == F.col("sorted")[k]["h"]
    last = F.size("sorted") - 1
    repeated = F.filter(F.sequence(F.lit(0), last), lambda j: ((j > 0) & same(j, F.greatest(j - 1, F.lit(0)))) | ((j < last) & same(j, F.least(j + 1, last))))
    df = df.withColumn("places", F.when(F.col("sorted").isNotNull(), F.sort_array(F.transform(repeated, lambda j: F.col("sorted")[j]["i"]))))
    steps = F.transform(F.sequence(F.lit(1), F.size("places") - 1), lambda j: F.least(F.lit(BASE_WINDOW), F.col("places")[j] - F.col("places")[j - 1]))
    covered = F.when(F.col("places").isNull(), F.lit(0)).otherwise(F.aggregate(steps, F.lit(BASE_WINDOW), lambda acc, x: acc + x))
    df = df.withColumn("n_repeat_words", covered.cast("long"))
    df = df.withColumn("word_chars", F.length(F.array_join("words", "")).cast("long"))
    df = df.withColumn("n_symbols", _count(F.col("text"), r"[#*$%&|<>]").cast("long"))
    df = df.withColumn("lines", F.split("text", "\n", -1))
    df = df.withColumn("with_word", F.filter("lines", _has_word))
    df = df.withColumn("n_dup_lines", (F.size("with_word") - F.size(F.array_distinct("with_word"))).cast("long"))
    df = df.withColumn("lower", F.lower("text"))  # has the same lines
    # one array that is read several times: the optimizer then works it out once a text, not inside the function for lines
    flags = {"symbols": F.col("text").rlike(SYMBOLS), "shouts": F.col("text").rlike("[!?]"), "separators": F.col("text").rlike(SEPARATORS), "notices": _any_of(F.col("lower"), BOILERPLATE)}
    df = df.withColumns({"flags": F.array(*flags.values()), "pairs": F.arrays_zip("lines", F.split("lower", "\n", -1).alias("lows"))})
    has = {name: F.col("flags")[k] for k, name in enumerate(flags)}
    df = df.withColumn("good", F.filter("pairs", lambda x: ~(_has_word(x["lines"]) & line_fails(x["lines"], x["lows"], has)))["lines"])
    df = df.withColumn("cleaned", F.array_join("good", "\n"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    df = df.withColumn("base_failed", failed)
    lost = F.length("text") - F.length("cleaned")
    df = df.withColumn("kept", ~failed & (lost <= MAX_LOST * F.length("text")))
    return df.select(*carried, *COUNTS, "cleaned")


def _has_word(line: Column) -> Column:
    return line.rlike(r"[^\x20\x09-\x0D]")


def quality_report(docs: DataFrame) -> DataFrame:
    """One row for each document: the counts, and whether it is kept."""
    return measured(docs.select("doc_id", "text")).drop("cleaned")


def cleaned(docs: DataFrame) -> DataFrame:
    """The documents that are kept, without their failing lines; n_chars follows the text."""
    # a generator instead of a filter: a filter would be pushed below the counts and work them out again inside it
    rows = measured(docs.select(document(docs), "text")).select("document", F.explode(F.when(F.col("kept"), F.array("cleaned"))).alias("text"))
    return restored(rows, docs, text=F.col("text"), n_chars=F.length("text").cast("long"))
