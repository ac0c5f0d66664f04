"""Column functions over text: cleaning, normalising, tokens, n-grams, shares of scripts."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, functions as F

#: Letters and digits of any script.
WORD = r"[\p{L}\p{N}]"
#: The token class of Korean and English questions.
HANGUL_WORD = "[0-9A-Za-z가-힣]"
#: The end of a word of Latin letters without accents; \b would see an accented letter after it as a part of the word.
WORD_END = "(?![0-9A-Za-z_])"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once: a lambda's free expressions are otherwise computed for every element."""
    return F.transform(F.array(value), body).getItem(0)


def strip(text: Column) -> Column:
    """Without white space, of any kind, at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def collapse(text: Column) -> Column:
    """Runs of white space, of any kind, as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def normalise(text: Column) -> Column:
    """Lower case with collapsed white space."""
    return collapse(F.lower(text))


def compact(text: Column) -> Column:
    """Normalised text without any white space."""
    return F.regexp_replace(normalise(text), " ", "")


def tokens(text: Column, least: int = 1, word: str = WORD, lower: bool = True) -> Column:
    """All runs of at least ``least`` word characters."""
    return F.regexp_extract_all(F.lower(text) if lower else text, F.lit(f"{word}{{{least},}}"), F.lit(0))


def ngrams(text: Column, shortest: int = 2, longest: int = 4) -> Column:
    """All substrings of the compacted text with ``shortest`` to ``longest`` characters, repeats included."""

    def of(held: Column, n: int) -> Column:
        parts = lambda i: F.concat(*[F.get(held, i + k) for k in range(n)])
        return F.when(F.size(held) >= n, F.transform(F.sequence(F.lit(0), F.size(held) - n), parts)).otherwise(F.array().cast("array<string>"))

    # single characters first: picking one is then constant time, while a substring is counted from the start of the text
    characters = F.filter(F.split(compact(text), ""), lambda c: c != "")
    return let(characters, lambda held: F.concat(*[of(held, n) for n in range(shortest, longest + 1)]))


def features(text: Column, word: str = WORD) -> Column:
    """Character n-grams, and every token twice: the features of the centroid classifier."""
    own = tokens(normalise(text), 1, word)
    return F.concat(ngrams(text), own, own)


def without(text: Column, patterns: Sequence[str], by: str = "") -> Column:
    """The text with each pattern's matches replaced, one pattern after another."""
    for pattern in patterns:
        text = F.regexp_replace(text, pattern, by)
    return text


def lines_without(text: Column, pattern: str, joined: str = " ") -> Column:
    """Stripped lines, those that match ``pattern`` left out, joined again."""
    return F.array_join(F.filter(F.transform(F.split(text, "\n"), strip), lambda line: ~line.rlike(pattern)), joined)


def clipped(text: Column, most: int, mark: str = "...") -> Column:
    """At most ``most`` characters, with ``mark`` after a text that is cut."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit(mark))).otherwise(text)


def chunks(text: Column, size: int = 5) -> Column:
    """Consecutive pieces of ``size`` characters, the last may be shorter; together they are the text."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))


def safe_id(title: Column, most: int = 20) -> Column:
    """The first letters and digits of a title, of any script."""
    return F.substring(F.regexp_replace(title, r"(?U)\W+", ""), 1, most)


def content_hash(text: Column, digits: int = 12) -> Column:
    """The first hex digits of the text's MD5."""
    return F.substring(F.md5(text), 1, digits)


def count_of(text: Column, characters: str) -> Column:
    """How many characters of a class, written as the inside of [...], the text has."""
    return (F.length(text) - F.length(F.regexp_replace(text, f"[{characters}]", ""))).cast("bigint")


#: Ideographs and kana that a Korean answer shouldn't hold.
FOREIGN = r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{20000}-\x{2A6DF}\x{30A0}-\x{30FF}\x{3040}-\x{309F}"


def sanitised(text: Column, characters: str = FOREIGN, most: float = 0.15) -> Column:
    """The text without some characters and with runs of spaces collapsed; empty if they are more than a share of its visible ones."""
    found = count_of(text, characters)
    visible = F.length(F.regexp_replace(text, r"(?U)\s", ""))
    kept = strip(F.regexp_replace(F.regexp_replace(text, f"[{characters}]", ""), " {2,}", " "))
    return F.when((visible > 0) & (found / visible > most), "").otherwise(kept)


def once_consecutive(lines: Column) -> Column:
    """Lines of an array without those that repeat the last line that isn't blank; blank lines stay."""
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(None).cast("string").alias("last"))

    def step(state: Column, line: Column) -> Column:
        bare = strip(line)
        repeats = (bare != "") & bare.eqNullSafe(state["last"])
        return F.struct(F.when(repeats, state["kept"]).otherwise(F.concat(state["kept"], F.array(line))).alias("kept"), F.when(bare == "", state["last"]).otherwise(bare).alias("last"))

    return F.aggregate(lines, start, step, lambda state: state["kept"])


def once_frequent(lines: Column, times: int = 3) -> Column:
    """Lines of an array; of a line that isn't blank and occurs ``times`` times or more the first alone."""

    def kept(pair: Column) -> Column:
        own = lambda i: F.element_at(pair["bare"], i + 1)
        # how often each line occurs is looked up in counts of the sorted lines that occur often, a short list in any text
        return F.filter(pair["lines"], lambda line, i: (own(i) == "") | ~F.array_contains(pair["often"], own(i)) | (F.array_position(pair["bare"], own(i)) == i + 1))

    def often(bare: Column) -> Column:
        return let(F.array_sort(bare), lambda ranked: F.array_distinct(F.filter(ranked, lambda line, i: F.get(ranked, i + times - 1) == line)))

    def both(held: Column) -> Column:
        return let(F.transform(held, strip), lambda bare: kept_of(held, bare))

    def kept_of(held: Column, bare: Column) -> Column:
        return let(F.struct(held.alias("lines"), bare.alias("bare"), often(bare).alias("often")), kept)

    return let(lines, both)


def deduplicated(text: Column) -> Column:
    """Text whose consecutive and frequent lines occur once."""
    return F.array_join(once_frequent(once_consecutive(F.split(text, "\n"))), "\n")


def snippet(text: Column, keywords: Column, before: int = 50, size: int = 350) -> Column:
    """A piece of the text from shortly before the first keyword of the array that it holds, or from its start."""
    met = F.filter(keywords, lambda k: F.contains(text, k))
    at = F.when(F.size(met) > 0, F.greatest(F.instr(text, F.get(met, F.lit(0))) - 1 - before, F.lit(0))).otherwise(0)
    return strip(F.substr(text, at + 1, F.lit(size)))


def keyword_window(text: Column, keyword: str, before: int = 30, after: int = 300) -> Column:
    """The text from ``before`` characters ahead of a keyword to ``after`` behind its start; null without the keyword."""
    at = F.locate(keyword, text)
    low = F.greatest(at - before, F.lit(1))
    return F.when(at > 0, F.substr(text, low, at + after - low))


def unique_snippets(snippets: Column, key: int = 80, most: int = 3) -> Column:
    """The first ``most`` snippets of an array whose first ``key`` characters differ from those of all before them; nulls are left out."""
    held = F.filter(snippets, lambda s: s.isNotNull())
    keys = F.transform(held, lambda s: F.substring(s, 1, key))
    return let(keys, lambda known: F.slice(F.filter(held, lambda s, i: F.array_position(known, F.substring(s, 1, key)) == i + 1), 1, most))


def first_window(text: Column, keywords: Column, before: int = 30, after: int = 300, least: int = 50) -> Column:
    """The stripped window around the first keyword of an array that the text holds with more than ``least`` characters; null if there is none."""

    def window(word: Column) -> Column:
        at = F.instr(text, word)
        low = F.greatest(at - before, F.lit(1))
        return F.when(at > 0, strip(F.substr(text, low, at + after - low)))

    return F.get(F.filter(F.transform(keywords, window), lambda w: F.length(w) > least), F.lit(0))


def year_of(text: Column) -> Column:
    """A year written as 20dd, else the year of a class written as two digits before a word for class."""
    full = F.regexp_extract(text, r"(20[0-9]{2})", 1)
    short = F.regexp_extract(text, r"([0-9]{2})(?U)\s*학번", 1)
    return F.when(full != "", full).when(short != "", F.concat(F.when(short.cast("int") < 50, "20").otherwise("19"), short))


def date_of(text: Column, today: Column, now: Sequence[str] = ("오늘", "금일"), next_day: str = "내일") -> Column:
    """An ISO date that a question means: today's, tomorrow's, or one written out; ``today`` is a parameter so that answers can be repeated."""
    parts = [F.regexp_extract(text, "(20[0-9]{2})[./년 -]+([0-9]{1,2})[./월 -]+([0-9]{1,2})", i) for i in (1, 2, 3)]
    iso = lambda d: F.date_format(d, "yyyy-MM-dd")
    return (
        F.when(any_in(text, now), iso(today))
        .when(F.contains(text, F.lit(next_day)), iso(F.date_add(today, 1)))
        .when(parts[0] != "", F.concat(parts[0], F.lit("-"), F.lpad(parts[1], 2, "0"), F.lit("-"), F.lpad(parts[2], 2, "0")))
    )


def any_in(text: Column, words: Sequence[str]) -> Column:
    """Whether the text holds any of the words."""
    out = F.lit(False)
    for word in words:
        out = out | F.contains(text, F.lit(word))
    return out
