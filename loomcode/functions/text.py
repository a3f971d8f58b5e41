"""Text primitives as column expressions: everything stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Languages with a lemma provider.
LANGUAGES = ["de", "en", "fr", "it"]

#: Function words of the default provider.
STOP_WORDS = {
    "en": "a an and are as at be been but by for from had has have he her his i if in into is it its my no not of on or our she so that the their them then there they this to was we were what when where which who will with you your".split(),
    "de": "aber als am an auch auf aus bei bin bis da das dass dem den der des die du ein eine einem einen einer er es für hat ich im in ist ja mit nicht noch nur oder sich sie sind so um und uns von war was wie wir zu zum zur".split(),
    "fr": "à au aux avec ce ces cette dans de des du elle en est et eux il ils je la le les leur lui ma mais me mes moi mon ne nos nous on ou où par pas pour qu que qui sa se ses son sur ta te tu un une vos vous y".split(),
    "it": "a al alla anche che chi ci come con cui da dal de dei del della di e ed è gli ha ho i il in io la le lei li lo lui ma mi ne nei nella no noi non o per più quando quella questo se sei si sono su sua suo te ti tra tu un una uno".split(),
}

#: Labels that name an interviewer.
INTERVIEWER = r"(?i)^(I\d*|IV|INT|MOD|MODERATOR|INTERVIEWER)$"

#: The default provider: a token, and the break between sentences.
TOKEN = r"[\p{L}\p{N}_'-]+"
SENTENCE_BREAK = r"(?<=[.!?])\s+"
SPACE = r"[\s\x1c-\x1f]"
#: The same characters, where \s is Unicode's white space.
SPACES = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def strip(x) -> Column:
    """x without white space of any kind at its ends."""
    return F.trim(x, F.lit(SPACES))


def normalize_label(x) -> Column:
    """A code label for comparison: lower case, `_` and `-` as spaces, single spaces."""
    return strip(F.regexp_replace(F.translate(F.lower(x), "_-", "  "), rf"(?U){SPACE}+", " "))


def normalize_speaker(x) -> Column:
    """A speaker for comparison: no white space, no `.` or `:` at the ends, upper case."""
    bare = F.regexp_replace(x, rf"(?U){SPACE}+", "")
    return F.upper(F.regexp_replace(bare, r"^[.:]+|[.:]+$", ""))


def seconds(ts) -> Column:
    """[h:]m:s as seconds."""
    return F.aggregate(F.split(ts, ":"), F.lit(0), lambda acc, x: acc * 60 + F.coalesce(x.try_cast("int"), F.lit(0)))


def default_role(speaker) -> Column:
    return F.when(F.rlike(speaker, F.lit(INTERVIEWER)), "interviewer").otherwise("participant")


def paragraphs(text) -> Column:
    """The stripped lines that are not blank."""
    return F.filter(F.transform(F.split(text, "\n"), strip), lambda x: x != "")


def sentences(text) -> Column:
    """The sentences of a text, not split at line ends."""
    return F.filter(F.transform(F.split(text, SENTENCE_BREAK), strip), lambda x: x != "")


def line_sentences(text) -> Column:
    """The sentences of each line."""
    return F.flatten(F.transform(paragraphs(text), sentences))


def tokens(text) -> Column:
    """Lower-case tokens in order; the default lemma of a token is itself."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"({TOKEN})"), F.lit(1))


def stop_words(lang) -> Column:
    known = F.array().cast("array<string>")
    for k, v in STOP_WORDS.items():
        known = F.when(lang == k, F.lit(v)).otherwise(known)
    return known


def _inside(words):
    return lambda t: t.isin(words)


def _outside(words):
    return lambda t: ~t.isin(words)


def content(seq, lang) -> Column:
    """The tokens that are no stop words; duplicates and order stay."""
    kept = F.array().cast("array<string>")
    for k, v in STOP_WORDS.items():
        kept = F.when(lang == k, F.filter(seq, _outside(v))).otherwise(kept)
    return F.when(lang.isin(list(STOP_WORDS)), kept).otherwise(seq)


def is_phrase(expression) -> Column:
    """In straight or curly quotes."""
    return F.rlike(strip(expression), F.lit("(?s)^[\"\u201c\u201d\u201e\u00ab].*[\"\u201c\u201d\u00bb]$")) & (F.length(strip(expression)) >= 2)


def expression_lemmas(expression, lang) -> Column:
    """A phrase keeps stop words, a bag drops them."""
    seq = tokens(expression)
    return F.when(is_phrase(expression), seq).otherwise(content(seq, lang))


def split_expressions(cell) -> Column:
    return F.filter(F.transform(F.split(cell, ";"), strip), lambda x: x != "")


def stoplist(words) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.transform(words, lambda w: F.lower(strip(w))), lambda w: w != "")))


def estimated_tokens(x) -> Column:
    return F.expr(f"length({x}) div 4")


def rounded(x, places: int) -> Column:
    """x to so many places, half to even, judged on the binary value: 0.05 has a value above 5/100, and so becomes 0.1.

    2 * 10**places * x is taken as a product and its exact error (x is split so that both parts multiply exactly), so that a
    half is told from a value just above or below it.
    """
    scale = 10.0**places
    x = x.cast("double")
    big = x * 134217729.0
    high = big - (big - x)
    twice = x * (2 * scale)
    rest = (high * (2 * scale) - twice) + (x - high) * (2 * scale)
    below = F.floor(twice / 2)
    half = (twice == F.floor(twice)) & (F.abs(twice % 2) == 1)
    up = (rest > 0) | ((rest == 0) & (below % 2 != 0))
    whole = F.when(half, below + F.when(up, 1).otherwise(0)).otherwise(F.floor((twice + 1) / 2))
    return whole / F.lit(scale)


def percent(part, whole, places: int | None = None) -> Column:
    """100 * part / whole, or 0 without a whole; rounded to so many places."""
    share = F.when(whole > 0, F.lit(100.0) * part / whole).otherwise(F.lit(0.0))
    return share if places is None else rounded(share, places)


def detect_language(text, first: int | None = None) -> Column:
    """The language with most stop words, or null without any; ties go to the first by name. With `first`, among so many characters
    only; the reference looks at 5000."""
    bag = tokens(text if first is None else F.substring(text, 1, first))
    votes = F.array(*(F.struct(F.size(F.filter(bag, _inside(STOP_WORDS[k]))).alias("n"), F.lit(-i).alias("o"), F.lit(k).alias("lang")) for i, k in enumerate(sorted(STOP_WORDS))))
    best = F.array_max(votes)
    return F.when(best["n"] > 0, best["lang"])


def duration(secs) -> Column:
    s = secs.cast("long")
    return (
        F.when(s < 60, F.concat(s.cast("string"), F.lit(" s")))
        .when(s < 3600, F.concat(F.floor(s / 60).cast("string"), F.lit(" m "), (s % 60).cast("string"), F.lit(" s")))
        .otherwise(F.concat(F.floor(s / 3600).cast("string"), F.lit(" h "), F.floor(s % 3600 / 60).cast("string"), F.lit(" m")))
    )


def stem_name(name) -> Column:
    return F.regexp_replace(name, r"(?i)\.(docx|txt|pdf|xlsx)\b", "")


def display_name(filename, column, group) -> Column:
    """A workbook column's name, with its group if there is one."""
    shown = F.concat(filename, F.lit(" ["), column, F.lit("]"), F.when(F.coalesce(group, F.lit("")) != "", F.concat(F.lit(" ("), group, F.lit(")"))).otherwise(""))
    return F.coalesce(shown, filename)


def iso_time(ts) -> Column:
    """A time in UTC as exchange files write it."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def clock(ts) -> Column:
    return F.date_format(ts, "HH:mm:ss")


def shown_time(ts) -> Column:
    return F.concat(F.date_format(ts, "yyyy-MM-dd HH:mm"), F.lit(" UTC"))
