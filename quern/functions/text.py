"""Text analysis: tokens, stop-words, stems, n-grams, lengths. Lengths are bytes, letter case is ASCII's."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.config import TextConfig
from quern.functions.columns import ascii_lower, bind, strings

SPACE = "[ \\t\\n\\x0B\\f\\r]"
STRIP = ".,!?;:\"'()[]{}<>"

# The English stop-words.
ENGLISH = """
a about above after again against all am an and any are aren't as at be because been before being below between both
but by can can't cannot could couldn't did didn't do does doesn't doing don don't down during each few for from further
had hadn't has hasn't have haven't having he he'd he'll he's her here here's hers herself him himself his how how's i
i'd i'll i'm i've if in into is isn't it it's its itself just let's me more most mustn't my myself no nor not now of off
on once only or other ought our ours ourselves out over own same shan't she she'd she'll she's should shouldn't so some
such than that that's the their theirs them themselves then there there's these they they'd they'll they're they've this
those through to too under until up very was wasn't we we'd we'll we're we've were weren't what what's when when's where
where's which while who who's whom why why's will with won't would wouldn't you you'd you'll you're you've your yours
yourself yourselves
"""

# Stems of whole words, looked up before the rules.
STEMS = {"running": "run", "runs": "run", "ran": "ran", "easily": "easili", "organization": "organ", "jumping": "jump", "jumps": "jump", "foxes": "fox", "quickly": "quickli"}


def stopwords(language: str = "english") -> list[str]:
    return ENGLISH.split() if language in ("english", "en") else []


def is_stopword(x: Column, language: str = "english") -> Column:
    words = stopwords(language)
    return ascii_lower(x).isin(words) if words else F.lit(False)


def is_valid(token: Column, c: TextConfig) -> Column:
    ok = F.octet_length(token).between(max(1, c.min_length), c.max_length)
    return ok & ~token.rlike(r"\A[0-9]+\z") if c.remove_numbers else ok


def tokenize(text: Column, c: TextConfig) -> Column:
    """Array of tokens: split at white space, punctuation stripped at both ends, invalid ones dropped.

    If none is left, the whole text, stripped, is the token if it is valid. Null gives no tokens.
    """
    case = ascii_lower if c.lowercase else (lambda x: x)
    strip = lambda x: F.btrim(x, F.lit(STRIP))
    cut = F.filter(F.transform(F.split(text, SPACE + "+"), strip), lambda x: is_valid(x, c))
    whole = F.when(text.rlike("[^ \\t\\n\\x0B\\f\\r]") & is_valid(strip(text), c), F.array(strip(text))).otherwise(strings())
    found = bind(cut, lambda t: F.when(F.size(t) > 0, t).otherwise(whole))
    return F.when(text.isNull(), strings()).otherwise(F.transform(found, case) if c.lowercase else found)


def filter_stopwords(tokens: Column, language: str = "english") -> Column:
    return F.filter(tokens, lambda t: ~is_stopword(t, language))


def _drop(x: Column, n: int) -> Column:
    return F.left(x, F.length(x) - n)


def _plural(w: Column) -> Column:
    short = F.octet_length(w) < 4
    return (
        F.when(short, w).when(w.endswith("sses"), _drop(w, 2)).when(w.endswith("ies"), F.concat(_drop(w, 3), F.lit("i")))
        .when(w.endswith("s") & ~w.endswith("ss"), _drop(w, 1)).otherwise(w)
    )


def _ending(w: Column) -> Column:
    n = F.octet_length(w)
    return (
        F.when((n >= 5) & w.endswith("ing"), F.when(w.endswith("nning"), _drop(w, 4)).otherwise(_drop(w, 3)))
        .when((n >= 4) & w.endswith("ed"), _drop(w, 2)).otherwise(w)
    )


def stem(word: Column) -> Column:
    """Nine fixed words, then plurals, -ing and -ed, then y to i after a consonant; shorter than three bytes stays."""
    fixed = F.create_map(*[F.lit(x) for pair in STEMS.items() for x in pair])

    def ruled(low: Column) -> Column:
        rules = bind(_plural(low), lambda a: bind(_ending(a), lambda b: F.regexp_replace(b, r"([^aeiou])y\z", "$1i")))
        return F.when(low.isin(*STEMS), F.element_at(fixed, low)).otherwise(rules)

    return F.when(F.octet_length(word) < 3, word).otherwise(bind(ascii_lower(word), ruled))


def process(text: Column, c: TextConfig) -> Column:
    """Tokens as the index sees them: stop-words dropped, stemmed, lengths checked again."""
    t = tokenize(text, c)
    if c.lowercase is False:
        t = F.transform(t, ascii_lower)
    if c.remove_stopwords:
        t = filter_stopwords(t, c.language)
    if c.stem:
        t = F.transform(t, stem)
    return F.filter(t, lambda x: F.octet_length(x).between(c.min_length, c.max_length))


def normalize(text: Column, c: TextConfig = TextConfig()) -> Column:
    """Lower case, punctuation and (if so set) numbers to spaces, spaces collapsed and trimmed."""
    x = ascii_lower(text) if c.lowercase else text
    if c.remove_punctuation:
        x = F.regexp_replace(x, "[^A-Za-z0-9_ \\t\\n\\x0B\\f\\r]", " ")
    if c.remove_numbers:
        x = F.regexp_replace(x, "(?<![A-Za-z0-9_])[0-9]+(?![A-Za-z0-9_])", " ")
    return F.btrim(F.regexp_replace(x, SPACE + "+", " "), F.lit(" \t\n\r"))


def ngrams(tokens: Column, n: int) -> Column:
    if n <= 1:
        return strings()
    at = lambda i: F.concat_ws("_", *[F.get(tokens, i + k) for k in range(n)])
    return F.when(F.size(tokens) >= n, F.transform(F.sequence(F.lit(0), F.size(tokens) - n), at)).otherwise(strings())


def token_count(text: Column) -> Column:
    """A quarter of the bytes, rounded up."""
    return F.floor((F.octet_length(text) + 3) / 4).cast("long")


def snippet(text: Column, n: int = 100) -> Column:
    """The first n characters, with an ellipsis if that is not all (characters, so that none is cut in two)."""
    return F.when(F.length(text) > n, F.concat(F.left(text, F.lit(n)), F.lit("..."))).otherwise(text)
