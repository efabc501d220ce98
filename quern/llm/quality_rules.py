"""Quality rules: a table of thresholds compiled into one projection, without user functions.

A document without text counts as one without words. Rows stand alone: repeated rows and ids, empty tables and
further columns change nothing, and columns that carry the names of results are replaced. Every measure is defined
for every text: a ratio over nothing is 0. All of a text is read, however long it is; the one measure that compares
parts of a text with each other (repeated windows) sorts, so that its time grows little faster than the text.
"""

from __future__ import annotations

from dataclasses import dataclass

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import SPACE_RUN, SPACES, let, total, with_fields, words

SYMBOLS = "#*$%&|<>"
WINDOW = 5

# Frequent function words of four languages.
STOP_WORDS = {
    "en": "the of and to in is that it for was on are as with be by this from at or an not have which you he we they a",
    "de": "der die und den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an er sie aus bei in",
    "fr": "de la le et les des en un une du que est pour qui dans par sur au avec pas plus ce il elle ne se aux",
    "es": "de la que el en y los se del las un por con una su para es al lo como más o pero sus le ha a",
}
STOP_SET = sorted({w for v in STOP_WORDS.values() for w in v.split()})


@dataclass(frozen=True)
class Rule:
    """A measure that must lie between two bounds, both included."""

    measure: str
    least: float
    most: float


RULES = (
    Rule("mean_word_chars", 2.0, 14.0),
    Rule("symbol_ratio", 0.0, 0.10),
    Rule("stop_ratio", 0.04, 1.0),
    Rule("dup_line_ratio", 0.0, 0.50),
    Rule("capital_ratio", 0.0, 0.40),
    Rule("stutter_ratio", 0.0, 0.20),
)


def _runs(sorted_pairs: Column, value: str, position: str) -> Column:
    """Positions of those pairs whose value a neighbour shares."""

    def shared(x: Column, i: Column) -> Column:
        before, after = F.get(sorted_pairs, i - 1)[value], F.get(sorted_pairs, i + 1)[value]
        return F.coalesce(before == x[value], F.lit(False)) | F.coalesce(after == x[value], F.lit(False))

    return F.transform(F.filter(sorted_pairs, shared), lambda x: x[position])


def _covered(starts: Column) -> Column:
    """Words in the union of the windows that start at these sorted positions."""
    gap = lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, i + 1) - p, F.lit(WINDOW)))
    return total(F.transform(starts, gap))


def _repeated(w: Column, hashes: Column) -> Column:
    """Hashes name the windows that may repeat; then their words decide.

    A window is spelled by five lookups: ``slice`` copies the whole array each time.
    """
    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), (i + 1).alias("p"))))
    found = lambda at: F.sort_array(
        F.transform(at, lambda p: F.struct(F.concat_ws(" ", *[F.get(w, p - 1 + k) for k in range(WINDOW)]).alias("s"), p.alias("p")))
    )
    return let(
        let(let(pairs, lambda s: _runs(s, "h", "p")), found),
        lambda exact: let(F.sort_array(_runs(exact, "s", "p")), _covered),
    )


def repeat_words(w: Column, codes: Column) -> Column:
    """How many words stand in windows of five words that the text has twice or more, the first one included."""
    windows = F.transform(F.sequence(F.lit(0), F.size(codes) - WINDOW), lambda i: F.xxhash64(*[F.get(codes, i + k) for k in range(WINDOW)]))
    count = lambda hashes: F.when(
        F.size(F.array_distinct(hashes)) < F.size(hashes), _repeated(w, hashes)
    ).otherwise(F.lit(0).cast("long"))
    return F.when(F.size(codes) > WINDOW, let(windows, count)).otherwise(F.lit(0).cast("long"))


def _of_words(w: Column, stops: list[int]) -> Column:
    """The counts that look at one word after another, by the words' hashes."""
    return let(
        F.transform(w, lambda x: F.xxhash64(x)),
        lambda codes: F.struct(
            repeat_words(w, codes).alias("n_repeat_words"),
            F.size(F.filter(codes, lambda c: c.isin(stops))).cast("long").alias("n_stop_words"),
            F.size(F.filter(codes, lambda c, i: c == F.get(codes, i - 1))).cast("long").alias("n_stutters"),
        ),
    )


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(0.0)


def _counts(text: Column) -> Column:
    """All counts of a text as one struct.

    One expression binds the words and lines, so that a filter which Catalyst pushes below the projection cannot copy
    the splitting of the text into the loops over its words.
    """
    t = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(t, "\n", -1), lambda x: F.length(F.btrim(x, F.lit(SPACES))) > 0)
    stops = [xxhash.xxh64_intdigest(x.encode(), 42) for x in STOP_SET]
    signed = [x - (x >> 63 << 64) for x in stops]

    def struct(w: Column, rows: Column, seen: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.regexp_replace(t, SPACE_RUN, "")).cast("long").alias("word_chars"),
            F.regexp_count(t, F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"),
            F.size(rows).cast("long").alias("n_lines"),
            (F.size(rows) - F.size(F.array_distinct(rows))).cast("long").alias("n_dup_lines"),
            F.regexp_count(t, F.lit("\\p{Lu}")).cast("long").alias("n_capitals"),
            *[seen[k].alias(k) for k in ("n_repeat_words", "n_stop_words", "n_stutters")],
        )

    return let(words(text), lambda w: let(lines, lambda rows: let(_of_words(w, signed), lambda seen: struct(w, rows, seen))))


COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_capitals", "n_repeat_words", "n_stop_words", "n_stutters")


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the counts of the rules to every row."""
    return with_fields(docs, _counts(F.col(text)), COUNTS)


def verdict(counts: Column, rules: tuple[Rule, ...] = RULES) -> tuple[Column, Column]:
    """Whether a struct of counts fails the base conditions, and whether it passes all rules."""
    n = counts["n_words"]
    ratios = {
        "mean_word_chars": _ratio(counts["word_chars"], n),
        "symbol_ratio": _ratio(counts["n_symbols"], n),
        "stop_ratio": _ratio(counts["n_stop_words"] + 1, n),  # one more, so that a few words alone never fail
        "dup_line_ratio": _ratio(counts["n_dup_lines"], counts["n_lines"]),
        "capital_ratio": _ratio(counts["n_capitals"], counts["word_chars"]),
        "stutter_ratio": _ratio(counts["n_stutters"], n),
    }
    failed = (n < 10) | (100 * counts["n_repeat_words"] > 20 * n)
    passed = F.lit(True)
    for r in rules:
        passed = passed & ratios[r.measure].between(r.least, r.most)
    return failed, passed


def apply_rules(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Every row with its counts, ``base_failed`` and ``kept``."""

    def judged(counts: Column) -> Column:
        failed, passed = verdict(counts, rules)
        return F.struct(*[counts[k].alias(k) for k in COUNTS], failed.alias("base_failed"), (~failed & passed).alias("kept"))

    return with_fields(docs, let(_counts(F.col(text)), judged), (*COUNTS, "base_failed", "kept"))
