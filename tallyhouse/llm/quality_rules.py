"""Quality rules: a table of thresholds compiled into one projection over whole texts.

Every metric is a built-in expression of the text; the table RULES states which interval each
metric has to lie in. No user function runs and nothing is shuffled: a row's verdict depends on
its own text alone.

Cases: a null text is an empty text (all counts 0); a text with fewer than `MIN_WORDS` words fails
the base; ratios over no words or no lines are 0; repeated rows give repeated results; an empty
table gives an empty table; other columns pass through, except that columns named like a metric
are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm.common import bound, free_name, own, words, BLANK

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = "[#*$%&|<>]"

#: fixed values: frequent function words of English, German, French and Spanish
STOP_WORDS = (
    "the", "of", "and", "to", "a", "in", "is", "it", "that", "was", "for", "on", "are", "as", "with", "be", "this",
    "der", "die", "das", "und", "ist", "nicht", "mit", "ein", "eine", "zu", "von", "den", "auf", "für", "im", "sich",
    "le", "la", "les", "de", "des", "du", "et", "un", "une", "en", "que", "qui", "dans", "pour", "par", "pas", "est",
    "el", "los", "las", "y", "se", "del", "al", "por", "con", "para", "es", "su", "lo", "como", "no",
)


@dataclass(frozen=True)
class Rule:
    """`metric` must lie within [least, most]; an open end is None."""

    metric: str
    least: float | None = None
    most: float | None = None

    def failed(self, value: Column) -> Column:
        below = value < self.least if self.least is not None else F.lit(False)
        above = value > self.most if self.most is not None else F.lit(False)
        return below | above


#: the production thresholds
RULES = (
    Rule("n_words", least=MIN_WORDS),
    Rule("mean_word_chars", least=2, most=12),
    Rule("symbol_word_ratio", most=0.15),
    Rule("bang_word_ratio", most=0.3),
    Rule("stop_word_ratio", least=0.05),
    Rule("dup_line_ratio", most=0.4),
    Rule("ellipsis_line_ratio", most=0.3),
    Rule("bullet_line_ratio", most=0.9),
)


def _repeat_words(found: Column) -> Column:
    """Number of positions covered by 3-word windows that occur at least twice.

    Windows are sorted by their hash, so that equal ones are neighbours; each of those covers three positions.
    """
    windows = F.sort_array(F.transform(
        F.sequence(F.lit(0), F.size(found) - 3),
        lambda i: F.struct(F.xxhash64(F.get(found, i), F.get(found, i + 1), F.get(found, i + 2)).alias("h"), i.alias("i")),
    ))

    def covered(sorted_windows: Column) -> Column:
        def same(w: Column, k: Column) -> Column:
            return F.coalesce(w["h"] == F.get(sorted_windows, k)["h"], F.lit(False))

        again = F.filter(sorted_windows, lambda w, k: same(w, k - 1) | same(w, k + 1))
        return F.size(F.array_distinct(F.flatten(F.transform(again, lambda w: F.array(w["i"], w["i"] + 1, w["i"] + 2)))))

    return F.when(F.size(found) >= 4, bound(windows, covered)).otherwise(F.lit(0))


def _counts(text: Column) -> Column:
    """All counts of one text as a struct."""
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(f"[^{BLANK}]"))

    def of(found: Column, lined: Column) -> Column:
        counts = {
            "n_words": F.size(found),
            "word_chars": F.char_length(F.array_join(found, "")),
            "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)),
            "n_dup_lines": F.size(lined) - F.size(F.array_distinct(lined)),
            "n_repeat_words": _repeat_words(found),
            "n_lines": F.size(lined),
            "bangs": F.regexp_count(text, F.lit("!")),
            "stops": F.size(F.filter(found, lambda w: F.lower(w).isin(*STOP_WORDS))),
            "ellipses": F.size(F.filter(lined, lambda line: line.rlike(rf"(\.\.\.|…)[{BLANK}]*$"))),
            "bullets": F.size(F.filter(lined, lambda line: line.rlike(rf"^[{BLANK}]*[-*•]"))),
        }
        return F.struct(*[value.cast("long").alias(name) for name, value in counts.items()])

    return bound(words(text), lambda found: bound(lines, lambda lined: of(found, lined)))


#: metric -> (part, whole)
RATIOS = {
    "mean_word_chars": ("word_chars", "n_words"),
    "symbol_word_ratio": ("n_symbols", "n_words"),
    "bang_word_ratio": ("bangs", "n_words"),
    "stop_word_ratio": ("stops", "n_words"),
    "dup_line_ratio": ("n_dup_lines", "n_lines"),
    "ellipsis_line_ratio": ("ellipses", "n_lines"),
    "bullet_line_ratio": ("bullets", "n_lines"),
}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def _verdict(text: Column, rules: tuple[Rule, ...]) -> Column:
    """Every metric and verdict of one text as one expression, which no later step can take apart and repeat."""
    def of(count: Column) -> Column:
        values = {name: count[name] for name in COUNTS} | {
            name: F.when(count[whole] > 0, count[part] / count[whole]).otherwise(F.lit(0.0))
            for name, (part, whole) in RATIOS.items()}
        base = (count["n_words"] < MIN_WORDS) | (100 * count["n_repeat_words"] > MAX_REPEAT_PERCENT * count["n_words"])
        failed = F.array_compact(F.array(*[F.when(rule.failed(values[rule.metric]), F.lit(rule.metric)) for rule in rules]))
        verdicts = {"base_failed": base, "failed_rules": failed, "kept": ~base & (F.size(failed) == 0)}
        return F.struct(*[value.alias(name) for name, value in (values | verdicts).items()])

    return bound(_counts(F.coalesce(text, F.lit(""))), of)


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """The input columns plus every metric, `base_failed`, `failed_rules` and `kept`."""
    metrics = (*COUNTS, *RATIOS, "base_failed", "failed_rules", "kept")
    kept = [own(docs, c) for c in docs.columns if c.lower() not in metrics]
    verdict = free_name(docs, "_quality_verdict")
    judged = docs.select(*kept, _verdict(own(docs, text), rules).alias(verdict))
    return judged.select(*[own(judged, c) for c in judged.columns[:-1]], *[F.col(verdict)[name].alias(name) for name in metrics])


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents that pass, with exactly the columns they came with."""
    return docs.filter(_verdict(docs["text"], rules)["kept"])
