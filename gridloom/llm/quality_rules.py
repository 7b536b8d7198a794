"""Quality rules: a threshold table compiled into one projection of JVM expressions, with no user function and no shuffle.

Defined results: null and empty texts have no words and fail the base rule; a denominator of 0 makes a ratio 0; repeated rows
are judged alike, each on its own; a text of any length is judged whole; an empty table stays empty; other columns are left alone (statistics
travel in one struct), but one that has the name of the result is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.schema import fresh

# Fixed values of the result contract.
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
NOT_SYMBOL = r"[^#*$%&|<>]+"

#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to in is it that for was on are as with be by this from or an at not which have "
    "le la les de des du et un une est que qui dans pour par sur au en ne pas il elle avec "
    "der die das und ist von zu mit den ein eine für auf im nicht sich dem des auch es "
    "el los las que y en por para con del una se no su al lo como más"
).split()


@dataclass(frozen=True)
class Rule:
    """least <= top / bottom <= most; top and bottom name statistics."""

    name: str
    top: str
    bottom: str
    least: float
    most: float


#: Production thresholds. They are wide: a rule rejects what no prose reaches.
RULES = (
    Rule("mean_word_length", "word_chars", "n_words", 2.0, 14.0),
    Rule("symbols_per_word", "n_symbols", "n_words", 0.0, 0.5),
    Rule("stop_words", "n_stop", "n_words", 0.02, 1.0),
    Rule("repeated_lines", "n_dup_lines", "n_lines", 0.0, 0.5),
)


def _bind(value: Column, use) -> Column:
    """use(value) with value evaluated once a row: a lambda variable, not a copy of the expression."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _repeated(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more."""
    n = F.size(words)
    windows = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(words[i], words[i + 1], words[i + 2]))

    def covered(keys: Column) -> Column:
        rows = F.sort_array(F.transform(keys, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))

        def places(s: Column) -> Column:
            m = F.size(s)
            near = F.filter(s, lambda e, i: ((i > 0) & (s[F.greatest(i - 1, F.lit(0))]["x"] == e["x"])) | ((i < m - 1) & (s[F.least(i + 1, m - 1)]["x"] == e["x"])))
            return F.sort_array(F.transform(near, lambda e: e["i"]))

        zero = F.struct(F.lit(-3).alias("at"), F.lit(0).cast("long").alias("sum"))
        step = lambda a, p: F.struct(p.alias("at"), (a["sum"] + F.least(F.lit(3), p - a["at"])).cast("long").alias("sum"))
        return F.aggregate(_bind(rows, places), zero, step, lambda a: a["sum"])

    some = lambda keys: F.when(F.size(F.array_distinct(keys)) == F.size(keys), F.lit(0).cast("long")).otherwise(covered(keys))
    return F.when(n < 4, F.lit(0).cast("long")).otherwise(_bind(windows, some))


def statistics(text: Column) -> Column:
    """All counts of one text as a struct; each word list and line list is made once."""
    text = F.coalesce(text, F.lit(""))

    def of_words(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.size(F.filter(w, lambda x: F.lower(x).isin(STOP_WORDS))).cast("long").alias("n_stop"),
            _repeated(w).alias("n_repeat_words"),
        )

    def of_lines(x: Column) -> Column:
        return F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))

    words = F.filter(F.split(text, SPACES), lambda x: x != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    return F.struct(
        _bind(words, of_words).alias("w"),
        _bind(lines, of_lines).alias("l"),
        F.length(F.regexp_replace(text, NOT_SYMBOL, "")).cast("long").alias("n_symbols"),
    )


def compile_rules(rules: tuple[Rule, ...], stat) -> Column:
    """One boolean expression: true where every rule holds. stat(name) gives a statistic's column."""
    verdict = F.lit(True)
    for r in rules:
        top, bottom = stat(r.top).cast("double"), stat(r.bottom).cast("double")
        ratio = F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))
        verdict = verdict & (ratio >= r.least) & (ratio <= r.most)
    return verdict


def quality_rules(df: DataFrame, text_col: str = "text", out: str = "quality_rules", rules: tuple[Rule, ...] = RULES, least_words: int = 50, most_repeated: int = 50) -> DataFrame:
    """df with a struct column `out`: every statistic, base_failed and kept. A column of df that is called `out` already is replaced."""
    raw = fresh(df, f"{out}__raw")
    s = df.withColumn(raw, statistics(F.col(f"`{text_col}`")))
    names = {"n_words": "w.n_words", "word_chars": "w.word_chars", "n_symbols": "n_symbols", "n_dup_lines": "l.n_dup_lines", "n_lines": "l.n_lines", "n_stop": "w.n_stop", "n_repeat_words": "w.n_repeat_words"}
    stat = lambda k: F.col(f"{raw}.{names[k]}")
    failed = (stat("n_words") < least_words) | (100 * stat("n_repeat_words") > most_repeated * stat("n_words"))
    done = F.struct(*(stat(k).alias(k) for k in names), failed.alias("base_failed"), (~failed & compile_rules(rules, stat)).alias("kept"))
    return s.withColumn(out, done).drop(raw)
