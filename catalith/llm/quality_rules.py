"""Quality rules: a threshold table compiled into one projection of built-in expressions.

Every rule is a row (measure, least, most).  ``compile_rules`` turns the table
into one boolean column; the measures are length, symbol, stop-word and line
figures made by built-in array and string functions only, so that nothing
leaves the JVM and no shuffle is needed: the operator is one narrow stage over
the scan, whatever the sizes of sources, copies or documents.

Defined results: a null or empty text has no words and fails the length rule;
repeated rows each get their own result; an empty table gives an empty table;
other columns pass through, and a column already named like the output is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, WORD_CLASS, whole

#: Frequent function words of English, French, German and Spanish (fixed values).
STOP_WORDS = (
    "the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "as", "was", "with", "be", "by", "on", "this", "are", "or", "at", "from",
    "de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "par", "sur", "avec",
    "der", "die", "und", "den", "von", "zu", "das", "mit", "sich", "auf", "ist", "im", "dem", "nicht", "ein", "eine", "für",
    "el", "los", "y", "las", "del", "se", "por", "con", "no", "su", "para", "lo", "como",
)

#: Each as written, capitalised and in capitals; matching forms is far cheaper than lower-casing every word.
STOP_FORMS = tuple(sorted({f for w in STOP_WORDS for f in (w, w.capitalize(), w.upper())}))

#: Characters that count as symbols (fixed values).
SYMBOL_CLASS = r"[#*$%&|<>]"


@dataclass(frozen=True)
class Rule:
    """A text passes if ``least <= measure <= most``; None leaves a side open."""

    measure: str
    least: float | None = None
    most: float | None = None


#: The base rules: at least fifty words, at most half of them in repeated three-word windows.
BASE_RULES = (Rule("n_words", least=50), Rule("repeat_ratio", most=0.5))

#: The rules beside the base.
RULES = (
    Rule("mean_word_length", least=2.0, most=14.0),
    Rule("symbol_ratio", most=0.15),
    Rule("stop_ratio", least=0.06),
    Rule("dup_line_ratio", most=0.5),
)

def _free(docs: DataFrame) -> str:
    """A beginning that no column of ``docs`` has."""
    start = "__quality_"
    while any(c.lower().startswith(start) for c in docs.columns):
        start = f"_{start}"
    return start


def measures(docs: DataFrame, text: str = "text", out: str = "quality") -> DataFrame:
    """``docs`` with a struct column ``out`` of all measures.

    Counts are long, ratios double; ratios of an empty text are 0.
    """
    p = _free(docs)
    c = lambda name: F.col(p + name)
    n = c("n")
    # Each step stands on columns of the step before, which the optimizer keeps apart where they are used more than once.
    step = docs.withColumn(p + "t", whole(F.col(text)))
    step = step.withColumns({
        p + "w": F.array_remove(F.split(c("t"), SPACE_CLASS + "+"), ""),
        p + "l": F.filter(F.split(c("t"), "\n"), lambda x: x.rlike(WORD_CLASS)),
        p + "symbols": F.regexp_count(c("t"), F.lit(SYMBOL_CLASS)).cast("long"),
    })
    step = step.withColumns({
        p + "n": F.size(c("w")),
        p + "chars": F.length(F.array_join(c("w"), "")).cast("long"),
        p + "stops": F.size(F.filter(c("w"), lambda x: x.isin(*STOP_FORMS))),
        p + "lines": F.size(c("l")).cast("long"),
        p + "dups": (F.size(c("l")) - F.size(F.array_distinct(c("l")))).cast("long"),
    })
    # Repeated windows: a hash of each window tells texts without repeats (most) from the rest; there, equal hashes give
    # candidate positions, and equal words decide.
    hashed = lambda x, i: F.xxhash64(x, F.get(c("w"), i + 1), F.get(c("w"), i + 2))
    step = step.withColumn(p + "h", F.transform(F.slice(c("w"), 1, F.greatest(n - 2, F.lit(0))), hashed))
    step = step.withColumn(p + "h", F.when(F.size(F.array_distinct(c("h"))) < F.size(c("h")), c("h")).otherwise(F.array().cast("array<bigint>")))
    step = step.withColumn(p + "s", F.sort_array(F.transform(c("h"), lambda x, i: F.struct(x.alias("k"), i.alias("i")))))
    step = step.withColumn(p + "s", F.filter(c("s"), _twin(c("s"))))
    words = lambda x: F.concat_ws(" ", *(F.get(c("w"), x["i"] + k) for k in range(3)))
    step = step.withColumn(p + "s", F.sort_array(F.transform(c("s"), lambda x: F.struct(words(x).alias("k"), x["i"].alias("i")))))
    covered = F.flatten(F.transform(F.filter(c("s"), _twin(c("s"))), lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))
    step = step.withColumn(p + "repeat", F.size(F.array_distinct(covered)).cast("long"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    result = F.struct(
        n.cast("long").alias("n_words"), c("chars").alias("word_chars"), c("symbols").alias("n_symbols"), c("lines").alias("n_lines"),
        c("dups").alias("n_dup_lines"), c("repeat").alias("n_repeat_words"), c("stops").cast("long").alias("n_stop_words"),
        ratio(c("chars"), n).alias("mean_word_length"), ratio(c("symbols"), n).alias("symbol_ratio"), ratio(c("stops"), n).alias("stop_ratio"),
        ratio(c("dups"), c("lines")).alias("dup_line_ratio"), ratio(c("repeat"), n).alias("repeat_ratio"),
    )
    # Generated, so that a filter on the verdict is not pushed below and does not repeat the work of every step.
    step = step.select("*", F.explode(F.array(result)).alias(p + "result"))
    return step.withColumn(out, F.col(p + "result")).drop(p + "result", *(p + x for x in "t w l symbols n chars stops lines dups h s repeat".split()))


def _twin(ordered: Column):
    """For ``filter`` over a sorted array of (k, i): whether a neighbour has the same k."""
    at = lambda j: F.get(ordered, j)["k"]
    return lambda x, j: F.coalesce(x["k"] == at(j - 1), F.lit(False)) | F.coalesce(x["k"] == at(j + 1), F.lit(False))


def compile_rules(rules: tuple[Rule, ...], measured: Column) -> Column:
    """One boolean column: true where every rule holds."""
    passed = F.lit(True)
    for r in rules:
        if r.least is not None:
            passed = passed & (measured[r.measure] >= F.lit(r.least))
        if r.most is not None:
            passed = passed & (measured[r.measure] <= F.lit(r.most))
    return passed


def judge(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, base: tuple[Rule, ...] = BASE_RULES, out: str = "quality") -> DataFrame:
    """``docs`` with ``out``: the measures, ``base_failed`` and ``kept``."""
    found = measures(docs, text, out)
    q = F.col(out)
    failed = ~compile_rules(base, q)
    return found.withColumn(out, q.withField("base_failed", failed).withField("kept", ~failed & compile_rules(rules, q)))


def keep(docs: DataFrame, text: str = "text", **rules) -> DataFrame:
    """The rows of ``docs`` that pass, with their columns unchanged."""
    out = f"{_free(docs)}verdict"
    return judge(docs, text, out=out, **rules).where(F.col(out)["kept"]).drop(out)
