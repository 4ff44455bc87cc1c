"""Quality rules as one Spark projection: no user functions, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formwright.llm.common import named, packed_rows

SPACES = r"[\x20\x09-\x0D]+"
# Characters that count as symbols, and frequent words of four languages.
SYMBOLS = "#*$%&|<>"
STOP_WORDS = tuple(
    sorted(
        set(
            "the of and to in is was it for with as on be by at this that are from or an a not have he they we you his her "
            "le la les de des du un une et est que qui dans pour par sur au ce il elle en ne se "
            "der die das und ist nicht ein eine zu mit von dem den im auf für sich "
            "el los las y es por con para del al no su".split()
        )
    )
)
#: The table: what is measured, per what, from how many words on, and the range that a document must keep to.
THRESHOLDS: tuple[tuple[str, str | None, int, float, float], ...] = (
    ("n_words", None, 0, 1, float("inf")),
    ("word_chars", "n_words", 10, 2.5, 12.0),
    ("n_symbols", "n_words", 10, 0.0, 0.15),
    ("n_stop_words", "n_words", 30, 0.05, 1.0),
    ("n_dup_lines", "n_lines", 10, 0.0, 0.5),
)


def _windows(words: Column, width: int) -> Column:
    return F.when(F.size(words) > width, F.transform(F.sequence(F.lit(1), F.size(words) - width + 1), lambda i: F.xxhash64(F.slice(words, i, width)))).otherwise(F.array().cast("array<long>"))


def _covered(pairs: Column, starts: Column, width: int) -> Column:
    """Of ascending starts: how many places windows from there cover together."""
    gaps = F.zip_with(F.slice(starts, 1, F.size(starts) - 1), F.slice(starts, 2, F.size(starts) - 1), lambda a, b: F.least(F.lit(width), b - a))
    return F.when(F.size(starts) > 0, F.aggregate(gaps, F.lit(width), lambda s, x: s + x)).otherwise(0).cast("long")


def measures(docs: DataFrame, text: str = "text", width: int = 5) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_stop_words, n_repeat_words.

    Each step is a projection over the one before, so that a shared array is made once. Windows are told apart by a
    64-bit hash; only texts in which one occurs twice are sorted. Columns of docs with these names, or beginning with
    ``_q_``, are replaced; ``accepted`` keeps them. A null text has no words; all counts are then 0.
    """
    t = F.coalesce(F.col(named(text)).cast("string"), F.lit(""))
    one = docs.withColumns({"_q_words": F.filter(F.split(t, SPACES), lambda w: w != ""), "_q_lines": F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))})
    two = one.withColumns({"_q_hashes": _windows(F.col("_q_words"), width)})
    h = F.col("_q_hashes")
    three = two.withColumns({"_q_sorted": F.when(F.size(F.array_distinct(h)) < F.size(h), F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))).otherwise(F.array().cast("array<struct<h:long,i:int>>"))})
    s = F.col("_q_sorted")
    twice = F.zip_with(F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0))), F.slice(s, 2, F.greatest(F.size(s) - 1, F.lit(0))), lambda a, b: F.when(a.h == b.h, F.array(a.i, b.i)).otherwise(F.array().cast("array<int>")))
    four = three.withColumns({"_q_starts": F.when(F.size(s) > 0, F.sort_array(F.array_distinct(F.flatten(twice)))).otherwise(F.array().cast("array<int>"))})
    lines, words = F.col("_q_lines"), F.col("_q_words")
    counts = {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.regexp_replace(t, SPACES, "")).cast("long"),
        "n_symbols": (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_lines": F.size(lines).cast("long"),
        "n_stop_words": F.size(F.filter(words, lambda w: w.isin(*STOP_WORDS))).cast("long"),
        "n_repeat_words": _covered(s, F.col("_q_starts"), width),
    }
    own = [F.col(named(c)) for c in docs.columns if c not in counts and not c.startswith("_q_")]
    # a generator of one row: a later filter on the counts cannot be pushed below it, where it would repeat all of the above
    return four.select(*own, F.inline(F.array(F.struct(*(e.alias(n) for n, e in counts.items())))))


def verdict(table: tuple[tuple[str, str | None, int, float, float], ...] = THRESHOLDS) -> Column:
    """The table as one condition: true for a document within every range."""
    ok = F.lit(True)
    for value, per, least_words, low, high in table:
        x = F.col(value) / F.greatest(F.col(per), F.lit(1)) if per else F.col(value).cast("double")
        within = (x >= low) & (x <= high) if high != float("inf") else x >= low
        ok = ok & ((F.col("n_words") < least_words) | within)
    return ok


def judged(docs: DataFrame, text: str = "text", table: tuple[tuple[str, str | None, int, float, float], ...] = THRESHOLDS) -> DataFrame:
    """measures() with base_failed (fewer than 10 words, or over a fifth of them in repeated 5-word windows) and kept."""
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return measures(docs, text).withColumn("base_failed", base).withColumn("kept", ~F.col("base_failed") & verdict(table))


def accepted(docs: DataFrame, text: str = "text", table: tuple[tuple[str, str | None, int, float, float], ...] = THRESHOLDS) -> DataFrame:
    """The rows of docs that are kept, with their columns as they are, whatever names those have."""
    shape, _ = packed_rows(docs, F.col(named(text)).cast("string").alias("text"))
    return judged(shape, "text", table).where("kept").select("own.*")
