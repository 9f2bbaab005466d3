"""Quality rules: a table of thresholds compiled into one Spark projection.

Words are runs of anything but ASCII white space. Every measure is a built-in expression
over the words and lines of the whole text, so the rules run inside the scan without user
functions and without a shuffle.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"

#: Frequent function words of four languages. They count in lower, upper
#: and title case.
STOP_WORDS = """
the of and to in a is that it for on was as with be by this are at from or an have not
der die das und ist in zu den mit auf ein eine einer dem von sich auch
le la les de des et en un une est que dans pour sur du au
el los las de y en un una es que con por del se al
""".split()

STOP_SPELLINGS = sorted({f(w) for w in STOP_WORDS for f in (str.lower, str.capitalize, str.upper)})


@dataclass(frozen=True)
class Rule:
    """A document fails where the measure is below ``least`` or above ``most``.

    ``per`` divides the measure by another one; a division by zero fails no rule.
    """

    name: str
    measure: str
    least: float | None = None
    most: float | None = None
    per: str | None = None

    def fails(self) -> Column:
        # Products instead of quotients: whole numbers stay exact.
        value, unit = F.col(self.measure), F.col(self.per) if self.per else F.lit(1)
        wrong = F.lit(False)
        if self.least is not None:
            wrong = wrong | (value < unit * F.lit(self.least))
        if self.most is not None:
            wrong = wrong | (value > unit * F.lit(self.most))
        return wrong & (unit > 0) if self.per else wrong


#: The base: long enough, and at most half of the words in repeated three-word windows.
BASE = (
    Rule("few_words", "n_words", least=50),
    Rule("repeated_words", "n_repeat_words", most=0.5, per="n_words"),
)

RULES = (
    *BASE,
    Rule("short_words", "word_chars", least=2, per="n_words"),
    Rule("long_words", "word_chars", most=20, per="n_words"),
    Rule("many_symbols", "n_symbols", most=0.5, per="n_words"),
    Rule("repeated_lines", "n_dup_lines", most=0.5, per="n_lines"),
    Rule("no_stop_words", "n_stop_words", least=0.01, per="n_words"),
)


def repeated_window_words(windows: Column, n_windows: Column) -> Column:
    """Words in windows of three that occur twice or more; ``windows`` are their hashes.

    Sorting (hash, start) brings equal windows together; the starts of repeated ones, in
    text order, each cover up to three words that the start before does not.
    """
    by_hash = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    # Each window as (hash, start, equal to the one before) in one pass over sorted rows.
    nothing = F.struct(F.lit(None).cast("long").alias("h"), F.lit(None).cast("int").alias("i"))
    earlier = F.concat(F.array(nothing), by_hash)
    later = F.slice(by_hash, 2, n_windows)
    marked = F.zip_with(
        F.zip_with(by_hash, earlier, lambda x, y: F.struct(x.alias("x"), F.coalesce(x["h"] == y["h"], F.lit(False)).alias("r"))),
        later,
        lambda x, y: F.when(x["r"] | F.coalesce(x["x"]["h"] == y["h"], F.lit(False)), x["x"]["i"]),
    )
    starts = F.array_sort(F.array_compact(marked))
    return F.aggregate(
        starts,
        F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda s, i: F.struct(i.alias("last"), (s["n"] + F.least(F.lit(3), i - s["last"])).alias("n")),
        lambda s: s["n"],
    )


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the measures; columns of these names are replaced. Null text: empty."""
    whole = F.coalesce(F.col(text), F.lit(""))
    words = F.filter(F.split(whole, SPACE), lambda w: w != "")
    lines = F.filter(F.split(whole, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    own = [c for c in docs.columns if c not in MEASURES]
    step = docs.select(*own, words.alias("_words"), lines.alias("_lines"))
    n = F.size("_words")
    pairs = F.zip_with("_words", F.slice("_words", 2, F.greatest(n, F.lit(1))), lambda a, b: F.xxhash64(a, b))
    triples = F.zip_with(pairs, F.slice("_words", 3, F.greatest(n, F.lit(1))), lambda a, b: F.xxhash64(a, b))
    step = step.select(
        *own,
        n.cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.regexp_count(whole, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("_words", lambda w: w.isin(STOP_SPELLINGS))).cast("long").alias("n_stop_words"),
        F.slice(triples, 1, F.greatest(n - 2, F.lit(0))).alias("_windows"),
    )
    n_windows = F.size("_windows")
    repeated = F.when(
        F.size(F.array_distinct("_windows")) < n_windows,
        repeated_window_words(F.col("_windows"), F.greatest(n_windows, F.lit(1))),
    ).otherwise(F.lit(0).cast("long"))
    return step.withColumn("n_repeat_words", repeated).drop("_windows")


MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_stop_words", "n_repeat_words",
)


def quality_rules(docs: DataFrame, rules: tuple = RULES, text: str = "text") -> DataFrame:
    """``docs`` with measures, ``base_failed``, ``failed`` (names of rules) and ``kept``.

    Null and empty texts have no words and fail the rule on length. Rows are judged one by
    one: repeated rows, ties and null ids change nothing. Columns that already have the
    name of a result are replaced.
    """
    results = ("base_failed", "failed", "kept")
    step = measure(docs.drop(*results), text)
    base = F.lit(False)
    for rule in BASE:
        base = base | rule.fails()
    failed = F.array_compact(F.array(*(F.when(r.fails(), F.lit(r.name)) for r in rules)))
    return step.withColumns({"base_failed": base, "failed": failed}).withColumn(
        "kept", ~F.col("base_failed") & (F.size("failed") == 0)
    )


def passing(docs: DataFrame, rules: tuple = RULES, text: str = "text") -> DataFrame:
    """Rows of ``docs`` that pass all rules, with their own columns."""
    rows = docs.select(F.struct("*").alias("_row"), F.col(text).alias("_text"))
    # The row number keeps the filter above the measures: below, each rule would measure anew.
    once = measure(rows, "_text").withColumn("_at", F.monotonically_increasing_id())
    fails = F.lit(False)
    for rule in rules:
        fails = fails | rule.fails()
    return once.filter(~fails & (F.col("_at") >= 0)).select("_row.*")
