"""Quality rules: a threshold table compiled into one projection of length, symbol, stop-word and line ratios.

Everything is a Spark expression over the text of one row; nothing is shuffled.  Arrays that several expressions read
are bound by a one-element transform, so that each is made once a row.  Repeated windows are found by 64-bit
hashes of their words, sorted with their places.

Cases: null text is the empty text: all counts are 0 and the base fails; repeated rows get equal results; very long
texts are sorted in one row's memory, n log n; an empty table gives an empty result; other columns, whatever their names, pass by unread.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.llm.common import table, text_or_empty

SYMBOLS = "#*$%&|<>"
WHITESPACE = " \t\n\x0b\x0c\r"
#: Frequent words of four languages, in lower case as running text has them; a text of another language has none of them and
#: fails `stop_words`, so the table is for corpora of these four.
STOP_WORDS = "the of and to a in is that for it as was with be by on not this are or from at un une le la les de des et en que qui el los del se con por para una der die das und den von zu mit sich ein eine ist".split()


@dataclass(frozen=True)
class Rule:
    """A value of the row and the bounds outside of which the row is dropped."""

    value: str
    least: float | None = None
    most: float | None = None


#: The threshold table.  Ratios of an empty text are 0.
RULES = (
    Rule("mean_word_chars", 2.0, 20.0),
    Rule("symbols_per_word", None, 0.2),
    Rule("bang_words", None, 0.2),
    Rule("stop_words", 0.01, None),
    Rule("dup_lines", None, 0.3),
    Rule("upper_chars", None, 0.6),
)


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def words(text: Column) -> Column:
    """Array of the words `[^\\x20\\x09-\\x0D]+`."""
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def _covered(starts: Column, width: int) -> Column:
    """Places covered by runs of `width` from ascending starts."""
    step = lambda state, s: F.struct((state["n"] + F.least(F.lit(width), s - state["last"])).alias("n"), s.alias("last"))
    return F.aggregate(starts, F.struct(F.lit(0).cast("long").alias("n"), F.lit(-width).cast("int").alias("last")), step, lambda state: state["n"])


def repeated_words(hashes: Column, width: int = 5) -> Column:
    """Words in windows of `width` words found twice or more, the first included; hashes: of the words, in order."""

    def starts(found: Column) -> Column:
        order = F.array_sort(F.transform(found, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return bind(
            order,
            lambda o: F.array_sort(
                F.transform(
                    F.filter(
                        F.transform(o, lambda x, k: F.struct(x["i"].alias("i"), (F.coalesce(F.get(o, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(o, k + 1)["h"] == x["h"], F.lit(False))).alias("twice"))),
                        lambda x: x["twice"],
                    ),
                    lambda x: x["i"],
                )
            ),
        )

    def count(found: Column) -> Column:
        return F.when(F.size(F.array_distinct(found)) == F.size(found), F.lit(0).cast("long")).otherwise(_covered(starts(found), width))

    windows = bind(hashes, lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - width), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(width)])))
    return F.when(F.size(hashes) < width + 1, F.lit(0).cast("long")).otherwise(bind(windows, count))


def measures(documents: DataFrame) -> DataFrame:
    """(doc_id, the base counts, the values that the rules read)."""
    text = F.col("text")
    stop = F.array(*[F.xxhash64(F.lit(w)) for w in STOP_WORDS])
    base = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty("text").alias("text"))
    strip = lambda chars: (F.char_length(text) - F.char_length(F.translate(text, chars, ""))).cast("long")
    base = base.select(
        "doc_id",
        (F.char_length(text).cast("long") - strip(WHITESPACE)).alias("word_chars"),
        strip(SYMBOLS).alias("n_symbols"),
        strip("ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("n_upper"),
        bind(F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")), lambda x: F.struct(F.size(x).cast("long").alias("all"), F.size(F.array_distinct(x)).cast("long").alias("distinct"))).alias("lines"),
        bind(
            words(text),
            lambda w: bind(
                F.transform(w, lambda x: F.xxhash64(x)),
                lambda h: F.struct(
                    F.size(h).cast("long").alias("n"),
                    repeated_words(h).alias("repeat"),
                    F.size(F.filter(h, lambda x: F.array_contains(stop, x))).alias("stop"),
                    F.size(F.filter(w, lambda x: F.endswith(x, F.lit("!")))).alias("bang"),
                ),
            ),
        ).alias("w"),
    )
    n = F.col("w.n")
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    return base.select(
        "doc_id",
        n.alias("n_words"),
        "word_chars",
        "n_symbols",
        (F.col("lines.all") - F.col("lines.distinct")).alias("n_dup_lines"),
        F.col("w.repeat").alias("n_repeat_words"),
        ratio(F.col("word_chars"), n).alias("mean_word_chars"),
        ratio(F.col("n_symbols"), n).alias("symbols_per_word"),
        ratio(F.col("w.bang"), n).alias("bang_words"),
        ratio(F.col("w.stop"), n).alias("stop_words"),
        ratio(F.col("lines.all") - F.col("lines.distinct"), F.col("lines.all")).alias("dup_lines"),
        ratio(F.col("n_upper"), F.col("word_chars")).alias("upper_chars"),
    )


def verdict(rules: tuple[Rule, ...] = RULES) -> Column:
    """True where every rule holds."""
    out = F.lit(True)
    for rule in rules:
        if rule.least is not None:
            out = out & (F.col(rule.value) >= rule.least)
        if rule.most is not None:
            out = out & (F.col(rule.value) <= rule.most)
    return out


def judge(documents: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, counts, base_failed, kept): one row for each row of documents."""
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return measures(documents).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & verdict(rules)).alias("kept"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and verdicts of all documents."""
    return judge(table(spark, sf_dir, "documents"))


def oracle() -> str:
    """The same rows by exact comparison of words, windows and lines."""
    bounds = " AND ".join(x for rule in RULES for x in ([f"{rule.value} >= {rule.least}"] if rule.least is not None else []) + ([f"{rule.value} <= {rule.most}"] if rule.most is not None else []))
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
s AS (SELECT r, doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT r, unnest(range(1, len(w) - 3)) AS p, unnest(list_transform(range(1, len(w) - 3), lambda p: w[p : p + 4])) AS g FROM s WHERE len(w) >= 5),
h AS (SELECT r, unnest(range(p, p + 5)) AS q FROM (SELECT *, count(*) OVER (PARTITION BY r, g) AS n FROM g) WHERE n > 1),
k AS (SELECT r, count(DISTINCT q) AS n FROM h GROUP BY r),
m AS (SELECT doc_id, len(w) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(k.n, 0) AS n_repeat_words, len(l) AS n_lines, length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper,
  len(list_filter(w, lambda x: list_contains([{stop}], x))) AS n_stop, len(list_filter(w, lambda x: x[-1] = '!')) AS n_bang FROM s LEFT JOIN k USING (r)),
v AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, coalesce(word_chars / nullif(n_words, 0), 0) AS mean_word_chars, coalesce(n_symbols / nullif(n_words, 0), 0) AS symbols_per_word,
  coalesce(n_bang / nullif(n_words, 0), 0) AS bang_words, coalesce(n_stop / nullif(n_words, 0), 0) AS stop_words, coalesce(n_dup_lines / nullif(n_lines, 0), 0) AS dup_lines, coalesce(n_upper / nullif(word_chars, 0), 0) AS upper_chars FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {bounds} AS kept FROM v"""
