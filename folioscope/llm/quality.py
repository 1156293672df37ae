"""Quality rules: one table of thresholds, compiled into one projection of built-in functions.

A document is judged by ratios of its own text only, so nothing is shuffled and a text of any length is judged whole.
A rule is a row ``(name, numerator, denominator, least, most)``: the document fails if the ratio is outside its bounds.
Bounds are integer hundredths and compared by cross-multiplication, so no rounding enters a verdict.

Null text counts as empty; an empty text has no words and fails ``base``. Null in other columns does not matter, and
columns of the input that share a name with a measure are left out of it. Repeated rows are judged one by one.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from folioscope.llm.store import WHITE, WHITE_CLASS, table

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = """
the be to of and a in that have it for not on with as was by this is are or an from at which
der die und das den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei
le la les de des et un une est que qui dans en pour par sur ne pas au aux du ce il se plus avec
el los las y del una por con su para como al lo más o pero
""".split()

MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50


@dataclass(frozen=True)
class Rule:
    name: str
    part: str
    whole: str
    least: int = 0
    most: int | None = None

    def fails(self) -> Column:
        part, whole = F.col(self.part) * 100, F.col(self.whole)
        low = part < whole * self.least
        return low if self.most is None else low | (part > whole * self.most)


#: Ratios in hundredths. Mean word length 2 to 10, symbols at most 0.1 a word, stop words 6 to 60 %, repeated lines at most 30 %.
RULES = (
    Rule("word_length", "word_chars", "n_words", 200, 1000),
    Rule("symbols", "n_symbols", "n_words", 0, 10),
    Rule("stop_words", "n_stop_words", "n_words", 6, 60),
    Rule("repeated_lines", "n_dup_lines", "n_lines", 0, 30),
)
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_words")


def _repeated_words(words: Column) -> Column:
    """Words inside a 3-word window that the text holds at least twice.

    Windows are sorted by their hash, so equal ones are neighbours; each of those marks its three places.
    """
    windows = F.when(
        F.size(words) >= 3,
        F.transform(F.sequence(F.lit(0), F.size(words) - 3),
                    lambda i: F.struct(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i"))),
    )

    def covered(ordered: Column) -> Column:
        twice = F.filter(ordered, lambda x, k: (x.h == F.get(ordered, k - 1).h) | (x.h == F.get(ordered, k + 1).h))
        return F.size(F.array_distinct(F.flatten(F.transform(twice, lambda x: F.array(x.i, x.i + 1, x.i + 2)))))

    # One-element array: the lambda binds the sorted windows, which would otherwise be sorted again for every access.
    return F.coalesce(F.get(F.transform(F.array(F.sort_array(windows)), covered), F.lit(0)), F.lit(0))


def measured(docs: DataFrame, *keep: str) -> DataFrame:
    """``keep`` columns of ``docs`` and one long column per measure."""
    text = F.coalesce(F.col("text"), F.lit(""))
    marks = F.rtrim
    split = docs.select(
        *keep, text.alias("_text"),
        F.filter(F.split(text, f"[{WHITE_CLASS}]+"), lambda w: w != "").alias("_words"),
        F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(WHITE)) != "").alias("_lines"),
    )
    words, lines = F.col("_words"), F.col("_lines")
    counts = {
        "n_words": F.size(words),
        "word_chars": F.length(F.array_join(words, "")),
        "n_symbols": F.length("_text") - F.length(F.regexp_replace("_text", r"[#*$%&|<>]", "")),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_repeat_words": _repeated_words(words),
        "n_lines": F.size(lines),
        "n_stop_words": F.size(F.filter(words, lambda w: F.lower(marks(w, F.lit(".,;:"))).isin(STOP_WORDS))),
    }
    return split.select(*keep, *(c.cast("long").alias(name) for name, c in counts.items()))


def judged(docs: DataFrame, *keep: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``measured`` with ``base_failed`` and ``kept``."""
    base = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEATED_PERCENT)
    fails = reduce(lambda a, b: a | b, (r.fails() for r in rules), base)
    return measured(docs, *keep).withColumns({"base_failed": base, "kept": ~fails})


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that pass every rule, with the columns they came with.

    The verdict comes out of a one-row ``inline``: Spark moves a filter below a projection and would put every measure's
    expression, the splitting of the text with it, in the place of its name; it moves none below a generator.
    """
    names = [f"_c{i}" for i in range(len(docs.columns))]
    held = docs.select(F.col("text"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"))
    verdict = judged(held, "_row").select("_row", F.inline(F.array(F.struct(F.col("kept").alias("_kept")))))
    good = verdict.where("_kept")
    return good.select(*(F.col("_row").getField(c).alias(n) for c, n in zip(docs.columns, names))).toDF(*docs.columns)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = judged(table(spark, sf_dir, "documents"), "doc_id")
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT r, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS gram
      FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
t AS (SELECT r, i FROM g QUALIFY count(*) OVER (PARTITION BY r, gram) > 1),
p AS (SELECT r, count(DISTINCT i + k) AS n FROM t, (VALUES (0), (1), (2)) s(k) GROUP BY r),
m AS (SELECT doc_id, len(words) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
        CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
        CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(p.n, 0) AS BIGINT) AS n_repeat_words, len(lines) AS n_lines,
        len(list_filter(words, lambda x: list_contains(
          ['the','be','to','of','and','a','in','that','have','it','for','not','on','with','as','was','by','this','is','are','or','an','from','at','which',
           'der','die','und','das','den','von','zu','mit','sich','des','auf','für','ist','im','dem','nicht','ein','eine','als','auch','es','werden','aus','er','hat','dass','sie','nach','wird','bei',
           'le','la','les','de','et','un','une','est','que','qui','dans','en','pour','par','sur','ne','pas','au','aux','du','ce','il','se','plus','avec',
           'el','los','las','y','del','una','con','su','para','como','al','lo','más','o','pero'],
          lower(regexp_replace(x, '[.,;:]+$', ''))))) AS n_stop
      FROM w LEFT JOIN p USING (r)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 100 * word_chars NOT BETWEEN 200 * n_words AND 1000 * n_words OR 100 * n_symbols > 10 * n_words
       OR 100 * n_stop NOT BETWEEN 6 * n_words AND 60 * n_words OR 100 * n_dup_lines > 30 * n_lines) AS kept
FROM b
"""
