"""Quality rules: a threshold table compiled into one Spark projection, without user functions.

Every measure is a JVM expression over one row, so the operator is a map without a shuffle. Repeated three-word windows are
found by sorting (window hash, place) inside the row, n log n in the words of one text.

Defined cases: null text counts as the empty text (no words: base_failed, not kept); repeated rows give a row each; extra
columns, whatever their names, are ignored by :func:`report` and kept by :func:`keep`; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]"

# Frequent function words of the four languages of the corpus.
STOP_WORDS = (
    "a an and are as at be by for from in is it of on or that the this to was were with "
    "das dem den der des die ein eine einen im in ist mit nicht sich und von zu auf für auch "
    "au avec ce dans de des du elle en est et il la le les ne pas pour qui que sur un une par ou "
    "al como con de del el en es la las los no para por que se su un una lo más y"
).split()

STOP_FORMS = sorted({*STOP_WORDS, *(w.capitalize() for w in STOP_WORDS)})


@dataclass(frozen=True)
class Rule:
    """A text fails where low <= measure <= high doesn't hold."""

    measure: str
    low: float | None
    high: float | None


#: The threshold table; None: no bound on that side. An operator's user passes another table in the same form.
RULES = (
    Rule("mean_word_chars", 2.0, 12.0),
    Rule("symbol_ratio", None, 0.1),
    Rule("stop_ratio", 0.005, None),
    Rule("dup_line_ratio", None, 0.5),
    Rule("short_line_ratio", None, 0.9),
    Rule("bullet_line_ratio", None, 0.9),
)


def measures(text: Column) -> dict[str, Column]:
    """Base columns (exact integers) of a text column without nulls."""
    words = F.filter(F.split(text, f"{SPACE}+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return {"words": words, "lines": lines}


def let(value: Column, body) -> Column:  # noqa: ANN001
    """body(value) with value evaluated once: a lambda's variable is bound, an expression would be repeated for each use."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: Bits of a packed window key that hold the window's place; a text of more words goes by the exact way throughout.
PLACE_BITS = 24


def repeated(words: Column) -> Column:
    """How many words lie in three-word windows found twice or more (first included). words: a stored column.

    A text whose window hashes are distinct has none. Else packed keys (hash bits above, place below) sort as plain longs; the few windows whose hash bits occur twice are then
    compared by their words."""
    n = F.size(words)
    places = F.sequence(F.lit(0), n - 3)
    pairs = F.zip_with(words, F.slice(words, 2, n), lambda a, b: F.xxhash64(a, b))
    hashes = F.slice(F.zip_with(pairs, F.slice(words, 3, n), lambda a, b: F.xxhash64(a, b)), 1, n - 2)
    high = lambda x: F.shiftright(x, PLACE_BITS)
    keys = lambda h: F.sort_array(F.transform(h, lambda x, i: F.shiftleft(high(x), PLACE_BITS).bitwiseOR(i.cast("long"))))
    again = lambda o: F.filter(o, lambda x, k: (high(x) == high(F.get(o, k - 1))) | (high(x) == high(F.get(o, k + 1))))
    candidates = lambda h: F.transform(let(keys(h), again), lambda x: x.bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).cast("int"))
    windows = lambda at: F.sort_array(F.transform(at, lambda i: F.struct(F.get(words, i).alias("a"), F.get(words, i + 1).alias("b"), F.get(words, i + 2).alias("c"), i.alias("i"))))
    quick = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(candidates(h), lambda at: F.when(F.size(at) == 0, F.lit(0)).otherwise(let(windows(at), covered)))))
    return F.when(n < 3, F.lit(0)).when(n < (1 << PLACE_BITS), quick).otherwise(let(windows(places), covered))


def covered(ordered: Column) -> Column:
    same = lambda x, y: (x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"])
    twice = F.filter(ordered, lambda x, k: F.coalesce(same(x, F.get(ordered, k - 1)), F.lit(False)) | F.coalesce(same(x, F.get(ordered, k + 1)), F.lit(False)))
    return F.size(F.array_distinct(F.flatten(F.transform(twice, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))


def free_prefix(columns: list[str]) -> str:
    """A prefix that no column's name begins with (in any case)."""
    p = "_q_"
    while any(c.lower().startswith(p) for c in columns):
        p = "_" + p
    return p


def assess(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text", prefix: str | None = None) -> DataFrame:
    """docs with the measures and verdicts as columns named with `prefix` (by default a free one)."""
    p = prefix or free_prefix(docs.columns)
    c = lambda n: F.col(p + n)
    text = F.coalesce(F.col(text_col), F.lit(""))
    step = docs.withColumns({p + k: v for k, v in measures(text).items()})
    step = step.withColumns({
        p + "n_words": F.size(c("words")).cast("long"),
        p + "word_chars": F.length(F.array_join(c("words"), "")).cast("long"),
        p + "n_symbols": (F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]", ""))).cast("long"),
        p + "n_dup_lines": (F.size(c("lines")) - F.size(F.array_distinct(c("lines")))).cast("long"),
        p + "n_lines": F.size(c("lines")).cast("long"),
        p + "n_repeat_words": repeated(c("words")).cast("long"),
        p + "n_stop": F.size(F.filter(c("words"), lambda w: w.isin(STOP_FORMS))),
        p + "n_short_lines": F.size(F.filter(c("lines"), lambda x: F.length(x) < 15)),
        p + "n_bullets": F.size(F.filter(c("lines"), lambda x: x.rlike(r"^[ \t\n\x0B\f\r]*[-*•]"))),
    })
    per = lambda a, b: c(a) / F.greatest(c(b), F.lit(1))
    ratios = {
        "mean_word_chars": per("word_chars", "n_words"), "symbol_ratio": per("n_symbols", "n_words"), "stop_ratio": per("n_stop", "n_words"),
        "dup_line_ratio": per("n_dup_lines", "n_lines"), "short_line_ratio": per("n_short_lines", "n_lines"),
        "bullet_line_ratio": per("n_bullets", "n_lines"),
    }
    passed = F.lit(True)
    for r in rules:
        if r.low is not None:
            passed &= ratios[r.measure] >= r.low
        if r.high is not None:
            passed &= ratios[r.measure] <= r.high
    failed = (c("n_words") < 50) | (100 * c("n_repeat_words") > 50 * c("n_words"))
    return step.withColumns({p + "base_failed": failed, p + "passed": passed})


def report(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    c = lambda n: F.col("_q_" + n)
    return assess(docs.select("doc_id", "text"), rules).select(
        "doc_id", *[c(n).alias(n) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        c("base_failed").alias("base_failed"), (~c("base_failed") & c("passed")).alias("kept"),
    )


def keep(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows whose verdict is kept, with docs' own columns."""
    # a filter would be pushed below the projection and repeat its expressions; a row number in it keeps the filter above
    p = free_prefix(docs.columns)
    judged = assess(docs, rules, prefix=p).select(*docs.columns, (~F.col(p + "base_failed") & F.col(p + "passed")).alias(p + "kept"), F.monotonically_increasing_id().alias(p + "row"))
    return judged.where(F.col(p + "kept") & (F.col(p + "row") >= 0)).select(docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def sql(rules: tuple[Rule, ...] = RULES) -> str:
    """The same report in DuckDB, from the same table of thresholds."""
    per = lambda a, b: f"{a} / greatest({b}, 1)"
    ratios = {
        "mean_word_chars": per("word_chars", "n_words"), "symbol_ratio": per("n_symbols", "n_words"), "stop_ratio": per("n_stop", "n_words"),
        "dup_line_ratio": per("n_dup_lines", "n_lines"), "short_line_ratio": per("n_short", "n_lines"), "bullet_line_ratio": per("n_bullets", "n_lines"),
    }
    tests = [f"{ratios[r.measure]} >= {r.low}" for r in rules if r.low is not None] + [f"{ratios[r.measure]} <= {r.high}" for r in rules if r.high is not None]
    stops = "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in STOP_FORMS) + "]"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS ws,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS ls FROM documents),
tri AS (SELECT doc_id, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM d WHERE len(ws) >= 3)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM tri) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY doc_id),
m AS (SELECT doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines, len(list_filter(ws, lambda w: list_contains({stops}, w))) AS n_stop,
  len(list_filter(ls, lambda l: length(l) < 15)) AS n_short, len(list_filter(ls, lambda l: regexp_matches(l, '^[ \\t\\n\\x0B\\f\\r]*[-*•]'))) AS n_bullets FROM d),
f AS (SELECT m.*, coalesce(rep.n, 0) AS n_repeat_words FROM m LEFT JOIN rep USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {" AND ".join(tests)} AS kept FROM b
"""
