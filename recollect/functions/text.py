"""Row-level text functions as Column expressions: identity, entities, tokens, answers, display."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNIT = "\x1f"

# Capitalised words that are no entities.
STOP_CAPS = "who what when where why how the a an is are do does did i my you your it he she".split()
# Informal kinship words and the terms they stand for.
KIN_ALIASES = dict(
    mom="mother", mum="mother", mama="mother", mommy="mother", dad="father", papa="father", daddy="father", sis="sister",
    bro="brother", grandma="grandmother", granny="grandmother", grandpa="grandfather", hubby="husband",
)
# Relationship terms.
KIN_TERMS = (
    "mother father sister brother son daughter spouse husband wife grandmother grandfather parent sibling child colleague "
    "manager friend boss teacher doctor neighbor cousin uncle aunt nephew niece"
).split()
# Words that carry no content in turn attribution.
TURN_STOPWORDS = (
    "a an the and or but if then so of to in on at for with from by as is are was were be been being am it its this that "
    "these those i you he she we they my your his her our their me him them what which who when where how not no do does did "
    "done have has had will would can could should may might there here about into over after before all any some more most "
    "other just also very really said says told"
).split()
# Dollars per million input tokens; the first name found in a model's name counts.
PRICES = {
    "gpt-4o-mini": 0.15, "gpt-4o": 2.50, "gpt-4.1-mini": 0.40, "gpt-4.1": 2.00, "o4-mini": 1.10, "claude-haiku": 0.80,
    "claude-sonnet": 3.00, "claude-opus": 15.00, "gemini-2.0-flash": 0.10, "gemini-2.5-flash": 0.15, "gemma": 0.0,
    "ollama": 0.0, "local": 0.0,
}


def squeeze(text: Column) -> Column:
    """Trimmed, with runs of blanks as one."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def content_id(text: Column, subject: Column, day: Column, kind: Column) -> Column:
    """The identity of a fact: case- and blank-insensitive text, subject, calendar day and (unless atomic) lane."""
    body = F.concat_ws(UNIT, F.coalesce(subject, F.lit("")), F.coalesce(day, F.lit("")), squeeze(F.lower(text)))
    return F.substring(F.sha1(F.when(kind == "atomic", body).otherwise(F.concat(kind, F.lit(UNIT), body))), 1, 32)


def entities(text: Column) -> Column:
    """Sorted names and relationship terms of a text, lower-cased."""
    names = F.filter(F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), lambda w: w.rlike("^[A-Z][a-zA-Z]+$"))
    names = F.array_except(F.transform(names, F.lower), F.array(*map(F.lit, STOP_CAPS)))
    aliases = F.create_map(*[F.lit(x) for kv in KIN_ALIASES.items() for x in kv])
    kin = F.transform(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9']+"), F.lit(0)), lambda w: F.coalesce(F.try_element_at(aliases, w), w))
    return F.array_sort(F.array_union(names, F.array_intersect(kin, F.array(*map(F.lit, KIN_TERMS)))))


def tokens(text: Column) -> Column:
    """Lexical tokens: runs of a-z, 0-9 and _ in the lower-cased text."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9_]+"), F.lit(0))


def content_tokens(text: Column) -> Column:
    """Distinct tokens of more than two characters that are no stop words."""
    words = F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)), lambda w: F.length(w) > 2)
    return F.array_except(words, F.array(*map(F.lit, TURN_STOPWORDS)))


def normalized_answer(text: Column) -> Column:
    """Lower case, ASCII punctuation and articles gone, blanks squeezed."""
    bare = F.regexp_replace(F.lower(text), r"[!-/:-@\[-`{-~]", "")
    words = F.filter(F.split(bare, r"\s+"), lambda w: (w != "") & ~w.isin("a", "an", "the"))
    return F.array_join(words, " ")


def let(value: Column, body) -> Column:  # noqa: ANN001
    """body(value) with value evaluated once: a lambda's variable is bound, a repeated expression would be computed again."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def multiset_overlap(a: Column, b: Column) -> Column:
    """Size of the multiset intersection of two arrays."""
    count = lambda xs, v: F.size(F.filter(xs, lambda x: x == v))
    return F.aggregate(F.array_distinct(a), F.lit(0), lambda acc, v: acc + F.least(count(a, v), count(b, v)))


def words(text: Column) -> Column:
    return F.filter(F.split(text, " "), lambda w: w != "")


def exact_match(gold: Column, predicted: Column) -> Column:
    return F.when(normalized_answer(gold) == normalized_answer(predicted), 1.0).otherwise(0.0)


def token_f1(gold: Column, predicted: Column) -> Column:
    """Token F1 with multiset overlap; 0 without overlap."""

    def score(sides: Column) -> Column:
        g, p = sides["g"], sides["p"]
        return let(multiset_overlap(p, g), lambda n: F.when(n == 0, 0.0).otherwise(2 * (n / F.size(p)) * (n / F.size(g)) / (n / F.size(p) + n / F.size(g))))

    return let(F.struct(words(normalized_answer(gold)).alias("g"), words(normalized_answer(predicted)).alias("p")), score)


def set_f1(gold: Column, predicted: Column) -> Column:
    """Token F1 over sets of lower-cased words; 0 where either is empty."""
    g, p = F.array_distinct(words(squeeze(F.lower(gold)))), F.array_distinct(words(squeeze(F.lower(predicted))))
    both = F.size(F.array_intersect(g, p))
    precision, recall = both / F.size(p), both / F.size(g)
    return F.when((F.size(g) == 0) | (F.size(p) == 0) | (both == 0), 0.0).otherwise(2 * precision * recall / (precision + recall))


def normalized_query(text: Column) -> Column:
    return F.regexp_replace(squeeze(F.lower(text)), r"[^\p{L}\p{N}_\s@.+:-]", "")


def query_jaccard(a: Column, b: Column) -> Column:
    x, y = F.array_distinct(words(normalized_query(a))), F.array_distinct(words(normalized_query(b)))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), F.when(normalized_query(a) == normalized_query(b), 1.0).otherwise(0.0)).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))


def deduped_queries(queries: Column, threshold: float = 0.9) -> Column:
    """Greedy, order-preserving removal of near-equal queries from an array."""
    keep = lambda acc, q: F.when((q == "") | F.exists(acc, lambda k: query_jaccard(q, k) >= threshold), acc).otherwise(F.array_append(acc, q))
    return F.aggregate(F.transform(queries, squeeze), F.array().cast("array<string>"), keep)


def normalized_questions(items: Column, n: int, most: int = 160) -> Column:
    """Question texts squeezed, closed with a question mark, vague and repeated ones (by case) dropped, the first n kept."""
    tidy = F.filter(F.transform(items, squeeze), lambda q: (q != "") & (F.length(q) <= most))
    asked = F.transform(tidy, lambda q: F.when(F.endswith(q, F.lit("?")), q).otherwise(F.concat(F.regexp_replace(q, r"\.+$", ""), F.lit("?"))))
    clear = F.filter(asked, lambda q: ~F.lower(q).rlike("most important|summarize|summary of|what preferences"))
    fresh = lambda acc, q: F.when(F.exists(acc, lambda k: F.lower(k) == F.lower(q)), acc).otherwise(F.array_append(acc, q))
    return F.slice(F.aggregate(clear, F.array().cast("array<string>"), fresh), 1, n)


def estimated_tokens(*parts: Column) -> Column:
    total = sum((F.length(F.coalesce(p, F.lit(""))) for p in parts), F.lit(0))
    return F.floor(total / 4).cast("long")


def price_per_million(model: Column) -> Column:
    """NULL for an unknown model; local ones are free."""
    spec = F.lower(model)
    out = F.when(spec.contains("ollama") | spec.startswith("local:") | spec.contains(":local"), 0.0)
    for name, price in PRICES.items():
        out = out.when(spec.contains(name), price)
    return F.when(F.length(spec) > 0, out)


def cost(total_tokens: Column, model: Column) -> Column:
    return F.when(total_tokens <= 0, 0.0).otherwise(total_tokens / 1e6 * price_per_million(model))


def fixed(x: Column, digits: int) -> Column:
    """A double with so many (1 to 15) decimals, rounded to even on its exact binary value as C's printf does; Java's format
    rounds the shortest decimals half up. The product with 10**digits is kept exact as a sum of two doubles (Dekker)."""
    scale = float(10**digits)
    size = F.abs(x)
    whole = F.floor(size)
    part = size - whole.cast("double")
    halves = lambda v: (v * F.lit(134217729.0)) - (v * F.lit(134217729.0) - v)  # noqa: E731  # the upper half of its bits
    high = halves(part)
    low = part - high
    top = (scale * 134217729.0) - (scale * 134217729.0 - scale)
    product = part * F.lit(scale)
    error = ((high * F.lit(top) - product) + high * F.lit(scale - top) + low * F.lit(top)) + low * F.lit(scale - top)
    units = F.floor(product)
    over = (product - units.cast("double") - F.lit(0.5)) + error
    units = units + F.when((over > 0) | ((over == 0) & (units % 2 == 1)), 1).otherwise(0)
    carried = F.when(units == int(scale), 1).otherwise(0)
    text = F.concat(F.when(x < 0, "-").otherwise(""), (whole + carried).cast("string"), F.lit("."), F.lpad((units % int(scale)).cast("string"), digits, "0"))
    return F.when(size < float(1 << 62), text).otherwise(F.format_string(f"%.{digits}f", x))  # beyond a long, and not a number


def cost_text(usd: Column) -> Column:
    digits = lambda k: F.concat(F.lit("$"), fixed(usd, k))
    return F.when(usd.isNull(), "cost n/a").when(usd == 0, "$0").when(usd < 0.01, digits(4)).when(usd < 1, digits(3)).otherwise(digits(2))


def window_fraction(used: Column, window: int = 128_000) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), used / F.lit(float(window))))


def short_hash(text: Column, digits: int) -> Column:
    return F.substring(F.sha1(text), 1, digits)


def without_marker(text: Column) -> Column:
    """Without a closing pair marker such as ``->-> 3,2``."""
    return F.regexp_replace(text, r"\s*->->\s*[\d,\s]*$", "")


def namespace(owner: Column, prefix: str = "mem", most: int = 48) -> Column:
    clean = F.substring(F.regexp_replace(owner, "[^A-Za-z0-9_-]+", "-"), 1, most)
    return F.concat(F.lit(prefix + "-"), F.when(F.length(clean) > 0, clean).otherwise("default"))


def abstain_text(answer: Column, said: str = "I don't know.") -> Column:
    return F.when(F.upper(F.trim(answer)).isin("N/I", "N/I."), said).otherwise(answer)


def parsed_answer(text: Column) -> Column:
    return F.trim(F.substring_index(text, "Answer:", -1))


def split_evidence(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.split(text, "[;,]"), lambda x: F.trim(x)), lambda x: x != "")))


def glob(column: Column, pattern: str) -> Column:
    """Shell-style match with * and ?."""
    plain = "".join({"*": ".*", "?": "."}.get(c, c if c.isalnum() or c == "_" else "\\" + c) for c in pattern)
    return column.rlike(f"(?s)^{plain}$")
