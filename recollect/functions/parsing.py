"""Reading replies of models and judges: labels, scores, JSON in prose."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from recollect.functions import text


def is_json(body: Column) -> Column:
    return F.try_parse_json(body).isNotNull()


def between(body: Column, opening: str, closing: str) -> Column:
    """From the first opening sign to the last closing one; NULL where they don't stand in this order."""
    first, last = F.instr(body, opening), F.length(body) - F.instr(F.reverse(body), closing) + 1
    return F.when((first > 0) & F.contains(body, F.lit(closing)) & (last > first), F.substr(body, first, last - first + 1))


def fenced(body: Column, inner: str) -> Column:
    """What stands in the first code fence, if it is like `inner`."""
    found = F.regexp_extract(body, r"(?is)```(?:json)?\s*" + inner + r"\s*```", 1)
    return F.when(found != "", F.trim(found))


def json_reply(reply: Column) -> Column:
    """The JSON text in a reply: a fenced one, the reply itself, or its first object or list; NULL if there is none."""
    body = F.trim(reply)
    own = F.coalesce(F.when(F.startswith(body, F.lit("```")), fenced(body, r"(\[.*\]|\{.*\})")), body)
    part = F.regexp_extract(own, r"(?s)(\{.*?\}|\[.*?\])", 1)
    return F.when(is_json(own), own).when(is_json(F.when(part != "", part)), part)


def json_list(reply: Column) -> Column:
    """The JSON list in a reply: a fenced one, the reply itself, or from the first bracket to the last; NULL if there is none."""
    body = F.trim(F.coalesce(reply, F.lit("")))
    own = F.coalesce(fenced(body, r"(.*?)"), body)
    part = between(own, "[", "]")
    a_list = lambda c: is_json(c) & F.startswith(F.trim(c), F.lit("["))
    return F.when(is_json(own), F.when(a_list(own), own)).when(a_list(part), part)


def label(reply: Column) -> Column:
    """CORRECT or WRONG from a judge: a quoted label, the label of its JSON, else the word in its text; WRONG if in doubt."""
    quoted = F.upper(F.regexp_extract(reply, r'(?i)"label"\s*:\s*"?(CORRECT|WRONG)"?', 1))
    body = between(reply, "{", "}")
    of_json = F.when(is_json(body), F.upper(F.coalesce(F.get_json_object(body, "$.label"), F.lit("WRONG"))))
    up = F.upper(reply)
    by_word = F.when(F.contains(up, F.lit("WRONG")), "WRONG").when(F.contains(up, F.lit("CORRECT")), "CORRECT").otherwise("WRONG")
    return F.when(F.coalesce(reply, F.lit("")) == "", "WRONG").when(quoted != "", quoted).otherwise(F.coalesce(of_json, by_word))


def gold_answer(category: Column, answer: Column) -> Column:
    """Category 3 counts only what stands before the first semicolon."""
    return F.when((category == 3) & F.contains(answer, F.lit(";")), F.trim(F.substring_index(answer, ";", 1))).otherwise(answer)


def judged_score(reply: Column, gold: Column, said: Column) -> Column:
    """The first number of a judge's reply, held within 0 and 1; the answers' F1 where there is none."""
    number = F.regexp_extract(reply, r"(\d+\.?\d*)", 1)
    return F.when(number != "", F.least(F.lit(1.0), number.cast("double"))).otherwise(text.token_f1(gold, said))


def says_yes(reply: Column) -> Column:
    return F.contains(F.lower(reply), F.lit("yes"))
