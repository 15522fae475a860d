"""Rules that classify a question and choose depth, lane and reader for it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Cue phrases, found anywhere in the lower-cased question.
TEMPORAL_CUES = (
    "when", "what time", "what date", "how long", "how long ago", "ago", "before", "after", "first", "earliest", "last time",
    "latest", "most recent", "recently", "prior to", "since", "until", "which came first", "in what order", "in order",
    "order from", "first to last", "came first", "happened first", "chronolog", "timeline", "duration", "between",
)
UPDATE_CUES = (
    "now", "currently", "current", "still", "anymore", "no longer", "these days", "nowadays", "changed", "change", "switch",
    "switched", "updated", "update", "moved", "new ", "latest", "as of",
)
COUNT_CUES = ("how many", "how much", "count", "number of", "list all", "list the", "all the", "total", "in total", "every", "each of")
# Words of dates, and patterns of questions for advice, for changes, about earlier replies, for a broad view.
DATE_WORD = r"^(19|20)[0-9]{2}$|^(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)(uary|ruary|ch|il|e|y|ust|tember|ober|ember)?$"
ADVICE = (
    r"(?i)\b(?:recommend\w*|suggest\w*|propose)\b|what should i|what would you (?:recommend|suggest|do)"
    r"|any (?:advice|ideas?|tips|suggestions?|recommendations?|thoughts)|do you have any (?:advice|ideas?|tips|suggestions?|recommendations?)"
    r"|(?:do you think|what do you think).{0,40}(?:good idea|should|better|worth|might|would)"
    r"|good idea to|help me (?:find|pick|choose|decide)|worth (?:it|trying|buying)"
)
CHANGES = (
    r"(?i)\bwhat(?:'s|s| has| have)?\s+chang|\bwhat\s+changed\b|\bchang(?:ed|es|ing)\s+(?:recently|lately|over\s+time)\b|\brecently\s+chang"
    r"|\bwhat(?:'s|s)?\s+new\b|\bwhat\s+(?:was|were|got|have\s+been|has\s+been)\s+updat|\bupdat(?:ed|es|ing)\s+(?:recently|lately)\b"
    r"|\bwhat\s+has\s+changed\b|\bover\s+time\b"
)
RECALL = r"(?i)\byou (?:provided|gave|created|generated|suggested|recommended|told|said|wrote|listed|shared|mentioned|helped)|our (?:previous |last |earlier )?(?:conversation|discussion|chat)|we (?:discussed|talked)"
BROAD = r"(?is)\b(?:summar\w*|recap|overview|comprehensive|walk me through|how (?:has|have) .{0,60}?(?:progress|evolv|chang|develop)|(?:progression|evolution|journey) of)\b"
# Ability labels and the class of question they stand for.
ABILITIES = {
    "temporal": "temporal", "temporal_reasoning": "temporal", "knowledge_update": "knowledge_update",
    "multi_session": "aggregation", "info_extraction": "general", "abstention": "general",
}


def has_cue(text: Column, cues: tuple[str, ...]) -> Column:
    return F.exists(F.array(*map(F.lit, cues)), lambda c: F.contains(F.lower(text), c))


def has_date(text: Column) -> Column:
    """A year or a month's name stands as a word."""
    return F.exists(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), lambda w: w.rlike(DATE_WORD))


def question_class(text: Column, ability: Column | None = None) -> Column:
    """An ability label decides; else cues of change, of time, of counting, in this order; else general."""
    hint = F.replace(F.lower(ability), F.lit("-"), F.lit("_")) if ability is not None else F.lit(None).cast("string")
    by_hint = F.try_element_at(F.create_map(*[F.lit(x) for kv in ABILITIES.items() for x in kv]), hint)
    by_text = (
        F.when(has_cue(text, UPDATE_CUES), "knowledge_update")
        .when(has_cue(text, TEMPORAL_CUES) | has_date(text), "temporal")
        .when(has_cue(text, COUNT_CUES), "aggregation")
        .otherwise("general")
    )
    return F.coalesce(by_hint, by_text)


def organization(kind: Column, ability: Column | None = None) -> Column:
    """Chronological for time and change, and for sessions named by a label; else plain."""
    labelled = (F.replace(F.lower(ability), F.lit("-"), F.lit("_")) == "multi_session") if ability is not None else F.lit(False)
    return F.when(kind.isin("temporal", "knowledge_update") | F.coalesce(labelled, F.lit(False)), "temporal").otherwise("plain")


def is_reasoning(text: Column) -> Column:
    return question_class(text).isin("temporal", "aggregation", "knowledge_update")


def reader(text: Column) -> Column:
    return F.when(text.rlike(ADVICE), "recommendation").when(is_reasoning(text), "reasoning").otherwise("dated")


def depth(text: Column, scan: float = 0.3, top_k: int = 20, deep_scan: float = 1.0, counting_k: int = 50, deep_k: int = 60) -> Column:
    """Scan fraction and depth: counting questions read more, recall and broad ones most."""
    deep = text.rlike(RECALL) | text.rlike(BROAD)
    counting = has_cue(text, COUNT_CUES)
    return F.struct(
        F.when(deep | counting, deep_scan).otherwise(scan).alias("scan"),
        F.when(deep, deep_k).when(counting, counting_k).otherwise(top_k).alias("top_k"),
    )


def is_changelog(text: Column) -> Column:
    """The question asks what has changed, not what is."""
    return F.coalesce(text, F.lit("")).rlike(CHANGES)


def search_depth(text: Column, top_k: int = 20, reasoning_k: int = 50) -> Column:
    """(search, answer): a search reads more for reasoning questions that don't ask for advice, an answer for all of them."""
    reasoning = is_reasoning(text)
    return F.struct(F.when(reasoning & ~text.rlike(ADVICE), reasoning_k).otherwise(top_k).alias("search"), F.when(reasoning, reasoning_k).otherwise(top_k).alias("answer"))


def budget(facts: Column, scan: float = 0.3, full_below: int = 500) -> Column:
    """A small store is scanned whole."""
    return F.when(facts < full_below, 1.0).otherwise(scan)


def lanes(method: Column) -> Column:
    return F.when(method == "coremem_atomic", F.array(F.lit("atomic"))).when(method == "coremem", F.array(F.lit("verbatim"))).otherwise(F.array(F.lit("verbatim"), F.lit("atomic")))


def allowed_action(action: Column, allowed: Column) -> Column:
    """An action out of turn becomes a search, or a reflection where no search is allowed."""
    return F.when(F.array_contains(allowed, action), action).when(F.array_contains(allowed, F.lit("search")), "search").otherwise("reflect")
