"""A memory over a folder of fact tables: add, search as of a date, delete, forget, with receipts.

Each change writes a new version folder; a reader takes the latest one that is complete, so an unfinished write is never seen.
One writer at a time: of two that start from one version, the second fails, as its folder is there. `add` rewrites the bank,
which suits the small interactive store that this is; `streaming.ingest` appends. Encoder and reader are functions that a user
may replace; the defaults are deterministic."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.functions import dates, routing, text
from recollect.operators import lexical, mutations, validity
from recollect.plans.base import first_of_each

SCHEMA = (
    "fact_id string, pos long, kind string, text string, ts timestamp_ntz, subject string, entities array<string>, time_bucket string, "
    "doc_id string, source_session string, source_ref string, source_speaker string, superseded_by string, valid_to timestamp_ntz"
)


@dataclass
class Receipt:
    """What a search read and why."""

    query_class: str
    scanned: int
    returned: int
    as_of: str | None
    tokens: int
    buckets: list[str] = field(default_factory=list)


def as_sessions(content) -> list[list[tuple[str, str]]]:  # noqa: ANN001
    """Sessions of (role, text) turns from a text, a message, a list of messages or a list of such lists. A message is a pair
    or has `role` (by default the user's) and `content`."""
    if content is None or content == "":
        return []
    if isinstance(content, str):
        return [[("user", content.strip())]] if content.strip() else []
    if isinstance(content, dict):
        said = (content.get("content") or "").strip()
        return [[(content.get("role", "user"), said)]] if said else []
    if isinstance(content[0], list):
        return [turns for session in content for turns in as_sessions(session)]
    return [[(m.get("role", "user"), m.get("content") or "") if isinstance(m, dict) else tuple(m) for m in content]]


def retried(call, attempts: int = 6, first: float = 1.0, most: float = 30.0, sleep=None):  # noqa: ANN001, ANN201
    """call()'s result; after an error again, up to `attempts` times, with waits that double up to `most` seconds and vary."""
    import random
    import time

    for n in range(attempts):
        try:
            return call()
        except Exception:
            if n == attempts - 1:
                raise
            (sleep or time.sleep)(min(most, first * 2**n) * random.uniform(0.5, 1.0))


def hashing_encoder(rows: DataFrame) -> DataFrame:
    """(fact_id, vector) from (fact_id, text): signed hashing of tokens and of the sides of life they touch."""
    from recollect.operators import vectors

    return vectors.dense(vectors.hashed(rows, ["fact_id"], validity.aspect_tokens(text.tokens(F.col("text")))), ["fact_id"])


class Memory:
    """encoder: (fact_id, text) rows to (fact_id, vector) rows. A new fact closes the most similar older one of its subject at
    `threshold`; under `sure` they must share an entity or both be of a kind that changes. The default threshold suits the
    default encoder."""

    def __init__(self, spark: SparkSession, folder: str, encoder=hashing_encoder, threshold: float = 0.4, sure: float = 0.88) -> None:  # noqa: ANN001
        self.spark, self.folder = spark, folder.rstrip("/")
        self.encoder, self.threshold, self.sure = encoder, threshold, sure

    def _fs(self):  # noqa: ANN202
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def version(self) -> int:
        fs, path = self._fs()
        if not fs.exists(path):
            return 0
        done = [s.getPath().getName() for s in fs.listStatus(path) if fs.exists(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
        return max([int(n.removeprefix("v")) for n in done if n.startswith("v")], default=0)

    def facts(self) -> DataFrame:
        v = self.version()
        return self.spark.read.schema(SCHEMA).parquet(f"{self.folder}/v{v}") if v else self.spark.createDataFrame([], SCHEMA)

    def _write(self, rows: DataFrame) -> None:
        rows.write.parquet(f"{self.folder}/v{self.version() + 1}")

    def clear(self) -> None:
        """All facts go; earlier versions stay readable in the folder until it is dropped."""
        self._write(self.facts().limit(0))

    def get(self, fact_id: str) -> dict | None:
        row = self.facts().where(F.col("fact_id") == fact_id).head()
        return row.asDict() if row else None

    def set_valid_to(self, fact_id: str, until: str | None) -> bool:
        """Override a fact's end; False where there is no such fact."""
        bank = self.facts()
        if bank.where(F.col("fact_id") == fact_id).isEmpty():
            return False
        when = dates.parsed(F.lit(until)) if until else F.lit(None).cast("timestamp_ntz")
        self._write(mutations.valid_until(bank, self.spark.createDataFrame([(fact_id,)], "fact_id string").withColumn("until", when)))
        return True

    def documents(self) -> DataFrame:
        """(doc_id, sessions, facts): the documents that facts come from."""
        return self.facts().groupBy("doc_id").agg(F.countDistinct("source_session").alias("sessions"), F.count("*").alias("facts"))

    def add_all(self, content, day: str | None = None, subject: str = "", doc_id: str = "") -> int:  # noqa: ANN001
        """add() for whatever as_sessions() reads."""
        return sum(self.add(turns, day, subject, doc_id) for turns in as_sessions(content))

    def add(self, turns: list[tuple[str, str]], day: str | None = None, subject: str = "", doc_id: str = "") -> int:
        """Store a session of (role, text) turns; returns how many facts are new. New facts close older ones that they
        replace (validity.supersessions)."""
        bank = self.facts()
        at = bank.agg(F.coalesce(F.max("pos"), F.lit(-1))).head()[0] + 1
        session = f"session:{at}"
        rows = self.spark.createDataFrame([(at + n, role, body) for n, (role, body) in enumerate(turns) if body.strip()], "pos long, role string, text string")
        when = dates.parsed(F.lit(day)) if day else F.lit(None).cast("timestamp_ntz")
        new = rows.select(
            text.content_id(F.col("text"), F.lit(subject), F.coalesce(F.date_format(when, "yyyy-MM-dd"), F.lit("")), F.lit("verbatim")).alias("fact_id"), "pos", F.lit("verbatim").alias("kind"),
            F.trim("text").alias("text"), when.alias("ts"), F.lit(subject).alias("subject"), text.entities(F.col("text")).alias("entities"), dates.month_bucket(when).alias("time_bucket"),
            F.lit(doc_id).alias("doc_id"), F.lit(session).alias("source_session"), F.concat(F.lit(session + "/turn:"), F.col("pos") - at).alias("source_ref"), F.col("role").alias("source_speaker"),
            F.lit("").alias("superseded_by"), F.lit(None).cast("timestamp_ntz").alias("valid_to"),
        )
        fresh = first_of_each(mutations.upserted(bank, new))
        n = fresh.count()
        if n:
            self._write(self._linked(bank, fresh).unionByName(fresh))
        return n

    def _linked(self, bank: DataFrame, fresh: DataFrame) -> DataFrame:
        changing = F.col("text").rlike(validity.CHANGING)

        def side(rows: DataFrame) -> DataFrame:
            coded = self.encoder(rows.select("fact_id", "text")).select("fact_id", F.col("vector").alias("unit"))
            return rows.join(coded, "fact_id").select("fact_id", "pos", "ts", "unit", F.col("entities").alias("tags"), changing.alias("changing"), F.col("subject").alias("bucket"))

        pairs = validity.supersessions(side(fresh.where("source_speaker = 'user'")), side(bank.where("superseded_by = '' and source_speaker = 'user'")), self.threshold, self.sure)
        return mutations.superseded(bank, pairs)

    def search(self, question: str, as_of: str | None = None, top_k: int = 10, history: bool = False) -> DataFrame:
        """Facts active at a date, by BM25, in order of time."""
        when = dates.parsed(F.lit(as_of)) if as_of else F.lit(None).cast("timestamp_ntz")
        live = self.facts().where(validity.active(when, F.col("ts"), F.col("superseded_by"), F.col("valid_to"), history))
        asked = self.spark.createDataFrame([(0, question)], "query_id int, body string")
        hits = lexical.bm25(live.select(F.col("pos").alias("id"), F.col("text").alias("body")), asked, top_k, positive=False)
        state: Column = validity.status(when, F.col("ts"), F.col("superseded_by"), F.col("valid_to"))
        out = live.join(hits.select(F.col("id").alias("pos"), "score", "place"), "pos")
        return out.select("fact_id", "text", "ts", "source_ref", "score", "place", state.alias("status")).orderBy(F.col("ts").asc_nulls_first(), "place")

    def ask(self, question: str, as_of: str | None = None, top_k: int = 10, reader=None) -> tuple[str, Receipt]:  # noqa: ANN001
        """The reader's answer from dated evidence lines (default: the lines), and a receipt."""
        rows = self.search(question, as_of, top_k).collect()
        lines = [f"[{r['ts'].date() if r['ts'] else 'unknown-date'}] {r['text']}" for r in rows]
        kind = self.spark.range(1).select(routing.question_class(F.lit(question))).head()[0]
        receipt = Receipt(kind, self.facts().count(), len(rows), as_of, (sum(map(len, lines)) + len(question)) // 4)
        return (reader or (lambda q, evidence: "\n".join(evidence)))(question, lines), receipt

    def delete(self, refs: list[str]) -> int:
        """Delete facts by id or ``mem:`` reference; what they had closed is open again. Unknown or ambiguous references raise."""
        bank = self.facts()
        found = mutations.resolved(bank, self.spark.createDataFrame([(r,) for r in refs], "ref string")).collect()
        if bad := [r["ref"] for r in found if r["n"] != 1]:
            raise KeyError(f"no single fact: {bad}")
        self._write(mutations.deleted(bank, self.spark.createDataFrame([(r["fact_id"],) for r in found], "fact_id string")))
        return len(found)

    def forget(self, doc_id: str | None = None, source_session: str | None = None) -> int:
        """Delete all facts of a document, a session, or a session of a document."""
        if doc_id is None and source_session is None:
            raise ValueError("a document or a session is needed")
        bank = self.facts()
        test = (F.col("doc_id") == doc_id if doc_id is not None else F.lit(True)) & (F.col("source_session") == source_session if source_session is not None else F.lit(True))
        gone = bank.where(test).select("fact_id")
        n = gone.count()
        if n:
            self._write(mutations.deleted(bank, gone))
        return n
