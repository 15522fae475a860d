"""Sources, streaming, memory and functions on small cases."""

import datetime as dt
import io
import json
import random
import time
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from recollect.functions import dates, parsing, routing, text
from recollect.operators import mutations, overlaps, validity, vectors
from recollect.plans.memory import Memory, as_sessions, retried
from recollect.sources import files
from recollect.streaming import ingest


def one(spark, column):
    return spark.range(1).select(column.alias("x")).head()[0]


TREE = {
    "title": "t", "create_time": 1704067200.0, "current_node": "d",
    "mapping": {
        "a": {"parent": None, "children": ["b"], "message": None},
        "b": {"parent": "a", "children": ["c", "x"], "message": {"author": {"role": "system"}, "content": {"parts": ["hidden"]}}},
        "c": {"parent": "b", "children": ["d"], "message": {"author": {"role": "user"}, "content": {"parts": ["hello", "", {"text": "more"}]}}},
        "d": {"parent": "c", "children": [], "message": {"author": {"role": "assistant"}, "content": {"parts": ["hi"]}}},
        "x": {"parent": "b", "children": [], "message": {"author": {"role": "user"}, "content": {"parts": ["other branch"]}}},
    },
}
LIST = {"uuid": "1", "name": "n", "created_at": "2024-05-06T01:02:03Z", "chat_messages": [{"sender": "human", "text": "q"}, {"sender": "assistant", "content": [{"type": "thinking", "text": "no"}, {"type": "text", "text": "a"}]}]}
PHONE = "‎[18/04/2026, 12:44:37] Ann: first\nsecond line\n[18/04/2026, 12:45:00] Bob: image omitted\n[18/04/2026, 12:46:00] Bob: ok\n[19/04/2026, 09:00:00] Ann: next day\n[19/04/2026, 09:01:00] Ann: Messages and calls are end-to-end encrypted."


@pytest.mark.parametrize(
    ("data", "kind", "sessions"),
    [
        (TREE, "chat", [([("user", "hello\n\nmore"), ("assistant", "hi")], "2024-01-01")]),
        ([LIST], "chat", [([("user", "q"), ("assistant", "a")], "2024-05-06")]),
        ({"sessions": [[{"role": "user", "content": "x"}]], "dates": ["2024-01-02"]}, "chat", [([("user", "x")], "2024-01-02")]),
        ({"messages": [{"content": "x"}], "date": "2024-03-04"}, "chat", [([("user", "x")], "2024-03-04")]),
        ([{"role": "user", "content": "x"}], "chat", [([("user", "x")], None)]),
        ([[{"role": "user", "content": "x"}], [{"role": "assistant", "content": "y"}]], "chat", [([("user", "x")], None), ([("assistant", "y")], None)]),
        ([{"date": "2024-01-05", "turns": [{"role": "user", "content": "x"}]}], "chat", [([("user", "x")], "2024-01-05")]),
        ([{"id": 1, "none": None, "empty": "", "nested": {"é": 1}, "created_at": 1704067200000}], "records", [([("user", 'id: 1; nested: {"é": 1}; created_at: 1704067200000')], "2024-01-01")]),
    ],
)
def test_json_shapes(data, kind, sessions):
    assert files.parse_data(data) == (kind, sessions)


def test_tree_with_a_cycle_ends():
    tree = {"current_node": "a", "mapping": {"a": {"parent": "b"}, "b": {"parent": "a", "message": {"author": {"role": "user"}, "content": {"parts": ["x"]}}}}}
    assert files.parse_data(tree)[1] == [([("user", "x")], None)]


def test_phone_chat():
    assert files.phone_chat(PHONE) == [([("user", "Ann: first\nsecond line"), ("user", "Bob: ok")], "2026-04-18"), ([("user", "Ann: next day")], "2026-04-19")]
    dashes = "18/04/26, 12:44 - Ann: a\n18/04/26, 12:44 - Bob: b\n12/31/2025, 1:00 pm - Ann: c"
    assert [d for _, d in files.phone_chat(dashes)] == ["2026-04-18", "2025-12-31"]
    assert files.phone_chat("plain\n\nnotes") is None


def test_paragraphs():
    long = "x" * 900 + ". " + "y" * 900
    assert files.paragraphs("a\n \nb") == ["a", "b"]
    assert files.paragraphs(long) == ["x" * 900 + ".", "y" * 900]
    assert list(map(len, files.paragraphs("z" * 3100))) == [1500, 1500, 100]


def test_read_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.json").write_text(json.dumps(LIST))
    (tmp_path / "sub" / "b.csv").write_text("﻿id,created_at\n" + "\n".join(f"{i},2024-02-0{1 + i % 9}" for i in range(25)))
    (tmp_path / "c.txt").write_text(PHONE)
    (tmp_path / "d.jsonl").write_text('{"k": 1}\n\n{"k": 2}\n')
    (tmp_path / "skip.bin").write_bytes(b"\0")
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("conversations-1.json", json.dumps([TREE]))
    (tmp_path / "e.zip").write_bytes(raw.getvalue())
    rows = files.read(spark, str(tmp_path)).collect()
    counts = {}
    for r in rows:
        counts[r["name"]] = counts.get(r["name"], 0) + 1
    assert counts == {"a.json": 2, "b.csv": 25, "c.txt": 3, "d.jsonl": 2, "e.zip": 2}
    assert {(r["session"], r["day"]) for r in rows if r["name"] == "b.csv"} == {(0, "2024-02-01"), (1, "2024-02-03")}


@pytest.mark.parametrize(
    ("written", "want"),
    [("2024-05-01", "2024-05-01T00:00:00"), ("2024-05-01T10:20:30Z", "2024-05-01T10:20:30"), ("2024-05-01T10:20:30+02:00", "2024-05-01T08:20:30"), ("2023/05/20 (Sat) 02:21", "2023-05-20T02:21:00"), ("2023/05/20", "2023-05-20T00:00:00"), ("nonsense", None), ("", None), ("2024-13-45", None)],
)
def test_dates(spark, written, want):
    assert one(spark, dates.iso_seconds(dates.parsed(F.lit(written)))) == want


@pytest.mark.parametrize(
    ("question", "want"),
    [("What now?", "knowledge_update"), ("When was it?", "temporal"), ("In May", "temporal"), ("How many cats", "aggregation"), ("I know him", "knowledge_update"), ("Is he tall", "general")],
)
def test_routing(spark, question, want):
    assert one(spark, routing.question_class(F.lit(question))) == want
    assert one(spark, routing.question_class(F.lit(question), F.lit("multi-session"))) == "aggregation"


def test_validity(spark):
    d = lambda s: F.lit(s).cast("timestamp_ntz")
    old = (d("2024-01-10"), F.lit("x"), d("2024-03-01"))
    assert one(spark, validity.active(d("2024-02-01"), *old)) and not one(spark, validity.active(d("2024-06-01"), *old))
    assert not one(spark, validity.active(d("2024-01-01"), *old)) and one(spark, validity.active(d("2024-06-01"), *old, history=True))
    assert one(spark, validity.status(d("2024-06-01"), *old)) == "superseded" and one(spark, validity.status(d("2024-02-01"), *old)) == "current"


def test_text_functions(spark):
    ids = [one(spark, text.content_id(F.lit(t), F.lit(""), F.lit(day), F.lit("atomic"))) for t, day in (("A  b", ""), ("a b", ""), ("a b", "2024-01-01"))]
    assert ids[0] == ids[1] != ids[2]
    assert one(spark, text.entities(F.lit("Who is Ann? My mom met Éric and Bob."))) == ["ann", "bob", "mother"]
    assert one(spark, text.deduped_queries(F.array(*map(F.lit, ("a b", "A  b", "c", ""))))) == ["a b", "c"]
    assert one(spark, text.normalized_questions(F.array(*map(F.lit, ("Why  so.", "why so?", "Please summarize", "Next"))), 5)) == ["Why so?", "Next?"]
    assert one(spark, text.token_f1(F.lit("the cat sat"), F.lit("cat cat"))) == 0.5


def test_delete_reopens(spark):
    facts = spark.createDataFrame([("a", "b", dt.datetime(2024, 1, 1)), ("b", "", None)], "fact_id string, superseded_by string, valid_to timestamp_ntz")
    left = mutations.deleted(facts, spark.createDataFrame([("b",)], "fact_id string")).collect()
    assert [(r["fact_id"], r["superseded_by"], r["valid_to"]) for r in left] == [("a", "", None)]


def test_dense_topk_in_blocks(spark):
    r = np.random.default_rng(3).normal(size=(60, 8))
    bank = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(r)], "id long, vector array<double>").repartition(3)
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(r[:10])], "query_id long, vector array<double>")
    for block in (4096, 3):
        got = {(x["query_id"], x["place"]): x["id"] for x in vectors.dense_topk(bank, queries, 5, block).collect()}
        scores = np.round(r[:10] @ r.T, 6)
        for q in range(10):
            assert [got[(q, p)] for p in range(1, 6)] == sorted(range(60), key=lambda i: (-scores[q, i], i))[:5]


def test_stream_equals_batch(spark, tmp_path):
    rows = [(1, 0, "user", "One thing. Another thing."), (1, 1, "assistant", "Fine."), (2, 0, "user", "One thing.")]
    schema = ingest.TURNS
    source, bank, log = (str(tmp_path / n) for n in ("in", "bank", "log"))
    for k, r in enumerate(rows):
        spark.createDataFrame([r], schema).coalesce(1).write.mode("append").parquet(source)
        ingest.ingest(spark, source, bank, log, 1).awaitTermination()
        assert spark.read.parquet(bank).count() == [3, 4, 6][k]
    ingest.ingest(spark, source, bank, log, 1).awaitTermination()
    again = spark.read.parquet(bank)
    assert again.count() == again.select("fact_id").distinct().count() == 6


def test_a_move_closes_the_old_home_only(spark, tmp_path):
    memory = Memory(spark, str(tmp_path / "m"))
    memory.add([("user", "Ann lives in Paris")], "2024-01-10")
    memory.add([("user", "Ann has a dog named Rex")], "2024-02-10")
    memory.add([("user", "Ann moved to Rome")], "2024-03-01")
    state = {r["text"]: r["superseded_by"] for r in memory.facts().collect()}
    assert state["Ann lives in Paris"] and not state["Ann has a dog named Rex"] and not state["Ann moved to Rome"]
    rex = memory.facts().where("text like '%Rex'").head()["fact_id"]
    assert memory.get(rex)["text"].endswith("Rex") and memory.get("none") is None
    assert memory.set_valid_to(rex, "2024-05-01") and not memory.set_valid_to("none", None)
    assert str(memory.get(rex)["valid_to"].date()) == "2024-05-01"
    assert memory.documents().head()["facts"] == 3
    assert memory.add_all([{"role": "user", "content": "Bob likes tea"}, {"content": "and cake"}], doc_id="d") == 2
    memory.clear()
    assert memory.facts().isEmpty()


def test_sessions_and_retries():
    turn = [("user", "hi")]
    assert [as_sessions(x) for x in ("", None, " hi ", {"content": "hi"}, {"content": " "}, [{"role": "user", "content": "hi"}], [[("user", "hi")], turn])] == [[], [], [turn], [turn], [], [turn], [turn, turn]]
    waits, calls = [], iter([ValueError(), ValueError(), 7])

    def call():
        got = next(calls)
        if isinstance(got, Exception):
            raise got
        return got

    assert retried(call, sleep=waits.append) == 7 and len(waits) == 2 and waits[1] <= 2


def test_replies(spark):
    reply = lambda f, t: one(spark, f(F.lit(t)))
    assert [reply(parsing.label, t) for t in ('{"label": "Correct"}', 'so {"label": "maybe"}', "it is correct", "correct or wrong", "", "?")] == ["CORRECT", "MAYBE", "CORRECT", "WRONG", "WRONG", "WRONG"]
    assert [reply(parsing.json_reply, t) for t in ('```json\n{"a": 1}\n```', ' {"a": 1} ', 'x {"a": 1} y', "none", "{a")] == ['{"a": 1}'] * 3 + [None, None]
    assert [reply(parsing.json_list, t) for t in ("```\n[1]\n```", 'x [1, [2]] y', '{"a": [1]}', "[", None)] == ["[1]", "[1, [2]]", None, None, None]
    assert one(spark, parsing.judged_score(F.lit("about 0.7."), F.lit("a"), F.lit("b"))) == 0.7 and one(spark, parsing.judged_score(F.lit("7"), F.lit("a"), F.lit("b"))) == 1.0
    assert one(spark, parsing.judged_score(F.lit("none"), F.lit("the cat sat"), F.lit("cat cat"))) == 0.5
    assert one(spark, routing.is_changelog(F.lit("What's changed lately?"))) and not one(spark, routing.is_changelog(F.lit("Where is it?")))


def test_memory(spark, tmp_path):
    memory = Memory(spark, str(tmp_path / "m"))
    assert memory.facts().count() == 0
    assert memory.add([("user", "Ann moved to Paris"), ("assistant", "Noted, Paris.")], "2024-01-10", doc_id="d1") == 2
    assert memory.add([("user", "Ann moved to Paris")], "2024-01-10", doc_id="d1") == 0
    assert memory.add([("user", "Ann moved to Rome")], "2024-03-01", doc_id="d2") == 1
    now = {r["text"] for r in memory.search("where did Ann move, Paris or Rome").collect()}
    assert "Ann moved to Rome" in now and "Ann moved to Paris" not in now
    then = {r["text"] for r in memory.search("Ann Paris Rome", as_of="2024-02-01").collect()}
    assert "Ann moved to Paris" in then and "Ann moved to Rome" not in then
    answer, receipt = memory.ask("When did Ann move to Rome?")
    assert "2024-03-01" in answer and receipt.query_class == "temporal" and receipt.scanned == 3
    rome = memory.facts().where("text = 'Ann moved to Rome'").head()["fact_id"]
    assert memory.delete([f"mem:{rome[:12]}"]) == 1
    assert "Ann moved to Paris" in {r["text"] for r in memory.search("Paris").collect()}
    with pytest.raises(KeyError):
        memory.delete(["unknown"])
    assert memory.forget(doc_id="d1") == 2 and memory.facts().count() == 0
    with pytest.raises(ValueError):
        memory.forget()


@pytest.mark.parametrize(("rare", "asked_block", "held_block"), [(20, 16, 32), (0, 1000, 1000), (10**6, 10, 10)])
def test_reached_against_brute_force(spark, rare, asked_block, held_block):
    rng = random.Random(3)
    drawn = lambda: sorted({f"w{min(39, int(rng.expovariate(0.15)))}" for _ in range(rng.randint(0, 6))})
    asked, held = [drawn() for _ in range(150)], [(rng.choice(["a", "a", None, f"g{n % 60}"]), drawn()) for n in range(2000)]
    want = {}
    for es in asked:
        hit = [g for g, other in held if set(es) & set(other)]
        if hit:
            want[tuple(es)] = (len(hit), len({g for g in hit if g is not None}))
    got = overlaps.reached(spark.createDataFrame([(x,) for x in asked], "es array<string>"), spark.createDataFrame(held, "grp string, es array<string>"), rare, asked_block, held_block)
    assert {tuple(r["es"]): (r["items"], r["groups"]) for r in got.collect()} == want


def test_reached_makes_no_row_per_pair_of_a_common_element(spark):
    """40,000 sets that all hold one element, by 40,000 that ask for it: 1.6 billion pairs."""
    n = 40_000
    asked = spark.range(n).select(F.array(F.lit("of"), F.concat(F.lit("x"), "id")).alias("es"))
    held = spark.range(n).select((F.col("id") % 100).cast("string").alias("grp"), F.array(F.lit("of"), F.concat(F.lit("y"), "id")).alias("es"))
    start = time.monotonic()
    assert overlaps.reached(asked, held).groupBy("items", "groups").count().collect() == [(n, 100, n)]
    assert time.monotonic() - start < 90


def test_half_up_as_sql_rounds(spark):
    x = [0.1234565, 0.1234575, -0.1234565, 0.3, 2.5e-7, 5e-7, 1.0000005, 123.4567895, 0.9999995]
    rounded = [r[0] for r in spark.createDataFrame([(v,) for v in x], "x double").select(F.round("x", 6)).collect()]
    assert validity.half_up(np.array(x)).tolist() == rounded


@pytest.mark.parametrize("tags", [5, 500])
def test_best_older_against_all_pairs(spark, tags):
    rng = random.Random(tags)
    day = dt.datetime(2024, 1, 1)
    unit = lambda: [float(round(rng.gauss(0, 1) / 2, 1)) for _ in range(4)]  # noqa: E731  # coarse: many equal scores
    rows = [(n, n * 7 % 301, None if n % 7 == 0 else day + dt.timedelta(rng.randint(0, 20)), unit() if n % 50 else None, [f"t{rng.randint(0, tags)}" for _ in range(rng.randint(0, 4))], rng.random() < 0.3, n % 3) for n in range(300)]
    facts = spark.createDataFrame(rows, "fact_id long, pos long, ts timestamp_ntz, unit array<double>, tags array<string>, changing boolean, bucket int")
    best = {}
    for n in rows:
        for o in rows:
            if n[0] == o[0] or n[6] != o[6] or not n[3] or not o[3] or not (n[2] is None or (o[2] is not None and n[2] > o[2])):
                continue
            score = round(sum(a * b for a, b in zip(n[3], o[3], strict=True)), 6)
            if score >= 0.3 and (score >= 0.9 or set(n[4]) & set(o[4]) or (n[5] and o[5])):
                best[n[0]] = max(best.get(n[0], ()), (score, o[1], o[0]))
    want, latest = {}, dt.datetime.max
    for n in rows:
        if n[0] in best:
            rank = (n[2] is not None, n[2] or latest, -n[1] if n[2] is None else n[1])
            want[best[n[0]][2]] = max(want.get(best[n[0]][2], ()), (*rank, n[0]))
    for block in (4096, 16):
        got = {r["old_id"]: r["new_id"] for r in validity.supersessions(facts, facts, 0.3, 0.9, block).collect()}
        assert got == {o: x[-1] for o, x in want.items()}


def test_supersessions_leave_a_row_a_fact_not_a_row_a_pair(spark):
    """24,000 facts of one bucket, 288 million pairs of an older and a newer one."""
    n = 24_000
    facts = spark.range(n).select(F.col("id").alias("fact_id"), F.col("id").alias("pos"), F.timestamp_seconds("id").cast("timestamp_ntz").alias("ts"), F.transform(F.sequence(F.lit(1), F.lit(32)), lambda i: F.sin(F.col("id") * i)).alias("unit"), F.array().cast("array<string>").alias("tags"), F.lit(True).alias("changing"), F.lit(1).alias("bucket"))
    start = time.monotonic()
    assert validity.supersessions(facts, facts).count() > n / 4
    assert time.monotonic() - start < 90


def test_fixed_rounds_the_binary_value_as_printf_does(spark):
    """Ties go to even, and 1.005 is below its decimals: Java's format gives $0.13, $2.68 and $1.01 for the first ones."""
    rng = random.Random(9)
    values = [0.125, 0.375, 2.675, 1.005, 0.0625, 0.00005, 0.00015, 0.9995, 0.99951, 1.995, 0.00995, 0.009995, 0.0625 / 4, 12345678.125, 2.0**53 + 2, -0.125, -0.00005, 1e-30, 5e-324]
    values += [rng.randrange(200_000) / 1e4 * p / 100 for p in (0.15, 0.4, 1.1, 2.5, 15.0) for _ in range(400)] + [rng.randrange(10**6) / 8 / 10**k for k in (0, 1, 2, 3) for _ in range(200)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for k in (2, 3, 4):
        assert [r[0] for r in df.select(text.fixed(F.col("x"), k)).collect()] == [f"{v:.{k}f}" for v in values]
    assert one(spark, text.cost_text(F.lit(1.125))) == "$1.12" and one(spark, text.cost_text(F.lit(0.0625))) == "$0.062"
