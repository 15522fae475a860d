"""The pipeline stage by stage against brute force, and the registered queries against their SQL."""

import os
import random
import re

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from recollect.llm import packing
from tests.llm.test_operators import brute_lines, brute_links, brute_repeats, sha

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(11)
    words = ["the", "of", "and", "to"] * 30 + ["".join(r.choice("abcdefg") for _ in range(r.randint(3, 8))) for _ in range(500)]
    prose = lambda n: " ".join(r.choice(words) for _ in range(n))
    base, line, passage = prose(150), "A line long enough to be common in many documents", prose(60)
    texts = [base, base, base.rsplit(" ", 3)[0] + " x", "too short", "# * $ " * 100, "same same " * 80, None, *[prose(90) + "\n" + line for _ in range(7)], prose(70) + " " + passage + " " + prose(10), prose(80) + " " + passage]
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")


def test_stages(spark, docs, tmp_path):
    before, now = docs, docs
    tables = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, "").write.parquet(str(tmp_path / str(k)))
        before, now = now, spark.read.parquet(str(tmp_path / str(k)))
        tables.append([(r["doc_id"], r["text"]) for r in before.collect()])
        if k < len(corpus_pipeline.STAGES) - 1:
            assert now.columns == docs.columns
            assert all(r["n_chars"] == len(r["text"]) for r in now.collect())
    ids = [{i for i, _ in t} for t in tables]
    assert ids[1] == {0, 1, 2, *range(7, 16)}  # the junk is gone, clean documents stay
    assert sum(n for i, _, n, _ in brute_lines(tables[1])) == 6
    assert {(i, sha(t)) for i, t in tables[2]} == {(i, digest) for i, _, _, digest in brute_lines(tables[1])}
    classes = {(i, c) for i, c, _ in brute_links(tables[2])}
    assert ids[3] == {i for i, c in classes if i == c} and 0 in ids[3] and not ids[3] & {1, 2}
    for (i, t), (size, gone, _, digest) in zip(sorted(tables[3]), brute_repeats([t for _, t in sorted(tables[3])], 200)):
        assert sha(dict(tables[4])[i]) == digest and size - gone == len(dict(tables[4])[i].encode())
    assert ids[4] == ids[3] and any(len(a[1]) > len(dict(tables[4])[a[0]]) for a in tables[3])
    own = packing.encoder(packing.tokenizer_path())
    pieces = {}
    for r in now.collect():
        pieces.setdefault(r["doc_id"], {})[r["start"]] = r["ids"]
    for i, t in tables[4]:
        assert [x for s in sorted(pieces[i]) for x in pieces[i][s]] == [*np.frombuffer(own.ids(t), "<u4").tolist(), 0]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(n for n in entry.oracle_sql() if re.match(r"op\d+_", n)))
def test_sql_twin(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        path = f"{DATA}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    df = entry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    cursor = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    order = sorted(range(len(names)), key=lambda i: names[i])
    shown = lambda r: tuple(map(repr, r))
    assert sorted(shown(r[c] for c in columns) for r in df.collect()) == sorted(shown(r[i] for i in order) for r in cursor.fetchall())


def test_every_operator_is_registered():
    names = list(entry.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
