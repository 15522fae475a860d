"""Each operator on hard little tables, against brute force or an exact round trip."""

import hashlib
import math
import random
import re
import textwrap
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from recollect.llm import chat, chosen_path, licenses, line_dedup, minhash, packing, pieces, quality, repeats, scoring
from recollect.llm.components import components
from recollect.llm.textnum import span_hashes

SPACE = r"[\x20\x09-\x0D]"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
rng = random.Random(5)
VOCABULARY = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 7))) for _ in range(400)]


def prose(n, r=rng):
    return " ".join(r.choice(VOCABULARY) for _ in range(n))


BASE = prose(120)
LINE = "A line that is long enough to be counted as common, " + prose(3)
TEXTS = [
    BASE, BASE, BASE.replace(" ", "  "), BASE + " " + prose(5), " ".join(BASE.split()[:-6]), None, "", "   \n\t ", "one", "one", "two words", "\n\n\n",
    prose(60) + "\n" + LINE, LINE + "\n" + prose(50), "  " + LINE.upper().replace("É", "é") + " \t\n" + prose(55), prose(60) + "\n" + LINE + "\r\n" + LINE, LINE, prose(80) + "\n" + LINE,
    prose(3000), "aaaa " * 400, "a" * 900, "日本語のテキスト。" * 60, "🙂 ▁ \x00 " + prose(30), "# * $ % & | < > " * 30 + prose(60), "the of and " + prose(70),
    "Released under the MIT License.\n" + prose(60), BASE[:700] + prose(20), prose(20) + BASE[100:600],
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", -1, "x", "y") for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "en", "s", -1, "x", "y"), (None, "null id " + prose(70), None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, i string, spans string")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def key(doc_id, text):
    return (-1 if doc_id is None else doc_id, text or "")


def source(docs):
    return sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=lambda x: key(*x))


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


# -- 1: fingerprints


def test_fingerprints(spark, docs, empty):
    for parts in (1, 3):
        out = rows_of(minhash.edited_fingerprints(docs, parts))
        assert len(out) == len(TEXTS) + 2
        by = Counter((r["doc_id"], r["n_chars"]) for r in out)
        assert by == Counter((i, len(t or "")) for i, t in source(docs))
    order = sorted((r for r in source(docs)), key=lambda x: key(*x), reverse=True)
    want = Counter()
    for (i, t), (_, n) in zip(order, [*order[1:], order[0]]):
        t, n = t or "", n or ""
        want[(i, sha(t[: len(t) - len(t) // 3] + n[: len(t) // 3]))] += 1
    assert Counter((r["doc_id"], r["edited_sha256"]) for r in out) == want
    same = {}
    for r in out:
        same.setdefault(TEXTS[r["doc_id"]] if r["doc_id"] is not None else "null id", set()).add(r["fingerprint"])
    assert all(len(v) == 1 for v in same.values())
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in out)
    assert minhash.edited_fingerprints(empty).count() == 0


def shingles(t, k=5):
    w = WORD.findall(t or "")
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def test_likeness_estimates_jaccard():
    a, b = prose(400), prose(400)
    mixed = " ".join(a.split()[:300]) + " " + b
    s = minhash.signatures(pa.array([a, mixed, None, ""]))
    real = len(shingles(a) & shingles(mixed)) / len(shingles(a) | shingles(mixed))
    assert abs(minhash.likeness(s[:1], s[1:2])[0] - real) < 0.15
    assert list(minhash.likeness(s[2:], s[3:])) == [1.0] if len(s[2:]) == 1 else minhash.likeness(s[2:3], s[3:4])[0] == 1.0
    assert minhash.likeness(s[:1], s[2:3])[0] == 0


# -- 2: repeats


def brute_repeats(texts, size):
    bodies = [(t or "").encode() for t in texts]
    count = Counter(b[i : i + size] for b in bodies for i in range(len(b) - size + 1))
    out = []
    for b in bodies:
        gone = bytearray(len(b))
        for i in range(len(b) - size + 1):
            if count[b[i : i + size]] > 1:
                gone[i : i + size] = b"\1" * size
        spans = sum(1 for i, x in enumerate(gone) if x and not (i and gone[i - 1]))
        out.append((len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone) if not g))))
    return out


@pytest.mark.parametrize("options", [{}, {"hot": 1}, {"bound": 0, "shard_bytes": 1 << 10}])
def test_repeats(docs, options):
    given = source(docs)
    want = Counter((i, *x) for (i, _), x in zip(given, brute_repeats([t for _, t in given], 200)))
    got = Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows_of(repeats.report(docs, **options)))
    assert got == want


def test_repeats_empty_and_columns(docs, empty):
    assert repeats.report(empty).count() == 0
    assert repeats.apply(docs).columns == docs.columns


def test_interval_expansion_against_brute_force():
    r = random.Random(1)
    for _ in range(150):
        size, letters = r.choice([2, 3, 5, 9]), r.choice([2, 3, 8])
        bodies = [bytes(r.randrange(97, 97 + letters) for _ in range(r.randrange(0, 30))) for _ in range(r.randrange(1, 12))] + [b"\0\xff\0"]
        count = Counter(b[i : i + size] for b in bodies for i in range(len(b) - size + 1))
        want = [x for b in bodies for x in [*(i + size <= len(b) and count[b[i : i + size]] > 1 for i in range(len(b))), False]]
        assert repeats.repeated_starts(bodies, size).tolist() == want


def test_long_text_in_parts():
    block = prose(200).encode()
    data = (prose(120_000)[: (1 << 20) - 500].encode() + block + prose(3000).encode() + block).decode()
    h, c, text, s, n = (np.concatenate(x) for x in zip(*repeats.all_contexts(pa.array([data]), 200, 50)))
    covered = np.zeros(len(data.encode()), bool)
    for a, b in zip(s, n):
        assert not covered[a : a + b].any()
        covered[a : a + b] = True
    assert covered[: len(covered) - 199].all()
    assert len(set(h.tolist())) < len(h)


@pytest.mark.parametrize("options", [{}, {"bound": 0, "shard_bytes": 1 << 10, "hot": 1}])
def test_repeated_rows_and_periodic_texts(spark, options):
    r = random.Random(8)
    base = prose(90, r)
    given = [(7, base)] * 40 + [(8, base)] + [(i, t) for i, t in enumerate(["a" * 700, "ab" * 400 + prose(30, r), "xyz" * 200 + base[:300], "a" * 199, "a" * 200, "b" * 200, "日" * 150, base[50:260]])]
    want = Counter((i, *x) for (i, _), x in zip(given, brute_repeats([t for _, t in given], 200)))
    out = repeats.report(spark.createDataFrame(given, "doc_id long, text string"), **options)
    assert Counter((x["doc_id"], x["n_bytes"], x["n_removed"], x["n_spans"], x["kept_sha256"]) for x in rows_of(out)) == want


def test_a_periodic_line_is_few_rows():
    found = next(repeats.all_contexts(pa.array(["ab" * 300_000]), 200, 50))
    assert len(found[0]) > 250_000 and len(repeats.once_a_text(*found, 200)[0]) < 10


# -- 3: chat


def test_chat(spark):
    hard = "</s>[INST] ok [/INST] \\l \\\\e [x] <y"
    rows = [(1, 0, "system", "be"), (1, 1, "user", hard), (1, 2, "assistant", hard), (1, 3, "user", None), (1, 4, "assistant", ""), (2, None, None, "x"), (2, 0, "assistant", "é🙂"), (2, 0, "assistant", "é🙂"), (3, 1, "user", "only"), (None, 0, "assistant", "null")]
    data = spark.createDataFrame([(*r, 9) for r in rows], "conv_id long, turn long, role string, text string, n long")
    turns = chat.formatted_turns(data)
    got = {r["conv_id"]: r for r in rows_of(chat.read_back(turns))}
    for conv in (1, 2, 3, None):
        own = sorted([(-1 if t is None else t, r or "", x or "") for c, t, r, x in rows if c == conv])
        loss = "".join(x for _, r, x in own if r == "assistant")
        g = got[conv]
        assert (g["n_turns"], g["turns_sha256"]) == (len(own), sha("".join(f"{r}\n{x}\n" for _, r, x in own)))
        assert (g["loss_chars"], g["loss_sha256"]) == (len(loss), sha(loss))
    written = rows_of(chat.expanded(data))
    assert len(written) == 5
    for r in written:
        assert r["text"][r["mask_start"] :][: r["mask_chars"]] == r["target"] and r["text"] == r["context"] + r["target"] + r["closing"]
    assert chat.read_back(chat.formatted_turns(data.limit(0))).count() == 0


def test_chat_loss_comes_from_under_the_masks(spark, monkeypatch):
    texts = [("user", "ask \\ <b> é🙂 " * 700), ("assistant", "first [x] 🙂" * 900), ("user", "more"), ("assistant", "second")]
    turns = chat.formatted_turns(spark.createDataFrame([(1, k, *t) for k, t in enumerate(texts)], "conv_id long, turn long, role string, text string"))
    read = lambda: chat.read_back(turns).head()["loss_sha256"]
    assert read() == sha(texts[1][1] + texts[3][1])
    given = chat.examples
    monkeypatch.setattr(chat, "examples", lambda t: given(t).where("n <> 4"))  # a lost example
    assert read() == sha(texts[1][1])
    monkeypatch.setattr(chat, "examples", lambda t: given(t).where("n = 4").withColumn("context_chars", given(t)["context_chars"] - 1))  # a wrong mask
    assert read() == sha("]secon")


def test_chat_contexts_are_written_out(spark, monkeypatch):
    monkeypatch.setattr(chat, "PIECE", 8)
    monkeypatch.setattr(chat, "STEP", 32)
    r = random.Random(9)
    data = [(c, k, r.choice(["user", "assistant", "a[b]"]), prose(r.randint(0, 4), r) + r.choice(["", "</s>", "[é🙂]", "\\"])) for c in (1, 2, None) for k in range(12)]
    turns = chat.formatted_turns(spark.createDataFrame([*data, (3, 0, "assistant", ""), (3, 1, "user", "x")], "conv_id long, turn long, role string, text string"))
    got, expected = {(x["conv_id"], x["n"]): x for x in rows_of(chat.examples(turns))}, {}
    coded = lambda x: x.replace("\\", "\\e").replace("<", "\\l").replace("[", "\\b").replace("]", "\\d")
    for c in (1, 2, None):
        before = ""
        for n, (_, _, role, text) in enumerate([x for x in data if x[0] == c], 1):
            if role == "assistant":
                expected[c, n] = (before + "[assistant]", coded(text))
            before += f"[{coded(role)}]{coded(text)}</s>"
    expected[3, 1] = ("[assistant]", "")
    assert {k: (x["context"], x["target"]) for k, x in got.items()} == expected
    assert all(x["context_chars"] == len(x["context"]) for x in got.values()) and max(x["context_chars"] for x in got.values()) > 3 * chat.STEP
    assert {r["conv_id"]: r["loss_sha256"] for r in rows_of(chat.read_back(turns))} == {c: sha("".join(x[3] for x in data if x[0] == c and x[2] == "assistant")) for c in (1, 2, None)} | {3: sha("")}
    given = chat.examples
    whole = chat.read_back(turns).where("conv_id = 1").head()["loss_sha256"]
    monkeypatch.setattr(chat, "examples", lambda t: given(t).withColumn("context", F.expr("substring(context, 2)")))  # a context that isn't whole
    assert chat.read_back(turns).where("conv_id = 1").head()["loss_sha256"] != whole


# -- 4: lines


def brute_lines(given):
    strip = " \t\n\x0b\x0c\r"
    lower = {c: c + 32 for c in range(65, 91)}
    keyed = [(i, [(x, x.strip(strip).translate(lower)) for x in (t or "").split("\n")]) for i, t in given]
    holders = {}
    for i, lines in keyed:
        for k in {k for _, k in lines if len(k) >= 40}:
            holders.setdefault(k, []).append(-1 if i is None else i)
    out = []
    for i, lines in keyed:
        kept = [x for x, k in lines if not (len(holders.get(k, ())) >= 5 and max(holders[k]) != (-1 if i is None else i))]
        out.append((i, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    return Counter(out)


@pytest.mark.parametrize("options", [{}, {"broadcast_bytes": -1}])
def test_lines(docs, empty, options):
    got = Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in rows_of(line_dedup.report(docs, **options)))
    assert got == brute_lines(source(docs))
    assert line_dedup.report(empty, **options).count() == 0
    assert line_dedup.apply(docs, **options).columns == docs.columns


def test_perfect_hash():
    high = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 5000, dtype=np.uint64))
    keys = high * np.uint64(3)
    keys[:100] = keys[0]  # keys that share their low halves are told apart
    shard = line_dedup.Shard.load(line_dedup.Shard(keys, high, np.full(len(keys), 7), high.astype(np.int64)).dump())
    assert sorted(shard.hash.index(keys, high)) == list(range(len(keys)))
    known, last = shard.probe(keys, high)
    assert known.all() and (last == high.astype(np.int64)).all()
    assert not shard.probe(keys + np.uint64(1), high + np.uint64(1))[0].any()
    assert not shard.probe(keys[:1], high[:1] + np.uint64(1))[0].any()


# -- 5: packing


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    path = packing.tokenizer_path()
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    out = rows_of(packing.packed(docs, path, with_ids=True))
    assert len({r["sequence_id"] for r in out}) == len(out)
    by = {}
    for r in out:
        assert len(r["ids"]) == r["length"] and r["length"] & (r["length"] - 1) == 0 and r["length"] <= 1024 and r["offset"] == 0
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"]
        by.setdefault((r["doc_id"], r["doc_tokens"]), {})[r["start"]] = r["ids"]
    for i, t in source(docs):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        parts = by[(i, len(ids))]
        assert [x for s in sorted(parts) for x in parts[s]] == ids
    assert packing.packed(empty, path).count() == 0


def test_tokens_of_mixed_blanks():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    tokenizer.encode_special_tokens = True
    own = packing.encoder(packing.tokenizer_path())
    r = random.Random(3)
    for _ in range(300):
        t = "".join(r.choice([" ", " ", "\n", "\t", "\r", "\x85", "\xa0", "　", "\x1c", "a", "B", "é", "1", ".", "'s", "don't", "日", "<|endoftext|>"]) for _ in range(r.randrange(0, 25)))
        assert np.frombuffer(own.ids(t), "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids, repr(t)


# -- 6: quality


def test_quality(docs, empty):
    got = Counter(tuple(r[c] for c in ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) for r in rows_of(quality.report(docs)))
    want = Counter()
    for i, t in source(docs):
        t = t or ""
        w = WORD.findall(t)
        windows = Counter(zip(w, w[1:], w[2:]))
        again = {j for k in range(len(w) - 2) if windows[tuple(w[k : k + 3])] > 1 for j in (k, k + 1, k + 2)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        want[(i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(again), len(w) < 50 or 100 * len(again) > 50 * len(w))] += 1
    assert got == want
    assert quality.report(empty).count() == 0
    kept = quality.keep(docs)
    assert kept.columns == docs.columns and kept.count() == quality.report(docs).where("kept").count()


# -- 7: join


def brute_links(given, threshold=0.8):
    sets = [shingles(t) for _, t in given]
    links, parent = [0] * len(given), list(range(len(given)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(given)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 9 * both >= 4 * (len(sets[a]) + len(sets[b])):
                links[a] += 1
                links[b] += 1
                parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(given):
        least.setdefault(find(k), []).append(i)
    return Counter((i, min(least[find(k)], key=lambda x: -1 if x is None else x), links[k]) for k, (i, _) in enumerate(given))


@pytest.mark.parametrize("options", [{}, {"small": 2, "block": 2}, {"keys": minhash.band_keys}])
def test_links(docs, empty, options):
    got = Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in rows_of(chosen_path.linked(docs, **options)))
    assert got == brute_links(source(docs))


def test_links_of_chains_and_empty(spark, docs, empty):
    r = random.Random(9)
    base = prose(150, r).split()
    texts, now = [], list(base)
    for _ in range(60):  # a chain: neighbours are near, ends are not
        now[r.randrange(150)] = r.choice(VOCABULARY)
        texts.append(" ".join(now))
    data = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in rows_of(chosen_path.linked(data, block=16)))
    assert got == brute_links(list(enumerate(texts)))
    assert chosen_path.linked(empty).count() == 0
    kept = rows_of(chosen_path.keep_one(docs))
    classes = rows_of(chosen_path.linked(docs))
    assert len(kept) == len({(r["class_id"], r["n_links"] == 0 and r["doc_id"]) for r in classes})


def test_outliers_of_crowded_groups(spark):
    r = np.random.default_rng(3)
    groups, copies = 16, chosen_path.SMALL + 12
    sigs = np.repeat(r.integers(0, 1 << 16, (groups, minhash.PERMUTATIONS)), copies + 1, axis=0).astype(np.uint16)
    for g in range(groups):  # long near copies have equal signatures; the last set of each group is at 0.8 from them
        sigs[g * (copies + 1) + copies, r.permutation(minhash.PERMUTATIONS)[:25]] += 1
    keys = chosen_path.path_keys(sigs)
    nodes = spark.createDataFrame([(int(k), i) for i, row in enumerate(keys) for k in row], "node long, id long")
    links = chosen_path.candidate_links(nodes, spark.createDataFrame([(i, row.tobytes()) for i, row in enumerate(sigs)], "id long, sig binary"))
    got = {x["node"]: x["label"] for x in components(links).collect()}
    assert [got.get(i) for i in range(len(sigs))] == [i // (copies + 1) * (copies + 1) for i in range(len(sigs))]
    assert chosen_path.recall_of(chosen_path.WAYS) >= chosen_path.RECALL > chosen_path.recall_of((2, 1))


def test_intersections_against_sets():
    r = random.Random(4)
    for _ in range(60):
        sets = [sorted({r.randrange(40) for _ in range(r.randrange(1, 30))}) for _ in range(r.randrange(2, 12))]
        bodies = [np.array(x, np.uint64) for x in sets]
        half = np.array([r.random() < 0.5 for _ in sets])
        half[:2] = [True, False]
        for one, two in ((np.arange(len(sets)), np.arange(len(sets))), (np.flatnonzero(half), np.flatnonzero(~half))):
            got = chosen_path.intersections(bodies, one, two)
            for a, i in enumerate(one):
                for b, j in enumerate(two):
                    assert i == j or got[a, b] == len(set(sets[i]) & set(sets[j]))


def test_regular_long_words_differ():
    word = b"a"
    for _ in range(12):  # Thue-Morse strings: equal polynomial hashes modulo a power of two
        word += bytes(195 - x for x in word)
    data = np.frombuffer(word + bytes(195 - x for x in word), np.uint8)
    h = span_hashes(data, np.array([0, len(word)]), np.array([len(word), 2 * len(word)]))
    assert h[0] != h[1]


def test_crowded_bucket_of_one_group_is_not_split(spark):
    """300 near copies, two sets further off and three that are like none, in one bucket: one pass links what is alike."""
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 16, 128, dtype=np.uint16)
    changed = lambda n: np.where(rng.permutation(128) < n, rng.integers(0, 1 << 16, 128, dtype=np.uint16), base)
    near = [changed(6) for _ in range(300)]
    edge = [near[n].copy() for n in (10, 20)]
    for x, n in zip(edge, (10, 20), strict=True):
        x[rng.permutation(np.flatnonzero(near[n] == base))[:27]] = 7
        x[near[n] != base] = near[n][near[n] != base]
    far = [rng.integers(0, 1 << 16, 128, dtype=np.uint16) for _ in range(3)]
    sigs = [*far, *near, *edge]
    table = spark.createDataFrame([(i, row.tobytes()) for i, row in enumerate(sigs)], "id long, sig binary")
    large = spark.range(len(sigs)).select(F.lit(1).cast("long").alias("node"), "id")
    links, rest = chosen_path.settled(large, table)
    pairs = {(r["a"], r["b"]) for r in links.collect()}
    assert rest.count() == 0 and all(b < a for a, b in pairs) and len(pairs) < 320
    label = dict(enumerate(chosen_path.roots(len(sigs), *(np.array([p[k] for p in pairs]) for k in (0, 1)))))
    assert {label[i] for i in range(3, len(sigs))} == {3} and [label[i] for i in range(3)] == [0, 1, 2]
    groups = [changed(6) if n % 3 == 0 else rng.integers(0, 1 << 16, 128, dtype=np.uint16) for n in range(300)]
    links, rest = chosen_path.settled(large.where("id < 300"), spark.createDataFrame([(i, row.tobytes()) for i, row in enumerate(groups)], "id long, sig binary"))
    assert links.count() == 0 and rest.count() == 300


def test_recall_with_crowded_buckets(spark):
    """Pairs about the threshold among thousands of texts of one template, so that most buckets are crowded."""
    r = random.Random(21)
    base, texts = prose(110, r).split(), []
    for _ in range(400):  # up to 3 words changed in each: two texts share about 0.6 to 1 of their shingles
        now = list(base)
        for _ in range(r.randrange(0, 4)):
            now[r.randrange(len(now))] = r.choice(VOCABULARY)
        texts.append(" ".join(now))
    data = spark.createDataFrame(list(enumerate(texts + [prose(40, r) for _ in range(4600)])), "doc_id long, text string")
    got = {x["doc_id"]: (x["class_id"], x["n_links"]) for x in chosen_path.linked(data).collect()}
    want = {i: (c, n) for i, c, n in brute_links([(i, t) for i, t in enumerate(texts)])}
    assert sum(got[i][1] for i in want) >= 0.999 * sum(n for _, n in want.values())
    assert sum(got[i] == w for i, w in want.items()) >= 0.99 * len(want)


def test_names_that_clash(spark):
    base = prose(120)
    names = ("_i", "_t", "i", "t", "k", "n", "node", "label", "set", "sieve_word", "_kept", "_text", "_spans", "_row", "row", "_gone", "_n_lines", "_q_words", "_q_kept", "q_words")
    rows = [(n, x, *[f"{c}{n}" for c in names]) for n, x in enumerate([base, base, base + " more", prose(90), prose(80) + "\n" + LINE, None])]
    data = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{c} string" for c in names))
    for apply in (chosen_path.keep_one, repeats.apply, line_dedup.apply, lambda d: line_dedup.apply(d, broadcast_bytes=-1), quality.keep):
        out = apply(data)
        assert out.columns == data.columns
        assert all(r[c] == f"{c}{r['doc_id']}" for r in out.collect() for c in names)


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 101), (102, 101), (7, 7)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(51)) and got[102] == 100 and len(got) == 54


# -- 8: scoring


def test_scoring(docs, empty):
    out = rows_of(scoring.scored(docs, group_bytes=1 << 12))
    lower = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    tokens, count, given = {}, Counter(), source(docs)
    for i, t in given:
        w = [*re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().translate(lower)), None]
        tokens[(i, t)] = w
        if zlib.crc32(("" if i is None else str(i)).encode()) % 10:
            count.update(w)
    n, v = sum(count.values()), len(count)
    want = Counter((i, len(tokens[(i, t)]), sum(count[x] > 0 for x in tokens[(i, t)]), n, round(sum(math.log10((count[x] + 0.1) / (n + 0.1 * (v + 1))) for x in tokens[(i, t)]), 6)) for i, t in given)
    assert Counter((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in out) == want
    assert all(r["score"] < 0 for r in out)
    assert scoring.scored(empty).count() == 0


def test_model_is_normalised_and_learns():
    r = np.random.default_rng(0)
    units = scoring.Units(np.arange(300, dtype=np.uint64), np.full(300, 50.0), {k: (10, 5) for k in range(scoring.CLASSES)})
    model = scoring.Model(units)
    u = np.tile(np.arange(10), 4000) + r.integers(0, 2, 40000) * 150
    first, second = scoring.contexts_of(u, np.array([0, len(u)]), units.size)
    before = model.log_probabilities(first, second, u).mean()
    scoring.Trainer(model, 1).learn(first, second, u)
    assert model.log_probabilities(first, second, u).mean() > before + 0.5
    every = model.log_probabilities(np.full(units.size, 3), np.full(units.size, 2), np.arange(units.size))
    assert abs(np.exp(every).sum() - 1) < 1e-3
    inside = units.inside(np.full(6, units.top), np.array([2, 2, 2, 2, 2, 0]))
    assert abs(np.exp(inside).sum() - 1) < 1e-9


def test_most_frequent_tokens_are_exact(spark, monkeypatch):
    monkeypatch.setattr(scoring, "TOP", 40)
    for rows in ([(h, h % 7, 1 + 5000 // (h + 1)) for h in range(300)], [(h, 0, 3) for h in range(100)], [(h, 0, 9) for h in range(12)], []):
        got = [(r["h"], r["c"]) for r in scoring.most_frequent(spark.createDataFrame(rows, "h long, kind int, c long").repartition(5))]
        assert got == [(h, c) for h, _, c in sorted(rows, key=lambda r: (-r[2], r[0]))[:40]]


def test_scores_by_hand_and_whatever_the_partitions(spark, monkeypatch):
    """score against sums over explicit softmaxes, token by token; and the same from one, four and nine partitions."""
    monkeypatch.setattr(scoring, "TOP", 200)
    r = random.Random(12)
    words = [w for w in VOCABULARY for _ in range(1 + ord(w[0]) % 3)]
    rows = [(i, " ".join(r.choice(words) for _ in range(r.randrange(0, 60)))) for i in range(400)] + [(None, "")] * 30
    seen = {}
    given = scoring.trained
    monkeypatch.setattr(scoring, "trained", lambda *a: seen.setdefault("model", given(*a)) if "model" not in seen else given(*a))
    results = [sorted((-1 if x["doc_id"] is None else x["doc_id"], round(x["score"], 4)) for x in scoring.scored(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts), group_bytes=1 << 12).collect()) for parts in (1, 4, 9)]
    for other in results[1:]:
        assert all(i == j and abs(a - b) <= 2e-3 * max(1, abs(a)) for (i, a), (j, b) in zip(results[0], other))
    model = seen["model"]
    units = model.units
    counts = Counter()
    for i, t in rows:
        if zlib.crc32(("" if i is None else str(i)).encode()) % 10:
            h, k, _ = scoring.tokens(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))
            counts.update(h.tolist())
    for i, t in rows[:40]:
        h, k, _ = scoring.tokens(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))
        u, total = units.of(h, k), 0.0
        for n, unit in enumerate(u.tolist()):
            before = [u[n - 1] if n else units.size, u[n - 2] if n > 1 else units.size]
            v = sum(model.inputs[x, :-1].astype(float) * model.positions[p, :-1] for p, x in enumerate(before))
            soft = lambda table, pick: float(table[pick, :-1] @ v + table[pick, -1] - np.log(np.exp(table[:, :-1].astype(float) @ v + table[:, -1]).sum()))  # noqa: B023, E731
            total += soft(model.groups, units.cluster[unit])
            if unit < units.top:
                low = unit // scoring.MEMBERS * scoring.MEMBERS
                total += soft(model.outputs[low : min(low + scoring.MEMBERS, units.top)], unit - low)
            else:
                kind = unit - units.top
                total += math.log((counts[int(h[n])] + 0.1) / (units.totals[unit] + 0.1 * (units.kinds[kind] + 1)))
        assert abs(total / math.log(10) - dict(results[0])[i]) < 1e-2 * max(1, abs(total)), i


# -- 9: licences


def test_licenses(spark, docs, empty):
    apache = "Licensed under the Apache License, Version 2.0 (the \"License\");\nyou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\nhttp://x\n"
    data = spark.createDataFrame([(0, apache), (1, "Intro. Released under the MIT License. Licensed under CC BY-NC 4.0.\nmore"), (2, None), (3, "all rights reserved"), (4, "no licence here")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in rows_of(licenses.scanned(data))}
    assert got[0]["licenses"] == "Apache-2.0" and not got[0]["partial"]
    assert got[1]["licenses"] == "CC-BY-NC-4.0,MIT"
    assert got[2]["licenses"] == "" and got[2]["n_sentences"] == 0
    assert got[3]["licenses"] == "" and got[3]["partial"]
    assert got[4]["n_sentences"] == 0
    assert licenses.scanned(docs).count() == len(TEXTS) + 2 and licenses.scanned(empty).count() == 0


def test_every_sentence_and_rule_fires(spark):
    known = list(licenses.SENTENCES.items())
    text_of = {i: s for s, i in known}
    rows = [(k, f"Intro. {s}.\nmore") for k, (s, _) in enumerate(known)] + [(100 + k, "\n".join(text_of[i] + "." for i in seq)) for k, (_, seq) in enumerate(licenses.RULES)]
    got = {r["doc_id"]: r for r in rows_of(licenses.scanned(spark.createDataFrame(rows, "doc_id long, text string")))}
    assert [got[k]["sequence"] for k in range(len(known))] == [i for _, i in known]
    assert [(got[100 + k]["licenses"], got[100 + k]["partial"]) for k in range(len(licenses.RULES))] == [(name, False) for name, _ in licenses.RULES]


@pytest.mark.parametrize("mark", ["", "# ", " * ", "// "])
def test_wrapped_licences(spark, mark):
    text_of = {i: s for s, i in licenses.SENTENCES.items()}
    rows = []
    for k, (_, seq) in enumerate(licenses.RULES):
        wrapped = [textwrap.wrap(("- " if i in ("BSD-source", "BSD-binary") else "") + text_of[i] + ("" if text_of[i][-1] == ":" else "."), 38) for i in seq]
        rows.append((k, "\n".join(mark + line for sentence in wrapped for line in [*sentence, ""])))
    rows.append((99, "MIT License\nReleased under the MIT\n\nLicense.\nall\nrights reserved"))
    rows.append((98, "Licensed under the GNU General Public License, version\n3. " + text_of["BSD-grant"] + "\n1. " + text_of["BSD-source"] + ".\n(b) " + text_of["BSD-binary"]))
    got = {r["doc_id"]: r for r in rows_of(licenses.scanned(spark.createDataFrame(rows, "doc_id long, text string")))}
    assert [(got[k]["licenses"], got[k]["partial"]) for k in range(len(licenses.RULES))] == [(name, False) for name, _ in licenses.RULES]
    assert got[98]["licenses"] == "BSD-2-Clause,GPL-3.0-only"
    assert got[99]["sequence"] == "MIT-title|Reserved"


def hard_licences():
    r = random.Random(2)
    known, sequences = list(licenses.SENTENCES), [seq for _, seq in licenses.RULES]
    text_of = {i: s for s, i in licenses.SENTENCES.items()}
    out = ["Licensed under the MIT License. Licensed under the MIT License.", "MIT License\n\nMIT License", "see: mit license", "MIT Licensed", "x. MIT License; y", "MIT License!? All rights reserved...", "all\nrights reserved", "(a) MIT License\r\n- All rights reserved.\r\n"]
    for _ in range(160):
        parts = [text_of[i] for i in r.choice(sequences)] if r.random() < 0.6 else [r.choice(known) for _ in range(r.randrange(1, 4))]
        marks = [r.choice(["", ".", ".", ";", "!?"]) + r.choice([" ", "\n", "\n\n", "  ", " \n\t", "\n- ", "\n1) "]) for _ in parts]
        text = "".join((x if r.random() < 0.8 else x.upper()) + m for x, m in zip(parts, marks))
        if r.random() < 0.5:
            text = "\n".join(r.choice(["", "# ", " * "]) + line for line in textwrap.wrap(text, r.choice([20, 50, 90]), replace_whitespace=False, break_long_words=False))
        out.append(r.choice(["", "Intro text. ", "word "]) + text)
    return out


def brute_licences(text):
    """Sentences by a walk over the text's boundaries, rules by lists: independent of the operator's and the SQL's patterns."""
    lines = [re.sub(r"^[ \t]*(?:#|//|/\*|\*/|\*|--)*[ \t]*", "", line) for line in text.replace("\r", "").split("\n")]
    flat = "\n".join(lines).lower()
    flat = re.sub(r" ?\n", "\n", re.sub(r"[ \t]+", " ", "\n" + flat).strip(" "))
    flat = re.sub(r"\n(?:[-•]|\(?[0-9a-z]{1,2}\)) ", "\n\n", flat)
    one, at, ids = flat.replace("\n", " "), 0, []
    by_length = sorted(licenses.SENTENCES, key=len, reverse=True)
    while at < len(flat):
        begins = at == 0 or flat[at - 1] == "\n" or (flat[at - 1] == " " and at > 1 and flat[at - 2] in ".;!?")
        for s in by_length if begins else ():
            end = at + len(s)
            tail = flat[end:].lstrip(".;!?")
            closed = not tail or tail[0] == "\n" or (len(tail) < len(flat) - end and tail[0] == " ")
            if one[at:end] == s and closed:
                ids.append(licenses.SENTENCES[s])
                at = end - 1
                break
        at += 1
    rest, names = list(ids), []
    for name, seq in licenses.RULES:
        k = 0
        while k + len(seq) <= len(rest):
            if tuple(rest[k : k + len(seq)]) == seq:
                rest[k : k + len(seq)] = [None]
                names += [name] * (name not in names)
            k += 1
    return len(ids), "|".join(ids), ",".join(names), any(rest)


def test_licences_against_brute_force_and_sql(spark):
    import duckdb

    rows = list(enumerate(hard_licences()))
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    columns = ("n_sentences", "sequence", "licenses", "partial")
    by_sql = {r[0]: r[1:] for r in con.execute(f"SELECT doc_id, {', '.join(columns)} FROM ({licenses.sql()})").fetchall()}
    by_spark = {r["doc_id"]: tuple(r[c] for c in columns) for r in licenses.scanned(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        assert by_spark[i] == brute_licences(text), text
        assert by_sql[i] == by_spark[i], text
    assert by_spark[0][2:] == ("MIT", False)


# -- 10: pieces


@pytest.fixture(scope="module")
def table():
    import public_tokenizers

    return pieces.Pieces(pieces.read_pieces(public_tokenizers.path("piece_bpe_32k.model")))


def live_pieces(table):
    return {s.replace(b" ", pieces.MARKER.encode()).decode(): i for i, s in enumerate(table.surface) if i > 258}


def best_score(table, live, text):
    """The exhaustive path: best score over all segmentations, by plain dynamic programming."""
    body = text.replace(" ", pieces.MARKER)
    best = [0.0] + [-math.inf] * len(body)
    for b in range(1, len(body) + 1):
        for a in range(max(0, b - 48), b):
            i = live.get(body[a:b])
            if i is not None:
                best[b] = max(best[b], best[a] + float(table.scores[i]))
        if body[b - 1] not in live:
            best[b] = max(best[b], best[b - 1] + table.unknown)
    return best[-1]


def path_score(table, ids):
    """The score of ids: a character in byte pieces counts once, as unknown."""
    total = 0.0
    for i in ids:
        if not table.is_byte[i]:
            total += float(table.scores[i])
        elif table.surface[i][0] & 0xC0 != 0x80:
            total += table.unknown
    return total


def test_pieces(table):
    live = live_pieces(table)
    known = [t[:200] for t in TEXTS if t][:20] + ["  a  b ", "日本語 漢字🙂 é", "x\n\ny"]
    long = ["日本語のテキストと漢字🙂" * 40, prose(200).replace(" ", ""), "international" * 90 + "é🙂\x00" * 30, "a" * 2000]
    for t in known + long:
        ids = np.frombuffer(table.encode([t])[0], "<u4")
        assert table.decode(ids.tobytes()) == t
        if "\n" not in t and "▁" not in t:
            assert abs(path_score(table, ids) - best_score(table, live, " " + t)) < 1e-6, t


def test_scores_are_log_probabilities(table):
    assert abs(sum(math.exp(s) for p, s in zip(table.surface, table.scores.tolist()) if s < 0) - 1) < 1e-6
    shown = lambda t: [table.surface[i].decode() for i in np.frombuffer(table.encode([t])[0], "<u4")]
    assert shown("the international communities are playing") == [" the", " international", " communities", " are", " playing"]


def test_a_megabyte_without_blanks(table):
    begun = time.process_time()
    text = ("日本語のテキスト🙂" * 40 + prose(300).replace(" ", "")) * 400
    assert len(text.encode()) > 1 << 20
    assert table.decode(table.encode([text])[0]) == text
    assert time.process_time() - begun < 60


def test_pieces_query(docs, empty):
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    assert all(r["round_trip"] for r in rows_of(pieces.report(docs, path)))
    back = pieces.decoded(pieces.encoded(docs, path), path)
    assert Counter((r["doc_id"], r["text"]) for r in rows_of(back)) == Counter((i, t or "") for i, t in source(docs))
    assert pieces.report(empty, path).count() == 0
