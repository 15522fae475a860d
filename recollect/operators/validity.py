"""What was true when: activity and status as of a date, supersession links, as-of joins."""

from __future__ import annotations

from collections.abc import Callable
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Words that say that something may change.
CHANGING = (
    r"(?i)\b(rent|lease|salary|wage|lives?\s+in|moved\s+to|relocated|employer|works?\s+at|job|role|married|divorced|prefer"
    r"|switched\s+to|raised|became|changed|now\s+|currently|notify|notification|breach|liability|cap|timeout)\b"
)
#: Words of one side of life, and the token that stands for it beside them: facts about the same side are more alike.
ASPECTS = {
    "home": ("live", "lives", "lived", "living", "moved", "moving", "relocated", "resides", "rent", "lease", "apartment"),
    "work": ("work", "works", "working", "job", "role", "employer", "salary", "wage", "hired", "promoted"),
    "family": ("married", "divorced", "engaged", "widowed"),
    "taste": ("prefer", "prefers", "favorite", "favourite", "switched"),
}

#: Rows up to which a bucket is compared as one block, values that a block of vectors may hold beyond it, the time of undated rows.
BLOCK, MOST = 4096, 1 << 22
LAST = (1 << 63) - 1


def aspect_tokens(tokens: Column) -> Column:
    """The tokens, and twice each aspect that they touch."""
    touched = [F.when(F.arrays_overlap(tokens, F.array(*map(F.lit, words))), F.lit("@" + name)) for name, words in ASPECTS.items()]
    found = F.filter(F.array(*touched), lambda a: a.isNotNull())
    return F.concat(tokens, found, found)


def active(as_of: Column, ts: Column, superseded_by: Column, valid_to: Column, history: bool = False) -> Column:
    """Whether a fact may be evidence on a date (NULL: now). A NULL timestamp is never in the future."""
    not_later = F.coalesce(ts <= as_of, F.lit(True))
    if history:
        return not_later
    open_ = F.coalesce(valid_to > as_of, F.lit(True)) & ~((superseded_by != "") & valid_to.isNull())
    return F.when(as_of.isNull(), superseded_by == "").otherwise(not_later & open_)


def status(as_of: Column, ts: Column, superseded_by: Column, valid_to: Column) -> Column:
    closed = (superseded_by != "") & F.coalesce(valid_to <= as_of, F.lit(True))
    return F.when(ts > as_of, "historical").when(closed, "superseded").otherwise("current")


def supersessions(new: DataFrame, old: DataFrame, threshold: float = 0.78, sure: float = 0.88, block: int = BLOCK) -> DataFrame:
    """(old_id, new_id, valid_to): each new fact closes the most similar older one, each old fact is closed once.

    Both sides: (fact_id, pos, ts, unit, tags, changing, bucket): unit vector, array of entities, flag. Pairs meet within a
    bucket (a topic, an owner); a pair under `sure` needs a shared entity or two changing facts. Ties go to the later row.

    A bucket of more than `block` rows is dealt by hash to blocks, and each pair of a block of new and one of old facts is
    compared by matrix products (best_older); only the best old fact of each new one leaves it."""
    names = ["fact_id", "pos", "ts", "unit", "tags", "changing", "bucket"]
    # each side's own columns, as both may be one table
    sides = [side.select(*[F.col(c).alias(c) for c in names], F.size("unit").alias("dim")).where("bucket is not null and fact_id is not null and dim > 0") for side in (new, old)]
    # more blocks than 8 only where they would grow beyond MOST values
    most = F.greatest(F.lit(block), F.floor(F.lit(MOST) / F.col("dim")))
    blocks = F.ceil(F.col("n") / F.least(F.greatest(F.ceil(F.col("n") / 8), F.lit(block)), most)).cast("int")
    large = [side.groupBy("bucket", "dim").agg(F.count("*").alias("n")).where(F.col("n") > block).select("bucket", "dim", blocks.alias(c)) for side, c in zip(sides, ("xs", "ys"), strict=True)]
    grid = F.broadcast(large[0].join(large[1], ["bucket", "dim"], "full"))  # a row per bucket of more than `block` rows

    def dealt(side: DataFrame, own: str, other: str) -> DataFrame:
        rows = side.join(grid, ["bucket", "dim"], "left").withColumns({c: F.coalesce(c, F.lit(1)) for c in ("xs", "ys")})
        return rows.withColumns({own: F.pmod(F.xxhash64("fact_id"), F.col(own + "s")).cast("int"), other: F.explode(F.sequence(F.lit(0), F.col(other + "s") - 1))}).drop("xs", "ys").alias(own).groupBy("bucket", "dim", "x", "y")

    kind = {c: side.schema[c].dataType.simpleString() for side, c in ((sides[0], "fact_id"), (sides[0], "ts"))} | {"old": sides[1].schema["fact_id"].dataType.simpleString()}
    schema = f"new_id {kind['fact_id']}, new_pos long, new_ts {kind['ts']}, old_id {kind['old']}, old_pos long, score double"
    pairs = dealt(sides[0], "x", "y").cogroup(dealt(sides[1], "y", "x")).applyInArrow(lambda n, o: best_older(n, o, threshold, sure), schema)
    best = pairs.groupBy("new_id").agg(F.max(F.struct("score", "old_pos", "old_id", "new_pos", "new_ts")).alias("b")).select("new_id", "b.*")
    once = Window.partitionBy("old_id").orderBy(F.col("new_ts").desc_nulls_last(), F.when(F.col("new_ts").isNull(), -F.col("new_pos")).otherwise(F.col("new_pos")).desc())
    return best.withColumn("_o", F.row_number().over(once)).where("_o = 1").select("old_id", "new_id", F.col("new_ts").alias("valid_to"))


def half_up(x: np.ndarray) -> np.ndarray:
    """Rounded to six digits as Spark's round() does: half up on the shortest decimals."""
    shifted = x * 1e6
    whole = np.floor(shifted + 0.5)
    out = np.where(np.abs(shifted) < 1 << 52, whole / 1e6, x)
    for i in np.flatnonzero(np.abs(shifted + 0.5 - np.rint(shifted + 0.5)) < 1e-5):
        out[i] = float(Decimal(repr(float(x[i]))).quantize(Decimal("0.000001"), ROUND_HALF_UP))
    return out


def best_older(new: pa.Table, old: pa.Table, threshold: float, sure: float, rows: int = 256, columns: int = 2048) -> pa.Table:
    """For each new fact its best older one of this table. Products in single precision leave the pairs that can be best within
    their error; these are scored in double precision, term by term, and rounded, as SQL does."""
    lists = [t.column("unit").combine_chunks() for t in (new, old)]
    vectors = [pc.fill_null(u.flatten().cast(pa.float64()), np.inf).to_numpy().reshape(len(u), -1) for u in lists]
    full = [np.bincount(pc.list_parent_indices(u).to_numpy(), u.flatten().is_null().to_numpy(zero_copy_only=False), len(u)) == 0 if len(u) else np.zeros(0, bool) for u in lists]
    when = [t.column("ts").combine_chunks() for t in (new, old)]
    undated = [w.is_null().to_numpy(zero_copy_only=False) for w in when]
    time = [pc.fill_null((w.cast(pa.int32()) if pa.types.is_date32(w.type) else w).cast(pa.int64()), LAST).to_numpy() for w in when]
    # rows by time, undated ones last; a row with an empty component has no score
    order = [np.flatnonzero(f)[np.argsort(t[f], kind="stable")] for f, t in zip(full, time, strict=True)]
    (nu, ou), (nt, ot) = ([x[o] for x, o in zip(xs, order, strict=True)] for xs in (vectors, time))
    if not len(nu) or not len(ou):
        return pa.table({"new_id": new.column("fact_id").slice(0, 0), "new_pos": pa.array([], pa.int64()), "new_ts": new.column("ts").slice(0, 0), "old_id": old.column("fact_id").slice(0, 0), "old_pos": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
    change = [pc.fill_null(t.column("changing").combine_chunks(), False).to_numpy(zero_copy_only=False)[o] for t, o in zip((new, old), order, strict=True)]
    opos = old.column("pos").cast(pa.int64()).to_numpy()[order[1]]
    ids = pa.chunked_array([*new.column("fact_id").chunks, *old.column("fact_id").cast(new.column("fact_id").type).chunks]).combine_chunks().dictionary_encode().indices.to_numpy()
    nid, oid = ids[: len(new)][order[0]], ids[len(new) :][order[1]]
    shares = _sharing(new.column("tags").combine_chunks().take(pa.array(order[0])), old.column("tags").combine_chunks().take(pa.array(order[1])))

    reach = np.where(nt == LAST, len(ou), np.searchsorted(ot, nt))  # the old rows before this place are older
    with np.errstate(all="ignore"):
        n32, o32 = nu.astype(np.float32), np.ascontiguousarray(ou.astype(np.float32).T)
        slack = 1e-6 + (nu.shape[1] + 4) * 2.0**-23 * float(np.sqrt((nu * nu).sum(axis=1).max() * (ou * ou).sum(axis=1).max()))
        score, place = np.full(len(nu), np.nan), np.full(len(nu), -1)
        for a in range(0, len(nu), rows):
            end, least = min(a + rows, len(nu)), np.full(min(rows, len(nu) - a), -np.inf)
            for c in range(0, int(reach[a:end].max()), columns):
                s = n32[a:end] @ o32[:, c : c + columns]
                i, j = np.nonzero(~(s < threshold - slack))
                v, i, j = s[i, j].astype(np.float64), i + a, j + c
                ok = (j < reach[i]) & (nid[i] != oid[j])
                v, i, j = v[ok], i[ok], j[ok]
                free = (change[0][i] & change[1][j]) | shares(i, j)
                certain = (v >= threshold + slack) & (free | (v >= sure + slack))
                np.maximum.at(least, i[certain] - a, v[certain])
                may = (free | ~(v < sure - slack)) & ~(v < least[i - a] - 2 * slack)
                i, j, free = i[may], j[may], free[may]
                for k in range(0, len(i), 1 << 14):
                    x, y = i[k : k + (1 << 14)], j[k : k + (1 << 14)]
                    exact = half_up(np.cumsum(nu[x] * ou[y], axis=1)[:, -1])
                    ok = ~(exact < threshold) & (free[k : k + (1 << 14)] | ~(exact < sure))
                    x, y, exact = x[ok], y[ok], exact[ok]
                    rank = np.where(np.isnan(exact), np.inf, exact)  # not a number counts as the largest
                    last = np.lexsort((opos[y], rank, x))
                    last = last[np.append(x[last][1:] != x[last][:-1], True)] if len(last) else last
                    x, y, exact, rank = x[last], y[last], exact[last], rank[last]
                    before = np.where(np.isnan(score[x]), np.inf, score[x])
                    better = (place[x] < 0) | (rank > before) | ((rank == before) & (opos[y] > opos[place[x]]))
                    score[x[better]], place[x[better]] = exact[better], y[better]
    at = np.flatnonzero(place >= 0)
    n, o = pa.array(order[0][at]), pa.array(order[1][place[at]])
    return pa.table({"new_id": new.column("fact_id").take(n), "new_pos": new.column("pos").cast(pa.int64()).take(n), "new_ts": new.column("ts").take(n), "old_id": old.column("fact_id").take(o), "old_pos": old.column("pos").cast(pa.int64()).take(o), "score": pa.array(score[at])})


def _sharing(new: pa.ListArray, old: pa.ListArray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Whether rows i of new and j of old have a tag in common: by bits, and by look-up where there are more tags than bits."""
    code = pa.chunked_array([new.flatten(), old.flatten()]).combine_chunks().dictionary_encode()
    tags = pc.fill_null(code.indices, -1).to_numpy().astype(np.int64)
    owner = [pc.list_parent_indices(x).to_numpy() for x in (new, old)]
    mine, other = tags[: len(owner[0])], tags[len(owner[0]) :]
    bits = []
    for side, own, values in zip((new, old), owner, (mine, other), strict=True):
        mask = np.zeros(len(side), np.uint64)
        np.bitwise_or.at(mask, own[values >= 0], np.uint64(1) << (values[values >= 0] % 64).astype(np.uint64))
        bits.append(mask)
    many = len(code.dictionary)
    held = np.unique(owner[1][other >= 0] * many + other[other >= 0]) if many > 64 else None
    own, mine = owner[0][mine >= 0], mine[mine >= 0]
    starts = np.searchsorted(own, np.arange(len(new) + 1))

    def run(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = (bits[0][i] & bits[1][j]) != 0
        if held is not None and out.any():
            at = np.flatnonzero(out)
            lengths = starts[i[at] + 1] - starts[i[at]]
            pair = np.repeat(at, lengths)
            nth = np.arange(len(pair)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            key = j[pair] * many + mine[np.repeat(starts[i[at]], lengths) + nth]
            found = held[np.minimum(np.searchsorted(held, key), len(held) - 1)] == key
            out = np.bincount(pair[found], minlength=len(i)) > 0
        return out

    return run


def as_of_join(questions: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """Each question (key, asked) with the fact of its key in force then: the intervals of a key don't overlap, so it is an
    equality on the key with a range filter."""
    f = facts.alias("f")
    q = questions.alias("q")
    return q.join(f, (F.col(f"q.{key}") == F.col(f"f.{key}")) & (F.col("f.ts") <= F.col("q.asked")) & (F.col("f.valid_to").isNull() | (F.col("f.valid_to") > F.col("q.asked"))), "left")
