"""Differences between two copies of a table by set reconciliation.

Rows become 60-bit hashes in hash buckets of about BUCKET_ROWS rows. Each side
evaluates the characteristic polynomial of every bucket, prod (z - hash) over
GF(2**61 - 1), at a few points; only these sketches meet. The ratio of the two
polynomials is a rational function whose degree is the number of differing
rows: it is interpolated under a degree bound, verified at spare points, and
the bound doubles for the buckets that fail. Its zeros and poles are the hashes
of the differing rows, which are then fetched and compared field by field.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataq.common import stash, tasks
from strataq.functions.modular import P, mulmod, rational, roots, segment_products, value  # noqa: F401

HASH_BITS = 60
BUCKET_ROWS = 32
FIRST_DEGREE = 4
#: Buckets one task solves at most, about; what a task holds at once does not depend on it.
BUCKETS_PER_TASK = 20_000
SPARE_POINTS = 2  # a wrong interpolation passes both with a chance below 2**-110


def _points(m: int) -> list[int]:
    """Evaluation points above every hash, so that no factor is zero."""
    return [(1 << HASH_BITS) + 7919 * (i + 1) for i in range(m)]


def text_key(c: Column) -> Column:
    """A column's part in a hash; a null differs from every value."""
    return F.coalesce(F.concat(F.lit("v"), c.cast("string")), F.lit("n"))


def with_hashes(rows: DataFrame, key: Sequence[str], fields: Sequence[str], buckets: int) -> DataFrame:
    return rows.select(
        F.pmod(F.xxhash64(F.lit(17), *[text_key(F.col(c)) for c in key]), F.lit(buckets)).alias("bucket"),
        F.xxhash64(F.lit(29), *[text_key(F.col(c)) for c in [*key, *fields]]).bitwiseAND(F.lit((1 << HASH_BITS) - 1)).alias("hash"),
        *key,
        *fields,
    )


def sketches(side: DataFrame, which: int, points: int) -> DataFrame:
    """(bucket, side, size, e): products per bucket. side comes sorted by bucket within its files, so a bucket gives one
    row, and one more where a file is cut between two tasks; parts meet in solve()."""
    zs = np.array(_points(points), dtype=np.uint64)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_ = None  # bucket, size and product that may go on in the next batch
        for b in batches:
            if not len(b):
                continue
            factors = zs[None, :] - b["hash"].to_numpy().astype(np.uint64)[:, None]
            keys = b["bucket"].to_numpy()
            names, size = np.unique(keys, return_counts=True)
            _, e = segment_products(keys, factors)
            if open_ is not None:
                at = int(np.searchsorted(names, open_[0]))
                if at < len(names) and names[at] == open_[0]:
                    size[at] += open_[1]
                    e[at] = mulmod(e[at], open_[2])
                else:
                    names, size, e = np.r_[names, open_[0]], np.r_[size, open_[1]], np.vstack([e, open_[2]])
            last = int(np.flatnonzero(names == keys[-1])[0])
            open_ = (names[last], size[last], e[last].copy())
            rest = np.arange(len(names)) != last
            if rest.any():
                yield pd.DataFrame({"bucket": names[rest], "side": which, "size": size[rest], "e": list(e[rest].astype(np.int64))})
        if open_ is not None:
            yield pd.DataFrame({"bucket": [open_[0]], "side": which, "size": [open_[1]], "e": [open_[2].astype(np.int64)]})

    return side.select("bucket", "hash").mapInPandas(run, "bucket long, side int, size long, e array<long>")


def _solve_bucket(a: np.ndarray | None, na: int, b: np.ndarray | None, nb: int, degree: int, zs: list[int]) -> tuple[list[int], list[int]] | None:
    """The hashes only in a and only in b; None when the degree bound does not do."""
    m = len(zs)
    ea = [1] * m if a is None else [int(x) for x in a]
    eb = [1] * m if b is None else [int(x) for x in b]
    if na == nb and ea == eb:
        return [], []
    gap = na - nb
    if abs(gap) > degree:
        return None
    da, db = min(na, (degree + gap) // 2), 0
    db = da - gap
    ratios = [x * pow(y, P - 2, P) % P for x, y in zip(ea, eb)]
    found = rational(zs, ratios, da, db)
    if found is None:
        return None
    f, g = found
    if any(value(f, z) != r * value(g, z) % P for z, r in zip(zs[da + db :], ratios[da + db :])):
        return None
    ra, rb = roots(f), roots(g)
    if ra is None or rb is None or any(x >> HASH_BITS for x in [*ra, *rb]):
        return None
    return ra, rb


def solve(parts: DataFrame, degree: int, buckets: int) -> DataFrame:
    """(bucket, side, hash): side 0/1 for a row only there, -1 for a bucket that needs a higher bound.

    Sketches come sorted by bucket and are solved as they come: a task holds one
    batch and the bucket that may go on in the next.
    """
    zs = _points(degree + SPARE_POINTS)

    def solved(bucket: int, rows: list[tuple[int, int, np.ndarray]]) -> list[tuple[int, int, int]]:
        e: list[np.ndarray | None] = [None, None]
        n = [0, 0]
        for which, size, product in rows:
            n[which] += size
            e[which] = product if e[which] is None else mulmod(e[which], product)
        got = _solve_bucket(e[0], n[0], e[1], n[1], degree, zs)
        return [(bucket, -1, 0)] if got is None else [(bucket, 0, h) for h in got[0]] + [(bucket, 1, h) for h in got[1]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bucket, held = None, []
        for b in batches:
            out: list[tuple[int, int, int]] = []
            for k, which, size, e in zip(b["bucket"], b["side"], b["size"], b["e"]):
                if k != bucket:
                    if held:
                        out += solved(bucket, held)
                    bucket, held = k, []
                held.append((which, size, np.asarray(e, dtype=np.int64).astype(np.uint64)))
            yield pd.DataFrame(out, columns=["bucket", "side", "hash"])
        if held:
            yield pd.DataFrame(solved(bucket, held), columns=["bucket", "side", "hash"])

    # sketches are small but costly to solve: their number sets that of the partitions, not their bytes
    n = max(tasks(parts.sparkSession), -(-buckets // BUCKETS_PER_TASK))
    return parts.repartition(n, "bucket").sortWithinPartitions("bucket").mapInPandas(run, "bucket long, side int, hash long")


def differing_hashes(a: DataFrame, b: DataFrame, buckets: int) -> DataFrame:
    """(bucket, side, hash) of the rows that only one side has. a, b: written tables with bucket and hash, in that order."""
    degree, found, left = FIRST_DEGREE, None, None
    while True:
        sides = [(a, 0), (b, 1)]
        if left is not None:
            sides = [(s.join(left, "bucket", "left_semi"), w) for s, w in sides]
        parts = sketches(*sides[0], degree + SPARE_POINTS).unionByName(sketches(*sides[1], degree + SPARE_POINTS))
        step = stash(solve(parts, degree, buckets), "reconciled")
        done = step.where("side >= 0")
        found = done if found is None else found.unionByName(done)
        left = step.where("side < 0").select("bucket")
        buckets = left.count()
        if not buckets:
            return found
        degree *= 2


def differences(left: DataFrame, right: DataFrame, key: Sequence[str], fields: Sequence[str], names: tuple[str, str], rows: int | None = None) -> DataFrame:
    """(key..., kind, field_name, left_value, right_value) of two tables with one row per key.

    kind is only_<name> with an empty field_name, or differs with one row per
    differing field; null equals null. Two empty tables give no rows; one empty
    table makes every row of the other an only_ row. rows, about the number of
    rows of the larger side, sets the number of buckets; without it they are counted.
    """
    rows = max(left.count(), right.count()) if rows is None else rows
    buckets = max(1, rows // BUCKET_ROWS)
    sides = [stash(with_hashes(d, key, fields, buckets).repartition("bucket").sortWithinPartitions("bucket"), "side") for d in (left, right)]
    hashes = differing_hashes(*sides, buckets)
    rest = []
    for i, (d, mark) in enumerate(zip(sides, "lr")):
        got = d.join(hashes.where(F.col("side") == i).select("bucket", "hash"), ["bucket", "hash"], "left_semi")
        rest.append(got.select(*[F.col(c).alias(f"{mark}_{c}") for c in [*key, *fields]], F.lit(True).alias(f"{mark}_here")))
    cond = F.col(f"l_{key[0]}").eqNullSafe(F.col(f"r_{key[0]}"))
    for c in key[1:]:
        cond = cond & F.col(f"l_{c}").eqNullSafe(F.col(f"r_{c}"))
    both = rest[0].join(rest[1], cond, "full_outer")
    here, there = F.col("l_here").isNotNull(), F.col("r_here").isNotNull()
    nothing = F.lit(None).cast("string")
    verdict = (
        F.when(~there, F.array(F.struct(F.lit(f"only_{names[0]}").alias("kind"), F.lit("").alias("field_name"), nothing.alias("left_value"), nothing.alias("right_value"))))
        .when(~here, F.array(F.struct(F.lit(f"only_{names[1]}").alias("kind"), F.lit("").alias("field_name"), nothing.alias("left_value"), nothing.alias("right_value"))))
        .otherwise(
            F.filter(
                F.array(*[F.struct(F.when(F.col(f"l_{c}").eqNullSafe(F.col(f"r_{c}")), F.lit(None)).otherwise(F.lit("differs")).alias("kind"), F.lit(c).alias("field_name"), F.col(f"l_{c}").cast("string").alias("left_value"), F.col(f"r_{c}").cast("string").alias("right_value")) for c in fields]),
                lambda x: x["kind"].isNotNull(),
            )
        )
    )
    return both.select(*[F.when(here, F.col(f"l_{c}")).otherwise(F.col(f"r_{c}")).alias(c) for c in key], F.explode(verdict).alias("v")).select(*key, "v.*")
