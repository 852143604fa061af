"""Embedding near-duplicates by collision-counting projections.

Vectors are set to length one and projected on PROJECTIONS random lines. On a line, two of them at distance d lie a normal
deviate of size d apart, so each line's window about a query catches the other with a known chance, and the number of
lines that do is binomial. `calibrated` takes the count that a pair at the threshold reaches with the recall asked for, and
the width of window at which fewest other pairs reach it. Pairs of that count are verified by cosine in double precision.

1. Equal vectors of a label are one from the start, with a weight: a vector that is very common is one row.
2. A label (and length of vector) with more than BLOCK vectors is cut at the median of one more projection, again and
   again while that helps. Vectors above the cut by no more than a window of ROUTE standard deviations are copied to the
   lower part, with a bit that says so; two vectors are compared where they are not both copies at one level, which is in
   one part alone. So a third of all rows under one label are many parts.
3. What can't be cut (a dense group of near copies) is dealt into tiles, and pairs of tiles are compared. In each pair the
   projections are sorted, windows are ranges of the sorted lines, and collisions are counted in a matrix. Links are
   counted, never emitted: out come a row per vector with its number of links, and links enough to connect what is linked.
4. Connected components of those; a vector's links are the weights of those it is linked to and the others equal to it.

Recall at the threshold: RECALL for the count, and about 0.3 % less for each level of cuts that a label needs; higher for
closer pairs. No pair below the threshold is a link.

Defined results: vectors null, empty, zero, or with null or non-finite components, and those with a null label, link with
nothing and are their own component; vectors of different lengths don't link; repeated rows link to each other; a null
vec_id is never a component's id unless all its vectors have none; kept compares null-safely; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_table, only, table, table_path, written
from .op4_jaccard import components

THRESHOLD = 0.98
RECALL = 0.9995
PROJECTIONS = 48
BLOCK = 2048
LEVELS = 24
ROUTE = 2.5
SEED = 20_240_103
STEP = 256  # queries whose windows are counted at once
GROUP = ["label", "dims", "path"]

ORACLE_SQL = """
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS k, vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e,
         label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
           AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS valid
  FROM embeddings
), l AS (
  SELECT a.k AS a, b.k AS b FROM v a JOIN v b ON a.valid AND b.valid AND a.label = b.label AND a.k <> b.k AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.98
), r AS (
  SELECT k, k AS other FROM v
  UNION
  SELECT r.k, l.b FROM r JOIN l ON l.a = r.other
), c AS (SELECT r.k, min(w.vec_id) AS component_id FROM r JOIN v w ON w.k = r.other GROUP BY r.k
), n AS (SELECT a AS k, count(*) AS n FROM l GROUP BY a)
SELECT v.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, c.component_id, v.vec_id IS NOT DISTINCT FROM c.component_id AS kept
FROM v JOIN c ON c.k = v.k LEFT JOIN n ON n.k = v.k
"""


def within(width: float, cosine: float) -> float:
    """Chance that the projections of two unit vectors of this cosine lie no further apart."""
    return math.erf(width / math.sqrt(2 - 2 * cosine) / math.sqrt(2)) if cosine < 1 else 1.0


def at_least(chance: float, lines: int) -> np.ndarray:
    """Chance of k or more of the lines, for k from 0 to lines + 1."""
    each = [math.comb(lines, k) * chance**k * (1 - chance) ** (lines - k) for k in range(lines + 1)]
    return np.append(np.cumsum(each[::-1])[::-1], 0.0)


def calibrated(threshold: float = THRESHOLD, recall: float = RECALL, lines: int = PROJECTIONS, noise: float = 0.7) -> tuple[float, int]:
    """Half the width of windows and the count with the recall at the threshold that fewest pairs of cosine `noise` reach."""
    spread, best = math.sqrt(2 - 2 * threshold), (2.0, 0.0, 0)
    for k in range(2, 31):
        width = spread * k / 10
        count = int(np.flatnonzero(at_least(within(width, threshold), lines) >= recall)[-1])
        best = min(best, (float(at_least(within(width, noise), lines)[count]), width, count))
    return best[1], best[2]


def directions(dims: int, first: int, lines: int) -> np.ndarray:
    """Random lines, alike wherever they are made: the first lines route, the others count."""
    return np.random.default_rng([SEED, dims, first]).standard_normal((dims, lines))


def units(vectors) -> np.ndarray:
    """Vectors of length one in double precision; scaled by their largest component first, so that squares don't overflow."""
    x = np.stack([np.asarray(v, np.float64) for v in vectors])
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def collisions(a: np.ndarray, b: np.ndarray, width: float) -> np.ndarray:
    """How many windows about projections of a hold those of b, for all pairs: a column each in sorted order."""
    hits = np.zeros(len(a) * len(b), np.uint8 if a.shape[1] < 256 else np.uint16)
    base = np.arange(len(a)) * len(b)
    for line in range(a.shape[1]):
        order = np.argsort(b[:, line])
        held = b[order, line]
        low, high = np.searchsorted(held, a[:, line] - width), np.searchsorted(held, a[:, line] + width, "right")
        many = high - low
        inside = np.arange(many.sum()) + np.repeat(low - np.cumsum(many) + many, many)
        hits[np.repeat(base, many) + order[inside]] += 1
    return hits.reshape(len(a), len(b))


def linked(a: np.ndarray, b: np.ndarray, copied_a: np.ndarray, copied_b: np.ndarray, same: bool, threshold: float, width: float, count: int, lines: int) -> np.ndarray:
    """Which unit vectors of a and b are linked; same: a is b, and only pairs above the diagonal count."""
    to = directions(a.shape[1], 1, lines)
    pa, pb = a @ to, b @ to
    out = np.zeros((len(a), len(b)), bool)
    for k in range(0, len(a), STEP):
        could = collisions(pa[k : k + STEP], pb, width) >= count
        if copied_a.any() and copied_b.any():
            could &= (copied_a[k : k + STEP, None] & copied_b[None, :]) == 0
        if same:
            could &= np.arange(k, k + len(could))[:, None] < np.arange(len(b))[None, :]
        i, j = np.nonzero(could)
        for at in range(0, len(i), 1 << 16):
            x, y = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
            ok = np.einsum("ij,ij->i", a[k + x], b[y]) >= threshold
            out[k + x[ok], y[ok]] = True
    return out


def tree(adjacent: np.ndarray) -> list[tuple[int, int]]:
    """Links (row, column) enough to connect what the matrix connects."""
    other, out = np.ascontiguousarray(adjacent.T), []
    rows, columns = np.ones(len(adjacent), bool), np.ones(len(other), bool)
    for start in np.flatnonzero(adjacent.any(1)).tolist():
        if not rows[start]:
            continue
        rows[start], waiting = False, [start]
        while waiting:
            r = waiting.pop()
            new = np.flatnonzero(adjacent[r] & columns)
            columns[new] = False
            for c in new.tolist():
                out.append((r, c))
                more = np.flatnonzero(other[c] & rows)
                rows[more] = False
                out += [(x, c) for x in more.tolist()]
                waiting += more.tolist()
    return out


def classes_of(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All rows (vec_id, label, h1, h2; the last two null where a row takes no part), and a row for each different vector
    of a label: id, label, h1, h2, first_id, weight, dims, embedding. Both are written."""
    given = only(vectors, "vec_id", "embedding", "label")
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    able = F.coalesce(F.col("label").isNotNull() & fine, F.lit(False))
    keys = {"h1": F.when(able, F.xxhash64("embedding")), "h2": F.when(able, F.xxhash64(F.lit(1), F.col("embedding")))}
    keyed = given.withColumns(keys)
    rows = written(keyed.select("vec_id", "label", "h1", "h2"), "rows")
    same = keyed.where("h1 is not null").groupBy("label", "h1", "h2").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("weight"), F.first("embedding").alias("embedding"))
    numbered = same.select(F.monotonically_increasing_id().alias("id"), "*", F.size("embedding").alias("dims"))
    return rows, written(numbered, "classes")


def routed(classes: DataFrame, block: int, levels: int, window: float) -> tuple[list[DataFrame], list[DataFrame]]:
    """The classes in groups of about `block` at most where projections can part them: label, dims, path, id, copied (a bit
    for each level at which a row is a copy), weight and embedding. Also the written tables that hold them."""
    spark = classes.sparkSession

    @F.pandas_udf("array<double>")
    def projected(embedding: pd.Series) -> pd.Series:
        out = np.empty(len(embedding), object)
        size = embedding.map(len).to_numpy()
        for n in np.unique(size):
            at = np.flatnonzero(size == n)
            for k, p in zip(at, units(embedding.iloc[at]) @ directions(int(n), 0, levels), strict=True):
                out[k] = p
        return pd.Series(out)

    state = classes.select("label", "dims", F.lit("").alias("path"), "id", F.lit(0).cast("long").alias("copied"), "weight", "embedding")
    crowded = classes.groupBy("label", "dims").count().where(F.col("count") > block)
    if crowded.isEmpty():
        return [state], []
    state = state.withColumn("lines", projected("embedding"))
    done, tables = [], []
    for level in range(levels):
        p = F.col("lines")[level]
        groups = state.groupBy(*GROUP).agg(F.count("*").alias("n"), F.percentile_approx(p, [0.5, 0.9], 1000).alias("q")).where(F.col("n") > block)
        groups = groups.select(*GROUP, F.col("q")[0].alias("cut"), (F.col("q")[1] > F.col("q")[0] + window).alias("parts"))
        lower = F.struct(F.concat("path", F.lit("0")).alias("path"), F.when(p > F.col("cut"), F.col("copied") + (1 << level)).otherwise(F.col("copied")).alias("copied"))
        upper = F.struct(F.concat("path", F.lit("1")).alias("path"), "copied")
        stays = F.array(F.struct("path", "copied"))
        split = F.when(p <= F.col("cut"), F.array(lower)).when(p <= F.col("cut") + window, F.array(lower, upper)).otherwise(F.array(upper))
        dealt = state.join(groups, GROUP, "left").withColumn("to", F.explode(F.when(F.col("parts"), split).otherwise(stays)))
        dealt = dealt.select("label", "dims", "to.path", "id", "to.copied", "weight", "embedding", "lines", F.col("cut").isNotNull().alias("open"))
        path = table_path(spark, "routed")
        dealt.write.partitionBy("open").option("compression", "zstd").parquet(path)
        dealt = spark.read.schema(dealt.schema).parquet(path)
        tables.append(dealt)
        done.append(dealt.where("not open").drop("lines", "open"))
        state = dealt.where("open").drop("open")
        if state.isEmpty():
            break
    else:
        done.append(state.drop("lines"))
    return done, tables


def links_of(groups: DataFrame, block: int, threshold: float, recall: float, lines: int) -> DataFrame:
    """id, links (the weight of all linked to it) and, for links enough to connect what is linked, id and other."""
    width, count = calibrated(threshold, recall, lines)

    def compare(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        side = rows["side"].to_numpy() == 1
        same = key[-1] == key[-2]
        part = lambda at: (rows["id"].to_numpy(np.int64)[at], rows["weight"].to_numpy(np.int64)[at], rows["copied"].to_numpy(np.int64)[at], units(rows["embedding"].to_numpy()[at]))
        none = pd.DataFrame({"id": pd.array([], "Int64"), "other": pd.array([], "Int64"), "links": pd.array([], "Int64")})
        if len(rows) < 2 or not same and (side.all() or not side.any()):
            return none
        ids, weight, copied, x = part(~side)
        other_ids, other_weight, other_copied, y = (ids, weight, copied, x) if same else part(side)
        links = linked(x, y, copied, other_copied, same, threshold, width, count, lines)
        if not links.any():
            return none
        own, others = links @ other_weight, links.T @ weight
        n = pd.concat([pd.Series(own, ids), pd.Series(others, other_ids)])
        n = n[n > 0]
        pairs = tree(links)
        a, b = ids[[i for i, _ in pairs]], other_ids[[j for _, j in pairs]]
        return pd.DataFrame({"id": pd.array([*n.index, *a], "Int64"), "other": pd.array([*[None] * len(n), *b], "Int64"), "links": pd.array([*n, *[0] * len(a)], "Int64")})

    sizes = groups.groupBy(*GROUP).agg(F.count("*").alias("n")).where("n > 1")
    tiles = F.ceil(F.col("n") / block).cast("int")
    dealt = groups.join(sizes, GROUP).withColumn("tiles", tiles).withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int"))
    dealt = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    pair = dealt.select(*GROUP, F.least("tile", "with").alias("left"), F.greatest("tile", "with").alias("right"), (F.col("tile") > F.col("with")).cast("int").alias("side"), "id", "weight", "copied", "embedding")
    return pair.groupBy(*GROUP, "left", "right").applyInPandas(compare, "id long, other long, links long")


def near(vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, lines: int = PROJECTIONS, block: int = BLOCK, levels: int = LEVELS) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of vectors (vec_id, embedding, label)."""
    rows, classes = classes_of(vectors)
    parts, tables = routed(classes, block, levels, ROUTE * math.sqrt(2 - 2 * threshold))
    groups = parts[0]
    for part in parts[1:]:
        groups = groups.unionByName(part)
    found = written(links_of(groups, block, threshold, recall, lines), "links")
    links = found.where("other is null").groupBy("id").agg(F.sum("links").alias("links"))
    roots = components(found.where("other is not null").select(F.col("id").alias("a"), F.col("other").alias("b")))
    named = classes.select("id", "label", "h1", "h2", "first_id", "weight").join(links, "id", "left").join(roots.withColumnRenamed("node", "id"), "id", "left")
    named = named.withColumn("root", F.coalesce("root", "id"))
    heads = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = named.join(heads, "root").select("label", "h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id", F.lit(True).alias("able"))
    out = rows.join(named, ["label", "h1", "h2"], "left")
    component = F.when(F.col("able"), F.col("component_id")).otherwise(F.col("vec_id"))
    out = written(out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept")), "near")
    for x in (rows, classes, found, *tables):
        drop_table(x)
    return out


def op12_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near(table(spark, sf_dir, "embeddings"))
