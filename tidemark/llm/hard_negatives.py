"""Hard negatives: for an anchor and each of its nearest rows of the same label, the most similar
rows of other labels whose product with the anchor is from half to 19/20 of the positive's.

Rows are dealt to groups by a hash of their row number, so no label, id or common vector decides a
group's size. A group's task builds the cover trees of its rows once and then takes the anchors as
a stream; every anchor visits every group and brings back at most k rows of each window, which are
merged by rank. First the positives are found, then the windows that they define are searched.

The vectors of anchors are copied to each group (rows / GROUP_ROWS of them). This is the price of an
exact answer for a stated query set; nothing else is copied, and no pair is written but the best.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.cover_tree import NO_ID, Best, Forest
from tidemark.llm.texts import map_batches
from tidemark.shared import materialise

POSITIVES = 5
NEGATIVES = 3
#: An allowed negative has at least LOW and at most HIGH hundredths of the positive's product.
LOW, HIGH = 50, 95
#: Rows of one group; with 64 components these are 130 MB in a task.
GROUP_ROWS = 1 << 18
#: Groups of a small table, so that several tasks share the work.
LEAST_GROUPS = 16
#: Products beyond the range of a long count as its ends.
ENDS = -(2**63), 2**63 - 1


def taking_part(df: DataFrame, label: Column | None = None) -> DataFrame:
    """Rows (uid, vec_id, label, vector) of `df(vec_id, embedding, label)` that take part.

    `label` replaces the label. Null labels, null vectors and vectors with a null or non-finite
    component do not take part. uid numbers rows, so that repeated rows stay apart.
    """
    vector = F.col("embedding").cast("array<double>")
    broken = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = df.where(F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~broken)
    named = F.coalesce(label, F.col("label")) if label is not None else F.col("label")
    return rows.select(
        F.monotonically_increasing_id().alias("uid"), F.col("vec_id").cast("long").alias("vec_id"), named.cast("long").alias("label"), vector.alias("vector")
    )


def whole_numbers(column: pa.ListArray, width: int | None = None) -> np.ndarray:
    """floor(256 x) of the components; shorter vectors are filled up with zeros, longer ones cut."""
    sizes = np.diff(column.offsets.to_numpy())
    values = np.floor(256.0 * column.flatten().to_numpy(zero_copy_only=False).astype(float))
    widest = int(sizes.max(initial=0)) if width is None else width
    if (sizes == widest).all():
        return values.reshape(len(sizes), widest)
    out = np.zeros((len(sizes), widest))
    starts = np.cumsum(sizes) - sizes
    for row, (start, size) in enumerate(zip(starts.tolist(), np.minimum(sizes, widest).tolist())):
        out[row, :size] = values[start : start + size]
    return out


def in_groups(rows: DataFrame, anchors: DataFrame, groups: int) -> DataFrame:
    """Each group's rows (kind 0), followed by all anchors (kind 1), sorted by group."""
    group = F.pmod(F.xxhash64("uid"), F.lit(groups)).cast("int")
    stored = rows.select(group.alias("group"), F.lit(0).alias("kind"), "uid", "vec_id", "label", "vector", F.lit(None).cast("array<struct<id:bigint,score:bigint>>").alias("positives"))
    every = F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
    asking = anchors.select(every.alias("group"), F.lit(1).alias("kind"), "uid", "vec_id", "label", "vector", "positives")
    return stored.unionByName(asking).repartition(groups, "group").sortWithinPartitions("group", "kind", "uid")


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, pa.RecordBatch]]:
    """(group, kind, rows): the batches cut where group or kind changes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        group, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        cuts = np.flatnonzero((np.diff(group) != 0) | (np.diff(kind) != 0)) + 1
        for first, last in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
            yield int(group[first]), int(kind[first]), batch.slice(first, last - first)


def forest_of(held: list[pa.RecordBatch]) -> tuple[Forest, set[int]]:
    """The trees over a group's rows, and the uids of rows without an id."""
    table = pa.Table.from_batches(held).combine_chunks()
    ids = table.column("vec_id")
    uids = table.column("uid").to_numpy()
    nameless = set(uids[ids.is_null().to_numpy()].tolist())
    vectors = whole_numbers(table.column("vector").chunk(0))
    return Forest(vectors, ids.fill_null(NO_ID).to_numpy(), uids, table.column("label").to_numpy()), nameless


def searched(grouped: DataFrame, ask: Callable[[Forest, np.ndarray, dict], Iterator[tuple]], schema: str) -> DataFrame:
    """`ask(forest, vector, anchor)` for every anchor in every group; it yields rows of `schema`
    whose last two values are the id and the uid of the row that was found."""
    names = [each.split()[0] for each in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, forest, nameless = None, [], None, set()
        for group, kind, rows in runs(batches):
            if group != now:
                now, held, forest = group, [], None
            if kind == 0:
                held.append(rows)
                continue
            if forest is None:
                if not held:  # a group without rows
                    continue
                forest, nameless = forest_of(held)
                held = [held[0].slice(0, 0)]
            vectors = whole_numbers(rows.column("vector"), forest.vectors.shape[1])
            out: dict[str, list] = defaultdict(list)
            anchors = rows.select(["uid", "vec_id", "label", "positives"]).to_pylist()
            for anchor, vector in zip(anchors, vectors):
                for row in ask(forest, vector, anchor):
                    for name, value in zip(names, row):
                        out[name].append(value)
                    if row[-1] in nameless:
                        out[names[-2]][-1] = None
            if out:
                types = [pa.int32() if name == "slot" else pa.int64() for name in names]
                yield pa.RecordBatch.from_arrays([pa.array(out[name], kind) for name, kind in zip(names, types)], names)

    return map_batches(grouped, run, schema)


def ends(product: int) -> int:
    return min(max(product, ENDS[0]), ENDS[1])


def nearest(forest: Forest, vector: np.ndarray, anchor: dict) -> Iterator[tuple]:
    """The group's best rows of the anchor's label, itself left out."""
    best = Best(POSITIVES)
    forest.search(vector, [best], lambda labels, uids: (labels == anchor["label"]) & (uids != anchor["uid"]))
    for product, vec_id, uid in best.found:
        yield anchor["uid"], anchor["vec_id"], ends(product), vec_id, uid


def hardest(forest: Forest, vector: np.ndarray, anchor: dict) -> Iterator[tuple]:
    """The group's best rows of other labels in each positive's window."""
    given = anchor["positives"]
    windows = [Best(NEGATIVES, -(-LOW * each["score"] // 100), HIGH * each["score"] // 100) for each in given]
    open_ones = [window for window in windows if window.low <= window.high]
    forest.search(vector, open_ones, lambda labels, uids: labels != anchor["label"])
    for slot, (window, each) in enumerate(zip(windows, given)):
        for product, vec_id, uid in window.found:
            yield anchor["uid"], anchor["vec_id"], slot, each["id"], each["score"], ends(product), vec_id, uid


def first_of(df: DataFrame, keys: list[str], k: int, score: str, name: str) -> DataFrame:
    """The k first rows of each key by score, ties by id (none last), then by uid."""
    order = Window.partitionBy(*keys).orderBy(F.desc(score), F.asc_nulls_last("id"), "other")
    return df.withColumn(name, F.row_number().over(order)).where(F.col(name) <= k)


def mine(rows: DataFrame, anchors: DataFrame) -> DataFrame:
    """Hard negatives of `anchors`, some of the stored `rows(uid, vec_id, label, vector)`."""
    groups = max(LEAST_GROUPS, -(-rows.count() // GROUP_ROWS))
    asking = anchors.withColumn("positives", F.lit(None).cast("array<struct<id:bigint,score:bigint>>"))
    found = searched(in_groups(rows, asking, groups), nearest, "uid long, anchor_id long, score long, id long, other long")
    best = first_of(found, ["uid"], POSITIVES, "score", "slot")
    # At most POSITIVES rows of an anchor are gathered.
    given = best.groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("slot", "id", "score"))).alias("found"))
    given = materialise(given.select("uid", F.transform("found", lambda x: F.struct(x["id"].alias("id"), x["score"].alias("score"))).alias("positives")))
    schema = "uid long, anchor_id long, slot int, positive_id long, positive_score long, negative_score long, id long, other long"
    kept = searched(in_groups(rows, anchors.join(given, "uid"), groups), hardest, schema)
    ranked = first_of(kept, ["uid", "slot"], NEGATIVES, "negative_score", "rank")
    return ranked.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", "negative_score")


def result(df: DataFrame) -> DataFrame:
    """Hard negatives of every row of `df(vec_id, embedding, label)` whose vec_id is divisible by 50.

    A row whose vec_id is divisible by 7 counts under the next of ten labels. Rows without an id
    are candidates, last among equals. Repeated rows are rows of their own, so a repeated anchor
    has its own results. Shorter vectors are filled up with zeros. An empty table gives an empty one.
    """
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10)
    rows = materialise(taking_part(df, moved))
    return mine(rows, rows.where("vec_id % 50 = 0"))


ORACLE_SQL = """
WITH given AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL
        AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), placed AS (SELECT *, row_number() OVER () AS uid FROM given),
scored AS (
    SELECT a.uid, a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS id, b.uid AS other,
        CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
    FROM placed a JOIN placed b ON a.vec_id % 50 = 0 AND a.uid <> b.uid
), positives AS (
    SELECT *, row_number() OVER (PARTITION BY uid ORDER BY score DESC, id NULLS LAST, other) AS slot
    FROM scored WHERE same QUALIFY slot <= 5
), ranked AS (
    SELECT p.anchor_id, p.id AS positive_id, n.id AS negative_id, p.score AS positive_score, n.score AS negative_score,
        row_number() OVER (PARTITION BY p.uid, p.slot ORDER BY n.score DESC, n.id NULLS LAST, n.other) AS rank
    FROM positives p JOIN scored n ON n.uid = p.uid AND NOT n.same
        AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM ranked WHERE rank <= 3
"""
