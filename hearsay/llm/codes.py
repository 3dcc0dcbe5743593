"""Short codes for vectors: exact k-means over the parts of vectors, on metric trees.

A vector is cut into equal parts. For each part position a codebook of 256 entries is fitted to the
parts of all vectors, and a vector's code is the index of the nearest entry of each part.

1. Vectors are read in blocks. The parts of a block make a metric tree, middle-out by the anchors
   hierarchy: anchors are set one after another at the point that is furthest from its own, and
   take over the points that are nearer to them (a point nearer to its anchor than half the way
   between both cannot be); the anchors' balls are merged in pairs up to the root, and split in
   the same way down to the leaves. Every ball keeps the sum and the number of its points. Trees
   are built once and written.
2. A round goes down each tree with the list of the entries that may be nearest to a point of
   the ball. A ball drops those entries that are further than another one for all its points and
   leaves the shorter list to its children. Once one entry is left it owns the ball: the ball's sum
   and count go to it at once. Only points of leaves with a longer list are compared, with what
   is left of it.
3. Sums and counts are added up by Spark; what comes to the driver has the size of a codebook.

All is exact: components are integers, ball bounds leave room for rounding, and what they cannot
tell is compared in integers.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearsay.llm.frames import binaries, written

SCALE = 1024
PARTS = 4
ENTRIES = 256
ROUNDS = 4
#: Vectors of one tree (fewer, if they are long), and bytes of their components at most.
BLOCK_ROWS = 4096
BLOCK_BYTES = 8 << 20
#: Points of a leaf at most.
LEAF = 64
#: Components are below this after scaling.
BOUND = 1 << 62
MOST = (1 << 63) - 1


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, label and embedding of the vectors that take part: not null, all components finite
    and below 2**52, so that scaled ones are 64-bit integers."""
    whole = F.col("embedding").isNotNull() & F.forall(
        "embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < BOUND // SCALE)
    )
    return vectors.where(whole).select(
        F.col("vec_id").cast("bigint").alias("vec_id"), "label", "embedding"
    )


def scaled(column: pa.Array, width: int) -> np.ndarray:
    """floor(SCALE * x) of every component, a row for each vector, shorter ones filled up by 0."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(column), width), np.int64)
    out[np.arange(width)[None, :] < lengths[:, None]] = np.floor(SCALE * values)
    return out


# Trees


def anchored(x: np.ndarray, members: np.ndarray, anchors: int) -> list[np.ndarray]:
    """The members in groups, each with the anchor that they are nearest to."""
    points = x[members]
    pivots = points[:1]
    owner = np.zeros(len(members), np.int64)
    away = np.sqrt(((points - pivots[0]) ** 2).sum(axis=1))
    for new in range(1, anchors):
        far = int(away.argmax())
        if not away[far] > 0:
            break
        gaps = np.sqrt(((pivots - points[far]) ** 2).sum(axis=1))
        able = np.flatnonzero(away > gaps[owner] / 2)
        found = np.sqrt(((points[able] - points[far]) ** 2).sum(axis=1))
        nearer = found < away[able]
        owner[able[nearer]], away[able[nearer]] = new, found[nearer]
        pivots = np.concatenate([pivots, points[far:far + 1]])
    order = np.argsort(owner, kind="stable")
    return np.split(members[order], np.flatnonzero(np.diff(owner[order])) + 1)


def paired(balls: list[tuple], centres: np.ndarray, radii: np.ndarray, sizes: np.ndarray) -> tuple:
    """One tree of all balls: the two that fit the smallest ball become one, until one is left."""
    n = len(balls)
    balls, centres, radii, sizes = list(balls), centres.copy(), radii.copy(), sizes.astype(float)
    ways = np.sqrt(((centres[:, None] - centres[None]) ** 2).sum(axis=2))
    cost = (ways + radii[:, None] + radii[None]) / 2
    cost = np.maximum(cost, np.maximum(radii[:, None], radii[None]))
    np.fill_diagonal(cost, np.inf)
    for _ in range(n - 1):
        i, j = divmod(int(cost.argmin()), n)
        balls[i] = (balls[i], balls[j])
        radii[i] = cost[i, j]
        whole = sizes[i] + sizes[j]
        centres[i] = (centres[i] * sizes[i] + centres[j] * sizes[j]) / whole
        sizes[i] = whole
        live = np.isfinite(cost[i])
        live[j] = False
        cost[j, :] = cost[:, j] = np.inf
        ways = np.sqrt(((centres - centres[i]) ** 2).sum(axis=1))
        merged = np.maximum((ways + radii + radii[i]) / 2, np.maximum(radii, radii[i]))
        cost[i, :] = cost[:, i] = np.where(live, merged, np.inf)
        cost[i, i] = np.inf
        last = i
    return balls[last] if n > 1 else balls[0]


def hierarchy(x: np.ndarray, members: np.ndarray):
    """Nested pairs of balls; a leaf is the array of its points."""
    if len(members) <= LEAF:
        return members
    anchors = max(2, min(int(np.sqrt(len(members))), -(-2 * len(members) // LEAF)))
    groups = anchored(x, members, anchors)
    if len(groups) == 1:
        return members  # all points are equal
    centres = np.array([x[g].mean(axis=0) for g in groups])
    radii = np.array([np.sqrt(((x[g] - c) ** 2).sum(axis=1).max()) for g, c in zip(groups, centres)])
    return paired([hierarchy(x, g) for g in groups], centres, radii, np.array([len(g) for g in groups]))


def grown(points: np.ndarray) -> dict[str, np.ndarray]:
    """The metric tree of some points: a ball's points are those from start to stop in the tree's
    order, its children are left and right (-1 at a leaf)."""
    x = points.astype(np.float64)
    start, stop, left, right, order = [], [], [], [], []
    done = 0
    waiting = [(hierarchy(x, np.arange(len(points))), -1, None)]
    while waiting:
        ball, parent, side = waiting.pop()
        if ball is None:
            stop[parent] = done
            continue
        at = len(start)
        if side is not None:
            side[parent] = at
        for column, value in ((start, done), (stop, -1), (left, -1), (right, -1)):
            column.append(value)
        if isinstance(ball, tuple):
            waiting += [(None, at, None), (ball[1], at, right), (ball[0], at, left)]
        else:
            order.append(ball)
            done += len(ball)
            stop[at] = done
    order = np.concatenate(order)
    points, x = points[order], x[order]
    wide = len(points) and int(np.abs(points).max()) >= 1 << 40
    total = np.concatenate([np.zeros((1, points.shape[1]), np.int64), points]).astype(
        object if wide else np.int64
    ).cumsum(axis=0)
    start, stop = np.array(start), np.array(stop)
    sums = total[stop] - total[start]
    centre = sums.astype(np.float64) / (stop - start)[:, None]
    radius = np.array([np.sqrt(((x[a:b] - c) ** 2).sum(axis=1).max())
                       for a, b, c in zip(start, stop, centre)])
    return {"order": order, "points": points, "start": start, "stop": stop, "left": np.array(left),
            "right": np.array(right), "centre": centre, "radius": radius, "sums": sums}


# A round on a tree


def squares(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of all points to all entries: by doubles as long as these hold
    every integer on the way, else by Python's integers."""
    most = max(int(np.abs(points).max(initial=0)), int(np.abs(entries).max(initial=0)))
    if 4 * points.shape[1] * most ** 2 < 1 << 53:
        p, e = points.astype(np.float64), entries.astype(np.float64)
        return (p ** 2).sum(axis=1)[:, None] - 2 * (p @ e.T) + (e ** 2).sum(axis=1)[None]
    return ((points.astype(object)[:, None] - entries.astype(object)[None]) ** 2).sum(axis=2)


def owned(tree: dict[str, np.ndarray], entries: np.ndarray):
    """Balls with the entry that owns them, and the leaves with the entry of each of their points."""
    e = entries.astype(np.float64)
    first = np.zeros(len(entries), bool)  # of equal entries, the first is nearest
    first[np.unique(entries, axis=0, return_index=True)[1]] = True
    norms = (e ** 2).sum(axis=1)
    gaps = np.sqrt(np.maximum(0, norms[:, None] - 2 * (e @ e.T) + norms[None]))
    gaps += 1e-6 * np.sqrt(norms.max(initial=0))
    balls, owners, leaves = [], [], []
    front, lists = np.zeros(1, np.int64), first[None]
    while len(front):
        centre = tree["centre"][front]
        own = (centre ** 2).sum(axis=1)
        away = own[:, None] - 2 * (centre @ e.T) + norms[None]
        best = np.where(lists, away, np.inf).argmin(axis=1)
        rows = np.arange(len(front))
        # Within the ball the difference of squared distances changes by 2 radius * gap at most.
        room = 2 * tree["radius"][front][:, None] * gaps[best] * (1 + 1e-9)
        slack = 1e-9 * (own + norms.max(initial=0)) + 1e-9
        lists = lists & (away <= away[rows, best][:, None] + room + slack[:, None])
        alone = lists.sum(axis=1) == 1
        balls.append(front[alone])
        owners.append(lists[alone].argmax(axis=1))
        leaf = tree["left"][front] < 0
        for ball, able in zip(front[~alone & leaf].tolist(), lists[~alone & leaf]):
            able = np.flatnonzero(able)
            points = tree["points"][tree["start"][ball]:tree["stop"][ball]]
            leaves.append((ball, able[squares(points, entries[able]).argmin(axis=1)]))
        inner = ~alone & ~leaf
        front, lists = (
            np.concatenate([tree["left"][front[inner]], tree["right"][front[inner]]]),
            np.concatenate([lists[inner], lists[inner]]),
        )
    return np.concatenate(balls), np.concatenate(owners), leaves


def tree_sums(tree: dict[str, np.ndarray], entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many points each entry gets, and their sum."""
    counts = np.zeros(len(entries), np.int64)
    sums = np.zeros(entries.shape, tree["sums"].dtype)
    balls, owners, leaves = owned(tree, entries)
    np.add.at(counts, owners, (tree["stop"] - tree["start"])[balls])
    np.add.at(sums, owners, tree["sums"][balls])
    for ball, entry in leaves:
        np.add.at(counts, entry, 1)
        points = tree["points"][tree["start"][ball]:tree["stop"][ball]]
        np.add.at(sums, entry, points.astype(sums.dtype))
    return counts, sums


def tree_codes(tree: dict[str, np.ndarray], entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each point and the squared distance to it, in the points' first order."""
    codes = np.zeros(len(tree["order"]), np.int64)
    balls, owners, leaves = owned(tree, entries)
    for ball, entry in [*zip(balls.tolist(), owners.tolist()), *leaves]:
        codes[tree["start"][ball]:tree["stop"][ball]] = entry
    points, at = tree["points"], entries[codes]
    most = max(int(np.abs(points).max(initial=0)), int(np.abs(at).max(initial=0)))
    kind = np.int64 if 4 * points.shape[1] * most ** 2 < 1 << 62 else object
    errors = ((points.astype(kind) - at.astype(kind)) ** 2).sum(axis=1)
    back = np.argsort(tree["order"])
    return codes[back], errors[back]


# Spark


def forest(rows: DataFrame, width: int) -> DataFrame:
    """ids, labels and trees (one for each part position) of blocks of vectors."""
    schema = rows.select(
        F.array("vec_id").alias("ids"), F.array("label").alias("labels"),
        F.lit(b"").alias("trees"),
    ).schema
    block_rows = max(1, min(BLOCK_ROWS, BLOCK_BYTES // (8 * width)))
    part = width // PARTS

    def block(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        x = np.concatenate([scaled(b.column("embedding"), width) for b in held])
        trees = [grown(x[:, i * part:(i + 1) * part]) for i in range(PARTS)]
        lists = [
            pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), table.column(c).chunk(0))
            for c in ("vec_id", "label")
        ]
        return pa.RecordBatch.from_arrays([*lists, binaries([pickle.dumps(trees)])], schema.names)

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in stream:
            at = 0
            while at < batch.num_rows:
                taken = batch.slice(at, block_rows - size)
                held.append(taken)
                at, size = at + taken.num_rows, size + taken.num_rows
                if size == block_rows:
                    yield block(held)
                    held, size = [], 0
        if size:
            yield block(held)

    return rows.select("vec_id", "label", "embedding").mapInArrow(batches, schema)


def round_of(trees: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after a round: each entry is the rounded-down mean of the parts it is nearest
    to; entries without parts stay."""
    carried = trees.sparkSession.sparkContext.broadcast(books)

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = carried.value
        counts = np.zeros(own.shape[:2], np.int64)
        sums = np.zeros(own.shape, object)
        for batch in stream:
            for value in batch.column("trees"):
                for i, tree in enumerate(pickle.loads(value.as_py())):
                    n, total = tree_sums(tree, own[i])
                    counts[i] += n
                    sums[i] += total.astype(object)
        part, entry = np.nonzero(counts)
        width = own.shape[2]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(part, width).astype(np.int32)),
             pa.array(np.repeat(entry, width).astype(np.int32)),
             pa.array(np.tile(np.arange(width, dtype=np.int32), len(part))),
             pa.array(np.repeat(counts[part, entry], width)),
             pa.array([Decimal(x) for x in sums[part, entry].ravel().tolist()],
                      pa.decimal128(38, 0))],
            ["part", "entry", "place", "n", "total"],
        )

    found = (
        trees.select("trees")
        .mapInArrow(batches, "part int, entry int, place int, n bigint, total decimal(38,0)")
        .groupBy("part", "entry", "place")
        .agg(F.sum("n").alias("n"), F.sum("total").cast("decimal(38,0)").alias("total"))
    )
    out = books.copy()
    for row in found.collect():  # as many as the codebooks have components
        out[row.part, row.entry, row.place] = int(row.total) // row.n
    return out


def coded(trees: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, code and error of all vectors."""
    carried = trees.sparkSession.sparkContext.broadcast(books)
    schema = trees.select(
        F.element_at("ids", 1).alias("vec_id"), F.element_at("labels", 1).alias("label"),
        F.lit("").alias("code"), F.lit(0).cast("bigint").alias("error"),
    ).schema

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for at in range(batch.num_rows):
                found = [tree_codes(tree, carried.value[i]) for i, tree in
                         enumerate(pickle.loads(batch.column("trees")[at].as_py()))]
                codes = np.stack([codes for codes, _ in found], axis=1).astype(np.uint8)
                errors = sum(errors.astype(object) for _, errors in found)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("ids").slice(at, 1).flatten(),
                     batch.column("labels").slice(at, 1).flatten(),
                     pa.array([row.tobytes().hex() for row in codes], pa.string()),
                     pa.array([min(x, MOST) for x in errors.tolist()], pa.int64())],
                    schema.names,
                )

    return trees.mapInArrow(batches, schema)


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(
    vectors: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS
) -> tuple[DataFrame, np.ndarray]:
    """vec_id, label, code and error of each vector, and the codebooks (part, entry, place).

    Left out are vectors that are null or hold a component that is null, not finite or 2**52 or
    more. Shorter vectors (and a length that PARTS does not divide) are filled up by zeros, so
    an empty vector is one of zeros. Codebooks start with the vectors of the smallest ids (null
    ids last; rows of one id by their vectors), fewer if there are fewer. Repeated rows count as
    often as they come. ``entries`` is 256 at most. An error beyond a long is given as the largest
    long. Without any usable vector the result is empty.
    """
    rows = usable(vectors)
    longest = rows.agg(F.max(F.size("embedding"))).first()[0]
    width = PARTS * max(1, -(-(longest or 0) // PARTS))
    start = (
        rows.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries)
        .select("embedding").toArrow()
    )
    trees = written(forest(rows, width), "trees")
    first = [scaled(chunk, width) for chunk in start.column(0).chunks]
    books = np.concatenate([np.zeros((0, width), np.int64), *first])
    books = np.stack(np.split(books, PARTS, axis=1))
    for _ in range(rounds):
        books = round_of(trees, books) if books.shape[1] else books
    return coded(trees, books), books


def digests(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error (the error summed over the rows of its label, null labels
    together; the largest long if it is more) and codebooks_sha256."""
    found, books = compress(vectors)
    rows = written(found, "codes")
    by_label = rows.groupBy(F.col("label").alias("of_label")).agg(
        F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(MOST).cast("decimal(38,0)"))
        .cast("bigint").alias("label_error")
    )
    return rows.join(by_label, F.col("label").eqNullSafe(F.col("of_label"))).select(
        "vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256")
    )


_NEAREST = """
  select p.pos, p.part, min_by(b.entry, list_inner_product(p.p, p.p)
      - 2 * list_inner_product(p.p, b.e) + list_inner_product(b.e, b.e) + b.entry / 1024) as entry
  from parts p join book{m} b using (part) group by p.pos, p.part"""

_ROUND = """
), near{n} as materialized ({nearest}
), mean{n} as materialized (
  select part, entry, list(x order by i) as e from (
    select part, entry, i, floor(sum(p[i]) / count(*)) as x
    from near{n} join parts using (pos, part), range(1, len(p) + 1) t(i) group by part, entry, i
  ) group by part, entry
), book{n} as materialized (
  select b.part, b.entry, coalesce(m.e, b.e) as e
  from book{m} b left join mean{n} m using (part, entry)"""

SQL = (
    """
with kept as materialized (
  select row_number() over (order by vec_id, embedding) as pos, vec_id, label,
    list_transform(embedding, lambda x: floor(1024 * x::double)) as v
  from embeddings
  where embedding is not null and list_count(embedding) = len(embedding)
    and len(list_filter(embedding, lambda x: not isfinite(x))) = 0
), parts as materialized (
  select pos, part, v[part * len(v) // 4 + 1 : (part + 1) * len(v) // 4] as p
  from kept, range(4) t(part)
), book0 as materialized (
  select part, pos - 1 as entry, p as e from parts where pos <= 256"""
    + "".join(_ROUND.format(n=n + 1, m=n, nearest=_NEAREST.format(m=n)) for n in range(ROUNDS))
    + f"""
), final as materialized ({_NEAREST.format(m=ROUNDS)}
), errors as materialized (
  select pos, string_agg(lpad(lower(to_hex(entry)), 2, '0'), '' order by part) as code,
    sum(list_inner_product(p, p) - 2 * list_inner_product(p, e) + list_inner_product(e, e))::bigint
      as error
  from final join parts using (pos, part) join book{ROUNDS} using (part, entry) group by pos
), digest as materialized (
  select sha256(string_agg(array_to_string(list_transform(e, lambda x: x::bigint), ','), ','
    order by part, entry)) as codebooks_sha256 from book{ROUNDS}
)
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error,
  codebooks_sha256
from kept join errors using (pos) cross join digest
"""
)
