"""Records that tell the same text with small edits: chosen-path set similarity join.

A record is the set of its distinct three-word sequences. Every set is embedded in COORDS minwise values. A tree
starts in one node per record; each node picks coordinates by its own hash, and every record in the node goes on to
the children named by its values there, so that like records share a child and unlike ones part quickly. After DEPTH
levels of two children, nodes that still hold more than `limit` records branch further, level by level and with three
children, until they are small or MAX_DEPTH is reached. With three children a pair at 1/2 shares 1.5 children on
average, so its chance to stay together does not fade with depth; the number of independent trees is that which
meets pairs at the threshold with probability `recall` at MAX_DEPTH, wherever a node really ends. Small nodes are
compared exhaustively with sketches of 128 bits, and what comes near is checked against the full sets.

Skew: copies with equal sets are one representative from the start. Node sizes are counted with map-side partial
sums, never by gathering a node. Which nodes are heavy reaches the workers as an array of CELLS size classes by the
nodes' hashes, of the same size at any scale: nodes that share a cell with a heavy one branch too, which loses
nothing, as the trees are enough for MAX_DEPTH. A heavy node that does not shrink when it branches (records nearly
equal everywhere), or is heavy at MAX_DEPTH, is cut into blocks of BLOCK records that are compared block against
block, each pair of blocks in a task of its own. The pairs among different texts of such a group are links of the
result, all of which are due: they are the only work that grows faster than the records.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstream.llm.boilerplate import Labeller, page_columns, page_pieces, train_labeller
from loomstream.llm.words import distinct, mix, runs, words
from loomstream.session import ship, written

COORDS, DEPTH, MAX_DEPTH, LIMIT, BLOCK, MAX_TREES = 64, 3, 6, 100, 1_000, 1_000
#: Children of a node in the first DEPTH levels, and of heavy nodes below them.
FEW, MANY = 2, 3
CELLS = 1 << 22
#: Four bits of each of HASHES minwise values; of a pair at 1/2 fewer than AGREE of them agree in 1 of 10,000 cases.
HASHES, AGREE = 32, 7
#: Of the COORDS values a pair at 1/2 shares fewer than NEAR in 1 of 50,000 cases.
NEAR = 16
#: Bits of a three-word sequence's hash: two different ones of a pair of records are equal in 1 of 10^8 pairs of 1,000 each.
MEMBER_BITS = 48
_SETS = "id string, rid bigint, key bigint, n int, coords binary, s0 bigint, s1 bigint, members binary"


def trees_for(recall: float, threshold: float, depth: int | None = None) -> int:
    """Trees needed so that a pair at the threshold shares a leaf of this depth (MAX_DEPTH) with probability `recall`.

    All trees draw from the same COORDS values, so how many of these a pair shares is averaged over.
    """
    depth = MAX_DEPTH if depth is None else depth
    shared = [(math.comb(COORDS, k) * threshold**k * (1 - threshold) ** (COORDS - k), k / COORDS) for k in range(COORDS + 1)]
    left = []
    for p, s in shared:
        q = 1.0
        for level in range(depth, 0, -1):
            q = 1 - (1 - s * q) ** (FEW if level <= DEPTH else MANY)
        left.append((p, 1 - q))
    trees = 1
    while sum(p * x**trees for p, x in left) > 1 - recall and trees < MAX_TREES:
        trees += 1
    return trees


def shingle_sets(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct three-word sequences of each text as sorted values of MEMBER_BITS, one text after the other, and offsets."""
    n, most = len(at) - 1, (1 << (64 - MEMBER_BITS)) - 1
    if n > most:  # the owner shares a word with the value
        parts = [shingle_sets(h[at[a] : at[min(a + most, n)]], at[a : min(a + most, n) + 1] - at[a]) for a in range(0, n, most)]
        firsts = np.cumsum([0, *(len(v) for v, _ in parts)])
        return np.concatenate([v for v, _ in parts]), np.concatenate([*(o[:-1] + f for (_, o), f in zip(parts, firsts, strict=False)), firsts[-1:]])
    if len(h) < 3:
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    owner = np.repeat(np.arange(n, dtype=np.uint64), np.diff(at))
    g = mix(h[:-2] * np.uint64(3) + mix(h[1:-1] * np.uint64(5) + mix(h[2:]))) >> np.uint64(64 - MEMBER_BITS)
    both = distinct(((owner[:-2] << np.uint64(MEMBER_BITS)) | g)[owner[:-2] == owner[2:]])
    return both & np.uint64((1 << MEMBER_BITS) - 1), np.searchsorted(both >> np.uint64(MEMBER_BITS), np.arange(n + 1, dtype=np.uint64))


def minwise(values: np.ndarray, at: np.ndarray, n: int, salt: int, step: int = 16) -> np.ndarray:
    """(texts, n) smallest hash of each non-empty set under n hash functions."""
    out = np.empty((len(at) - 1, n), np.uint32)
    x = (mix(values + np.uint64(salt)) >> np.uint64(32)).astype(np.uint32)
    a = (mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    for k in range(0, n, step):
        out[:, k : k + step] = np.minimum.reduceat(x[:, None] * a[None, k : k + step], at[:-1], axis=0)
    return out


def sketch(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(texts, 2) words of four bits of each of HASHES minwise values."""
    bits = (minwise(values, at, HASHES, 2) & np.uint32(15)).astype(np.uint64).reshape(len(at) - 1, 2, HASHES // 2)
    return (bits << (np.arange(HASHES // 2, dtype=np.uint64) * np.uint64(4))).sum(2, dtype=np.uint64)


def agreeing(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many of the HASHES values agree in each pair of sketches."""
    d = x ^ y
    d |= d >> np.uint64(1)
    d |= d >> np.uint64(2)
    return HASHES - np.bitwise_count(d & np.uint64(0x1111111111111111)).sum(1, dtype=np.int64)


def pack(members: np.ndarray) -> bytes:
    return members.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : MEMBER_BITS // 8].tobytes()


def unpack(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).reshape(-1, MEMBER_BITS // 8)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, : MEMBER_BITS // 8] = raw
    return out.view("<u8")[:, 0]


def similarity(a: bytes, b: bytes) -> float:
    x, y = unpack(a), unpack(b)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / max(len(x) + len(y) - both, 1)


def set_columns(ids: pa.Array, rids: np.ndarray, h: np.ndarray, at: np.ndarray) -> pa.RecordBatch | None:
    """Rows of _SETS for the texts that have a three-word sequence."""
    values, offs = shingle_sets(h, at)
    keep = np.flatnonzero(np.diff(offs))
    if not len(keep):
        return None
    bounds = np.r_[offs[keep], offs[-1]]  # empty sets take no room in between
    coords = (minwise(values, bounds, COORDS, 1) & np.uint32(0xFFFF)).astype("<u2")
    words_ = sketch(values, bounds).view(np.int64)
    key = np.bitwise_xor.reduceat(mix(values + np.uint64(99)), bounds[:-1]) ^ mix(np.diff(bounds).astype(np.uint64))
    cols = [
        ids.take(pa.array(keep)), pa.array(rids[keep], pa.int64()), pa.array(key.view(np.int64)), pa.array(np.diff(bounds), pa.int32()),
        pa.array([c.tobytes() for c in coords], pa.binary()), pa.array(words_[:, 0]), pa.array(words_[:, 1]),
        pa.array([pack(values[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in _SETS.split(", ")])


def _article_sets(model):
    def make(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        rid = TaskContext.get().partitionId() << 33
        for batch in it:
            titles, about = batch.column("title").to_pylist(), batch.column("description").to_pylist()
            for a, b, blocks, per_doc, p in page_pieces(model.value, batch, 40):
                blocks, own, at = blocks.to_pylist(), p <= 0.5, np.r_[0, np.cumsum(per_doc)]
                texts = []
                for i in range(b - a):
                    parts = [titles[a + i], about[a + i], *(blocks[k] for k in range(at[i], at[i + 1]) if own[k])]
                    texts.append("\n".join(x for x in parts if x))
                h, at, _ = words(texts)
                out = set_columns(batch.column("url_id").slice(a, b - a), rid + np.arange(b - a), h, at)
                rid += b - a
                if out is not None:
                    yield out

    return make


def article_sets(articles: DataFrame, clean: DataFrame, model: Labeller | None = None) -> DataFrame:
    """The sets of title, description and body of each article (page furniture left out), written once."""
    ship(articles.sparkSession)
    model = model or train_labeller(articles, clean)
    cols = page_columns(articles, "title", "description").filter("url_id is not null")
    return written(cols.mapInArrow(_article_sets(articles.sparkSession.sparkContext.broadcast(model)), _SETS), "sets")


# ---------------------------------------------------------------- the join


def children(node: np.ndarray, row: np.ndarray, coords: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The n children of each (node, record) by n different coordinates that the node picks."""
    pick = mix(node + np.uint64(0xA5A5))
    step = (pick >> np.uint64(20)) | np.uint64(1)  # odd: coordinates differ
    kids = []
    for j in range(n):
        c = (pick + np.uint64(j) * step) % np.uint64(COORDS)
        kids.append(mix(node * np.uint64(3) + (c << np.uint64(16)) + coords[row, c.astype(np.int64)].astype(np.uint64) + np.uint64(1)))
    return np.concatenate(kids), np.tile(row, n)


def first_nodes(coords: np.ndarray, trees: int) -> tuple[np.ndarray, np.ndarray]:
    """(node, record) at level DEPTH of all trees."""
    n = len(coords)
    node = np.repeat(mix(np.arange(trees, dtype=np.uint64) + np.uint64(77)), n)
    row = np.tile(np.arange(n), trees)
    for _ in range(DEPTH):
        node, row = children(node, row, coords, FEW)
    return node, row


def _cell(node: np.ndarray, classes: np.ndarray) -> np.ndarray:
    return classes[(node & np.uint64(CELLS - 1)).astype(np.int64)]


def _coords(batch: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("coords").to_pylist()), "<u2").reshape(-1, COORDS)


def _slices(it: Iterator[pa.RecordBatch], n: int = 4_000) -> Iterator[pa.RecordBatch]:
    for batch in it:
        for a in range(0, batch.num_rows, n):
            yield batch.slice(a, n)


_ENTRIES = "node bigint, key bigint, s0 bigint, s1 bigint, side tinyint"
_OPEN = "node bigint, up tinyint, key bigint, s0 bigint, s1 bigint, coords binary"


def _batch(ddl: str, *cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in cols], names=[x.split()[0] for x in ddl.split(", ")])


def _counter(trees: int):
    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(it):
            nodes, n = np.unique(first_nodes(_coords(b), trees)[0], return_counts=True)
            yield _batch("node bigint, n bigint", nodes.view(np.int64), n)

    return count


def _enter(trees: int, classes):
    """Entries of the small nodes of level DEPTH."""

    def enter(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(it):
            node, row = first_nodes(_coords(b), trees)
            small = _cell(node, classes.value) == 0
            node, row = node[small], pa.array(row[small])
            yield _batch(_ENTRIES, node.view(np.int64), *(b.column(c).take(row) for c in ("key", "s0", "s1")), np.zeros(len(node), np.int8))

    return enter


def _children_of(b: pa.RecordBatch, node: np.ndarray, row: np.ndarray, size: np.ndarray) -> pa.RecordBatch:
    kids, rows = children(node, row, _coords(b), MANY)
    return _batch(_OPEN, kids.view(np.int64), np.tile(size.astype(np.int8), MANY), *(b.column(c).take(pa.array(rows)) for c in ("key", "s0", "s1", "coords")))


def _open_first(trees: int, classes):
    """Children of the heavy nodes of level DEPTH, each with the size class of its parent."""

    def branch(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(it):
            node, row = first_nodes(_coords(b), trees)
            size = _cell(node, classes.value)
            if size.any():
                yield _children_of(b, node[size > 0], row[size > 0], size[size > 0])

    return branch


def _stays(up: np.ndarray, size: np.ndarray, last: bool) -> np.ndarray:
    """Heavy nodes that branch no further: at the last level, or not smaller than their parents."""
    return (size > 0) & (last | (size >= up))


def _branch(classes):
    def branch(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(it, 20_000):
            node, up = b.column("node").to_numpy().view(np.uint64), b.column("up").to_numpy()
            size = _cell(node, classes.value)
            go = np.flatnonzero((size > 0) & ~_stays(up, size, False))
            if len(go):
                yield _children_of(b, node[go], go, size[go])

    return branch


def _settle(classes, last: bool, limit: int):
    """Entries of the open nodes that are small, or cut into blocks: once per pair of blocks, with the side of the pair."""

    def settle(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(it, 20_000):
            node, up = b.column("node").to_numpy().view(np.uint64), b.column("up").to_numpy()
            size = _cell(node, classes.value)
            take = np.flatnonzero((size == 0) | _stays(up, size, last))
            node, size = node[take], size[take].astype(np.int64)
            parts = np.where(size > 0, -(-(limit << size) // BLOCK), 1)
            row, node, total, other = np.repeat(take, parts), np.repeat(node, parts), np.repeat(parts, parts), runs(parts)
            key = b.column("key").to_numpy()[row]
            mine = (mix(key.view(np.uint64) + np.uint64(5)) % total.astype(np.uint64)).astype(np.int64)
            low, high = np.minimum(mine, other), np.maximum(mine, other)
            node = np.where(total > 1, mix(node + (low * 1_000_003 + high + 1).astype(np.uint64)), node)
            side = np.where(low == high, 0, np.where(mine == low, 1, 2)).astype(np.int8)
            at = pa.array(row)
            yield _batch(_ENTRIES, node.view(np.int64), key, b.column("s0").take(at), b.column("s1").take(at), side)

    return settle


def near_in_nodes(node: np.ndarray, key: np.ndarray, s: np.ndarray, side: np.ndarray) -> np.ndarray:
    """Pairs of keys whose sketches agree, within the runs of equal nodes (nodes in order); of two blocks only across."""
    cuts = np.flatnonzero(np.r_[True, node[1:] != node[:-1], True])
    sizes = np.diff(cuts)
    found = []
    for size in np.unique(sizes[sizes > 1]):
        i, j = np.triu_indices(size, 1)
        starts = cuts[:-1][sizes == size]
        step = max(1, 400_000 // len(i))
        for a in range(0, len(starts), step):
            x = (starts[a : a + step, None] + i).ravel()
            y = (starts[a : a + step, None] + j).ravel()
            ok = (agreeing(s[x], s[y]) >= AGREE) & (key[x] != key[y]) & ((side[x] == 0) | (side[x] != side[y]))
            found.append(np.stack([np.minimum(key[x[ok]], key[y[ok]]), np.maximum(key[x[ok]], key[y[ok]])], 1))
    return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)


def _compare(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rest: list[np.ndarray] | None = None

    def emit(cols: list[np.ndarray]) -> pa.RecordBatch:
        pairs = near_in_nodes(cols[0], cols[1], np.stack([cols[2].view(np.uint64), cols[3].view(np.uint64)], 1), cols[4])
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    for batch in it:
        cols = [batch.column(c).to_numpy() for c in ("node", "key", "s0", "s1", "side")]
        if rest is not None:
            cols = [np.concatenate(x) for x in zip(rest, cols, strict=True)]
        if not len(cols[0]):
            continue
        cut = int(np.searchsorted(cols[0], cols[0][-1]))  # the last node may go on in the next batch
        rest = [c[cut:] for c in cols]
        if cut:
            yield emit([c[:cut] for c in cols])
    if rest is not None and len(rest[0]):
        yield emit(rest)


def _likely(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs that share NEAR of the COORDS minwise values, so that few full sets have to be fetched in vain."""
    for b in it:
        ca, cb = (np.frombuffer(b"".join(b.column(c).to_pylist()), "<u2").reshape(-1, COORDS) for c in ("ca", "cb"))
        yield b.select(["a", "b"]).filter(pa.array((ca == cb).sum(1) >= NEAR, pa.bool_()))


def marks(keys: DataFrame) -> np.ndarray:
    """CELLS * 8 bits, set where a key's hash falls: of one size however many keys there are."""
    word, bit = F.shiftright(F.col("key").bitwiseAND(CELLS * 8 - 1), 6), F.expr("shiftleft(1L, CAST(key & 63 AS INT))")
    got = keys.groupBy(word.alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    out = np.zeros(CELLS // 8, np.uint64)
    out[got.column("word").to_numpy()] = got.column("bits").to_numpy().view(np.uint64)
    return out


def _marked(bits):
    """Rows whose key is marked: those that are wanted, and few others, before they are shuffled."""

    def keep(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            at = b.column("key").to_numpy().view(np.uint64) & np.uint64(CELLS * 8 - 1)
            hit = bits.value[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)
            yield b.filter(pa.array(hit.astype(bool)))

    return keep


def _checker(threshold: float):
    def check(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            js = [similarity(x, y) for x, y in zip(b.column("ma").to_pylist(), b.column("mb").to_pylist(), strict=True)]
            keep = pa.array([j >= threshold for j in js], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(js, pa.float64())], names=["a", "b", "similarity"]).filter(keep)

    return check


def representatives(sets: DataFrame) -> DataFrame:
    """One row (rid, key, coords, s0, s1) per distinct set, written; the members stay where they are."""
    first = sets.groupBy("key").agg(F.min("rid").alias("rid"))
    return written(sets.select("rid", "key", "coords", "s0", "s1").join(first, ["key", "rid"], "left_semi"), "representatives")


def size_classes(counted: DataFrame, limit: int) -> np.ndarray:
    """Of the nodes (node, n) in each of CELLS cells the largest size class: 0 up to `limit`, then one more for every doubling."""
    sizes = counted.groupBy("node").agg(F.sum("n").alias("n")).filter(F.col("n") > limit)
    size = F.ceil(F.log2(F.col("n") / limit)).cast("int")
    got = sizes.groupBy(F.col("node").bitwiseAND(CELLS - 1).alias("cell")).agg(F.max(size).alias("size")).toArrow()  # at most CELLS rows
    out = np.zeros(CELLS, np.uint8)
    out[got.column("cell").to_numpy()] = got.column("size").to_numpy()
    return out


def similar_pairs(sets: DataFrame, threshold: float, recall: float = 0.95, limit: int = LIMIT) -> DataFrame:
    """(a, b, similarity) of the distinct sets (by key, a < b) at or above the threshold, written."""
    sc = sets.sparkSession.sparkContext
    reps = representatives(sets)
    trees = trees_for(recall, threshold)
    counted = reps.select("coords").mapInArrow(_counter(trees), "node bigint, n bigint")
    classes = size_classes(counted, limit)
    shared = sc.broadcast(classes)
    rows = reps.select("key", "s0", "s1", "coords")
    entries = rows.mapInArrow(_enter(trees, shared), _ENTRIES)
    if classes.any():
        open_ = written(rows.mapInArrow(_open_first(trees, shared), _OPEN), "open")
        for depth in range(DEPTH + 1, MAX_DEPTH + 1):
            classes = size_classes(open_.groupBy("node").agg(F.count("*").alias("n")), limit)
            shared, last = sc.broadcast(classes), depth == MAX_DEPTH or not classes.any()
            entries = entries.unionByName(open_.mapInArrow(_settle(shared, last, limit), _ENTRIES))
            if last:
                break
            open_ = written(open_.mapInArrow(_branch(shared), _OPEN), "open")
    parts = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    near = entries.repartition(parts, "node").sortWithinPartitions("node").mapInArrow(_compare, "a bigint, b bigint")
    coords = [reps.select(F.col("key").alias(k), F.col("coords").alias(f"c{k}")).hint("merge") for k in ("a", "b")]  # the same plan at any size
    near = written(near.distinct().join(coords[0], "a").join(coords[1], "b").mapInArrow(_likely, "a bigint, b bigint"), "candidates")
    wanted = near.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    first = sets.select("key", "rid", "members").mapInArrow(_marked(sc.broadcast(marks(wanted))), "key bigint, rid bigint, members binary")
    members = written(wanted.join(first, "key").groupBy("key").agg(F.min_by("members", "rid").alias("members")), "members")
    both = near.join(members.select(F.col("key").alias("a"), F.col("members").alias("ma")).hint("merge"), "a").join(members.select(F.col("key").alias("b"), F.col("members").alias("mb")).hint("merge"), "b")
    return written(both.mapInArrow(_checker(threshold), "a bigint, b bigint, similarity double"), "pairs")


def copy_pairs(owner: DataFrame, block: int = BLOCK) -> DataFrame:
    """(ia, ib), ia < ib: all records (key, id) of equal key; large groups block against block, each pair of blocks a key of its own."""
    many = owner.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1")
    parts = F.ceil(F.col("c") / block)
    mine = owner.join(many, "key").select("key", "id", F.pmod(F.xxhash64("id"), parts).alias("own"), F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1)).alias("other"))
    mine = mine.select("key", "id", "own", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))
    at = ["key", "low", "high"]
    both = mine.withColumnsRenamed({"id": "ia", "own": "oa"}).join(mine.withColumnsRenamed({"id": "ib", "own": "ob"}), at)
    return both.filter((F.col("ia") < F.col("ib")) & ((F.col("low") == F.col("high")) | (F.col("oa") != F.col("ob")))).select("ia", "ib")


def record_pairs(sets: DataFrame, threshold: float, recall: float = 0.95) -> DataFrame:
    """(id_a, id_b, similarity), smaller id first: the pairs of sets spelled out for all records that have them.

    Records with equal sets are pairs of similarity 1. Records without any three-word sequence are in no pair; a
    record delivered twice is one record. record_groups() has the same links with one row a record.
    """
    pairs = similar_pairs(sets, threshold, recall)
    owner = sets.select("key", "id").distinct()
    a, b = owner.select(F.col("key").alias("a"), F.col("id").alias("ia")), owner.select(F.col("key").alias("b"), F.col("id").alias("ib"))
    spelled = pairs.join(a, "a").join(b, "b").select("ia", "ib", "similarity")
    out = spelled.unionByName(copy_pairs(owner).withColumn("similarity", F.lit(1.0))).filter("ia <> ib")
    return out.groupBy(F.least("ia", "ib").alias("id_a"), F.greatest("ia", "ib").alias("id_b")).agg(F.max("similarity").alias("similarity"))


def components(pairs: DataFrame, a: str = "a", b: str = "b", rounds: int = 200) -> DataFrame:
    """(node, root): connected components by alternating large-star and small-star steps; root is the smallest node.

    The steps end when nothing changes, after about the logarithm of the longest path; that they don't within `rounds` is
    an error. Every step is a group-by and a join on written tables; a hub's neighbours are never gathered in one row.
    """
    edges = written(pairs.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct(), "edges")
    before = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(large.filter("u <> v").distinct(), "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("x"), "m").filter("x <> m").select(F.col("x").alias("u"), F.col("m").alias("v"))
        edges = written(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components are not settled after {rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def record_groups(sets: DataFrame, threshold: float, recall: float = 0.95) -> DataFrame:
    """(id, class_id, group_id, links), one row per record and text: its class of equal sets, the group of linked
    classes, and how many other classes it links to. Ids are the smallest record id of the class and group."""
    pairs = similar_pairs(sets, threshold, recall)
    links = pairs.select(F.explode(F.array("a", "b")).alias("key")).groupBy("key").agg(F.count("*").alias("links"))
    owner = sets.select("key", "id").distinct()
    roots = components(pairs).select(F.col("node").alias("key"), "root")
    classes = owner.groupBy("key").agg(F.min("id").alias("class_id")).join(roots, "key", "left").join(links, "key", "left")
    classes = written(classes.withColumn("root", F.coalesce("root", "key")), "classes")
    groups = classes.groupBy("root").agg(F.min("class_id").alias("group_id"))
    out = owner.join(classes.join(groups, "root"), "key")
    return out.select("id", "class_id", "group_id", F.coalesce("links", F.lit(0)).alias("links"))
