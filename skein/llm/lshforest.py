"""Near-duplicate documents through an LSH forest, confirmed on full shingle sets.

1.  Every text becomes its set of shingles, a 64-bit key of the set, and 160 min-hashes. Equal sets
    are one node from here on.
2.  Each of 32 trees orders all nodes by its own min-hashes. Orders are range-partitioned, so a dense
    stretch spreads over tasks. Rows with a common prefix of five hashes form a run; all rows of a run
    whose one-bit sketches are close enough are joined, however long the run is: within a task by
    growing components until no open row is close, across tasks against the run's least node, and what
    isn't close to that against the whole run, in blocks of bounded size.
3.  Candidates join nodes to regions (connected components). The full sets of a region's nodes are
    held against its least node's; what isn't linked to it is held against all of the region, in
    blocks of bounded size, by an inverted index over a block.
4.  Components of the confirmed links are the groups of near-duplicates.

At similarity 0.8 a tree puts a pair into a run with probability 0.8^5, so all trees miss it with
probability (1 - 0.8^5)^32 = 2.7e-6, in runs of any length; the sketch bound lies six standard deviations off.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .words import WordHashes, as_bytes, emptied, few_rows, shingles, small_batches, space_words
from .workspace import Workspace

TREES, BASE, DEPTH = 32, 5, 8
HASHES = TREES * BASE
DENSE = 512
_HALF = 256
#: Rows of a cut run in a block, and sketch pairs compared at a time.
_BLOCK, _PAIRS = 4096, 1 << 22
#: Parts that the rows of a node are dealt to when they get their group.
_SALTS = 8
_words = WordHashes()

_SIGNED = "doc_id long, node long, n_shingles long, minhash binary"
_TREE = "tree int, path binary, node long, sketch binary"


def _clean(kernel: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """What a worker knows of words goes with its task: each task meets its own words once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from emptied(kernel, _words)(batches)

    return run


def text_shingles(text: bytes, k: int) -> np.ndarray:
    return shingles(_words.array(space_words(text)), k)


def set_key(s: np.ndarray) -> int:
    import xxhash

    return int(np.array(xxhash.xxh3_64_intdigest(s.tobytes()), np.uint64).astype(np.int64))


def minhashes(s: np.ndarray, seed: int = 20) -> np.ndarray:
    """HASHES least values of s under affine maps of 32-bit words."""
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 1 << 32, HASHES, np.uint32) | np.uint32(1)
    b = rng.integers(0, 1 << 32, HASHES, np.uint32)
    x = (s ^ (s >> np.uint64(32))).astype(np.uint32)
    least = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 4096):
        least = np.minimum(least, (x[i : i + 4096, None] * a + b).min(axis=0))
    return least


def sketch_of(least: np.ndarray) -> np.ndarray:
    """One scrambled bit of each min-hash, as 64-bit words."""
    bits = np.bitwise_count(least * np.uint32(0x9E3779B1)) & 1
    return np.packbits(np.concatenate([bits, np.zeros(-len(bits) % 64, np.uint8)])).view(np.uint64)


def sketch_limit(similarity: float) -> int:
    p = (1 - similarity) / 2
    return int(HASHES * p + 6 * (HASHES * p * (1 - p)) ** 0.5)


def paths_of(least: np.ndarray) -> np.ndarray:
    """(TREES, DEPTH) 16-bit path steps: each tree starts at its own min-hashes and goes on into the next tree's."""
    steps = (least * np.uint32(0x85EBCA6B) >> np.uint32(16)).astype(">u2")
    return steps[(np.arange(TREES)[:, None] * BASE + np.arange(DEPTH)) % HASHES]


class Links(dict):
    """Union-find on the least node."""

    def find(self, x: int) -> int:
        root = x
        while (up := self.get(root, root)) != root:
            root = up
        while (up := self.get(x, x)) != root:
            self[x], x = root, up
        return root

    def unite(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self[max(a, b)] = min(a, b)
        self.setdefault(min(a, b), min(a, b))
        return a != b


def _near(x: np.ndarray, y: np.ndarray, limit: int) -> np.ndarray:
    """(len(x), len(y)) whether sketches are close."""
    far = np.bitwise_count(x[:, None, 0] ^ y[None, :, 0])
    for k in range(1, x.shape[1]):
        far = far + np.bitwise_count(x[:, None, k] ^ y[None, :, k])
    return far <= limit


def run_links(path: np.ndarray, node: np.ndarray, sketch: np.ndarray, limit: int, links: Links) -> None:
    """Unites all rows of each run (rows sorted by path, alike in ``BASE`` steps) whose sketches are close."""
    cuts = [0, *(np.flatnonzero((path[1:, :BASE] != path[:-1, :BASE]).any(axis=1)) + 1).tolist(), len(node)]
    for a, b in zip(cuts, cuts[1:]):
        if b - a < 2:
            continue
        if b - a <= DENSE:
            x, y = np.nonzero(_near(sketch[a:b], sketch[a:b], limit))
            for i, j in zip(x[x < y].tolist(), y[x < y].tolist()):
                links.unite(int(node[a + i]), int(node[a + j]))
            continue
        # Components grow from one row each: every row meets all rows that are still open.
        rest = np.arange(a, b)
        while len(rest) > 1:
            seed, front, rest = int(node[rest[0]]), rest[:1], rest[1:]
            while len(front) and len(rest):
                at, reached = 0, []
                while at < len(front) and len(rest):
                    step = max(1, _PAIRS // len(rest))
                    near = _near(sketch[front[at : at + step]], sketch[rest], limit).any(axis=0)
                    reached.append(rest[near])
                    rest = rest[~near]
                    at += step
                front = np.concatenate(reached)
                for i in front.tolist():
                    links.unite(seed, int(node[i]))


def tree_links(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Links among a task's sorted tree rows: (a, b) with b the least node of a's. Rows of the task's first
    and last run, which may go on in another task, also come as (a, b, run, sketch)."""
    links, ends = Links(), []
    held: list[tuple[np.ndarray, ...]] = []
    first = True

    def close(last: bool) -> None:
        nonlocal held, first
        if not held:
            return
        tree, path, node, sketch = (np.concatenate(x) for x in zip(*held))
        cut = np.flatnonzero((tree[1:] != tree[:-1]) | (path[1:, :BASE] != path[:-1, :BASE]).any(axis=1)) + 1
        cuts = [0, *cut.tolist(), len(tree)]
        stop = len(cuts) - 1 if last else len(cuts) - 2
        turns = [0, *(np.flatnonzero(tree[1 : cuts[stop]] != tree[: max(0, cuts[stop] - 1)]) + 1).tolist(), cuts[stop]]
        for a, b in zip(turns, turns[1:]):
            run_links(path[a:b], node[a:b], sketch[a:b], limit, links)
        for k in {k for k, end in ((0, first), (stop - 1, last)) if stop and end}:
            part = slice(cuts[k], cuts[k + 1])
            run = bytes([int(tree[part.start])]) + path[part.start, :BASE].tobytes()
            ends.extend((n, run, x.tobytes()) for n, x in zip(node[part].tolist(), sketch[part]))
        if stop:
            first = False
        held = [tuple(x[cuts[stop] :] for x in (tree, path, node, sketch))] if not last else []

    size = 0
    for batch in batches:
        if batch.num_rows:
            rows = batch.num_rows
            held.append((batch.column(0).to_numpy(), np.frombuffer(b"".join(batch.column(1).to_pylist()), ">u2").reshape(rows, DEPTH), batch.column(2).to_numpy(), np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint64).reshape(rows, -1)))
            size += rows
            if size > 100_000:
                close(False)
                size = 0
    close(True)
    out = [(a, r, None, None) for a in links if (r := links.find(a)) != a] + [(a, links.find(a), run, s) for a, run, s in ends]
    for i in range(0, len(out), 50_000):
        a, b, run, s = zip(*out[i : i + 50_000])
        yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "run": pa.array(run, pa.binary()), "sketch": pa.array(s, pa.binary())})


def _alike(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def block_links(left: list[tuple[int, int, np.ndarray]], right: Iterator[tuple[int, int, np.ndarray]], percent: int) -> list[tuple[int, int]]:
    """Confirmed links (node, node) between a block of sets and a stream of sets, as many as join groups.

    Entries are (node, group, set); left's sets are indexed by shingle."""
    sizes = np.array([len(s) for _, _, s in left])
    flat = np.concatenate([s for _, _, s in left])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], np.repeat(np.arange(len(left)), sizes)[order]
    links, out = Links(), []
    for node, group, s in right:
        lo, hi = np.searchsorted(flat, s), np.searchsorted(flat, s, side="right")
        counts = hi - lo
        ends = np.cumsum(counts)
        at = np.repeat(lo - (ends - counts), counts) + np.arange(int(ends[-1]) if len(ends) else 0)
        both = np.bincount(owner[at], minlength=len(left))
        for i in np.flatnonzero(100 * both >= percent * (sizes + len(s) - both)).tolist():
            if left[i][0] != node and links.unite(left[i][1], group):
                out.append((left[i][0], node))
    return out


def near_links(signed: DataFrame, docs: DataFrame, work: Workspace, k: int, percent: int) -> DataFrame:
    """(node, root) of all nodes that are linked to another: components of confirmed links."""
    limit = sketch_limit(percent / 100)
    nodes = signed.where("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("minhash").alias("minhash"))

    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                n = part.num_rows
                least = [np.frombuffer(x, np.uint32) for x in part.column(1).to_pylist()]
                paths, marks = np.stack([paths_of(x) for x in least]), [sketch_of(x).tobytes() for x in least]
                yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(TREES, dtype=np.int32), n)), pa.array([p.tobytes() for p in paths.reshape(n * TREES, DEPTH)], pa.binary()), pa.array(np.repeat(part.column(0).to_numpy(), TREES)), pa.array([m for m in marks for _ in range(TREES)], pa.binary())], names=["tree", "path", "node", "sketch"])

    nodes = work.table(nodes, "nodes")
    spread = lambda n, salt: F.pmod(F.xxhash64("node", F.lit(salt)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    trees = nodes.select("node", "minhash").mapInArrow(_clean(plant), _TREE).repartitionByRange("tree", "path", "node").sortWithinPartitions("tree", "path", "node")
    found = trees.mapInArrow(_clean(lambda b: tree_links(b, limit)), "a long, b long, run binary, sketch binary")
    found = work.table(found.withColumn("part", F.when(F.col("run").isNotNull(), F.spark_partition_id())), "candidates")
    work.release()
    # Runs cut by a task's end, at most one a task: what isn't close to the run's least node meets all of the run.
    ends = found.where("run is not null")
    heads = ends.groupBy("run").agg(F.min_by(F.struct("a", "sketch"), "a").alias("h"), F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo < hi")
    cut = ends.join(F.broadcast(heads.select("run", F.col("h.a").alias("head"), F.col("h.sketch").alias("other"))), "run")
    cut = work.table(cut.select("run", "a", "b", "head", "sketch", "other").mapInArrow(lambda b: _close(b, limit), "run binary, node long, grp long, linked boolean, sketch binary"), "cut")
    size = cut.groupBy("run").agg(F.count(F.lit(1)).alias("m"), F.count(F.when(~F.col("linked"), 1)).alias("u")).where("u > 0")
    size = size.select("run", F.ceil(F.col("m") / _BLOCK).cast("int").alias("nm"), F.ceil(F.col("u") / _BLOCK).cast("int").alias("nl"))
    state = cut.join(F.broadcast(size), "run")
    left = state.where("not linked").select("run", spread("nl", 1).alias("lb"), every("nm").alias("mb"), F.lit(0).alias("side"), "node", "grp", "sketch")
    right = state.select("run", every("nl").alias("lb"), spread("nm", 2).alias("mb"), F.lit(1).alias("side"), "node", "grp", "sketch")
    keys = ("run", "lb", "mb")
    dealt = left.unionByName(right).repartition(*keys).sortWithinPartitions(*keys, "side")
    across = dealt.mapInArrow(_clean(lambda b: _compare(b, lambda x, y: sketch_links(x, y, limit))), "a long, b long")
    tied = cut.where("linked and node <> grp").select(F.col("node").alias("a"), F.col("grp").alias("b"))
    regions = work.table(components(found.where("run is null").select("a", "b").unionByName(tied).unionByName(across), work), "regions")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in small_batches(batches, "text"):
            out = []
            for node, root, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), as_bytes(batch.column(2))):
                s = text_shingles(text or b"", k)
                # Another text under the same id has another key; a repeated row adds nothing.
                if node != last and set_key(s) == node:
                    out.append((node, root, s.tobytes()))
                    last = node
            if out:
                yield pa.RecordBatch.from_pydict(dict(zip(("node", "root", "shingles"), (pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.binary()))))))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            made = [text_shingles(text or b"", k) for text in as_bytes(batch.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array([set_key(s) for s in made], pa.int64()), pa.array([s.tobytes() for s in made], pa.binary())], names=["node", "shingles"])

    wanted = regions.join(nodes.select("node", "doc_id"), "node")
    found = docs.select("doc_id", "text").join(wanted.where("doc_id is not null"), "doc_id").select("node", "root", "text").mapInArrow(_clean(sets), "node long, root long, shingles binary")
    if not nodes.where("doc_id is null").isEmpty():
        # Nodes without any id are met by their key, made again from the texts of rows without an id.
        without = docs.where("doc_id is null").select("text").mapInArrow(_clean(keyed), "node long, shingles binary").groupBy("node").agg(F.first("shingles").alias("shingles"))
        found = found.unionByName(without.join(wanted.where("doc_id is null"), "node").select("node", "root", "shingles"))
    members = work.table(found, "members")
    work.release()
    heads = members.where("node = root").select("root", F.col("shingles").alias("head"))

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_rows(batches):
            n, r, x, h = (batch.column(c).to_pylist() for c in ("node", "root", "shingles", "head"))
            ok = [_alike(np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64), percent) for p, q in zip(x, h)]
            yield pa.RecordBatch.from_pydict({"node": pa.array(n, pa.int64()), "root": pa.array(r, pa.int64()), "linked": ok})

    checked = work.table(members.where("node <> root").join(heads, "root").mapInArrow(_clean(confirm), "node long, root long, linked boolean"), "checked")
    # What isn't linked to its region's head meets the whole region, in blocks of rows.
    open_ = checked.groupBy("root").agg(F.count(F.lit(1)).alias("m"), F.count(F.when(~F.col("linked"), 1)).alias("u")).where("u > 0 and m > 1")
    blocks = open_.select("root", F.ceil((F.col("m") + 1) / (2 * _HALF)).cast("int").alias("nm"), F.ceil(F.col("u") / _HALF).cast("int").alias("nl"))
    state = members.join(checked.select("node", "linked"), "node", "left").join(blocks, "root")
    rest = F.coalesce(F.col("node") != F.col("root"), F.lit(False)) & ~F.coalesce(F.col("linked"), F.lit(False))
    group = F.when(F.col("linked"), F.col("root")).otherwise(F.col("node"))
    base = work.table(state.select("root", "nm", "nl", "node", group.alias("grp"), rest.alias("rest"), "shingles"), "open")
    left = base.where("rest").select("root", spread("nl", 1).alias("lb"), every("nm").alias("mb"), F.lit(0).alias("side"), "node", "grp", "shingles")
    right = base.select("root", every("nl").alias("lb"), spread("nm", 2).alias("mb"), F.lit(1).alias("side"), "node", "grp", "shingles")
    keys = ("root", "lb", "mb")
    dealt = left.unionByName(right).repartition(*keys).sortWithinPartitions(*keys, "side")
    more = dealt.mapInArrow(_clean(lambda b: _compare(b, lambda x, y: block_links(x, y, percent))), "a long, b long")
    links = checked.where("linked").select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more)
    return components(work.table(links, "links"), work)


def sketch_links(left: list[tuple[int, int, np.ndarray]], right: Iterator[tuple[int, int, np.ndarray]], limit: int) -> list[tuple[int, int]]:
    """Links (group, group) between a block of sketches and a stream of sketches, as many as join groups."""
    import itertools

    x, links, out = np.stack([s for _, _, s in left]), Links(), []
    group = np.array([g for _, g, _ in left])
    for piece in itertools.batched(right, max(1, _PAIRS // len(left))):
        near = _near(x, np.stack([s for _, _, s in piece]), limit)
        for j, (_, g, _) in enumerate(piece):
            out += [(h, g) for h in np.unique(group[near[:, j]]).tolist() if links.unite(h, g)]
        group = np.array([links.find(g) for g in group.tolist()])
    return out


def _close(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Rows of cut runs; what is close to the run's head is in its group."""
    for batch in batches:
        if batch.num_rows:
            run, a, b, head, sketch, other = batch.columns
            x, y = (np.frombuffer(b"".join(c.to_pylist()), np.uint64).reshape(batch.num_rows, -1) for c in (sketch, other))
            linked = np.bitwise_count(x ^ y).sum(axis=1) <= limit
            yield pa.RecordBatch.from_arrays([run, a, pa.array(np.where(linked, head.to_numpy(), b.to_numpy())), pa.array(linked), sketch], names=["run", "node", "grp", "linked", "sketch"])


def _compare(batches: Iterator[pa.RecordBatch], links: Callable[[list, Iterator], list[tuple[int, int]]]) -> Iterator[pa.RecordBatch]:
    """Blocks (equal run or root, lb, mb; side 0 before 1) one after another."""
    import itertools

    def rows() -> Iterator[tuple]:
        for batch in few_rows(batches):
            yield from zip(*(c.to_pylist() for c in batch.columns))

    out: list[tuple[int, int]] = []
    for _, block in itertools.groupby(rows(), key=lambda r: r[:3]):
        left: list[tuple[int, int, np.ndarray]] = []
        right = None
        for r in block:
            if r[3] == 0:
                left.append((r[4], r[5], np.frombuffer(r[6], np.uint64)))
            elif left:
                right = itertools.chain([r], block)
                break
        if right is not None:
            out += links(left, ((r[4], r[5], np.frombuffer(r[6], np.uint64)) for r in right))
        if len(out) > 20_000:
            a, b = zip(*out)
            yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})
            out = []
    if out:
        a, b = zip(*out)
        yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def near_groups(docs: DataFrame, *, k: int = 2, percent: int = 80, work: Workspace | None = None) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_shingles, component_id, kept, text_hash, grp (a group's key).

    Empty sets (null, empty and blank texts) are linked with nothing. The least non-null id of a group is its
    component_id; a row with a null id is in its group all the same, and kept only where all of the group's ids
    are null. Rows that share an id, and repeated rows, each get a row; those with the group's least id are
    all kept. Texts are read whole, however long; an empty table gives no rows; other columns aren't read."""
    work = work or Workspace(docs.sparkSession, "forest")

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            ids, nodes, sizes, least = batch.column(0), [], [], []
            for text in as_bytes(batch.column(1)):
                s = text_shingles(text or b"", k)
                nodes.append(set_key(s))
                sizes.append(len(s))
                least.append(minhashes(s).tobytes() if len(s) else b"")
            yield pa.RecordBatch.from_arrays([ids, pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(least, pa.binary()), batch.column(2)], names=["doc_id", "node", "n_shingles", "minhash", "text_hash"])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = work.table(plain.withColumn("text_hash", F.xxhash64("text")).mapInArrow(_clean(sign), f"{_SIGNED}, text_hash long"), "signed")
    roots = work.table(near_links(signed, plain, work, k, percent), "roots")
    rows = signed.drop("minhash")
    # A group's least id is found from a row for each node, and goes back to them: copies don't meet in a task.
    nodes = rows.where("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id")).join(roots, "node", "left").withColumn("grp", F.coalesce("root", "node"))
    least = work.table(nodes.groupBy("grp").agg(F.min("doc_id").alias("least")), "least")
    told = nodes.where("root is not null").join(least, "grp").unionByName(nodes.where("root is null").withColumn("least", F.col("doc_id"))).select("node", "grp", F.col("least").alias("component_id"))
    salted = rows.where("n_shingles > 0").withColumn("salt", F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(_SALTS)))
    every = work.table(told, "told").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(_SALTS - 1).cast("long"))))
    columns = ("doc_id", "n_shingles", "component_id", "text_hash", "grp")
    whole = salted.join(every, ["node", "salt"]).select(*columns)
    empty = rows.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), "text_hash", F.col("node").alias("grp"))
    kept = F.col("doc_id").eqNullSafe(F.col("component_id"))
    return whole.unionByName(empty).select("doc_id", "n_shingles", "component_id", kept.alias("kept"), "text_hash", "grp")
