"""Near-duplicate texts by a chosen-path set similarity join.

A text is the set of its k-word shingles. Equal sets are one class. Each class walks
down TREES independent trees: at every level of a tree it follows the branch named by
one minwise token of its set, so two sets stay together with the probability of their
Jaccard similarity. A node of few classes, NEAR levels down, is compared exhaustively on
8-bit minwise sketches. The classes of larger nodes branch on together: each takes
BRANCHES paths of DEEP tokens, drawn from all its tokens. A node of few classes there is
compared, a larger one goes on as one star. The links found so far only bound where true
links can lie: their components are groups whose full shingle sets are then compared
exactly, in blocks of a bounded size.

A pair at the threshold t shares no node at the first level with probability
(1 - t**NEAR)**TREES, 2.4e-7 for t = 0.85 and 1.03e-5 for t = 0.8. If it shares one and
all it shares are large, both sets branch on, and then they share no path with probability
1.1e-8 and 4.6e-6 at most: the mean of (1 - C(m, DEEP) / C(128, DEEP))**BRANCHES over the
m of 128 tokens that agree. So a pair is lost with probability 2.5e-7 or 1.5e-5 at most,
however large its nodes are.

A group above a block's size is dealt over blocks by hash, and a few of its classes visit
all its blocks. Of the pairs left, only those with a class outside the group's largest
component can still join two components. Where these classes fill a block or two, they
meet every block of the group in tiles of two blocks. Where they are more, as the pages of
one template are, a prefix filter comes first: with a set's shingles in order of their
frequency in the group, two sets that link share one of their first n - least overlap + 1.
Shingles of one class alone open most prefixes, so classes that can link with nothing drop
out; a shared shingle of at most LIGHT classes names its pairs, which are compared one by
one, and classes whose prefixes reach more frequent shingles meet in tiles, as above. Tiles
are made of classes whose sizes allow a link. Pairs
inside a component are never written out: a block returns a spanning forest.

Cases: null and word-free texts have the empty set and link with nothing; a null id
links with nothing and is kept, with a null component; rows of one id are one node.
Repeated rows come out once each. Other columns are ignored, or kept by `keep_one`,
whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import textcore as T
from quern.llm.components import connected_components
from quern.llm.lineage import bound_batches, free_names, in_few, refuse_clash, stored

TREES = 16
#: Tokens that name a node of a tree; the classes of a node above LEAF take BRANCHES paths of DEEP tokens.
NEAR = 3
DEEP = 8
BRANCHES = 160
LEAF = 32
#: Sketches below the threshold less this are no candidates: 4.5 standard deviations at 128 tokens.
SLACK = 0.16
#: Shingles in a block that is compared exactly.
BLOCK = 150_000
#: Hash buckets of ids that are broadcast to spare texts a shuffle.
ID_BUCKETS = 1 << 19
#: Classes of a large group that visit all its blocks first.
HUBS = 8
#: Blocks of classes outside a group's largest component that meet all its blocks without a prefix filter.
DIRECT = 2
#: A shingle in more classes of a group than this names no pairs: the classes meet in tiles.
LIGHT = 64
#: Ratio of the sizes in a cell of classes that are dealt together.
CELL = 1.05
#: Candidates that are compared with one class in a task.
FEW = 256
#: Classes in a tree node above which its rows are dealt over SALTS tasks.
CROWD = 1024
SALTS = 64

_FUNCTIONS = np.random.default_rng(77).integers(1, 2**63, TREES * DEEP, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: The tokens of each path; the paths of one permutation have none in common.
_PATHS = np.concatenate([np.random.default_rng(78 + i).permutation(TREES * DEEP).reshape(-1, DEEP) for i in range(BRANCHES // TREES)])


def _signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Minwise tokens, a row per non-empty set and a column per function; unsigned 32-bit."""
    x = np.concatenate(sets)
    at = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out = np.empty((len(sets), len(_FUNCTIONS)), np.uint32)
    for f, a in enumerate(_FUNCTIONS):
        out[:, f] = np.minimum.reduceat(x * a, at) >> np.uint64(32)
    return out


def fingerprint(docs: DataFrame, doc_id: str, text: str, k: int) -> DataFrame:
    """(id, n, h1, h2, keys, sketch): size and 128-bit hash of the set, a branch key per tree, and the sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = T.text_buffers(batch.column(1))
            for lo, hi in T.slices(off):
                sets = T.shingle_sets(T.Words(data, off[lo : hi + 1], T.SPACE), k)
                n = np.array([len(s) for s in sets], np.int64)
                full = np.flatnonzero(n)
                h = np.zeros((2, len(sets)), np.uint64)
                keys: list = [None] * len(sets)
                sketch: list = [None] * len(sets)
                if len(full):
                    some = [sets[i] for i in full]
                    sig = _signatures(some)
                    x = np.concatenate(some)
                    at = np.concatenate([[0], np.cumsum(n[full])[:-1]])
                    h[0, full] = np.add.reduceat(T.mix(x), at)
                    h[1, full] = np.add.reduceat(T.mix(x ^ np.uint64(0x5851F42D4C957F2D)), at)
                    byte = sig.astype(np.uint8)
                    path = sig.reshape(len(full), TREES, DEEP).astype(np.uint64)
                    run_key = T.mix(np.broadcast_to(np.arange(1, TREES + 1, dtype=np.uint64), (len(full), TREES)).copy())
                    for d in range(NEAR):
                        run_key = T.mix(run_key * np.uint64(0x9E3779B97F4A7C15) + path[:, :, d])
                    packed = run_key.view(np.int64)
                    for r, i in enumerate(full.tolist()):
                        keys[i], sketch[i] = packed[r], byte[r].tobytes()
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(n), pa.array(h[0].view(np.int64)), pa.array(h[1].view(np.int64)), pa.array(keys, pa.list_(pa.int64())), pa.array(sketch, pa.binary())],
                    names=["id", "n", "h1", "h2", "keys", "sketch"],
                )

    src = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    return src.mapInArrow(run, "id long, n long, h1 long, h2 long, keys array<long>, sketch binary")


def _runs(batches: Iterator[pa.RecordBatch], column: int = 0) -> Iterator[pa.RecordBatch]:
    """Batches in which the rows of one key, which follow each other, are together."""
    held: list[pa.RecordBatch] = []
    last_key = None

    def merged() -> pa.RecordBatch:
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(column).to_numpy()
        if held and key[0] != last_key:
            yield merged()
            held = []
        change = np.flatnonzero(key[1:] != key[:-1]) + 1
        if len(change):
            held.append(batch.slice(0, change[0]))
            yield merged()
            if change[-1] > change[0]:
                yield batch.slice(change[0], change[-1] - change[0])
            held = [batch.slice(change[-1])]
        else:
            held.append(batch)
        last_key = key[-1]
    if held:
        yield merged()


class _Forest:
    """Union-find over places of a block."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True


def _leaf_links(least: float):
    """From (key, id, sketch) sorted by key: a spanning forest of each node's pairs of sketches that agree enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _runs(batches):
            key, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            sk = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(len(key), -1)
            need = (least + (1 - least) / 256) * sk.shape[1]
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            sizes = np.diff(np.append(starts, len(key)))
            out_a, out_b = [], []
            for size in np.unique(sizes).tolist():
                if size < 2:
                    continue
                at = starts[sizes == size]
                i, j = np.triu_indices(size, 1)
                step = max(1, 200_000 // len(i))
                for lo in range(0, len(at), step):
                    a, b = at[lo : lo + step, None] + i, at[lo : lo + step, None] + j
                    hit = (sk[a.ravel()] == sk[b.ravel()]).sum(axis=1).reshape(a.shape) >= need
                    if size == 2:
                        out_a.append(a[hit])
                        out_b.append(b[hit])
                        continue
                    for g in np.flatnonzero(hit.any(axis=1)).tolist():
                        forest, row = _Forest(size), at[lo + g]
                        for p in np.flatnonzero(hit[g]).tolist():
                            if forest.join(int(i[p]), int(j[p])):
                                out_a.append([row + i[p]])
                                out_b.append([row + j[p]])
            a = ids[np.concatenate(out_a).astype(np.int64)] if out_a else np.zeros(0, np.int64)
            b = ids[np.concatenate(out_b).astype(np.int64)] if out_b else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], names=["a", "b"])

    return run


def _branches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (id, sketch): (id, key) of each path."""
    tree = T.mix(np.arange(1, len(_PATHS) + 1, dtype=np.uint64))
    for whole in batches:
        for lo in range(0, whole.num_rows, 512):
            batch = whole.slice(lo, 512)
            sk = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
            key = T.mix(np.ascontiguousarray(sk[:, _PATHS]).view(np.uint64)[:, :, 0] * np.uint64(0x9E3779B97F4A7C15) + tree)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), len(_PATHS))), pa.array(key.view(np.int64).ravel())], names=["id", "key"])


def candidate_links(classes: DataFrame, threshold: float, most: int) -> tuple[DataFrame, int]:
    """(a, b) between at most `most` classes (id, keys, sketch), whose components hold every link that the trees find; and about how many."""

    def met(rows: DataFrame, most: int) -> DataFrame:
        """The rows of nodes that two classes or more are in, with the node's size and least id.

        Rows in the hash buckets of crowded nodes are salted, so no task gets a node whole;
        the buckets are at most ID_BUCKETS numbers. There are `most` rows at most.
        """
        size = stored(rows.groupBy("key").agg(F.count("*").alias("size"), F.min("id").alias("hub")).filter("size > 1"), rows=most // 2)
        bucket = F.pmod(F.xxhash64("key"), F.lit(ID_BUCKETS)).cast("int").alias("bucket")
        crowds = F.broadcast(size.filter(F.col("size") > CROWD).select(bucket).distinct().withColumn("salts", F.lit(SALTS)))
        dealt = rows.select("*", bucket).join(crowds, "bucket", "left").select("id", "key", F.pmod(F.xxhash64("id", F.lit(9)), F.coalesce("salts", F.lit(1))).cast("int").alias("salt"))
        each = size.select("*", bucket).join(crowds, "bucket", "left").select("key", "size", "hub", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)).alias("salt"))
        return stored(dealt.join(each, ["key", "salt"]).select("id", "key", "size", "hub"), rows=size.agg(F.sum("size")).first()[0] or 0)

    first = met(classes.select("id", F.explode("keys").alias("key")), most * TREES)
    crowded = first.filter(F.col("size") > LEAF).select("id").distinct()
    paths = stored(classes.select("id", "sketch").join(crowded, "id", "left_semi").mapInArrow(_branches, "id long, key long"), rows=crowded.count() * len(_PATHS))
    deep = met(paths, paths.count())
    stars = deep.filter((F.col("size") > LEAF) & (F.col("id") != F.col("hub"))).select(F.col("id").alias("a"), F.col("hub").alias("b"))
    leaf = first.union(deep).filter(F.col("size") <= LEAF).select("key", "id")
    with_sketch = leaf.join(classes.select("id", "sketch"), "id").select("key", "id", "sketch")
    parts = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    links = with_sketch.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(_leaf_links(threshold - SLACK), "a long, b long")
    return links.union(stars).distinct(), first.count() + deep.count()


def _exact_links(k: int, percent: int):
    """From (block, visit, id, text, late) sorted by block: a spanning forest of the links, confirmed on full sets.

    visit 0: at home here; 1: a visitor, compared with all; 2: at home, but compared with
    visitors alone. `late` shingles of a set are known to be in none of the others here.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _runs(batches):
            block = batch.column(0).to_numpy()
            visit, ids, none = batch.column(1).to_numpy(), batch.column(2).to_numpy(), batch.column(4).to_numpy()
            cuts = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1], [True]])).tolist()
            la: list[int] = []
            lb: list[int] = []
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if (visit[lo:hi] == 2).all():
                    continue
                data, off = T.text_buffers(batch.column(3).slice(lo, hi - lo))
                sets: list[np.ndarray] = []
                for p, q in T.slices(off):
                    sets += T.shingle_sets(T.Words(data, off[p : q + 1], T.SPACE), k)
                n = np.array([len(s) for s in sets], np.int64)
                _, code = np.unique(np.concatenate(sets), return_inverse=True)
                at = np.concatenate([[0], np.cumsum(n)])
                marked = np.zeros(len(code) and int(code.max()) + 1, bool)
                forest = _Forest(hi - lo)
                who, role = ids[lo:hi], visit[lo:hi]
                open_to = n - none[lo:hi]
                order = np.argsort(-role * (role == 1), kind="stable").tolist()
                trees = hi - lo
                for p in order:
                    if role[p] == 2 or trees == 1:
                        break
                    # Of no pair may the intersection be larger than what both sets have open.
                    may = (n > 0) & ((100 + percent) * np.minimum(open_to, open_to[p]) >= percent * (n + n[p]))
                    may[p] = False
                    if not may.any():
                        continue
                    mine = code[at[p] : at[p + 1]]
                    marked[mine] = True
                    both = np.add.reduceat(np.append(marked[code], False), at[:-1], dtype=np.int64)
                    marked[mine] = False
                    linked = may & (100 * both >= percent * (n + n[p] - both))
                    for q in np.flatnonzero(linked).tolist():
                        if forest.join(p, q):
                            trees -= 1
                            if who[p] != who[q]:
                                la.append(max(who[p], who[q]))
                                lb.append(min(who[p], who[q]))
            yield pa.RecordBatch.from_arrays([pa.array(la, pa.int64()), pa.array(lb, pa.int64())], names=["a", "b"])

    return run


def _compare(blocks: DataFrame, k: int, percent: int) -> DataFrame:
    parts = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return blocks.select("block", "visit", "id", "text", "late").repartition(parts, "block").sortWithinPartitions("block").mapInArrow(_exact_links(k, percent), "a long, b long")


def maybe_among(rows: DataFrame, ids: DataFrame, id_column: str, absent: bool = False) -> DataFrame:
    """The rows whose id's hash bucket holds some id of `ids`, or those whose bucket holds none.

    At most ID_BUCKETS bucket numbers are broadcast, whatever the tables, so that only
    rows that may join are shuffled.
    """

    def bucket(c: str):
        return F.pmod(F.xxhash64(F.col(f"`{c}`").cast("long")), F.lit(ID_BUCKETS)).cast("int")

    (name,) = free_names(rows.columns, "bucket")
    some = ids.select(bucket("id").alias(name)).distinct()
    return rows.withColumn(name, bucket(id_column)).join(F.broadcast(some), name, "left_anti" if absent else "left_semi").drop(name)


def _shingle_rows(k: int):
    """From (component, id, text): a row per distinct shingle (component, id, copy, n, token)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = T.text_buffers(batch.column(2))
            for lo, hi in T.slices(off):
                sets = T.shingle_sets(T.Words(data, off[lo : hi + 1], T.SPACE), k)
                n = np.array([len(s) for s in sets], np.int64)
                token = np.concatenate(sets)
                copy = np.array([np.bitwise_xor.reduce(T.mix(s)) if len(s) else 0 for s in sets], np.uint64).view(np.int64)
                take = pa.array(np.repeat(np.arange(lo, hi), n))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(take), batch.column(1).take(take), pa.array(np.repeat(copy, n)), pa.array(np.repeat(n, n)), pa.array(token.view(np.int64))],
                    names=["component", "id", "copy", "n", "token"],
                )

    return run


def prefixes(members: DataFrame, k: int, percent: int) -> DataFrame:
    """(component, id, n, rest, at, df, token) of the shingles that a class must share one of to link, `at` being their places in order of frequency.

    From members (component, id, text, rest). Shingles of one class, and those of no class
    in `rest`, are not given.
    """
    once = members.select("component", "id", "text", "rest")
    every = stored(once.select("component", "id", "text").mapInArrow(_shingle_rows(k), "component long, id long, copy long, n long, token long").distinct())
    flag = once.groupBy("id").agg(F.max("rest").alias("rest"))
    df = every.groupBy("component", "token").agg(F.count("*").alias("df")).filter("df > 1")
    sets = every.join(df, ["component", "token"]).groupBy("component", "id", "copy", "n").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("shared"))
    alone = F.col("n") - F.size("shared")
    least = F.ceil(F.col("n") * percent / 100)
    first = sets.withColumn("alone", alone).withColumn("head", F.slice("shared", F.lit(1), F.greatest(F.col("n") - least + 1 - alone, F.lit(0)).cast("int"))).filter("size(head) > 0")
    return stored(first.select("component", "id", "n", "alone", F.posexplode("head").alias("place", "s")).join(flag, "id").select("component", "id", "n", "rest", (F.col("alone") + F.col("place")).alias("at"), "s.df", "s.token"))


def light_pairs(heads: DataFrame, percent: int) -> DataFrame:
    """(x, y): the pairs, x outside the largest component, that share a light shingle of their prefixes and can reach the overlap from there."""
    x = heads.filter(F.col("rest") & (F.col("df") <= LIGHT)).select("component", "token", F.col("id").alias("x"), F.col("n").alias("nx"), F.col("at").alias("ax"))
    y = heads.filter(F.col("df") <= LIGHT).select("component", "token", F.col("id").alias("y"), F.col("n").alias("ny"), F.col("at").alias("ay"), "rest")
    reach = (100 + percent) * F.least(F.col("nx") - F.col("ax"), F.col("ny") - F.col("ay")) >= percent * (F.col("nx") + F.col("ny"))
    return x.join(y, ["component", "token"]).filter((F.col("x") != F.col("y")) & (~F.col("rest") | (F.col("x") < F.col("y"))) & reach).select("x", "y").distinct()


def _tiles(members: DataFrame, percent: int) -> DataFrame:
    """(block, visit, id, text, late): every class of `rest` meets the classes of its group whose size allows a link, in tiles of two blocks.

    The first `late` shingles of a class are known to be in none of the others, which
    narrows the sizes that a partner may have. Sizes are dealt in cells of CELL ratio; a
    cell that nothing visits is not sent.
    """
    n, cell = F.col("n"), lambda size: F.floor(F.log(size.cast("double")) / math.log(CELL)).cast("int")
    least, most = F.ceil(n * percent / 100), F.least(F.floor(n * 100 / percent), F.floor((100 + percent) * (n - F.col("late")) / percent) - n)
    home = members.withColumn("cell", cell(n))
    visit = members.filter("rest").withColumn("least", least).withColumn("most", most).filter("most >= least").withColumn("cell", F.explode(F.sequence(cell(F.col("least")), cell(F.col("most")))))
    blocks = lambda rows, name: rows.groupBy("component", "cell").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias(name))
    plan = stored(blocks(visit, "rows").join(blocks(home, "cols"), ["component", "cell"]))
    own = lambda parts: F.pmod(F.xxhash64("id", F.lit(21)), F.col(parts)).cast("int")
    to = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
    at_home = home.join(plan, ["component", "cell"]).select("component", "cell", "id", "text", "late", to("rows").alias("i"), own("cols").alias("j"), F.lit(2).alias("visit"))
    visitors = visit.join(plan, ["component", "cell"]).select("component", "cell", "id", "text", "late", own("rows").alias("i"), to("cols").alias("j"), F.lit(1).alias("visit"))
    return at_home.union(visitors).select(F.xxhash64("component", "cell", "i", "j").alias("block"), "visit", "id", "text", "late")


def _pair_blocks(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(block, visit, id, text, late): every x meets its y, at most about FEW of them in a block."""
    count = pairs.groupBy("x").agg(F.ceil(F.count("*") / FEW).cast("int").alias("parts"))
    block = lambda part: F.xxhash64(F.col("x"), F.lit(23), part)
    y = pairs.join(count, "x").select(block(F.pmod(F.xxhash64("y"), F.col("parts"))).alias("block"), F.lit(2).alias("visit"), F.col("y").alias("id"))
    x = count.select("x", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1)).alias("part")).select(block(F.col("part")).alias("block"), F.lit(1).alias("visit"), F.col("x").alias("id"))
    return y.union(x).join(texts, "id").select("block", "visit", "id", "text", F.lit(0).cast("long").alias("late"))


def _crossing_links(large: DataFrame, k: int, percent: int) -> DataFrame:
    """(a, b): links that join classes of `rest` with others of their group; large: (component, id, n, text, rest)."""
    out = large.groupBy("component").agg(F.sum(F.when(F.col("rest"), F.col("n")).otherwise(0)).alias("crossing")).filter("crossing > 0")
    large = stored(large.join(out, "component"))
    few = large.filter(F.col("crossing") <= DIRECT * BLOCK)
    links = _compare(_tiles(few.withColumn("late", F.lit(0).cast("long")), percent), k, percent)
    many = large.filter(F.col("crossing") > DIRECT * BLOCK)
    if many.limit(1).count():
        heads = prefixes(many, k, percent)
        pairs = stored(light_pairs(heads, percent))
        late = heads.filter(F.col("df") > LIGHT).groupBy("id").agg(F.min("at").alias("late"))
        links = links.union(_compare(_pair_blocks(pairs, many.select("id", "text")), k, percent)).union(_compare(_tiles(many.join(late, "id"), percent), k, percent))
    return links


def link_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """(id, n_shingles, component_id, kept) of every row; rows link if 100 * intersection >= percent * union."""
    refuse_clash(doc_id, ["n_shingles", "component_id", "kept"])
    bound_batches(docs.sparkSession)
    prints = stored(fingerprint(docs, doc_id, text, k))
    same = stored(prints.filter("n > 0 AND id IS NOT NULL").groupBy("h1", "h2", "n").agg(F.min("id").alias("rep"), F.count("*").alias("copies")), rows=prints.count())
    classes = same.count()
    reps = prints.filter("id IS NOT NULL").join(same.select("h1", "h2", "n", F.col("rep").alias("id")), ["h1", "h2", "n", "id"], "left_semi").dropDuplicates(["id", "h1", "h2"])
    # Rows of one id with different sets are tied by their id; the exact step sees the text of each.
    near, about = candidate_links(reps.select("id", "keys", "sketch"), percent / 100, classes)
    rough = connected_components(near, rows=about)

    member = stored(reps.select("id", "n", "h1").join(rough, "id").groupBy("id", "component").agg(F.sum("n").alias("n")), rows=classes)
    groups = member.groupBy("component").agg(F.sum("n").alias("weight"))
    dealt = member.join(groups, "component").select("id", "n", "component", F.ceil(F.col("weight") / BLOCK).cast("int").alias("parts"))
    dealt = dealt.withColumn("home", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    texts = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text")).filter("id IS NOT NULL AND text IS NOT NULL")
    rows = stored(maybe_among(texts, dealt, "id").join(dealt, "id"))

    def block(part):
        return F.xxhash64("component", part)

    none = F.lit(0).cast("long").alias("late")
    small = rows.select(block(F.col("home")).alias("block"), F.lit(0).alias("visit"), "id", "text", none)
    large = rows.filter("parts > 1")
    hubs = dealt.filter("parts > 1").groupBy("component", F.pmod(F.xxhash64("id", F.lit(3)), F.lit(HUBS)).alias("slot")).agg(F.min_by("id", F.xxhash64("id", F.lit(5))).alias("id")).select("id")
    visitors = large.join(hubs, "id", "left_semi").select(F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "component", "id", "text").select(block(F.col("part")).alias("block"), F.lit(1).alias("visit"), "id", "text", none)
    links = stored(_compare(small.union(visitors), k, percent))
    found = connected_components(links, rows=links.count())
    if large.limit(1).count():
        settled = stored(dealt.filter("parts > 1").select("id", "component").join(found.withColumnRenamed("component", "now"), "id", "left").select("id", "component", F.coalesce("now", "id").alias("now")), rows=classes)
        sizes = settled.groupBy("component", "now").agg(F.count("*").alias("size"))
        main = sizes.groupBy("component").agg(F.max_by("now", F.struct("size", "now")).alias("main"))
        rest = settled.join(main, "component").select("id", (F.col("now") != F.col("main")).alias("rest"))
        more = stored(_crossing_links(large.join(rest, "id").select("component", "id", "n", "text", "rest"), k, percent))
        found = connected_components(links.union(more), rows=links.count() + more.count())
    # Rows of one id are one node even if their sets differ.
    ties = prints.filter("n > 0 AND id IS NOT NULL").select("id", "h1", "h2", "n").join(same, ["h1", "h2", "n"]).filter("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    twice = prints.filter("n > 0 AND id IS NOT NULL").groupBy("id").agg(F.min("h1").alias("x"), F.max("h1").alias("y")).filter("x <> y").limit(1).count()
    if twice:
        found = connected_components(found.filter("id <> component").select(F.col("id").alias("a"), F.col("component").alias("b")).union(ties))
        label = prints.select("id", "n").join(found, "id", "left").select("id", "n", F.coalesce("component", "id").alias("component_id"))
    else:
        label = (
            prints.select("id", "n", "h1", "h2")
            .join(same.filter("copies > 1").select("h1", "h2", "n", "rep"), ["h1", "h2", "n"], "left")
            .select("id", "n", F.coalesce(F.when(F.col("id").isNotNull(), F.col("rep")), "id").alias("rep"))
            .join(found.select(F.col("id").alias("rep"), "component"), "rep", "left")
            .select("id", "n", F.coalesce("component", "rep").alias("component_id"))
        )
    return in_few(label, prints.count()).select(F.col("id").alias(doc_id), F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """The documents, all their columns, less the near copies: of each component, and of rows of one id, one row stays."""
    marks = link_components(docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text")), "id", "text", k, percent)
    marks = stored(marks.filter("id IS NOT NULL").select("id", "kept"))
    gone = stored(marks.filter("NOT kept").select("id").distinct(), rows=marks.filter("NOT kept").count())
    twice = marks.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select("id")
    touched = stored(gone.union(twice).distinct(), rows=marks.count())
    own = F.col(f"`{doc_id}`")
    (name,) = free_names(docs.columns, "id")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    free = maybe_among(docs.filter(own.isNotNull()), touched, doc_id, absent=True).union(docs.filter(own.isNull()))
    rest = maybe_among(docs.filter(own.isNotNull()), touched, doc_id).withColumn(name, own.cast("long")).join(gone.withColumnRenamed("id", name), name, "left_anti")
    return free.select(columns).union(in_few(rest.dropDuplicates([name]), touched.count()).select(columns))


def op2_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents: 3-word shingles, similarity of 0.85 or more."""
    return link_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text", 3, 85)


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) >= 3 THEN w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] ELSE array_to_string(w, ' ') END AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, least(len(w), 1)) + 1)) AS i FROM w)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), l AS (
  SELECT x, y FROM p JOIN n u ON u.doc_id = x JOIN n v ON v.doc_id = y WHERE 100 * c >= 85 * (u.n + v.n - c)
), e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l
), r(id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.y, r.c FROM r JOIN e ON e.x = r.id WHERE r.c < e.y
), m AS (SELECT id, min(c) AS c FROM r GROUP BY id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id, m.c = d.doc_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN m ON m.id = d.doc_id
"""
