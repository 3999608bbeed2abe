"""Near-duplicate documents by an LSH forest over MinHash signatures, confirmed on full shingle sets.

1. Each text becomes the set of its distinct word shingles and a signature of 64 MinHash components of 16 bits. Texts with equal sets are one node from here on.
2. Forest: 16 trees, each the order of all signatures that starts at another component. A tree is a global sort, laid out in ranges, so that
   no prefix, however common, has to fit one task; what lies at the borders of two ranges is compared in a further step.
3. Candidates: neighbours that share a prefix of ``DEPTH`` components. Where more than ``REGION`` nodes share one, the prefix grows, component by component and for this region only,
   until it holds no more, and each node is also compared with its next neighbours in the order. So each node has a bounded number of candidates per tree. What such a region
   may have missed is made up for at the end: its nodes outside of its largest component are compared, in blocks, with all nodes of the region in other components, the closest first, in turns until
   no pair between two components is left. Pairs whose signatures agree in fewer than ``AGREE`` components are left out; at a similarity of 0.8 that loses one pair in a hundred thousand. So are
   pairs that cannot be alike by their shingles' counts per bucket: sets differ by at least as much as these counts, so that this loses none.
4. Links are confirmed on the full sets, first one per node, then the best between any two components, then all that are still between two components. Pairs inside a component
   need no check, as they cannot change it. Components are found by star contraction over tables in the shared folder.

At a similarity of 0.8 a pair is missed by all trees with probability (1 - 0.8**3)**16, about 1e-5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runsight.llm.batches import small_batches
from runsight.llm.exprs import fresh
from runsight.llm.textbytes import SPACED, Words, blocks, mix
from runsight.plans.sizing import broadcast_if_small
from runsight.session import materialize

COMPONENTS, TREES, DEPTH = 64, 16, 3
REGION = 32
NEXT = 2
#: Partners that a node outside of a large region's main component is tested against in the first turn, per block of the region: those that agree most. Each further turn
#: goes on to ``FURTHER`` times as many.
CLOSEST, FURTHER = 4, 4
#: Buckets of a set's shingles, by hash; their counts (255 at most) bound how much two sets have in common.
BUCKETS = 128
AGREE = 34
#: Pairs that agree in so many components are tried first.
SURE = 50
_SEEDS = mix(np.arange(1, COMPONENTS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def _sets(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of each text, one after the other, and their borders."""
    shingles, borders = words.shingles(n)
    sets = [np.unique(shingles[a:b]) for a, b in zip(borders[:-1], borders[1:])]
    return np.concatenate([np.zeros(0, np.uint64), *sets]), np.concatenate([[0], np.cumsum([len(s) for s in sets], dtype=np.int64)])


def signatures(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, n_shingles, key_a and key_b (128 bits that depend on the set alone), signature, counts (shingles per bucket), text_key (hash of the text); key_a to counts null for texts without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, words in blocks(batch.column(1), SPACED):
                sets, borders = _sets(words, n)
                sizes, at = np.diff(borders), borders[:-1][np.diff(borders) > 0]
                none = sizes == 0
                table = np.zeros((len(sizes), COMPONENTS), "<u2")
                keys = np.zeros((2, len(sizes)), np.uint64)
                bucket = (sets >> np.uint64(57)).astype(np.int64) + np.repeat(np.arange(len(sizes)) * BUCKETS, sizes)
                counts = np.minimum(np.bincount(bucket, minlength=len(sizes) * BUCKETS), 255).astype(np.uint8).reshape(-1, BUCKETS)
                if len(at):
                    for k, seed in enumerate(_SEEDS):
                        own = (sets ^ seed) * seed
                        own ^= own >> np.uint64(32)
                        least = np.minimum.reduceat(own * seed, at)
                        table[~none, k] = (mix(least) & np.uint64(0xFFFF)).astype("<u2")
                    for k in range(2):
                        keys[k, ~none] = np.add.reduceat(mix(sets ^ _SEEDS[k]), at)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, len(sizes)),
                        pa.array(sizes),
                        *[pa.array(k.view(np.int64), mask=none) for k in keys],
                        *[pa.array([None if e else row.tobytes() for e, row in zip(none, x)], pa.binary()) for x in (table, counts)],
                        batch.column(2).slice(first, len(sizes)),
                    ],
                    ["doc_id", "n_shingles", "key_a", "key_b", "signature", "counts", "text_key"],
                )

    keyed = small_batches(docs).select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    return keyed.mapInArrow(run, "doc_id long, n_shingles long, key_a long, key_b long, signature binary, counts binary, text_key long")


def _neighbours(table: np.ndarray, tree: np.ndarray, node: np.ndarray, region: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Candidates among sorted signatures (one row each): smaller node, larger node, equal components."""
    rows = len(node)
    common = np.zeros(rows, np.int64)  # leading components that a row shares with the one before
    if rows > 1:
        differ = table[1:] != table[:-1]
        common[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), COMPONENTS)
        common[1:][tree[1:] != tree[:-1]] = -1
    base = np.cumsum(common < DEPTH)
    need = np.full(rows, DEPTH)
    while True:
        own = np.cumsum(common < need)
        large = (np.bincount(own)[own] > region) & (need <= COMPONENTS)
        if not large.any():
            break
        need[large] += 1
    # Rows with one and the same signature are cut into stretches; neighbours in the order join them.
    first = np.searchsorted(own, own)
    own = own * (rows + 1) + (np.arange(rows) - first) // region
    left, right, equal = [], [], []
    for step in range(1, region):
        at = np.flatnonzero(own[step:] == own[:-step]) if step < rows else np.zeros(0, int)
        if step <= NEXT and step < rows:
            at = np.union1d(at, np.flatnonzero(base[step:] == base[:-step]))
        if not len(at):
            if step > NEXT:
                break
            continue
        same = (table[at] == table[at + step]).sum(axis=1)
        at, same = at[same >= AGREE], same[same >= AGREE]
        left.append(np.minimum(node[at], node[at + step]))
        right.append(np.maximum(node[at], node[at + step]))
        equal.append(same)
    if not left:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0, int)
    a, b, c = np.concatenate(left), np.concatenate(right), np.concatenate(equal)
    return a[a < b], b[a < b], c[a < b]


_EDGE = "a long, b long, same long, part long, side long, place long, tree long, branch binary"


def _rows(a, b, same, *edge) -> pa.RecordBatch:
    """Pairs, or, with five more columns, border rows (node in ``a``)."""
    n = len(a)
    none = [pa.nulls(n, pa.int64())] * 4 + [pa.nulls(n, pa.binary())]
    columns = [pa.array(x, pa.int64()) if not isinstance(x, pa.Array) else x for x in (a, b, same)]
    return pa.RecordBatch.from_arrays(columns + (list(edge) if edge else none), [c.split()[0] for c in _EDGE.split(", ")])


def _turned(tree: Column) -> Column:
    """A signature as a tree orders it."""
    step = 2 * COMPONENTS // TREES
    return F.concat(F.substr("signature", tree * step + 1, F.lit(2 * COMPONENTS)), F.substr("signature", F.lit(1), tree * step))


def forest(nodes: DataFrame, *more: str) -> DataFrame:
    """(tree, branch, node): the signature of every node as each tree orders it, and ``more`` columns of the node."""
    turned = F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.struct(t.cast("long").alias("tree"), _turned(t).alias("branch")))
    return nodes.select("node", *more, F.explode(turned).alias("x")).select("x.tree", "x.branch", "node", *more)


def candidates(nodes: DataFrame, region: int = REGION) -> DataFrame:
    """(a, b, same) with a < b: distinct candidate pairs of nodes (node, signature) over all trees."""
    ordered = forest(nodes).repartitionByRange("tree", "branch", "node").sortWithinPartitions("tree", "branch", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        rows = pa.Table.from_batches(held)
        tree, node = rows.column(0).to_numpy(), rows.column(2).to_numpy()
        branches = rows.column(1).to_pylist()
        table = np.frombuffer(b"".join(branches), "<u2").reshape(len(node), COMPONENTS)
        yield _rows(*_neighbours(table, tree, node, region))
        part, n = TaskContext.get().partitionId(), len(node)
        for side, own in ((1, [*range(min(region, n))]), (0, [*range(max(0, n - region), n)])):
            k, none = len(own), pa.nulls(len(own), pa.int64())
            yield _rows(
                node[own], none, none, pa.array([part] * k), pa.array([side] * k), pa.array(own), pa.array(tree[own]), pa.array([branches[i] for i in own], pa.binary())
            )

    found = materialize(ordered.mapInArrow(run, _EDGE))
    borders = found.where("b IS NULL")
    used = borders.select("part").distinct().select("part", F.row_number().over(Window.orderBy("part")).alias("number"))  # a row per range
    meeting = borders.join(used, "part").withColumn("border", F.col("number") - F.col("side"))

    def meet(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("side", "ascending"), ("place", "ascending")])
        table = np.frombuffer(b"".join(rows["branch"].to_pylist()), "<u2").reshape(rows.num_rows, COMPONENTS)
        found = _neighbours(table, rows["tree"].to_numpy(), rows["a"].to_numpy(), region)
        return pa.table([pa.array(x, pa.int64()) for x in found], ["a", "b", "same"])

    across = meeting.groupBy("border").applyInArrow(meet, "a long, b long, same long")
    return found.where("b IS NOT NULL").select("a", "b", "same").unionByName(across).distinct()


_MISSED = ["a", "b", "same", "tree", "stem"]


def crowded(nodes: DataFrame, stars: DataFrame, region: int = REGION) -> tuple[DataFrame, DataFrame]:
    """Regions too large for all their pairs that hold several components: (tree, stem, n, n_strays, main), and the nodes in them, one row each, with ``places``, their regions.

    ``main`` is the largest component, so that of any two nodes in different components one at least is outside of it. It stays as it is while components grow together.
    """
    stem = F.substr("branch", F.lit(1), F.lit(2 * DEPTH)).alias("stem")
    large = materialize(forest(nodes).groupBy("tree", stem).agg(F.count("*").alias("n")).where(F.col("n") > region))
    own = nodes.join(stars, "node", "left").withColumn("first", F.coalesce("component", "node"))  # before a node is copied for the trees
    held = ["node", "first", "signature", "n_shingles", "counts"]
    members = materialize(forest(own, *held[1:]).select("tree", stem, *held).join(broadcast_if_small(large.select("tree", "stem"), stored=True), ["tree", "stem"]))
    sizes = members.groupBy("tree", "stem", "first").agg(F.count("*").alias("k"))
    main = sizes.groupBy("tree", "stem").agg(F.max_by("first", F.struct("k", "first")).alias("main"), F.sum("k").alias("n"), (F.sum("k") - F.max("k")).alias("n_strays"))
    regions = materialize(main.where("n_strays > 0"))
    places = members.join(broadcast_if_small(regions, stored=True), ["tree", "stem"]).groupBy(*held).agg(F.collect_list(F.struct(*regions.columns)).alias("places"))
    return regions, materialize(places)


def strays(regions: DataFrame, held: DataFrame, stars: DataFrame, percent: int, low: int, high: int, block: int = 2048) -> DataFrame:
    """(a, b, same, tree, stem): pairs that ``regions`` (tree, stem), too large for all their pairs, may have missed, and tree and stem alone of those in which some are left for further turns.

    Nodes outside of a region's main component are compared with all others of the region. Per block, partners that may be alike have a fixed order, the closest first;
    those in places ``low`` to ``high`` that are in another component by now are candidates. A pair that shares a region of an earlier tree is left to that tree. Both sides are cut into blocks of
    about ``block`` nodes, so that no task holds a whole region. As components only grow, a region without pairs for further turns stays without.
    """
    now = held.join(stars, "node", "left").withColumn("component", F.coalesce("component", "node"))  # one row per node
    placed = now.withColumn("x", F.explode("places")).select(*now.columns, "x.*").join(broadcast_if_small(regions.select("tree", "stem"), stored=True), ["tree", "stem"], "left_semi")
    placed = placed.withColumn("branch", _turned(F.col("tree").cast("int")))
    count = lambda n: F.ceil(F.col(n) / block).cast("int")
    own = lambda n: F.pmod(F.xxhash64("node"), count(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), count(n) - 1))
    key, columns = ["tree", "stem", "left", "right"], ["node", "component", "n_shingles", "branch", "counts"]
    left = placed.select("tree", "stem", own("n").alias("left"), every("n_strays").alias("right"), *columns)
    right = materialize(placed.where("first <> main").select(own("n_strays").alias("right"), every("n").alias("left"), "tree", "stem", *columns))

    def compare(these: pa.Table, those: pa.Table) -> pa.Table:
        found: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(3)]
        none = lambda n: [pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())]
        further = False
        if these.num_rows and those.num_rows:
            (na, ca, sa, ta, ka), (nb, cb, sb, tb, kb) = [
                (*[t[c].to_numpy() for c in columns[:3]], np.frombuffer(b"".join(t["branch"].to_pylist()), "<u2").reshape(-1, COMPONENTS), np.frombuffer(b"".join(t["counts"].to_pylist()), np.uint8).reshape(-1, BUCKETS).astype(np.int16))
                for t in (these.sort_by("node"), those)
            ]
            earlier = TREES - int(those["tree"][0].as_py())  # branches start with the tree's own components: those of earlier trees come last
            for node, component, size, row, held in zip(nb, cb, sb, tb, kb):
                equal = ta == row
                same = equal.sum(axis=1)
                at = np.flatnonzero((same >= AGREE) & (na != node))
                at = at[~equal[at].reshape(len(at), TREES, COMPONENTS // TREES)[:, earlier:, :DEPTH].all(axis=2).any(axis=1)]
                both = (sa[at] + size - np.abs(ka[at] - held).sum(axis=1, dtype=np.int64)) // 2  # at most so many shingles in common
                at = at[100 * both >= percent * (sa[at] + size - both)]
                at = at[np.argsort(-same[at], kind="stable")]
                further = further or bool((ca[at[high:]] != component).any())
                at = at[low:high]
                at = at[ca[at] != component]
                for k, x in enumerate((np.minimum(na[at], node), np.maximum(na[at], node), same[at])):
                    found[k].append(x)
        out = [pa.array(np.concatenate(x), pa.int64()) for x in found]
        out = pa.table([*out, *none(len(out[0]))], _MISSED)
        return pa.concat_tables([out, pa.table([*[pa.nulls(1, pa.int64())] * 3, those["tree"][:1], those["stem"][:1]], _MISSED)]) if further else out

    return left.groupBy(*key).cogroup(right.select(*key, *columns).groupBy(*key)).applyInArrow(compare, "a long, b long, same long, tree long, stem binary").distinct()


def _linked(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have ``percent`` of their union in common. ``texts``: node, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                sides = [[s for _, w in blocks(part.column(c), SPACED) for s in _each(*_sets(w, n))] for c in (2, 3)]
                for k, (x, y) in enumerate(zip(*sides)):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep[i + k] = 0 < both and 100 * both >= percent * (len(x) + len(y) - both)
            yield batch.select([0, 1]).filter(pa.array(keep))

    own = lambda c: texts.select(F.col("node").alias(c), F.col("text").alias(f"text_{c}"))
    return pairs.select("a", "b").join(own("a"), "a").join(own("b"), "b").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def _each(sets: np.ndarray, borders: np.ndarray) -> list[np.ndarray]:
    return [sets[a:b] for a, b in zip(borders[:-1], borders[1:])]


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for all nodes with a link (a, b). Links are replaced by stars until nothing changes."""
    edges, before = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()), None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if state == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = state
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        edges = materialize(large)
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        small = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        edges = materialize(small.where("u <> v").distinct())


def _confirmed(pairs: DataFrame, texts: DataFrame, n: int, percent: int, stars: DataFrame | None = None) -> DataFrame | None:
    """(node, component) of the nodes that confirmed links join, None without any link. On top of known ``stars`` all pairs between components are tested at once."""
    tested = None
    for turn in ("partner", "best", "all") if stars is None else ("all",):
        open_pairs = pairs
        if tested is not None:
            open_pairs = open_pairs.join(tested, ["a", "b"], "left_anti")
        if stars is not None:
            own = lambda c: stars.select(F.col("node").alias(c), F.col("component").alias(f"of_{c}"))  # noqa: E731, B023
            open_pairs = open_pairs.join(own("a"), "a", "left").join(own("b"), "b", "left")
            open_pairs = open_pairs.withColumns({"of_a": F.coalesce("of_a", "a"), "of_b": F.coalesce("of_b", "b")}).where("of_a <> of_b")
        if turn == "partner":  # per node the smallest sure partner, so that a group of copies becomes a star
            chosen = open_pairs.groupBy("b").agg(F.min_by("a", F.struct(F.col("same") < SURE, F.col("a"))).alias("a"))
        elif turn == "best" and stars is not None:
            ends = [F.least("of_a", "of_b").alias("x"), F.greatest("of_a", "of_b").alias("y")]
            chosen = open_pairs.groupBy(*ends).agg(F.max_by(F.struct("a", "b"), F.struct("same", "a", "b")).alias("p")).select("p.a", "p.b")
        else:
            chosen = open_pairs
        chosen = materialize(chosen.select("a", "b"))
        if chosen.isEmpty():
            break
        links = _linked(chosen, texts, n, percent)
        if stars is not None:
            links = links.unionByName(stars.select(F.col("component").alias("a"), F.col("node").alias("b")))
        stars = components(links)
        tested = chosen if tested is None else tested.unionByName(chosen)
    return stars


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80, region: int = REGION) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable over links, itself included), kept (whether it is that document).

    Words are maximal runs without white space, A-Z lower-cased; a text with fewer than ``n`` words is one shingle. Null or empty texts have no shingle and no link. Rows
    that share a doc_id are one document with several texts; rows without a doc_id are not linked, have no component and are kept. An empty table gives no rows. Only
    doc_id and text are read.
    """
    return _grouped(docs, n, percent, region).drop("text_key")


def _grouped(docs: DataFrame, n: int, percent: int, region: int = REGION) -> DataFrame:
    """Rows of ``near_duplicates`` with the hash of their text."""
    own = materialize(signatures(docs, n))
    sets = own.where("doc_id IS NOT NULL AND key_a IS NOT NULL").groupBy("key_a", "key_b").agg(F.min("doc_id").alias("node"), *[F.first(c).alias(c) for c in ("signature", "n_shingles", "counts")])
    sets = materialize(sets)
    pairs = materialize(candidates(sets, region))

    def texts_of(some: DataFrame) -> DataFrame:
        wanted = materialize(some.select(F.col("a").alias("node")).unionByName(some.select(F.col("b").alias("node"))).distinct())
        return materialize(docs.where("text IS NOT NULL").select(F.col("doc_id").alias("node"), "text").join(broadcast_if_small(wanted, stored=True), "node"))

    stars = _confirmed(pairs, texts_of(pairs), n, percent)
    if stars is None:
        stars = docs.sparkSession.createDataFrame([], "node long, component long")
    regions, held = crowded(sets, stars, region)
    low, high = 0, CLOSEST
    while not regions.isEmpty():
        found = materialize(strays(regions, held, stars, percent, low, high))
        missed = found.where("a IS NOT NULL").select("a", "b", "same")
        if not missed.isEmpty():
            stars = _confirmed(missed, texts_of(missed), n, percent, stars)
        regions = materialize(found.where("a IS NULL").select("tree", "stem"))
        low, high = high, FURTHER * high
    placed = own.join(sets.select("key_a", "key_b", "node"), ["key_a", "key_b"], "left")
    placed = placed.join(stars, "node", "left").withColumn("component_id", F.coalesce("component", "node", "doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), F.col("component_id"))
    return placed.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"), "text_key")


def deduplicate(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each group of near-duplicates, the one with the smallest doc_id; all columns stay.

    Where rows share a doc_id, each is judged by its own text: a row goes if its component has a smaller doc_id, and of the texts of one component under the kept doc_id one stays. Rows without a doc_id or without
    words stay. Texts are not shuffled unless the removed rows are too many to be sent to every task.
    """
    key, held_id, held_key = (fresh(docs, name) for name in ("own_text_key", "held_doc_id", "held_text_key"))
    found = materialize(_grouped(docs, n, percent))
    gone = materialize(found.where("NOT kept").select("doc_id", "text_key").distinct())
    marked = docs.withColumn(key, F.xxhash64("text"))
    away = lambda some: broadcast_if_small(some.select(F.col("doc_id").alias(held_id), F.col("text_key").alias(held_key)), stored=True)
    same = (F.col("doc_id") == F.col(held_id)) & (F.col(key) == F.col(held_key))
    left = marked.join(away(gone), same, "left_anti")
    repeats = found.where("kept AND doc_id IS NOT NULL AND n_shingles > 0").groupBy("doc_id", "component_id").agg(F.count("*").alias("n"), F.min("text_key").alias("first"))
    again = materialize(repeats.where("n > 1").select("doc_id", "component_id", "first"))
    if again.isEmpty():
        return left.select(*docs.columns)
    texts = materialize(found.where("n_shingles > 0").join(again, ["doc_id", "component_id"]).select("doc_id", "text_key", "first").distinct())
    rest = left.join(away(texts), same, "left_anti")
    once = left.join(away(texts.where("text_key = first")), same, "left_semi").dropDuplicates(["doc_id", key])
    return rest.unionByName(once).select(*docs.columns)
