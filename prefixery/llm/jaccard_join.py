"""N-gram Jaccard join by count vectors.

A document's set is its distinct 5-word shingles (A-Z lower-cased; fewer words:
the whole sequence as one), as 64-bit hashes.  Two documents link when
100 * |A n B| >= 75 * |A u B|.  Result: per document its set size and the least
doc_id reachable by links.

1. Documents with equal sets are one class, named by a 64-bit signature of the
   set; classes are the nodes of the join.
2. Which shingles occur in two documents?  Every document sends the half of its
   set with the smallest hashes to hash buckets, packed into binary blocks.  A
   shingle that repeats within a task's block is known as shared at once and
   goes on as one entry, so that no shingle adds more than one entry per block.
   If |A n B| is to reach three quarters of the union, at least a quarter of
   the smaller one's size is found shared here (``_needed``); documents with
   fewer shared shingles link with nothing and are done.
3. Only classes that share shingles can link.  Of its shared shingles a class
   leaves out the most frequent, one less than the number it must have in common
   with any partner: the rarest common shingle of a linking pair stays with both.
   So a passage that many texts share seldom ties them together.  The classes
   that the others connect are found first, as groups (``components`` over class
   and least class of each shingle), and go on with their whole sets.
4. Within a group, sets are first verified against pivots, block by block
   (``set_links``): a group of near copies is done after one round.  What remains
   is dealt to pairs of blocks, bounded in sets and shingles.  There a few hubs are
   held against all sets; then the shingles of each set are hashed into ``GROUPS``
   groups; the group counts are its point, and the overlap of two sets is at most
   the sum of the minima of their coordinates.  An R-tree over the points (nodes
   bound by their largest coordinates and their sizes) gives each set the points
   whose bound reaches the needed overlap.  The largest component is not searched
   within itself, subtrees of a set's own component are skipped.  What remains is
   verified on the whole sets, first one point of each component, then, where that
   did not link, the others.

Every pair that links is connected by verified links, so the components are
exact; no bucket, partner or candidate is capped, and only spanning links leave
a task.  With ``all_links`` every candidate pair of classes is verified in the same
places, without regard to components, and the number of links of each class, in
rows, is summed up (``op5_jaccard_links``).

Defined results: null or blank texts have the empty set (n_shingles 0) and are
their own component.  Rows that share a doc_id are one node: it links through
any of its texts, and each row is returned.  Rows with a null doc_id are
returned with a null component.  Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import mix, signed, slices, window_hashes, windows
from .common import discard, small_batches, stored, table
from .components import components, one_node_per_id
from .set_links import chosen_side, common_counts, group_links, meetings

SHINGLE = 5
PERCENT = 75
GROUPS = 512
HUBS = 8                   # sets held against all others before the tree
LEAF = 16
CHUNK = 32                 # sets that query the tree together
FLUSH = 1 << 20            # entries per packed block
FLUSH_ROWS = 1 << 14
BUCKET_ROWS = 1 << 20      # entries aimed at per bucket
_ALREADY, _ROW = 1 << 15, (1 << 14) - 1


def _sets(s) -> list[np.ndarray]:
    """Sorted distinct shingle hashes per row."""
    s.lower()
    starts, ends, first = s.words()
    h = s.hashes(starts, ends)
    at, _ = windows(first, SHINGLE)
    w = window_hashes(h, at, SHINGLE)
    n = np.diff(first)
    edge = np.concatenate([[0], np.cumsum(np.maximum(n - SHINGLE + 1, 0))])
    return [np.unique(w[edge[r]:edge[r + 1]]) if n[r] >= SHINGLE
            else window_hashes(h, first[r:r + 1], int(n[r])) if n[r] else w[:0] for r in range(s.n)]


def _floor_needed(n):
    """Least |A n B| over |A| = n: ceil(3 n / 4)."""
    return (3 * n + 3) // 4


def _region(n):
    """How many of its smallest hashes a set of n sends."""
    return (n + 1) // 2


def _needed(n):
    """Sent shingles that a set of n has in common with any partner, at least: of
    the set whose sent hashes end first, m >= ceil(3 n / 4) in size, at least
    m / 2 were sent, at most m / 4 are missing in the other, and what the other
    has of them it sent as well."""
    return F.greatest(F.lit(1), F.ceil((F.floor((3 * n + 3) / 4)) / 4))


# ------------------------------------------------- equal sets, shared shingles

def _signature(x: np.ndarray) -> np.uint64:
    """Name of a set: the mixed sum of its mixed hashes and its size."""
    return mix(np.array([mix(x).sum(dtype=np.uint64) + np.uint64(len(x))], np.uint64))[0]


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, n, sig) per row."""
    def run(batches):
        for s in slices(batches):
            sets = _sets(s)
            sig = np.array([_signature(x) for x in sets], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [s.column("doc_id").cast(pa.int64()), pa.array([len(x) for x in sets], pa.int64()),
                 pa.array(signed(sig))], ["doc_id", "n", "sig"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, sig long")


def _packed(docs: DataFrame, bits: int) -> DataFrame:
    """Blocks of entries per bucket, and (buckets below 0, each block's its own) the
    entries known as shared.  ``keys``: the 32 bits after the bucket's; ``refs``: row in
    ``ids`` and flags."""
    def flush(ids, sizes, keys):
        refs = np.repeat(np.arange(len(ids)), sizes).astype(np.uint16)
        keys = np.concatenate(keys)
        order = np.argsort(keys, kind="stable")
        keys, refs = keys[order], refs[order]
        keys = keys >> np.uint64(32 - bits)                    # bucket and 32 bits
        ids = signed(np.array(ids, np.uint64))
        same = keys[1:] == keys[:-1]
        repeated = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        first = np.concatenate([[True], ~same])
        known = (keys[repeated], refs[repeated])
        refs = np.where(repeated, refs | _ALREADY, refs).astype(np.uint16)[first]
        keys = keys[first]
        bucket = (keys >> np.uint64(32)).astype(np.int64)
        edges = np.searchsorted(bucket, np.arange((1 << bits) + 1))
        out = []
        for b in range(1 << bits):
            part = slice(edges[b], edges[b + 1])
            if part.start < part.stop:
                used, ref = np.unique(refs[part] & _ROW, return_inverse=True)
                out.append((b, ids[used].tobytes(), (ref.astype(np.uint16) | (refs[part] & ~np.uint16(_ROW))).tobytes(),
                            keys[part].astype(np.uint32).tobytes()))
        if len(known[0]):
            out.append((-1 - int(ids[0] & 0xFFFFFF), ids.tobytes(), known[1].tobytes(), known[0].tobytes()))
        columns = list(zip(*out, strict=True))
        return pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.int32()), *[pa.array(c, pa.binary()) for c in columns[1:]]],
            ["bucket", "ids", "refs", "keys"])

    def run(batches):
        ids, sizes, keys, size, seen = [], [], [], 0, set()
        for s in slices(batches):
            for x in _sets(s):
                n = len(x)
                if not n or (sig := _signature(x)) in seen:
                    continue                               # its class is in this block
                seen.add(sig)
                k = int(_region(n))
                ids.append(sig)
                sizes.append(k)
                keys.append(x[:k])
                size += k
                if size >= FLUSH or len(ids) == FLUSH_ROWS:
                    yield flush(ids, sizes, keys)
                    ids, sizes, keys, size, seen = [], [], [], 0, set()
        if ids:
            yield flush(ids, sizes, keys)

    return docs.select("text").mapInArrow(run, "bucket int, ids binary, refs binary, keys binary")


def _entries(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, refs, keys = [], [], []
    wide = np.uint64 if rows.column("bucket")[0].as_py() < 0 else np.uint32
    for i, r, k in zip(*[rows.column(c).to_pylist() for c in ("ids", "refs", "keys")], strict=True):
        r = np.frombuffer(r, np.uint16)
        ids.append(np.frombuffer(i, np.int64)[r & _ROW])
        refs.append(r)
        keys.append(np.frombuffer(k, wide))
    return np.concatenate(ids), np.concatenate(refs), np.concatenate(keys)


_SHARED = "sig long, key long"


def _rows(ids, keys) -> pa.Table:
    return pa.table({"sig": ids, "key": keys.astype(np.int64)})


def shared(docs: DataFrame, bits: int) -> DataFrame:
    """(sig, key): entries whose key occurs in several classes."""
    def meet(rows: pa.Table) -> pa.Table:
        bucket = rows.column("bucket")[0].as_py()
        ids, refs, keys = _entries(rows)
        if bucket < 0:
            return _rows(ids, keys)
        order = np.lexsort((ids, keys))
        ids, refs, keys = ids[order], refs[order], keys[order]
        first = np.concatenate([[True], keys[1:] != keys[:-1]])
        new = first | np.concatenate([[True], ids[1:] != ids[:-1]])
        edge = np.flatnonzero(first)
        several = (np.add.reduceat(new.astype(np.int64), edge) > 1) | np.logical_or.reduceat((refs & _ALREADY) > 0, edge)
        tell = new & np.repeat(several, np.diff(np.append(edge, len(keys))))
        return _rows(ids[tell], keys[tell].astype(np.int64) | (bucket << 32))

    return stored(_packed(docs, bits).groupBy("bucket").applyInArrow(meet, _SHARED).distinct(), "jaccard-shared")


# ------------------------------------------------------------- bound and verify

def _sets_of(docs: DataFrame):
    """For ``set_links``: the rows' columns and the whole set, sorted, of the text
    whose set has the name in ``node``."""
    def sets_of(rows: DataFrame, columns: list[str]) -> DataFrame:
        named = rows.select("doc_id", *columns)
        schema = ", ".join(f"{c} {named.schema[c].dataType.simpleString()}" for c in columns) + ", hashes binary"

        def run(batches):
            for s in slices(batches):
                sets = _sets(s)
                names = np.array([_signature(x) for x in sets], np.uint64)
                own = pa.array(signed(names) == np.asarray(s.column("node")))       # not another text of the same id
                yield pa.RecordBatch.from_arrays(
                    [*[s.column(c) for c in columns], pa.array([x.tobytes() for x in sets], pa.binary())],
                    [*columns, "hashes"]).filter(own)

        return docs.join(chosen_side(named), "doc_id").select("text", *columns).mapInArrow(run, schema)

    return sets_of


def _overlap(na, nb):
    """Least overlap that links sets of these sizes: ceil(75 (na + nb) / 175)."""
    return -(-3 * (na + nb) // 7)


def _point(x: np.ndarray) -> np.ndarray:
    """Group counts of a set (16 bits, saturating)."""
    return np.minimum(np.bincount((x & np.uint64(GROUPS - 1)).astype(np.int64), minlength=GROUPS), 65535).astype(np.uint16)


def _minima_sum(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Upper bound of the overlap; a saturated coordinate bounds nothing."""
    low = np.minimum(a, b)
    total = low.sum(axis=-1, dtype=np.int64)
    total[(low == 65535).any(axis=-1)] = 1 << 40
    return total


class RTree:
    """Points packed by size into leaves; nodes are bound by their coordinates'
    maxima and their sizes' range."""

    def __init__(self, n: np.ndarray, vec: np.ndarray):
        self.order = np.lexsort((vec.argmax(axis=1), n))
        level = (vec[self.order], n[self.order], n[self.order])
        self.levels = [level]
        while len(level[1]) > LEAF:
            edge = np.arange(0, len(level[1]), LEAF)
            level = (np.maximum.reduceat(level[0], edge), np.minimum.reduceat(level[1], edge),
                     np.maximum.reduceat(level[2], edge))
            self.levels.append(level)

    def _components(self, comp: np.ndarray) -> list[np.ndarray]:
        """Per level the component of each node, -1 where it is mixed."""
        out = [comp[self.order]]
        for level in self.levels[1:]:
            edge = np.arange(0, len(out[-1]), LEAF)
            low, high = np.minimum.reduceat(out[-1], edge), np.maximum.reduceat(out[-1], edge)
            out.append(np.where(low == high, low, -1))
        return out

    def search(self, n: np.ndarray, vec: np.ndarray, own: np.ndarray, comp: np.ndarray):
        """(query, point, bound) for the points outside the query's component
        whose bound reaches the needed overlap.  ``own``: the queries'
        components, ``comp``: the points'."""
        comps = self._components(comp)
        top = len(self.levels[-1][1])
        q, node = np.repeat(np.arange(len(n)), top), np.tile(np.arange(top), len(n))
        bounds = np.zeros(len(q), np.int64)
        for depth in range(len(self.levels) - 1, -1, -1):
            hi, least, most = self.levels[depth]
            ok = (comps[depth][node] != own[q]) & (4 * most[node] >= 3 * n[q]) & (4 * n[q] >= 3 * least[node])
            q, node = q[ok], node[ok]
            bounds = np.concatenate([_minima_sum(vec[q[k:k + 4096]], hi[node[k:k + 4096]])
                                     for k in range(0, len(q), 4096)] or [np.zeros(0, np.int64)])
            ok = bounds >= _overlap(n[q], np.maximum(least[node], _floor_needed(n[q])))
            q, node, bounds = q[ok], node[ok], bounds[ok]
            if depth:
                below = len(self.levels[depth - 1][1])
                size = np.minimum(LEAF, below - node * LEAF)
                child = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                q, node = np.repeat(q, size), np.repeat(node * LEAF, size) + child
        return q, self.order[node], bounds


def _linked(x: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Which of the other sets link with ``x``."""
    both = common_counts(x, others)
    return 100 * both >= PERCENT * (len(x) + np.array([len(y) for y in others]) - both)


def _spanning(sets: list[np.ndarray], label: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect what all links between left and right sets (index arrays)
    connect; sets of one label are connected."""
    n = np.array([len(x) for x in sets])
    comp = np.unique(label, return_inverse=True)[1]
    out: list[tuple[int, int]] = []
    hub: list[int] = []                   # the point linked last: mostly one of a large component

    def verify(a: int, points: np.ndarray) -> None:
        hit = points[_linked(sets[a], [sets[b] for b in points])]
        if len(hit):
            hit = hit[np.unique(comp[hit], return_index=True)[1]]
            out.extend((a, int(b)) for b in hit)
            comp[np.isin(comp, np.append(comp[hit], comp[a]))] = min(comp[hit].min(), comp[a])
            hub[:] = [int(hit[0])]

    def outside() -> np.ndarray:
        return np.flatnonzero(comp != np.bincount(comp).argmax())

    tried = np.zeros(len(sets), bool)
    for _ in range(HUBS):
        rest = outside()
        rest = rest[~tried[rest]]
        if not len(rest):
            break
        a = int(rest[0])
        tried[a] = True
        verify(a, np.flatnonzero(comp != comp[a]))
    rest = outside()
    if not len(rest):
        return out
    vec = np.stack([_point(x) for x in sets])

    def search(points: np.ndarray, queries: np.ndarray) -> None:
        tree = RTree(n[points], vec[points])
        for k in range(0, len(queries), CHUNK):
            chunk = queries[k:k + CHUNK]
            for a in chunk:
                if hub and comp[a] != comp[hub[0]]:
                    verify(a, np.array(hub))
            q, p, bound = tree.search(n[chunk], vec[chunk], comp[chunk], comp[points])
            p = points[p]
            for r, a in enumerate(chunk):
                near = p[q == r][np.argsort(-bound[q == r], kind="stable")]
                near = near[comp[near] != comp[a]]
                if len(near):
                    verify(a, near[np.unique(comp[near], return_index=True)[1]])         # the best of each component
                    near = near[comp[near] != comp[a]]
                if len(near):
                    verify(a, near)

    alone = np.zeros(len(sets), bool)
    alone[rest] = True
    if alone[right].any():
        search(left, right[alone[right]])
    if left[0] != right[0] and alone[left].any() and not alone[right].all():
        search(left[alone[left]], right[~alone[right]])
    return out


def _link_counts(sets: list[np.ndarray], members: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Per set the members of the sets that link with it, over all pairs of a
    left and a right set (of two different ones, where both are the same)."""
    n = np.array([len(x) for x in sets])
    vec = np.stack([_point(x) for x in sets])
    tree, out = RTree(n[left], vec[left]), np.zeros(len(sets), np.int64)
    same = left[0] == right[0]
    for k in range(0, len(right), CHUNK):
        chunk = right[k:k + CHUNK]
        q, p, _ = tree.search(n[chunk], vec[chunk], np.ones(len(chunk), np.int64), np.zeros(len(left), np.int64))
        p = left[p]
        for r, a in enumerate(chunk):
            points = p[q == r]
            points = points[points > a] if same else points
            if len(points):
                hit = points[_linked(sets[a], [sets[b] for b in points])]
                out[a] += members[hit].sum()
                out[hit] += members[a]
    return out


def _within(node, sets, members, label, left, right) -> list[tuple[int, int]]:
    """Rows (a, b): spanning links of a pair of blocks."""
    return [(int(node[a]), int(node[b])) for a, b in _spanning(sets, label, left, right)]


def _counted(node, sets, members, label, left, right) -> list[tuple[int, int]]:
    """Rows (sig, n_links): rows of other classes that each class links with."""
    n = _link_counts(sets, members, left, right)
    return [(int(node[k]), int(n[k])) for k in np.flatnonzero(n)]


# -------------------------------------------------------------------- the join

def link(docs: DataFrame, all_links: bool = False) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(doc_id, n, sig) per row, verified links (a, b) between classes that
    connect every component, and with ``all_links`` (sig, n_links) of classes that
    link with others."""
    spark = docs.sparkSession
    docs = small_batches(docs).select("doc_id", "text").where("doc_id IS NOT NULL")
    own = stored(signatures(docs), "jaccard-signatures")
    entries = own.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] // 2
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bits = min(24, max(1, (2 * partitions - 1).bit_length(), (entries // BUCKET_ROWS).bit_length()))

    common = shared(docs, bits)
    classes = own.where("n > 0").groupBy("sig").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"),
                                                     F.count("*").alias("members"))
    some = stored(common.groupBy("sig").agg(F.count("*").alias("common")).join(classes, "sig")
                  .where(F.col("common") >= _needed(F.col("n"))).select("sig", "doc_id", "n", "members"), "jaccard-some")
    whole, common = common, stored(common.join(some.select("sig"), "sig", "left_semi"), "jaccard-common")
    discard(whole)
    many = stored(common.groupBy("key").agg(F.count("*").alias("many")).where("many > 1"), "jaccard-frequencies")
    rare = (common.join(many, "key").groupBy("sig").agg(F.sort_array(F.collect_list(F.struct("many", "key"))).alias("keys"))
            .join(some.select("sig", "n"), "sig").withColumn("needed", _needed(F.col("n")).cast("int"))
            .where(F.size("keys") >= F.col("needed"))
            .select("sig", F.explode(F.slice("keys", F.lit(1), F.size("keys") - F.col("needed") + 1)).alias("k")))
    entry = stored(rare.select("sig", "k.key"), "jaccard-entries")
    discard(common, many)
    pivots = stored(entry.groupBy("key").agg(F.min("sig").alias("pivot"), F.count("*").alias("many"))
                    .where("many > 1").select("key", "pivot"), "jaccard-pivots")
    near = (entry.join(pivots, "key").where("sig <> pivot").select(F.col("sig").alias("a"), F.col("pivot").alias("b"))
            .distinct())
    groups = stored(components(near), "jaccard-groups")
    discard(entry, pivots)
    roots = groups.withColumnRenamed("node", "sig")
    # what is in no group links with nothing
    chosen = stored(some.join(roots, "sig").select("doc_id", F.col("sig").alias("node"), "root", "n", "members"), "jaccard-chosen")
    discard(some, groups)
    sets_of = _sets_of(docs)
    links = group_links(chosen, sets_of, PERCENT, _within, "jaccard")
    if not all_links:
        return own, links, None
    counts = meetings(chosen, sets_of, _counted, "sig long, n_links long").groupBy("sig").agg(F.sum("n_links").alias("n_links"))
    return own, links, stored(counts, "jaccard-link-counts")


def join(docs: DataFrame, all_links: bool = False) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id; with ``all_links``
    n_links, the number of other rows (with an id) that link with the row."""
    own, links, counts = link(docs, all_links)
    roots = components(links).withColumnRenamed("node", "sig")
    classes = (own.where("n > 0").groupBy("sig").agg(F.min("doc_id").alias("least"), F.count("*").alias("members")).join(roots, "sig", "left")
               .withColumn("root", F.coalesce("root", "sig")))
    met = classes = stored(classes, "jaccard-classes")
    named = stored(classes.groupBy("root").agg(F.min("least").alias("component_id")), "jaccard-named")
    classes = classes.join(named, "root")
    linked = F.lit(None).cast("long")
    if all_links:
        classes = classes.join(counts, "sig", "left")
        linked = F.coalesce("n_links", F.lit(0)) + F.col("members") - 1          # equal sets link, too
    classes = classes.select("sig", "component_id", linked.alias("n_links"))
    final = stored(classes, "jaccard-named-classes")
    out = (own.join(final, "sig", "left")
           .select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"),
                   F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")))
    out = stored(out if all_links else out.drop("n_links"), "jaccard-out")
    discard(own, links, met, named, final)
    out = one_node_per_id(out)
    none = docs.where("doc_id IS NULL").select("doc_id", "text")
    if none.limit(1).count():
        out = out.unionByName(signatures(none).select(
            "doc_id", F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"),
            F.lit(0).cast("long").alias("n_links")).select(*out.columns))
    return out


def representatives(docs: DataFrame) -> DataFrame:
    """One document of each component, the one with the least id, with its own
    columns; of several rows with words and this id, one with the least text
    hash.  Documents without words and rows without id stay."""
    joined = stored(join(docs), "jaccard-joined").where("n_shingles > 0 AND component_id IS NOT NULL")
    drop = stored(joined.where("doc_id > component_id").select(F.col("doc_id").alias("dropped")).distinct(), "jaccard-dropped")
    left = docs.join(drop, docs["doc_id"] == drop["dropped"], "left_anti")
    twice = stored(joined.where("doc_id = component_id").groupBy(F.col("doc_id").alias("again")).count()
                   .where("count > 1").select("again"), "jaccard-repeated")
    if not twice.limit(1).count():
        return left
    has_words = F.coalesce(left["text"].rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    many = left.join(twice, (left["doc_id"] == twice["again"]) & has_words, "left_semi")
    one = many.groupBy("doc_id").agg(F.min(F.struct(
        F.xxhash64("text"), *[F.col(c) for c in docs.columns])).alias("row")).select("row.*").select(*docs.columns)
    return left.join(twice, (left["doc_id"] == twice["again"]) & has_words, "left_anti").unionByName(one)


def op5_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"))


def op5_jaccard_links(spark, sf_dir: str) -> DataFrame:
    """As ``op5_jaccard_join``, with each document's number of links."""
    return join(table(spark, sf_dir, "documents"), all_links=True)


OP5_SQL = """
WITH RECURSIVE tokens AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
    FROM documents
), shingles AS (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' ')) END) AS s,
        len(w) < 5 AS short
    FROM tokens
), sizes AS (
    SELECT t.doc_id, count(s.s) AS n FROM (SELECT DISTINCT doc_id FROM tokens) t
    LEFT JOIN shingles s USING (doc_id) GROUP BY t.doc_id
), links AS (
    SELECT a.doc_id AS a, b.doc_id AS b
    FROM shingles a JOIN shingles b ON a.s = b.s AND a.short = b.short AND a.doc_id <> b.doc_id
    JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
    GROUP BY a.doc_id, b.doc_id, x.n, y.n
    HAVING 100 * count(*) >= 75 * (x.n + y.n - count(*))
), reach AS (
    SELECT doc_id, doc_id AS other FROM sizes
    UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other
)
SELECT s.doc_id, s.n AS n_shingles, r.component_id
FROM sizes s JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) r USING (doc_id)
"""
