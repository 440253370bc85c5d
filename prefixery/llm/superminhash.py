"""Near-duplicate classes by SuperMinHash.

A document's set: its distinct 3-word shingles (A-Z lower-cased; fewer words: the
whole sequence as one), as 64-bit hashes.  Two documents link when
100 * |A n B| >= 85 * |A u B|.

1. Signatures.  Every element shuffles the ``SLOTS`` slots by its own random
   permutation; the j-th slot of the permutation is offered j + r, r a random
   fraction drawn for that step, and keeps the least offer.  So an element fills each
   slot once, the ranks are correlated, and a signature varies less than with
   independent hashes.  Steps are taken by all elements of a document together: after
   step j every further offer is at least j + 1, so a document whose slots are all
   filled is done (early stopping), mostly after a few steps.
2. Banding.  ``BANDS`` keys of ``ROWS`` slots each.  A pair at 0.85 meets in at
   least one of them but for 7e-9 of the cases, at 0.9 but for 1e-12.  Sets of fewer
   than six elements link with equal sets only and have no keys.
3. Verification.  Documents with equal sets are one class, kept by its least doc_id.
   The classes that meet in a band, directly or through others, are a group; within
   groups all links are verified on the full sets (``set_links``): first against
   pivots, then within pairs of blocks, where the distances to a few hubs rule out
   most pairs by the triangle inequality.
4. Grouping.  Union-find within a block, connected components over all blocks.

Defined results: null or blank texts have the empty set (n_shingles 0) and link with
nothing.  Rows that share a doc_id are one node: it links through any of its texts,
and each row is returned.  Rows with a null doc_id have a null component and are
kept.  Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import mix, signed, slices, window_hashes, windows
from .common import small_batches, stored, table
from .components import components, one_node_per_id
from .set_links import chosen_side, common_counts, group_links

SHINGLE = 3
PERCENT = 85
ROWS, BANDS = 5, 32
SLOTS = ROWS * BANDS
LEAST = 6                  # smaller sets link with equal ones only
HUBS = 24
_FILLED = np.uint64(1) << np.uint64(63)
_STEP = mix(np.arange(1, SLOTS + 1, dtype=np.uint64))


def shingle_sets(s) -> list[np.ndarray]:
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


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, SLOTS): step (upper 16 bits) and random fraction (48 bits) of the least
    offer to each slot.  The sets are not empty."""
    sig = np.full(len(sets) * SLOTS, _FILLED, np.uint64)
    doc = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    e = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    swaps: list[np.ndarray] = []
    for j in range(SLOTS):
        x = mix(e ^ _STEP[j])
        k = (j + (((x & np.uint64(0xFFFF)) * np.uint64(SLOTS - j)) >> np.uint64(16)).astype(np.int64)).astype(np.int16)
        slot = k
        for i in range(j - 1, -1, -1):                     # what earlier swaps brought to place k
            slot = np.where(slot == swaps[i], np.int16(i), slot)
        np.minimum.at(sig, doc * SLOTS + slot, (np.uint64(j) << np.uint64(48)) | (x >> np.uint64(16)))
        swaps.append(k)
        open_ = (sig.reshape(-1, SLOTS) == _FILLED).any(axis=1)
        on = open_[doc]
        if not on.any():
            break
        if not on.all():
            e, doc, swaps = e[on], doc[on], [s[on] for s in swaps]
    return sig.reshape(-1, SLOTS)


_BAND = mix(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x51ED270B))


def band_keys(sig: np.ndarray) -> np.ndarray:
    """(sets, BANDS) keys."""
    key = np.broadcast_to(_BAND, (len(sig), BANDS)).copy()
    for r in range(ROWS):
        key = mix(key + sig[:, r::ROWS] * np.uint64(2 * r + 0x9E3779B1))
    return key


def _names(x: np.ndarray) -> tuple[int, int]:
    """Two 64-bit names of a set."""
    return tuple(int(signed(mix(np.array([mix(x ^ seed).sum(dtype=np.uint64) + np.uint64(len(x))], np.uint64)))[0])
                 for seed in (np.uint64(0), np.uint64(0xA5A5A5A5A5A5A5A5)))


_OWN = "doc_id long, n long, s1 long, s2 long, bands array<long>"


def signed_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, n, s1, s2, bands) per row: size, names and band keys of its set."""
    def run(batches):
        for s in slices(batches):
            sets = shingle_sets(s)
            names = [_names(x) for x in sets]
            able = [r for r, x in enumerate(sets) if len(x) >= LEAST]
            keys = signed(band_keys(signatures([sets[r] for r in able]))).reshape(-1) if able else np.zeros(0, np.int64)
            has = np.zeros(len(sets), np.int64)
            has[able] = BANDS
            edge = np.concatenate([[0], np.cumsum(has)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [s.column("doc_id").cast(pa.int64()), pa.array([len(x) for x in sets], pa.int64()),
                 *[pa.array([n[k] for n in names], pa.int64()) for k in (0, 1)], pa.ListArray.from_arrays(edge, pa.array(keys))],
                ["doc_id", "n", "s1", "s2", "bands"])

    return small_batches(docs).select("doc_id", "text").mapInArrow(run, _OWN)


def _sets_of(docs: DataFrame):
    """For ``set_links``: the rows' columns and hashes."""
    def sets_of(rows: DataFrame, columns: list[str]) -> DataFrame:
        named = rows.select("doc_id", "s1", "s2", *columns)
        schema = ", ".join(f"{c} {named.schema[c].dataType.simpleString()}" for c in columns) + ", hashes binary"

        def run(batches):
            for s in slices(batches):
                sets = shingle_sets(s)
                asked = zip(s.column("s1").to_pylist(), s.column("s2").to_pylist(), strict=True)
                own = [r for r, name in enumerate(asked) if _names(sets[r]) == name]      # not another text of the same id
                yield pa.RecordBatch.from_arrays(
                    [*[s.column(c).take(pa.array(own, pa.int64())) for c in columns],
                     pa.array([sets[r].tobytes() for r in own], pa.binary())], [*columns, "hashes"])

        return docs.join(chosen_side(named), "doc_id").select("text", "s1", "s2", *columns).mapInArrow(run, schema)

    return sets_of


def _hub_links(node, sets, members, label, left, right) -> list[tuple[int, int]]:
    """Links that connect what all links between left and right sets connect."""
    n = np.array([len(x) for x in sets])
    comp = np.unique(label, return_inverse=True)[1]
    far, out, done = [], [], np.zeros(len(sets), bool)

    def against(a: int, others: np.ndarray) -> np.ndarray:
        """Distances of the others to ``a``; those that link are united with it."""
        both = common_counts(sets[a], [sets[b] for b in others])
        union = n[a] + n[others] - both
        hit = others[(100 * both >= PERCENT * union) & (comp[others] != comp[a])]
        if len(hit):
            hit = hit[np.unique(comp[hit], return_index=True)[1]]
            out.extend((int(node[a]), int(node[b])) for b in hit)
            comp[np.isin(comp, np.append(comp[hit], comp[a]))] = min(comp[hit].min(), comp[a])
        return 1 - both / union

    def outside() -> np.ndarray:
        return np.flatnonzero((comp != np.bincount(comp).argmax()) & ~done)

    whole, t = np.arange(len(sets)), 1 - PERCENT / 100 + 1e-9
    for _ in range(HUBS):
        rest = outside()
        if not len(rest):
            return out
        hub = int(rest[np.argmax(np.min([f[rest] for f in far], axis=0))]) if far else int(rest[0])
        far.append(against(hub, whole))
        done[hub] = True
    near, same = np.array(far), left[0] == right[0]
    in_left = np.zeros(len(sets), bool)
    in_left[left] = True
    while len(rest := outside()):
        a = int(rest[0])
        other = ~done if same else ~done & (in_left != in_left[a])
        other &= (comp != comp[a]) & (100 * n >= PERCENT * n[a]) & (100 * n[a] >= PERCENT * n)
        b = np.flatnonzero(other)
        b = b[(np.abs(near[:, b] - near[:, [a]]) <= t).all(axis=0)]
        if len(b):
            against(a, b)
        done[a] = True
    return out


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    docs = docs.select("doc_id", "text")
    own = stored(signed_documents(docs), "superminhash-signatures")
    classes = stored(own.where("n > 0 AND doc_id IS NOT NULL").groupBy("s1", "s2")
                     .agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.count("*").alias("members"),
                          F.first("bands").alias("bands"))
                     .withColumn("node", F.monotonically_increasing_id()), "superminhash-classes")
    entries = classes.select("node", F.explode("bands").alias("key"))
    pivots = stored(entries.groupBy("key").agg(F.min("node").alias("pivot"), F.count("*").alias("many"))
                    .where("many > 1").select("key", "pivot"), "superminhash-bands")
    near = entries.join(pivots, "key").where("node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct()
    groups = stored(components(near), "superminhash-groups").withColumnRenamed("node", "member")
    chosen = stored(classes.join(groups, F.col("node") == F.col("member"))
                    .select("doc_id", "node", "root", "n", "members", "s1", "s2"), "superminhash-chosen")
    links = group_links(chosen, _sets_of(docs), PERCENT, _hub_links, "superminhash", extra=["s1", "s2"])
    roots = stored(components(links), "superminhash-components").withColumnRenamed("node", "member")
    named = stored(classes.drop("bands").join(roots, F.col("node") == F.col("member"), "left")
                   .withColumn("root", F.coalesce("root", "node")).select("s1", "s2", "doc_id", "root"), "superminhash-roots")
    least = stored(named.groupBy("root").agg(F.min("doc_id").alias("component_id")), "superminhash-least")
    named = stored(named.join(least, "root").select("s1", "s2", "component_id"), "superminhash-named")
    out = (own.drop("bands").join(named, ["s1", "s2"], "left")
           .select("doc_id", F.col("n").alias("n_shingles"),
                   F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id")))
    out = one_node_per_id(stored(out, "superminhash-out"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op11_superminhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
