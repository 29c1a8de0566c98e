"""MinHash near-duplicates by a multi-index Hamming join, with links confirmed on whole shingle sets.

A text's signature has ``k`` symbols of 16 bits.  Texts at least as similar as the threshold differ in more than
``radius`` symbols with a chance of ``miss`` at most.  The signature is cut into so many chunks that any two within
the radius differ by one symbol at most in one of them (pigeonhole); for each chunk all allowed errors are enumerated
by leaving out one symbol at a time, so both texts meet in a bucket.  A pair counts only in the first bucket that it
shares.  Buckets compare signatures first; then whole sets are compared where signatures are near, and each bucket
gives a spanning forest of its confirmed links, never all pairs.

A bucket beyond a block's size is first held against pivots: each of its texts is compared with one other text, on whole
sets.  Texts linked with the same pivot need no further comparison with each other, so only the rest of a bucket is
compared with all of it, block by block; no task holds more than two blocks.  Work grows with the product of a bucket's
size and the part of it that the pivot does not link.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .text import lowered, shingles, space_words, stored, text_key

SYMBOLS = 64
#: Rows of signatures, and shingles, that a block holds at most; a task holds two blocks.
BLOCK_ROWS, BLOCK_SHINGLES = 4096, 1 << 20
SMALL = 16
#: A set with more than one row in so many is hot.
HOT = 2000


def radius(k: int, percent: int, miss: float = 1e-5) -> int:
    """The least r for which texts of that similarity differ in more than r of k symbols with a chance up to ``miss``."""
    p = 1 - percent / 100
    tail, r = 1.0, -1
    while tail > miss and r < k:
        r += 1
        tail -= math.comb(k, r) * p**r * (1 - p) ** (k - r)
    return r


class Scheme:
    """Chunks of a signature: within the radius one chunk has one error at most."""

    def __init__(self, k: int, percent: int, miss: float = 1e-5):
        self.k, self.percent, self.radius = k, percent, radius(k, percent, miss)
        m = self.radius // 2 + 1
        self.starts = np.array([c * k // m for c in range(m)])
        self.sizes = np.diff(np.append(self.starts, k))
        self.chunk_of = np.repeat(np.arange(m), self.sizes)
        rng = np.random.default_rng(20240229)
        self.mul = rng.integers(1, 1 << 63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.add = rng.integers(0, 1 << 63, k, dtype=np.uint64)

    def signatures(self, values: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """values: hashes of the shingles, set after set; starts: where each set, none empty, begins."""
        out = np.empty((len(starts), self.k), np.uint16)
        for j in range(self.k):
            least = np.minimum.reduceat(values * self.mul[j] + self.add[j], starts)
            out[:, j] = (least * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)
        return out

    def keys(self, sig: np.ndarray) -> np.ndarray:
        """A bucket for each symbol left out of its chunk; the lowest byte says which symbol that is."""
        part = (sig.astype(np.uint64) + np.uint64(1)) * self.mul
        part ^= part >> np.uint64(29)
        part *= np.uint64(0xBF58476D1CE4E5B9)
        whole = np.add.reduceat(part, self.starts, axis=1)[:, self.chunk_of] - part
        whole ^= whole >> np.uint64(32)
        whole *= np.uint64(0x94D049BB133111EB)
        return ((whole & ~np.uint64(0xFF)) | np.arange(self.k, dtype=np.uint64)).view(np.int64)

    def meets(self, a: np.ndarray, b: np.ndarray, slot: int | np.ndarray) -> np.ndarray:
        """Whether rows of a and b are within the radius and first meet in the bucket of that slot."""
        differ = a != b
        near = np.count_nonzero(differ, axis=1) <= self.radius
        out = np.zeros(len(near), bool)
        at = np.flatnonzero(near)
        if len(at):
            d = differ[at]
            errors = np.add.reduceat(d, self.starts, axis=1, dtype=np.int16)
            chunk = np.argmax(errors <= 1, axis=1)
            inside = d & (self.chunk_of == chunk[:, None])
            first = np.where(errors[np.arange(len(at)), chunk] == 0, self.starts[chunk], np.argmax(inside, axis=1))
            out[at] = first == (slot if np.isscalar(slot) else slot[at])
        return out


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups of (key, pair), which come sorted, and where each group begins."""
    rest: pa.Table | None = None
    for b in batches:
        t = pa.Table.from_batches([b])
        rest = t if rest is None else pa.concat_tables([rest, t])
        key, pair = rest.column("key").to_numpy(), rest.column("pair").to_numpy()
        new = np.flatnonzero((key[1:] != key[:-1]) | (pair[1:] != pair[:-1])) + 1
        if len(new):
            yield rest.slice(0, new[-1]), np.append(0, new[:-1])
            rest = rest.slice(new[-1])
    if rest is not None and rest.num_rows:
        yield rest, np.array([0])


def _sigs(t: pa.Table, k: int) -> np.ndarray:
    col = t.column("sig").combine_chunks()
    return np.frombuffer(b"".join(col.to_pylist()), np.uint16).reshape(-1, k)


def _sides(t: pa.Table) -> tuple[np.ndarray, bool]:
    """The block of each row, and whether only rows of different blocks are to be compared."""
    pair = t.column("pair")[0].as_py()
    return t.column("block").to_numpy(), (pair >> 24) != (pair & 0xFFFFFF)


def signature_table(docs: DataFrame, scheme: Scheme, width: int = 5) -> DataFrame:
    """doc_id, text_key, n (size of the set), h1 and h2 (which tell sets apart), sig (null for an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("s")
            offsets = lists.offsets.to_numpy().astype(np.int64)
            all_values = lists.values.to_numpy(zero_copy_only=False).view(np.uint64)
            n = np.diff(offsets)
            h1, h2 = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
            sig = np.zeros((len(n), scheme.k), np.uint16)
            full = np.flatnonzero(n)
            lo = 0
            while lo < len(full):  # a part of the batch at a time
                hi = max(lo + 1, int(np.searchsorted(offsets[full + 1], offsets[full[lo]] + BLOCK_SHINGLES, "right")))
                rows = full[lo:hi]
                values = all_values[offsets[rows[0]] : offsets[rows[-1] + 1]]
                starts = offsets[rows] - offsets[rows[0]]
                mixed = (values ^ (values >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
                h1[rows] = np.add.reduceat(mixed ^ (mixed >> np.uint64(32)), starts)
                h2[rows] = np.bitwise_xor.reduceat((values ^ np.uint64(0x5851F42D4C957F2D)) * np.uint64(0xCA5A826395121157), starts)
                sig[rows] = scheme.signatures(values, starts)
                lo = hi
            raw = [sig[i].tobytes() if n[i] else None for i in range(len(n))]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("text_key"), pa.array(n, pa.int64()), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(raw, pa.binary())],
                ["doc_id", "text_key", "n", "h1", "h2", "sig"],
            )

    sets = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_key(F.col("text")).alias("text_key"), shingles(space_words(lowered(F.col("text"))), width).alias("s"))
    return sets.mapInArrow(run, "doc_id bigint, text_key bigint, n bigint, h1 bigint, h2 bigint, sig binary")


def _dealt(rows: DataFrame, total: Column, most: int) -> DataFrame:
    """Adds pair and block: each bucket is one block or, with a ``total`` beyond ``most``, several, and its rows go to all
    pairs of them."""
    rows = rows.withColumn("_n", F.ceil(total / most).cast("int")).withColumn("block", F.pmod(F.xxhash64("node"), F.col("_n")).cast("int"))
    return _paired(rows.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))).drop("_n")


def _paired(rows: DataFrame) -> DataFrame:
    return rows.withColumn("pair", F.least("block", "_o").cast("bigint") * F.lit(1 << 24) + F.greatest("block", "_o")).drop("_o")


def _in_blocks(big: DataFrame, labels: DataFrame) -> DataFrame:
    """Block pairs of large buckets (key, node, m); labels: the pivot that a node is linked with.

    Of a bucket the rows of the most frequent pivot are settled: they go to blocks that are compared with those of the
    loose rows only, and nowhere if there are no loose rows."""
    known = big.join(labels, "node", "left")
    tops = known.filter("label IS NOT NULL").groupBy("key", "label").agg(F.count(F.lit(1)).alias("c")).groupBy("key").agg(F.max(F.struct("c", "label")).alias("top"))
    tops = stored(tops)  # a stored side lets the engine split a hot key of the other
    rows = known.join(tops, "key", "left").withColumn("_linked", F.coalesce(F.col("label") == F.col("top.label"), F.lit(False)))
    few, many = F.coalesce(F.col("top.c"), F.lit(0)), F.col("m")
    rows = rows.withColumn("_u", F.ceil((many - few) / BLOCK_ROWS).cast("int")).withColumn("_v", F.ceil(few / BLOCK_ROWS).cast("int"))
    at = lambda n: F.pmod(F.xxhash64("node"), F.greatest(n, F.lit(1))).cast("int")
    rows = rows.withColumn("block", F.when(F.col("_linked"), F.col("_u") + at(F.col("_v"))).otherwise(at(F.col("_u"))))
    last = F.when(F.col("_linked"), F.col("_u")).otherwise(F.col("_u") + F.col("_v")) - 1
    rows = rows.filter(last >= 0).withColumn("_o", F.explode(F.sequence(F.lit(0), last)))
    return _paired(rows).select("key", "pair", "block", "node")


def _pivot_links(big: DataFrame, shingled: Callable[[DataFrame], DataFrame], percent: int) -> DataFrame:
    """(node, label): nodes of large buckets that are linked with the pivot of the largest bucket that they are in, by
    whole sets; shingled: adds n and s to rows with a node.

    A bucket's pivot is the node with the least hash of those that have it as their largest.  The pivot's set is sent to
    each block of its nodes, so that no task holds all of them."""
    home = big.groupBy("node").agg(F.max(F.struct("m", "key")).alias("home")).select("node", F.col("home.key").alias("key"))
    leads = home.groupBy("key").agg(F.min(F.struct(F.xxhash64("node").alias("h"), "node")).alias("lead"), F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("blocks"))
    leads = stored(leads.select(F.col("key").alias("_k"), F.col("lead.node").alias("label"), "blocks"))
    mine = home.join(leads, F.col("key") == F.col("_k")).withColumn("block", F.pmod(F.xxhash64(F.lit(1), "node"), F.col("blocks")).cast("int"))
    sets = stored(shingled(mine.select("node", "label", "block", "blocks")))  # one row a node
    pivots = sets.filter("node = label").select(F.col("label").alias("_p"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("_b"), F.col("n").alias("pn"), F.col("s").alias("ps"))
    both = sets.join(pivots.dropDuplicates(["_p", "_b"]), (F.col("label") == F.col("_p")) & (F.col("block") == F.col("_b")))
    common = F.size(F.array_intersect("s", "ps"))
    return both.filter(100 * common >= percent * (F.col("n") + F.col("pn") - common)).select("node", "label").distinct()


def _gathered(rows: DataFrame, run: Callable, schema: str) -> DataFrame:
    return rows.repartition("key", "pair").sortWithinPartitions("key", "pair").mapInArrow(run, schema)


def _candidates(nodes: DataFrame, scheme: Scheme, shingled: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame | None]:
    """Distinct (key, node): the buckets in which a node first meets another one within the radius; and the links with
    pivots of large buckets, (node, label)."""

    def enumerated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = scheme.keys(_sigs(pa.Table.from_batches([b]), scheme.k))
            offsets = pa.array(np.arange(len(keys) + 1, dtype=np.int32) * scheme.k)
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.ListArray.from_arrays(offsets, pa.array(keys.reshape(-1)))], ["node", "keys"])

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in _grouped(batches):
            key, sig = t.column("key").to_numpy(), _sigs(t, scheme.k)
            sizes = np.diff(np.append(starts, len(key)))
            hit = np.zeros(len(key), bool)
            group = np.repeat(np.arange(len(starts)), sizes)
            small = sizes[group] <= SMALL
            pair = t.column("pair").to_numpy()
            whole = small & ((pair >> 24) == (pair & 0xFFFFFF))
            for step in range(1, SMALL):
                i = np.flatnonzero(whole[:-step] & (group[:-step] == group[step:]))
                if not len(i):
                    break
                for part in np.array_split(i, len(i) // 50_000 + 1):
                    ok = part[scheme.meets(sig[part], sig[part + step], key[part] & 0xFF)]
                    hit[ok] = hit[ok + step] = True
            for g in np.unique(group[~whole]):
                lo, hi = starts[g], starts[g] + sizes[g]
                block, across = _sides(t.slice(lo, hi - lo))
                slot = int(key[lo] & 0xFF)
                for i in range(lo, hi - 1):
                    if hit[i] and hit[i + 1 : hi].all():
                        continue
                    others = np.arange(i + 1, hi)
                    if across:
                        others = others[block[i + 1 - lo :] != block[i - lo]]
                    ok = others[scheme.meets(sig[i][None, :], sig[others], slot)]
                    if len(ok):
                        hit[i] = True
                        hit[ok] = True
            if hit.any():
                yield pa.RecordBatch.from_arrays([pa.array(key[hit]), t.column("node").combine_chunks().filter(pa.array(hit))], ["key", "node"])

    keyed = nodes.select("node", "sig").mapInArrow(enumerated, "node bigint, keys array<bigint>").select("node", F.explode("keys").alias("key"))
    crowded = stored(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("m")).filter("m > 1"))  # partial counts first, so no key is hot
    met = stored(keyed.join(crowded, "key").select("key", "node", "m"))
    small, big, labels = met.filter(F.col("m") <= BLOCK_ROWS), met.filter(F.col("m") > BLOCK_ROWS), None
    dealt = small.select("key", F.lit(0).cast("bigint").alias("pair"), F.lit(0).alias("block"), "node")
    if not big.isEmpty():
        labels = stored(_pivot_links(big, shingled, scheme.percent))
        dealt = dealt.unionByName(_in_blocks(big, labels))
    rows = dealt.join(nodes.select("node", "sig"), "node").select("key", "pair", "block", "node", "sig")
    return _gathered(rows, compared, "key bigint, node bigint").distinct(), labels


def _links(cands: DataFrame, sets: DataFrame, scheme: Scheme) -> DataFrame:
    """(u, v): for each bucket a spanning forest of the links confirmed on whole sets; sets has node, n, sig and s."""
    percent = scheme.percent

    def confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in _grouped(batches):
            us, vs = [], []
            for lo, hi in zip(starts, [*starts[1:], table.num_rows], strict=True):
                t = table.slice(lo, hi - lo)
                node = t.column("node").to_numpy()
                _, one = np.unique(node, return_index=True)  # repeated rows of one text
                if len(one) < len(node):
                    t = t.take(pa.array(one))
                    node = node[one]
                block, across = _sides(t)
                lists = t.column("s").combine_chunks()
                offsets = lists.offsets.to_numpy().astype(np.int64)
                values = lists.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
                offsets = offsets - offsets[0]
                uniq, local = np.unique(values, return_inverse=True)
                n, sig, slot = np.diff(offsets), _sigs(t, scheme.k), int(t.column("key")[0].as_py() & 0xFF)
                comp, mark = np.arange(len(node)), np.zeros(len(uniq), bool)
                for i in range(len(node) - 1):
                    j = np.arange(i + 1, len(node))
                    j = j[(comp[j] != comp[i]) & ((block[j] != block[i]) | (not across))]
                    if len(j):
                        j = j[scheme.meets(sig[i][None, :], sig[j], slot)]
                    if not len(j):
                        continue
                    own = local[offsets[i] : offsets[i + 1]]
                    mark[own] = True
                    common = np.array([np.count_nonzero(mark[local[offsets[x] : offsets[x + 1]]]) for x in j])
                    mark[own] = False
                    for x in j[100 * common >= percent * (n[i] + n[j] - common)]:
                        if comp[x] != comp[i]:
                            comp[comp == comp[x]] = comp[i]
                            us.append(node[i])
                            vs.append(node[x])
            if us:
                yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])

    weighed = cands.join(sets.select("node", "n").distinct(), "node")
    totals = stored(weighed.groupBy("key").agg(F.sum("n").alias("total")))
    rows = _dealt(weighed.join(totals, "key"), F.col("total"), BLOCK_SHINGLES).drop("n", "total").join(sets.select("node", "sig", "s"), "node").select("key", "pair", "block", "node", "sig", "s")
    return _gathered(rows, confirmed, "u bigint, v bigint")


def near_duplicates(docs: DataFrame, *, percent: int = 80, width: int = 5, k: int = SYMBOLS, miss: float = 1e-5) -> DataFrame:
    """doc_id, text_key, n_shingles, component_id, kept: one row for each row of ``docs``.

    Two documents are linked if 100 * |A & B| >= percent * |A | B| for their sets of lower-cased word shingles;
    component_id is the smallest doc_id that links lead to.  A text with fewer words than ``width`` has one shingle;
    a null text, or one without words, has none and is linked with nothing.  Rows with equal sets are linked; rows
    without a doc_id are linked with nothing, have no component and are kept.  An empty table gives an empty result;
    only doc_id and text are read, so other columns cannot clash.  Texts are taken as a whole; a set of shingles has
    to fit into a task's memory."""
    scheme = Scheme(k, percent, miss)
    sigs = stored(signature_table(docs, scheme, width))
    real = F.col("n").isNotNull() & (F.col("n") > 0) & F.col("doc_id").isNotNull()
    # equal sets, by 128 bits and their size, are one node; its number is fixed by the written table
    nodes = sigs.filter(real).groupBy("h1", "h2", "n").agg(F.min(F.struct("doc_id", "text_key")).alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("sig").alias("sig"))
    nodes = stored(nodes.select(F.monotonically_increasing_id().alias("node"), "h1", "h2", "n", "copies", F.col("rep.doc_id").alias("rep_id"), F.col("rep.text_key").alias("rep_key"), "sig"))
    texts = docs.select(F.col("doc_id").cast("bigint").alias("rep_id"), text_key(F.col("text")).alias("rep_key"), "text")

    def shingled(rows: DataFrame) -> DataFrame:
        near = rows.join(nodes.select("node", "n", "sig", "rep_id", "rep_key"), "node")
        return texts.join(near, ["rep_id", "rep_key"]).select(*rows.columns, "n", "sig", shingles(space_words(lowered(F.col("text"))), width).alias("s"))

    cands, labels = _candidates(nodes, scheme, shingled)
    cands = stored(cands)
    sets = stored(shingled(cands.select("node").distinct()))
    links = _links(cands, sets, scheme)
    if labels is not None:
        links = links.unionByName(labels.select(F.col("node").alias("u"), F.col("label").alias("v")))
    roots = components(links)
    least = roots.join(nodes.select("node", "rep_id"), "node").groupBy("root").agg(F.min("rep_id").alias("component_id"))
    linked = roots.join(least, "root").select("node", "component_id")
    # only nodes with links or copies are joined back to the rows
    joined = nodes.join(linked, "node", "left").filter("component_id IS NOT NULL OR copies > 1")
    joined = joined.select(F.col("h1").alias("_h1"), F.col("h2").alias("_h2"), F.col("n").alias("_n"), F.coalesce("component_id", "rep_id").alias("component_id"), "copies")
    joined = stored(joined)  # read three times, and the driver does not hold the plans and shuffles of the graph with those of the result
    # a set with over one row in HOT of all is hot: there are HOT such sets at most, which are broadcast
    some = nodes.agg(F.coalesce(F.sum("copies"), F.lit(0)).alias("n")).first().n // HOT
    same = (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2")) & (F.col("n") == F.col("_n"))
    hot, rest = joined.filter(F.col("copies") > some), joined.filter(F.col("copies") <= some)
    columns = ["doc_id", "text_key", "n", "component_id"]
    cold = sigs.filter(real).join(F.broadcast(hot), same, "left_anti").join(rest, same, "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    out = sigs.filter(real).join(F.broadcast(hot), same).select(*columns).unionByName(cold.select(*columns))
    out = out.unionByName(sigs.filter(~real).select("doc_id", "text_key", "n", F.col("doc_id").alias("component_id")))
    return out.select("doc_id", "text_key", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
