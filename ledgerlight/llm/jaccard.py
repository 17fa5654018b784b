"""Similarity join of five-word shingle sets by chosen paths.

Documents with equal shingle sets form one class and go on as one set. Each set is embedded as 64 min-hash tokens. A
run starts with all sets in one node; a node picks some token positions at random (the same for all
its sets, a few on average), and each set goes on to the children that its tokens at these positions name. A
node with few sets is a leaf and is compared by brute force; larger nodes split again, down to a fixed depth. Two
sets of the least similarity meet in a leaf of a run with a known probability, so the number
of runs follows from the recall that is asked for.

In a leaf, sketches are compared first; sets that have a likely partner then fetch their shingles and similarity
is computed exactly. A pair is counted in the first leaf that its sets share, so counts need no list of
pairs. Leaves beyond a block's size are dealt out as pairs of blocks. What leaves a task are sums and a spanning forest
of links, one row for each set and leaf; groups are joined up by repeated smallest-label steps.

Defined results: a text with one to four words has one shingle, all its words; null and empty texts have equal (empty) sets and are
one class; repeated rows are members of one class; the class id is the smallest document id of the group, null only if all ids are; very long texts are compared whole; an empty table gives no
rows; columns of any name are kept as they are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .common import discard, packed, stage

SHINGLE, LEAST = 5, 0.8
TOKENS = 64
PICKS = 1.6
DEPTH = 3
RECALL = 0.998
LEAF, BLOCK = 512, 1024
_LAST = (1 << 63) - 1
_ODD = tv.mix64(np.arange(1, TOKENS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def runs_needed(recall: float = RECALL, least: float = LEAST, picks: float = PICKS, depth: int = DEPTH) -> int:
    """Runs after which a pair of similarity `least` has met with probability `recall`, were its leaf at the full depth."""
    q = 1.0
    for _ in range(depth):
        q = 1 - math.exp(-picks * least * q)
    return math.ceil(math.log(1 - recall) / math.log(1 - q))


def shingles(buf: np.ndarray, offs: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each document, in the order of documents, and the document of each."""
    s, e, first = tv.words(buf, offs)
    h = tv.hashes(buf, s, e)
    doc = np.repeat(np.arange(len(offs) - 1), np.diff(first))
    ok = tv.inside(first, width, len(h))
    r, of = tv.rolling(h, width)[ok], doc[: len(ok)][ok]
    n = np.diff(first)
    short = np.flatnonzero((n > 0) & (n < width))
    if len(short):
        r = np.r_[r, [tv.rolling(h[first[k] : first[k + 1]], int(n[k]))[0] for k in short]].astype(np.uint64)
        of = np.r_[of, short]
    _, at = np.unique(tv.mix64(r + tv.mix64(of.astype(np.uint64) + np.uint64(1))), return_index=True)
    at.sort()
    o = np.argsort(of[at], kind="stable")
    return r[at][o], of[at][o]


def sketch(r: np.ndarray, of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Set hash, number of shingles and min-hash tokens of each of n documents."""
    size = np.bincount(of, minlength=n)
    has, start = size > 0, np.searchsorted(of, np.arange(n))
    tokens, whole = np.zeros((n, TOKENS), np.uint32), np.zeros(n, np.uint64)
    if has.any():
        at = start[has]
        whole[has] = np.add.reduceat(tv.mix64(r), at)
        for k in range(TOKENS):
            tokens[has, k] = np.minimum.reduceat(((r * _ODD[k]) >> np.uint64(32)).astype(np.uint32), at)
    return tv.mix64(whole + size.astype(np.uint64)), size, tokens


def children(path: np.ndarray, tokens: np.ndarray, picks: float) -> tuple[np.ndarray, np.ndarray]:
    """For each set in a node, given by path, the nodes that it goes on to; and the row of each."""
    most = np.uint64(min(1.0, picks / TOKENS) * float(1 << 63) * 1.9999999)
    row, pos = np.nonzero(tv.mix64((path[:, None] ^ _ODD[None, :]).ravel()).reshape(-1, TOKENS) < most)
    return tv.mix64(path[row] * np.uint64(3) + _ODD[pos] + tokens[row, pos].astype(np.uint64)), row


def _tokens(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, TOKENS)


def _sketches(width: int):
    def run(batches):
        for b in batches:
            for lo, hi, buf, offs in tv.slices(b.column(2)):
                whole, size, tokens = sketch(*shingles(buf, offs, width), hi - lo)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), pa.array(whole.view(np.int64)), pa.array(size.astype(np.int64)), pa.array([t.tobytes() for t in tokens], pa.binary())], ["did", "tkey", "cid", "size", "tokens"])

    return run


def _first_level(runs: int, picks: float):
    def run(batches):
        for b in batches:
            tokens = _tokens(b.column(1))
            for r in range(runs):
                root = tv.mix64(np.full(len(tokens), r + 1, np.uint64))
                path, row = children(root, tokens, picks)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), pa.array(path.view(np.int64))], ["cid", "path"])

    return run


def _next_level(picks: float):
    def run(batches):
        for b in batches:
            path, row = children(np.asarray(b.column(2)).view(np.uint64), _tokens(b.column(1)), picks)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), pa.array(path.view(np.int64))], ["cid", "path"])

    return run


def _groups(batches, keys: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups and the bounds of the groups in them; rows come in the order of the first `keys` columns."""
    rest: list[pa.RecordBatch] = []

    def cut(table: pa.Table) -> np.ndarray:
        new = np.zeros(len(table), bool)
        for k in range(keys):
            v = np.asarray(table.column(k))
            new[1:] |= v[1:] != v[:-1]
        return np.flatnonzero(new)

    for b in batches:
        if not b.num_rows:
            continue
        rest.append(b)
        table = pa.Table.from_batches(rest).combine_chunks()
        at = cut(table)
        if not len(at):
            continue
        yield table.slice(0, at[-1]), np.r_[0, at[:-1], at[-1]]
        rest = table.slice(at[-1]).combine_chunks().to_batches()
    if rest:
        table = pa.Table.from_batches(rest).combine_chunks()
        yield table, np.r_[0, cut(table), len(table)]


def candidates(tokens: np.ndarray, side: np.ndarray, apart: bool, leaf: int, leaves: list[np.ndarray], least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a group whose sketches are near enough, and whose first common leaf is this one."""
    floor = math.floor((least - 4 * math.sqrt(least * (1 - least) / TOKENS)) * TOKENS)
    out = []
    for k in range(len(tokens) - 1):
        near = np.flatnonzero((tokens[k + 1 :] == tokens[k]).sum(axis=1) >= floor) + k + 1
        near = near[side[near] != side[k]] if apart else near
        if len(near):
            mine = leaves[k][leaves[k] < leaf]
            if len(mine):
                lists = [leaves[j] for j in near]
                flat = np.isin(np.concatenate(lists), mine)
                at = np.cumsum([0, *map(len, lists)][:-1])
                near = near[~np.logical_or.reduceat(flat, at)]
            out.append((np.full(len(near), k), near))
    return (np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _group_parts(table: pa.Table, a: int, b: int):
    part = table.slice(a, b - a)
    i, j = part.column("i")[0].as_py(), part.column("j")[0].as_py()
    leaves = part.column("leaves").combine_chunks()
    return part, _tokens(part.column("tokens")), np.asarray(part.column("side")), i != j, part.column("leaf")[0].as_py(), [np.asarray(leaves[k].values) for k in range(len(part))]


def _likely(least: float):
    """Keeps the rows of sets with a likely partner in their group."""

    def run(batches):
        for table, cut in _groups(batches, 3):
            keep = np.zeros(len(table), bool)
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                if b - a > 1:
                    _, *parts = _group_parts(table, a, b)
                    x, y = candidates(*parts, least)
                    keep[a + x] = keep[a + y] = True
            yield from table.filter(pa.array(keep)).combine_chunks().to_batches()

    return run


def _links(least: float):
    """Exact similarities of likely pairs: links of each set, and its root in the group's forest."""

    def run(batches):
        for table, cut in _groups(batches, 3):
            cids, links, roots = [], [], []
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                part, *parts = _group_parts(table, a, b)
                x, y = candidates(*parts, least)
                n = b - a
                lists = part.column("set").combine_chunks()
                offs, values = np.asarray(lists.offsets), np.asarray(lists.values)
                values = values[offs[0] : offs[-1]]
                offs = offs - offs[0]
                size = np.diff(offs)
                _, local = np.unique(values, return_inverse=True)
                mark = np.zeros(local.max() + 1 if len(local) else 1, bool)
                good = np.zeros(len(x), bool)
                for k in np.unique(x):
                    at = np.flatnonzero(x == k) if len(x) < 64 else np.arange(*np.searchsorted(x, [k, k + 1]))
                    mine = local[offs[k] : offs[k + 1]]
                    mark[mine] = True
                    for part_of in np.array_split(at, max(1, len(at) // 256)):
                        where, cuts = tv.take_ranges(offs[y[part_of]], offs[y[part_of] + 1])
                        common = np.add.reduceat(mark[local[where]].astype(np.int64), cuts[:-1])
                        good[part_of] = common >= least * (size[k] + size[y[part_of]] - common) - 1e-9
                    mark[mine] = False
                x, y = x[good], y[good]
                count = np.bincount(x, minlength=n) + np.bincount(y, minlength=n)
                root = np.arange(n)
                while True:  # smallest label of the group's links
                    new = root.copy()
                    np.minimum.at(new, x, root[y])
                    np.minimum.at(new, y, root[x])
                    new = new[new]
                    if (new == root).all():
                        break
                    root = new
                has = count > 0
                own = np.asarray(part.column("cid"))
                cids.append(own[has])
                links.append(count[has])
                roots.append(own[root[has]])
            if cids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(cids)), pa.array(np.concatenate(links).astype(np.int64)), pa.array(np.concatenate(roots))], ["cid", "links", "root"])

    return run


def _sets(width: int):
    def run(batches):
        for b in batches:
            for lo, hi, buf, offs in tv.slices(b.column(1)):
                r, of = shingles(buf, offs, width)
                at = np.searchsorted(of, np.arange(hi - lo + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(at), pa.array(r.view(np.int64)))], ["cid", "set"])

    return run


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b -> node, label: the smallest node of each connected group. Each step takes the least label around and then that label's own label."""
    both = stage(edges.filter("a <> b").select("a", "b").union(edges.filter("a <> b").select("b", "a")).distinct(), "edges")
    labels = stage(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
    while True:
        around = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("near"))
        hop = labels.join(around, labels.node == around.a).select("node", "label", F.least("label", "near").alias("new"))
        own = labels.select(F.col("node").alias("n2"), F.col("label").alias("l2"))
        new = stage(hop.join(own, hop.new == own.n2, "left").select("node", "label", F.least("new", F.coalesce("l2", "new")).alias("new")), "labels")
        if new.filter("new <> label").isEmpty():
            return new.select("node", F.col("new").alias("label"))
        labels = new.select("node", F.col("new").alias("label"))


def classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, least: float = LEAST, recall: float = RECALL, leaf: int = LEAF, block: int = BLOCK, depth: int = DEPTH) -> DataFrame:
    """One row for each row of docs: did and tkey (its key), class_id, n_links (other shingle sets of the least similarity), n_copies (rows with its set), first (whether its did and tkey are the group's first)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    src = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("did"), F.xxhash64(text).alias("tkey"), text.alias("text"))
    rows = stage(src.mapInArrow(_sketches(shingle), "did long, tkey long, cid long, size long, tokens binary"), "sketches")
    sets = stage(rows.groupBy("cid").agg(F.min(F.struct("did", "tkey")).alias("of"), F.count(F.lit(1)).alias("n_copies"), F.max("size").alias("size"), F.first("tokens").alias("tokens")), "sets")
    full = sets.filter("size > 0").select("cid", "tokens")
    level, found, used = full.mapInArrow(_first_level(runs_needed(recall, least, PICKS, depth), PICKS), "cid long, path long"), [], []
    for d in range(depth):
        level = stage(level, f"level{d}")
        n = stage(level.groupBy("path").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), f"nodes{d}")
        counted = stage(level.join(n, "path"), f"counted{d}")
        discard(level, n)
        used.append(counted)
        found.append(counted if d == depth - 1 else counted.filter(F.col("n") <= leaf))
        large = counted.filter(F.col("n") > leaf).select("cid", "path")
        if d == depth - 1 or large.isEmpty():
            break
        level = large.join(full, "cid").select("cid", "tokens", "path").mapInArrow(_next_level(PICKS), "cid long, path long")
    hits = found[0]
    for f in found[1:]:
        hits = hits.unionByName(f)
    hits = hits.select("cid", F.col("path").alias("leaf"), "n")
    known = hits.groupBy("cid").agg(F.array_sort(F.collect_set("leaf")).alias("leaves")).join(full, "cid")
    blocks = F.ceil(F.col("n") / block).cast("int")
    own = F.pmod(F.xxhash64("cid", "leaf"), blocks).cast("int")
    dealt = hits.withColumn("side", own).withColumn("x", F.explode(F.sequence(F.lit(0), blocks - 1))).select("leaf", F.least("side", "x").alias("i"), F.greatest("side", "x").alias("j"), "side", "cid")
    shape = "leaf long, i int, j int, side int, cid long, leaves array<long>, tokens binary"
    ordered = lambda df: df.repartition("leaf", "i", "j").sortWithinPartitions("leaf", "i", "j", "cid")
    likely = stage(ordered(dealt.join(known, "cid").select("leaf", "i", "j", "side", "cid", "leaves", "tokens")).mapInArrow(_likely(least), shape), "likely")
    wanted = likely.select("cid").distinct().join(sets.select("cid", "of.did", "of.tkey"), "cid")
    texts = src.join(wanted, ["did", "tkey"]).select("cid", "text").mapInArrow(_sets(shingle), "cid long, set array<long>").dropDuplicates(["cid"])
    linked = stage(ordered(likely.join(texts, "cid").select("leaf", "i", "j", "side", "cid", "leaves", "tokens", "set")).mapInArrow(_links(least), "cid long, links long, root long"), "links")
    total = linked.groupBy("cid").agg(F.sum("links").alias("n_links"))
    label = components(linked.select(F.col("cid").alias("a"), F.col("root").alias("b")))
    groups = sets.select("cid", "of", "n_copies").join(total, "cid", "left").join(label.select(F.col("node").alias("cid"), "label"), "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    heads = groups.groupBy("label").agg(F.min("of").alias("head"))
    groups = stage(groups.join(heads, "label").select("cid", "head", "n_copies", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")), "groups")
    discard(*used, likely, linked)
    out = rows.select("did", "tkey", "cid").join(groups, "cid")
    return out.select("did", "tkey", F.when(F.col("head.did") != _LAST, F.col("head.did")).alias("class_id"), "n_links", "n_copies", ((F.col("did") == F.col("head.did")) & (F.col("tkey") == F.col("head.tkey"))).alias("first"))


def join(docs: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """One row for each row of docs: doc_id, class_id, n_links, n_copies."""
    return classes(docs, id_col=id_col, **options).select(F.when(F.col("did") != _LAST, F.col("did")).alias("doc_id"), "class_id", "n_links", "n_copies")


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs without those that another document of their group stands for; of repeated rows one stays. All columns of docs, of any name, are kept as they are."""
    keep = classes(docs, id_col=id_col, text_col=text_col, **options).filter("first").select("did", "tkey").distinct()
    rows = packed(docs, did=F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)), tkey=F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    return rows.join(keep, ["did", "tkey"], "left_semi").dropDuplicates(["did", "tkey"]).select("row.*")
