"""Language-model scores by online logistic mixing of hashed-context bit predictors.

A text is its words in lower case, each with a space after it, and one end. Its bytes are coded bit by bit. Six predictors look at the
bits of the byte so far in the context of the last 0 to 5 bytes, over spaces and words, hashed into tables. A slot's counts of zeros and ones
give the predictor's log-odds; a weight, chosen (gated) by the predictor and by how much and how evenly its slot has seen, multiplies them; the sum is the mixed
log-odds, which an adaptive map corrects for the bits so far.

A long-range predictor goes first. Words whose hash ends in four zero bits close a chunk (16 words on average). Before each chunk
but a text's first, one bit says whether it is the chunk that followed the chunk before it most often in the learning documents; an adaptive map of hits and misses gives that bit's
probability. Only if the bit is zero, or no such chunk is known, is the chunk coded byte by byte.

Learning: each task counts bits over its documents block after block, learns weights and map online from each block's bits against counts
without the occurrence itself, and hands on its tables; counts are added up, weights averaged by bytes. Chunk counts are a distributed table, joined by key. All counts cover all learning
documents. A learning document is scored against counts without its own occurrence of each bit and chunk, so its score compares with those of held-out ones.

Bounds: the tables' slots follow the number of different words, up to 2**MOST_BITS for a context, since every task holds them (two bytes a slot when
scoring); beyond that contexts share slots. What the driver sees are these tables, and sums.

Defined results: null and empty texts are one end; without learning documents every bit has probability one half; repeated rows count and score each; a null id
has the empty text as its key for the split; very long texts are worked on in blocks of bytes; extra columns of any name are not looked at; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .common import remainder, stage

#: Orders of the byte contexts; slots of the first two are exact, the others are 2**bits of a hash, with bits from the vocabulary's between these bounds.
ORDERS = 6
LEAST_BITS, MOST_BITS = 16, 22
GATES, PRIOR, RATE = 24, 0.4, 0.05
#: A word closes a chunk if these bits of its hash are zero.
CHUNK_MASK = np.uint64(15)
#: Bytes that are worked on at once; different byte strings after which a task learns from what it has counted.
BLOCK, LEARN_AT = 1 << 19, 2 << 20
#: Bytes of texts whose words and chunks are merged before they leave a task.
GATHER = 1 << 24
#: Slots of a table row on its way to the sum.
CELL = 1 << 14
#: Words whose counts every task knows, slots of the table that has them (of two words in a slot the more frequent), and bits of the map of contexts that can help.
#: These sizes are fixed; what they don't settle is settled by the join, at any size of the input.
FREQUENT, FREQUENT_BITS, FILTER_BITS = 1 << 18, 20, 25
#: Slots of a task's memory of byte strings that it has scored.
MEMORY_BITS = 21
_END = np.uint64(0x5851F42D4C957F2D)
_OWN = np.int64(0x14057B7EF767814F)
_CHUNK = np.uint64(0x2545F4914F6CDD1D)
#: Steps of hits and of misses by which the map of the long-range predictor goes.
LEVELS = 18
#: Steps that a task learns its weights in, where it has few byte strings.
STEPS = 256
#: Splits of the input that a learning task takes, where there are enough for all cores: it hands on its tables once.
SPLITS = 4


# Counts as levels: exact to 31, then steps of 1/16 of a power of two.
def _levels() -> tuple[np.ndarray, np.ndarray]:
    centre = np.r_[np.arange(32.0), 2.0 ** (5 + np.arange(1, 225) / 16)]
    of = np.minimum(np.searchsorted(np.sqrt(centre[:-1] * np.maximum(centre[1:], 1)) + (centre[:-1] < 31) * 0.5, np.arange(65536), "right"), 255)
    of[:32] = np.arange(32)
    return centre, of.astype(np.uint8)


CENTRE, LEVEL = _levels()
_N0, _N1 = (x.ravel() for x in np.meshgrid(CENTRE, CENTRE, indexing="ij"))
#: By state (level of zeros, level of ones): log-odds, gate, and the state without one zero or one one.
STRETCH = np.log((_N1 + PRIOR) / (_N0 + PRIOR)).astype(np.float32)
GATE = (np.minimum(np.log2(_N0 + _N1 + 1).astype(np.int64), GATES // 2 - 1) * 2 + (np.minimum(_N0, _N1) > 0)).astype(np.int64)
_down = np.r_[0, np.arange(31), 31, np.arange(32, 255)].astype(np.int64)[:256]
_down[1:32] = np.arange(31)
_down[32:] = np.arange(32, 256)
WITHOUT = [((_down[np.arange(65536) >> 8] << 8) | (np.arange(65536) & 255)).astype(np.uint16), ((np.arange(65536) & 0xFF00) | _down[np.arange(65536) & 255]).astype(np.uint16)]

#: The same by state, state without one zero, and state without one one.
GATE3, STRETCH3 = (np.concatenate([x, x[WITHOUT[0]], x[WITHOUT[1]]]) for x in (GATE, STRETCH))


def table_bits(distinct: int) -> tuple[int, ...]:
    """log2 of the slots of each order for so many different words."""
    n = max(1, int(distinct)).bit_length()
    return (8, 16, *(int(np.clip(n + 1 - k, min(LEAST_BITS, MOST_BITS - k), MOST_BITS - k)) for k in (4, 2, 1, 0)))


def shifts(bits: tuple[int, ...]) -> np.ndarray:
    return np.cumsum([0, *(1 << b for b in bits)])


def slots(key: np.ndarray, node: np.ndarray, bits: tuple[int, ...], at: np.ndarray):
    """Each order's slot, in one numbering over all tables, for byte strings (the last 5 bytes and the byte itself) and the bits so far (node: 1 and then those bits)."""
    yield node.astype(np.int64)
    yield (((key >> np.uint64(8)) & np.uint64(255)) << np.uint64(8) | node).astype(np.int64) + at[1]
    own = node.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for k in range(2, ORDERS):
        c = (key >> np.uint64(8)) & np.uint64((1 << (8 * k)) - 1)
        h = (c * np.uint64(0xD1342543DE82EF95) + own) * np.uint64(0x7FB5D329728EA185)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0x81DADEF4BC2DD44D)
        yield (h >> np.uint64(64 - bits[k])).astype(np.int64) + at[k]


def bit_steps(byte: np.ndarray):
    """For each of the eight bits: the bits so far, and the bit."""
    node = np.ones(len(byte), np.uint64)
    for k in range(7, -1, -1):
        bit = (byte >> np.uint64(k)) & np.uint64(1)
        yield node, bit
        node = (node << np.uint64(1)) | bit


def states(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Two bytes for each slot: the levels of its counts of zeros and ones. Counts beyond 65535 are scaled together."""
    out = np.empty(len(n0), np.uint16)
    for lo in range(0, len(n0), 1 << 18):
        a, b = n0[lo : lo + (1 << 18)].astype(np.float64), n1[lo : lo + (1 << 18)].astype(np.float64)
        scale = np.maximum(1.0, np.maximum(a, b) / 65535)
        small = lambda x: np.where(x > 0, np.maximum(np.rint(x / scale), 1), 0).astype(np.int64)
        out[lo : lo + (1 << 18)] = (LEVEL[small(a)].astype(np.uint16) << 8) | LEVEL[small(b)]
    return out


def _place(node: np.ndarray, st: np.ndarray) -> np.ndarray:
    return node.astype(np.int64) * 48 + np.clip(np.rint(st * 2) + 24, 0, 47).astype(np.int64)


def squash(st: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(st, -25, 25)))


class Counts:
    """What one task learns: bit counts, weights, adaptive map."""

    def __init__(self, bits: tuple[int, ...]):
        self.bits, self.at = bits, shifts(bits)
        self.n = np.zeros(2 * self.at[-1], np.uint32)  # zeros and ones of each slot, side by side
        self.w, self.grad2 = np.full((ORDERS, GATES), 0.3), np.full((ORDERS, GATES), 1e-2)
        self.hit, self.seen = np.zeros(256 * 48), np.zeros(256 * 48)
        self.bytes, self.pending, self.size = 0, [], 0

    def add(self, key: np.ndarray) -> None:
        """Byte strings of learning documents."""
        if not len(key):
            return
        self.bytes += len(key)
        self.pending.append(_counted(np.sort(key)))
        self.size += len(self.pending[-1][0])
        if self.size > LEARN_AT:
            self._merge()
            if self.size > LEARN_AT // 2:
                self.learn()

    def _merge(self) -> None:
        k, n = (np.concatenate(x) for x in zip(*self.pending, strict=True))
        o = np.argsort(k, kind="stable")
        k, n = k[o], n[o]
        cut = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
        self.pending = [(k[cut], np.add.reduceat(n, cut))]
        self.size = len(cut)

    def learn(self) -> None:
        """Counts the bits of what is pending, then steps through it in the order of a hash."""
        if not self.pending:
            return
        self._merge()
        (key, n), self.pending, self.size = self.pending[0], [], 0
        n32 = n.astype(np.uint32)
        for node, bit in bit_steps(key & np.uint64(255)):
            for at in slots(key, node, self.bits, self.at):
                np.add.at(self.n, 2 * at + bit.astype(np.int64), n32)
        state = states(self.n[::2], self.n[1::2])
        o = np.argsort(tv.mix64(key))
        key, n = key[o], n[o].astype(np.float64)
        self._steps(key, n, state, int(np.clip(len(key) // STEPS, 256, 4096)))

    def _steps(self, key: np.ndarray, n: np.ndarray, state: np.ndarray, batch: int) -> None:
        for lo in range(0, len(key), batch):
            k, c = key[lo : lo + batch], n[lo : lo + batch]
            g, table = np.zeros(ORDERS * GATES), lookup(self.w)
            for node, bit in bit_steps(k & np.uint64(255)):
                own, found, mixed = (bit.astype(np.int64) + 1) << 16, [], np.zeros(len(k), np.float32)
                for j, at in enumerate(slots(k, node, self.bits, self.at)):
                    found.append(state[at] + own)
                    mixed += table[j][found[-1]]
                err = c * (bit - squash(mixed))
                for j, s in enumerate(found):
                    g += np.bincount(GATE3[s] + j * GATES, err * STRETCH3[s], minlength=ORDERS * GATES)
                place = _place(node, mixed)
                self.hit += np.bincount(place, c * bit, minlength=256 * 48)
                self.seen += np.bincount(place, c, minlength=256 * 48)
            g = g.reshape(ORDERS, GATES)
            self.grad2 += g * g
            self.w += RATE * g / np.sqrt(self.grad2)


def _counted(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different values of a sorted array and how often each stands there."""
    cut = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    return key[cut], np.diff(np.r_[cut, len(key)])


def adaptive(hit: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """What to add to the mixed log-odds at each place of the map."""
    centre = (np.tile(np.arange(48), 256) - 24) / 2.0
    p = (hit + 50.0 * squash(centre)) / (seen + 50.0)
    return (np.log(p / (1 - p)) - centre).astype(np.float32)


def lookup(w: np.ndarray) -> np.ndarray:
    """Weighted log-odds by order and state; behind them those without one zero, and without one one."""
    return (w.astype(np.float32)[:, GATE3] * STRETCH3).astype(np.float32)


def byte_logs(key: np.ndarray, learned: np.ndarray, model: dict) -> np.ndarray:
    """Natural logarithm of the mixed probability of each byte string's last byte; learned: whether its own occurrence was counted."""
    out, at, table = np.zeros(len(key), np.float32), shifts(model["bits"]), model["lookup"]
    for node, bit in bit_steps(key & np.uint64(255)):
        mixed = np.zeros(len(key), np.float32)
        own = np.where(learned, (bit.astype(np.int64) + 1) << 16, 0)
        for k, slot in enumerate(slots(key, node, model["bits"], at)):
            mixed += table[k][model["states"][slot] + own]
        st = mixed + np.float32(0.5) * model["map"][_place(node, mixed)]
        out -= np.logaddexp(0.0, np.where(bit == 1, -st, st))
    return out


def tokens(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All tokens of a run of documents in order, each text's end included: starts, ends (equal for an end), hashes, documents."""
    s, e, first = tv.words(buf, offs)
    n = len(offs) - 1
    size = np.diff(first) + 1
    word = np.ones(len(s) + n, bool)
    word[np.cumsum(size) - 1] = False
    ts, te, h = np.zeros(len(word), np.int64), np.zeros(len(word), np.int64), np.full(len(word), _END)
    ts[word], te[word], h[word] = s, e, tv.hashes(buf, s, e)
    return ts, te, h, np.repeat(np.arange(n), size)


def coded(buf: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes that are coded, tokens one after the other, and the tokens' offsets."""
    at, offs = tv.take_ranges(s, e + 1)
    x = buf[np.minimum(at, max(0, len(buf) - 1))] if len(buf) else np.zeros(len(at), np.uint8)
    x[offs[1:] - 1] = np.where(e > s, 0x20, 0x0A)
    return x, offs


def byte_strings(x: np.ndarray, begin: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """For each position in [lo, hi) the byte and the 5 bytes before it in its text, as one integer. begin: the texts' first positions, in order."""
    back = min(5, lo)
    y = np.zeros(hi - lo + 5, np.uint64)
    y[5 - back :] = x[lo - back : hi]
    two = y[1:] | (y[:-1] << np.uint64(8))
    four = two[2:] | (two[:-2] << np.uint64(16))
    key = four[2:] | (two[:-4] << np.uint64(32))
    first = begin[np.searchsorted(begin, lo - 5) : np.searchsorted(begin, hi)]
    for k in range(5):  # nothing before a text's start
        at = first + k - lo
        at = at[(at >= 0) & (at < hi - lo)]
        key[at] &= np.uint64((1 << (8 * (k + 1))) - 1)
    return key


def chunks(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First token of each chunk, its hash, and whether it opens its text."""
    if not len(h):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, bool)
    close = (h & CHUNK_MASK) == 0
    close |= h == _END
    first = np.flatnonzero(np.r_[True, close[:-1]])
    up, down = tv.powers(len(h) + 1)
    p = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * up[: len(h)], out=p[1:])
    end = np.r_[first[1:], len(h)]
    value = tv.mix64((p[end] - p[first]) * down[first] + (end - first).astype(np.uint64))
    return first, value, np.r_[True, doc[first[1:]] != doc[first[1:] - 1]]


def _before(value: np.ndarray) -> np.ndarray:
    """Each chunk's context: the chunk before it."""
    return tv.mix64(np.r_[np.uint64(0), value[:-1]] ^ _CHUNK)


def _parts(text: pa.Array):
    """For runs of a batch's rows: first and end row, lower-case bytes, and tokens."""
    for lo, hi, buf, offs in tv.slices(text, BLOCK):
        buf = tv.lower_ascii(buf)
        yield lo, hi, buf, *tokens(buf, offs)


def _grouped(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """An order by keys (the first is the most important), and where in it a new combination begins."""
    o = np.lexsort(keys[::-1])
    new = np.zeros(len(o), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[o][1:] != k[o][:-1]
    return o, np.flatnonzero(new)


def _count(batches):
    """Occurrences in learning documents of each word (f is null), and of each chunk after each context; out: those of the latter in other documents."""
    words, pairs, size = [], [], 0

    def flush():
        h, n = _counted(np.sort(np.concatenate(words)))
        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.nulls(len(h), pa.int64()), pa.array(n), pa.nulls(len(h), pa.int64())], ["h", "f", "n", "out"])
        ctx, f, mine = (np.concatenate(x) for x in zip(*pairs, strict=True))
        o, cut = _grouped([ctx, f])
        if len(cut):
            n = np.add.reduceat(mine[o], cut)
            yield pa.RecordBatch.from_arrays([pa.array(ctx[o[cut]].view(np.int64)), pa.array(f[o[cut]].view(np.int64)), pa.array(n), pa.array(np.diff(np.r_[cut, len(o)]) - n)], ["h", "f", "n", "out"])

    for b in batches:
        learn = np.asarray(b.column(1)).astype(bool)
        for lo, _, buf, _, _, h, doc in _parts(b.column(0)):
            own = learn[doc + lo]
            words.append(h[own])
            first, value, opens = chunks(h, doc)
            pairs.append((_before(value)[~opens], value[~opens], own[first[~opens]].astype(np.int64)))
            size += len(buf)
            if size > GATHER:
                yield from flush()
                words, pairs, size = [], [], 0
    if words:
        yield from flush()


def _begins(offs: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Where each text begins in the coded bytes."""
    return offs[:-1][np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])] if len(doc) else np.zeros(0, np.int64)


def _learn(bits: tuple[int, ...]):
    """Tables, weights and map of one task: cells of tables as 32-bit counts; cell -1 has the bytes learned from, the weights times these, and the map."""

    def run(batches):
        counts, task = Counts(bits), TaskContext.get().partitionId()
        for b in batches:
            for _, _, buf, s, e, _, doc in _parts(b.column(0)):
                x, offs = coded(buf, s, e)
                begin = _begins(offs, doc)
                for lo in range(0, len(x), BLOCK):
                    counts.add(byte_strings(x, begin, lo, min(len(x), lo + BLOCK)))
        counts.learn()
        if not counts.bytes:
            return
        cells = [np.r_[counts.bytes, (counts.w * counts.bytes).ravel(), counts.hit, counts.seen].tobytes()]
        number = [-1]
        for lo in range(0, counts.at[-1], CELL):
            cell = counts.n[2 * lo : 2 * (lo + CELL)]
            if cell.any():
                cells.append(cell.tobytes())
                number.append(lo // CELL)
            if len(cells) == 64 or lo + CELL >= counts.at[-1]:
                yield pa.RecordBatch.from_arrays([pa.array(number, pa.int32()), pa.array([task] * len(cells), pa.int64()), pa.array(cells, pa.binary())], ["cell", "task", "data"])
                cells, number = [], []

    return run


def _add_up(batches):
    """Sums of the rows of each cell, which come one after the other in the order of their tasks; counts leave as states."""
    now, total = None, None

    def made():
        data = total if now < 0 else states(total[::2], total[1::2])
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([data.tobytes()], pa.binary())], ["cell", "data"])

    for b in batches:
        cells = np.asarray(b.column(0))
        for k, c in enumerate(cells.tolist()):
            data = np.frombuffer(b.column(2)[k].as_buffer(), np.float64 if c < 0 else np.uint32)
            if c != now:
                if now is not None:
                    yield made()
                now, total = c, np.zeros(len(data), np.float64 if c < 0 else np.uint64)
            total += data
    if now is not None:
        yield made()


def train(docs: DataFrame, distinct: int) -> dict:
    """The byte model from the texts of learning documents (one column)."""
    bits, splits = table_bits(distinct), docs.rdd.getNumPartitions()
    few = docs.coalesce(max(1, min(splits, max(docs.sparkSession.sparkContext.defaultParallelism, -(-splits // SPLITS)))))
    rows = few.mapInArrow(_learn(bits), "cell int, task long, data binary").repartition("cell").sortWithinPartitions("cell", "task").mapInArrow(_add_up, "cell int, data binary").toArrow()
    state, w, hit, seen = np.zeros(shifts(bits)[-1], np.uint16), np.full((ORDERS, GATES), 0.3), np.zeros(256 * 48), np.zeros(256 * 48)
    for cell, data in zip(rows["cell"].to_pylist(), rows["data"], strict=True):
        if cell < 0:
            x = np.frombuffer(data.as_buffer())
            n = ORDERS * GATES
            w, hit, seen = x[1 : 1 + n].reshape(ORDERS, GATES) / x[0], x[1 + n : 1 + n + len(hit)], x[1 + n + len(hit) :]
        else:
            part = np.frombuffer(data.as_buffer(), np.uint16)
            state[cell * CELL : cell * CELL + len(part)] = part
    return {"bits": bits, "states": state, "lookup": lookup(w), "map": adaptive(hit, seen), "weights": w}


def followers(counts: DataFrame) -> DataFrame:
    """For each context that can help a document: the chunk that follows most often (f), how often (c), and all occurrences (total)."""
    best = counts.filter(F.col("f").isNotNull()).groupBy("h").agg(F.max(F.struct("n", "f")).alias("top"), F.sum("n").alias("total"), F.sum("out").alias("out"))
    return best.filter((F.col("total") > 1) | ((F.col("total") == 1) & (F.col("out") > 0))).select("h", F.col("top.n").alias("c"), F.col("top.f").alias("best"), "total")


def _frequent_slot(h: np.ndarray) -> np.ndarray:
    return ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - FREQUENT_BITS)).astype(np.int64)


def _frequent(words: DataFrame) -> dict:
    """The most frequent words by slot, and log10(count + 1) of each: all words from a step of the counts on, such that no more than FREQUENT are there. The steps are counted first, so no task sees more words than its own."""
    step, cut, some = F.floor(F.log2("n") * 16), None, 0
    for r in sorted(words.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("many")).collect(), key=lambda r: -r["step"]):
        some += r["many"]
        if some > FREQUENT:
            break
        cut = r["step"]
    top = words.filter(F.lit(False) if cut is None else step >= cut).select("h", "n").toArrow()
    h, n = np.asarray(top["h"]).view(np.uint64), np.asarray(top["n"]).astype(np.float64)
    o = np.lexsort((h, n))  # of two words in a slot the more frequent stays
    at, log = np.full(1 << FREQUENT_BITS, ~np.uint64(0)), np.zeros(1 << FREQUENT_BITS, np.float64)
    slot = _frequent_slot(h[o])
    at[slot], log[slot] = h[o], np.log10(n[o] + 1)
    return {"words": at, "counts": log}


def _filter(follow: DataFrame) -> np.ndarray:
    """One bit for each value of the first bits of a context's key: whether a context that can help begins so."""
    bit = F.shiftrightunsigned("h", 64 - FILTER_BITS)
    rows = follow.groupBy(F.shiftright(bit, 3).cast("int").alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1, cast(shiftrightunsigned(h, {64 - FILTER_BITS}) & 7 AS int))")).alias("bits")).toArrow()
    out = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    out[np.asarray(rows["at"])] = np.asarray(rows["bits"]).astype(np.uint8)
    return out


def _level(n: Column) -> Column:
    return F.least(F.floor(F.log2(n)), F.lit(LEVELS - 2)).cast("int")


def flag_map(follow: DataFrame) -> np.ndarray:
    """The probability that the following chunk is the expected one, by levels of hits and misses, over all occurrences in learning documents without the occurrence itself."""
    seen = follow.filter("total > 1")
    hits, misses = F.col("hits"), F.col("misses")
    again = seen.select(F.greatest(F.col("c") - 1, F.lit(1)).alias("hits"), (F.col("total") - F.greatest(F.col("c"), F.lit(2))).alias("misses"), F.when(F.col("c") > 1, F.col("c")).otherwise(0).alias("hit"), F.col("c").alias("n"))
    other = seen.select(F.col("c").alias("hits"), (F.col("total") - 1 - F.col("c")).alias("misses"), F.lit(0).cast("long").alias("hit"), (F.col("total") - F.col("c")).alias("n")).filter("n > 0")
    at = again.unionByName(other).groupBy(_level(hits).alias("a"), F.when(misses < 1, F.lit(0)).otherwise(1 + _level(misses)).alias("b")).agg(F.sum("hit").alias("hit"), F.sum("n").alias("n"))
    out = np.full((LEVELS, LEVELS), 0.5)
    for r in at.collect():
        out[r["a"], r["b"]] = (r["hit"] + PRIOR) / (r["n"] + 2 * PRIOR)
    return out


def _flag(hits: np.ndarray, misses: np.ndarray, table: np.ndarray) -> np.ndarray:
    level = lambda n: np.minimum(np.log2(np.maximum(n, 1)).astype(np.int64), LEVELS - 2)
    return table[level(hits), np.where(misses < 1, 0, 1 + level(misses))]


class Memory:
    """Byte strings that a task has scored, by slot; a string that is not there is scored and takes its slot."""

    def __init__(self, model: dict):
        self.model = model
        self.key, self.log = np.full(1 << MEMORY_BITS, ~np.uint64(0)), np.zeros(1 << MEMORY_BITS, np.float32)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - MEMORY_BITS)).astype(np.int64)

    def logs(self, key: np.ndarray) -> np.ndarray:
        """Natural logarithms of the strings' last bytes; bit 48 says that the string's own occurrence was counted."""
        at = self._slot(key)
        out, new = self.log[at], np.flatnonzero(self.key[at] != key)
        if len(new):
            some = _counted(np.sort(key[new]))[0]
            strings, learned = some & np.uint64((1 << 48) - 1), some >= np.uint64(1 << 48)
            log = np.concatenate([byte_logs(strings[k : k + (1 << 15)], learned[k : k + (1 << 15)], self.model) for k in range(0, len(some), 1 << 15)])
            slot = self._slot(some)
            self.key[slot], self.log[slot] = some, log
            out[new] = self.log[at[new]]
            late = new[self.key[at[new]] != key[new]]  # strings that share a slot with a later one
            out[late] = log[np.searchsorted(some, key[late])]
        return out


def chunk_logs(memory: Memory, buf: np.ndarray, s: np.ndarray, e: np.ndarray, doc: np.ndarray, learn: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Natural logarithm of the probability of each chunk of a run of texts, spelled out."""
    x, offs = coded(buf, s, e)
    begin, starts, out = _begins(offs, doc), offs[first], np.zeros(len(first))
    flag = np.where(learn[doc[first]], np.uint64(1 << 48), np.uint64(0))
    for lo in range(0, len(x), BLOCK):
        hi = min(len(x), lo + BLOCK)
        a, b = int(np.searchsorted(starts, lo, "right")) - 1, int(np.searchsorted(starts, hi))
        cut = np.maximum(starts[a:b], lo) - lo
        log = memory.logs(byte_strings(x, begin, lo, hi) | np.repeat(flag[a:b], np.diff(np.r_[cut, hi - lo])))
        out[a:b] += np.add.reduceat(log, cut, dtype=np.float64)
    return out


def _postings(shared):
    """For each batch of documents (a unit): its own row with what is known without a join; for each other word and each (context, chunk) the rows that have it."""
    names = ["unit", "h", "f", "rows"]

    def lists(unit, o, cut, h, f, flat):
        ends = np.r_[cut, len(o)].astype(np.int64) * flat.shape[1] * flat.itemsize
        data = pa.Array.from_buffers(pa.binary(), len(cut), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(flat[o]).view(np.uint8).ravel())])
        key = [pa.array(np.full(len(cut), unit)), pa.array(h[o[cut]].view(np.int64)), pa.nulls(len(cut), pa.int64()) if f is None else pa.array(f[o[cut]].view(np.int64)), data]
        for k in range(0, len(cut), 50_000):
            yield pa.RecordBatch.from_arrays([x.slice(k, 50_000) for x in key], names)

    def run(batches):
        memory, word_at, often, can_help = Memory(shared.value["model"]), shared.value["words"], shared.value["counts"], shared.value["filter"]
        task, number = TaskContext.get().partitionId(), 0
        for b in batches:
            unit, number = (task << 24) + number, number + 1
            learn = ~np.asarray(b.column(1)).astype(bool)
            sums, size = np.zeros((3, b.num_rows)), np.zeros(b.num_rows, np.int64)  # known, base, score
            words, follow, done = [], [], 0

            def flush():
                h, row, times = (np.concatenate(x) for x in zip(*words, strict=True))
                o, cut = _grouped([h])
                yield from lists(unit, o, cut, h, None, np.stack([row, times], axis=1).astype(np.uint32))
                ctx, value, row, log = (np.concatenate(x) for x in zip(*follow, strict=True))
                o, cut = _grouped([ctx, value])
                yield from lists(unit, o, cut, ctx, value, np.stack([row.astype(np.uint32), log.astype(np.float32).view(np.uint32)], axis=1))

            for lo, hi, buf, s, e, h, doc in _parts(b.column(2)):
                size[lo:hi] = np.bincount(doc, minlength=hi - lo)
                at = _frequent_slot(h)
                known = word_at[at] == h
                sums[0, lo:hi] += np.bincount(doc[known], minlength=hi - lo)
                sums[1, lo:hi] += np.bincount(doc[known], often[at[known]], minlength=hi - lo)
                h_rest, doc_rest = h[~known], doc[~known]
                o, cut = _grouped([h_rest, doc_rest])
                words.append((h_rest[o[cut]], doc_rest[o[cut]] + lo, np.diff(np.r_[cut, len(o)])))
                first, value, opens = chunks(h, doc)
                ctx, row, log = _before(value), doc[first] + lo, chunk_logs(memory, buf, s, e, doc, learn[lo:hi], first)
                bit = (ctx >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
                joins = ~opens & (can_help[bit >> 3] >> (bit & 7) & 1).astype(bool)
                sums[2] += np.bincount(row[~joins], log[~joins], minlength=b.num_rows)
                follow.append((ctx[joins], value[joins], row[joins], log[joins]))
                done += len(buf)
                if done > GATHER:
                    yield from flush()
                    words, follow, done = [], [], 0
            if words:
                yield from flush()
            ids = np.empty((b.num_rows, 7), np.int64)
            ids[:, 0] = np.asarray(b.column(0).fill_null(0))
            ids[:, 1] = np.asarray(b.column(0).is_null()).astype(np.int64) + 2 * np.asarray(b.column(1)).astype(np.int64)
            ids[:, 2], ids[:, 3], ids[:, 4:] = size, np.asarray(b.column(3)), sums.T.copy().view(np.int64)
            # its own row has a key that no word has, another one for each unit
            key = tv.mix64(np.array([unit], np.uint64) ^ _CHUNK).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([unit]), pa.array(key), pa.array([_OWN]), pa.array([ids.tobytes()], pa.binary())], names)

    return run


def _sums(base: float, flags: np.ndarray):
    """Adds up the tokens of each document of a unit; the unit's own row comes first."""
    names = ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "n_bytes"]

    def emit(x: np.ndarray, acc: np.ndarray):
        doc = pa.array(x[:, 0], mask=(x[:, 1] & 1).astype(bool))
        return pa.RecordBatch.from_arrays([doc, pa.array((x[:, 1] & 2) > 0), pa.array(x[:, 2]), pa.array(np.rint(acc[0]).astype(np.int64)), pa.array(acc[1] - x[:, 2] * base), pa.array(acc[2] / np.log(10)), pa.array(x[:, 3])], names)

    def entries(rows: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        _, offs, data = rows.buffers()
        o = np.frombuffer(offs, np.int32)[rows.offset : rows.offset + len(rows) + 1].astype(np.int64)
        return np.frombuffer(data, np.uint8)[o[0] : o[-1]].view(np.uint32).reshape(-1, 2), np.diff(o) // 8

    def run(batches):
        unit, ids, acc = None, None, None
        for b in batches:
            units, is_own = np.asarray(b.column(0)), np.asarray(b.column(1)) == _OWN
            cuts = np.flatnonzero(np.r_[True, units[1:] != units[:-1], True]) if len(units) else np.zeros(0, np.int64)
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if units[lo] != unit:
                    if ids is not None:
                        yield emit(ids, acc)
                    assert is_own[lo]
                    unit, ids = units[lo], np.frombuffer(b.column(2)[lo].as_py(), np.int64).reshape(-1, 7)
                    acc = ids[:, 4:].copy().view(np.float64).T.copy()
                    learned = (ids[:, 1] & 2) == 0
                    lo += 1
                part = b.slice(lo, hi - lo)
                f, c, best, total = (np.asarray(part.column(k).fill_null(0)) for k in (1, 3, 4, 5))
                is_chunk = np.asarray(part.column(1).is_valid())
                for kind in (False, True):
                    mine = pa.array(is_chunk == kind)
                    flat, n = entries(part.column(2).filter(mine))
                    if not len(flat):
                        continue
                    row = flat[:, 0].astype(np.int64)
                    each = lambda x: np.repeat(x[is_chunk == kind], n)  # noqa: B023, E731
                    cs = each(c)
                    if not kind:
                        times = flat[:, 1].astype(np.float64)
                        acc[0] += np.bincount(row, times * (cs > 0), minlength=len(ids))
                        acc[1] += np.bincount(row, times * np.log10(cs + 1.0), minlength=len(ids))
                        continue
                    log, own = np.ascontiguousarray(flat[:, 1]).view(np.float32).astype(np.float64), learned[row].astype(np.int64)
                    hit, all_ = (each(f) == each(best)) & (cs > 0), each(total) - own
                    hits = cs - (hit * own)
                    hit &= hits > 0
                    hits = np.maximum(hits, 1)
                    p = _flag(hits, all_ - hits, flags)
                    acc[2] += np.bincount(row, np.where(all_ < 1, log, np.where(hit, np.log(p), np.log1p(-p) + log)), minlength=len(ids))
        if ids is not None:
            yield emit(ids, acc)

    return run


def score(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", held_out: Column | None = None) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    held_out: condition on docs' rows; those rows are scored but not learned from. By default none is.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = F.lit(False) if held_out is None else F.coalesce(held_out, F.lit(False))
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), out.alias("out"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    counts = src.select("text", (~F.col("out")).alias("learn")).mapInArrow(_count, "h long, f long, n long, out long").groupBy("h", "f").agg(F.sum("n").alias("n"), F.sum("out").alias("out"))
    counts = stage(counts, "counts")
    words = counts.filter(F.col("f").isNull() & (F.col("n") > 0))
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    model = train(src.filter(~F.col("out")).select("text"), distinct)
    follow = stage(followers(counts), "followers")
    flags = flag_map(follow)
    shared = docs.sparkSession.sparkContext.broadcast({"model": model, "filter": _filter(follow)} | _frequent(words))
    known = words.select("h", F.col("n").alias("c"), F.lit(None).cast("long").alias("best"), F.lit(None).cast("long").alias("total")).unionByName(follow)
    asked = src.select("doc_id", "out", "text", "n_bytes").mapInArrow(_postings(shared), "unit long, h long, f long, rows binary")
    late = (~F.col("f").eqNullSafe(F.lit(int(_OWN)))).alias("late")
    by_unit = asked.join(known, "h", "left").select("unit", "f", "rows", "c", "best", "total", late).repartition("unit").sortWithinPartitions("unit", "late").drop("late")
    base = float(np.log10(total + distinct + 1))
    sums = by_unit.mapInArrow(_sums(base, flags), "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, n_bytes long")
    bits = F.try_divide(-F.col("score") * float(np.log2(10)), F.col("n_bytes"))
    return sums.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score", bits.alias("bits_per_byte"))


def by_remainder(docs: DataFrame, n: int = 7, left: int = 2, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return score(docs, id_col=id_col, text_col=text_col, held_out=remainder(id_col, n) == left)
