"""Toxicity by a support vector machine on a gapped-subsequence string kernel, made finite by Nyström landmarks.

A sentence is taken as the strings in it: its words (pieces of long ones, and runs of single characters
joined). Two strings are similar by the sub-sequences of four bytes that they share, where each
skipped byte costs a factor, so `id.iot` and `idxiot` stay near `idiot`. The kernel to a set of landmark
strings spans the space in which the machine is trained (multiple-instance: the sentences of a toxic document
are not all toxic, so its strongest strings are chosen anew in each round). Every landmark is itself
a weighted set of sub-sequences; summed up, the trained machine is one table over hashed
sub-sequences, so scoring a string is a number of table look-ups, with the same value as by the landmarks.

Defined results: null and empty texts have no string and get the score of the lowest strings seen in training;
without labelled rows of both classes every score is 0; repeated rows get equal scores; the class of a document labelled twice is the higher; very long texts are scored whole, but not learned from;
an empty table gives no rows; columns of any name are kept as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv

ORDER, SPAN, DECAY = 4, 6, 0.6
TABLE_BITS = 16
LANDMARKS = 160
#: Bounds of the labelled sample that the machine is fitted on: rows of each class, characters of a row.
SAMPLE_ROWS, SAMPLE_CHARS = 2000, 20_000
PIECE, STEP = 24, 12
_STEPS = [(0, *c) for c in combinations(range(1, SPAN), ORDER - 1)]
_LOWEST = -2.0
IS_PUNCT = np.zeros(256, bool)
IS_PUNCT[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def strings(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and documents of the strings of a slice: words; overlapping pieces of those above PIECE bytes."""
    s, e, first = tv.words(buf, offs)
    doc = np.repeat(np.arange(len(offs) - 1), np.diff(first))
    long = e - s > PIECE
    if long.any():
        ls, le, ld = s[long], e[long], doc[long]
        at, of = tv.take_ranges(np.zeros(len(ls), np.int64), -(-(le - ls - PIECE) // STEP) + 1)
        k = np.repeat(np.arange(len(ls)), np.diff(of))
        ps = np.minimum(ls[k] + at * STEP, le[k] - PIECE)
        s, e, doc = np.r_[s[~long], ps], np.r_[e[~long], ps + PIECE], np.r_[doc[~long], ld[k]]
    return s, e, doc


def spaced_out(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Strings with what separates their letters taken out, and their documents: runs of three or more words of one byte each (`i d i o t`), and words with ASCII punctuation between other characters (`i.d.iot`)."""
    s, e, first = tv.words(buf, offs)
    if not len(s):
        return np.zeros(0, object), np.zeros(0, np.int64)
    one = e - s == 1
    doc = np.repeat(np.arange(len(offs) - 1), np.diff(first))
    new = np.ones(len(s), bool)
    new[1:] = ~(one[1:] & one[:-1] & (doc[1:] == doc[:-1]))
    heads = np.flatnonzero(new)
    n = np.diff(np.r_[heads, len(s)])
    keep = n >= 3
    out = [buf[s[h : h + k]].tobytes()[j : j + PIECE] for h, k in zip(heads[keep], n[keep], strict=True) for j in range(0, max(1, k - STEP), STEP)]
    of = [d for d, k in zip(doc[heads[keep]], n[keep], strict=True) for _ in range(0, max(1, k - STEP), STEP)]
    mark = IS_PUNCT[buf]
    change = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(mark, out=change[1:])
    inner = np.flatnonzero(change[e] - change[s] > 0)
    turns = np.zeros(len(buf) + 1, np.int64)  # from other characters to punctuation and back, inside a word
    turns[2:] = np.cumsum(mark[:-1] & ~mark[1:])
    for k in inner[turns[e[inner]] - turns[np.minimum(s[inner] + 1, e[inner])] > mark[s[inner]]]:
        w = buf[s[k] : e[k]]
        w = w[~mark[s[k] : e[k]]].tobytes()
        if 2 < len(w):
            pieces = range(0, max(1, len(w) - STEP), STEP)
            out += [w[j : j + PIECE] for j in pieces]
            of += [doc[k]] * len(pieces)
    return np.array(out, object), np.array(of, np.int64)


def _flat(buf: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The strings, each between two boundary marks, one after the other; and their offsets."""
    at, offs = tv.take_ranges(s - 1, e + 1)
    x = buf[np.clip(at, 0, max(0, len(buf) - 1))].astype(np.uint32)
    x[offs[:-1]], x[offs[1:] - 1] = 2, 3
    return x, offs


def _steps(x: np.ndarray, offs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """For each pattern of gaps: positions, table places of their sub-sequences, weight."""
    left = np.repeat(offs[1:], np.diff(offs)) - np.arange(len(x))
    for step in _STEPS:
        at = np.flatnonzero(left > step[-1])
        h = np.zeros(len(at), np.uint32)
        for k in step:
            h = (h ^ x[at + k]) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
        yield at, h >> np.uint32(32 - TABLE_BITS), DECAY ** (step[-1] + 1 - ORDER)


def project(x: np.ndarray, offs: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Inner products of the strings' unit feature vectors with a table (places, or places x columns)."""
    at_word = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    norm, out = np.zeros(len(offs) - 1), np.zeros((len(offs) - 1, *weights.shape[1:]), np.float64)
    for at, place, w in _steps(x, offs):
        if not len(at):
            continue
        of = at_word[at]
        norm += np.bincount(of, minlength=len(norm)) * (w * w)
        if weights.ndim == 1:
            out += w * np.bincount(of, weights[place], minlength=len(norm))
        else:
            cut = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
            out[of[cut]] += w * np.add.reduceat(weights[place], cut, axis=0)
    norm = np.sqrt(np.maximum(norm, 1e-12))
    return out / (norm if weights.ndim == 1 else norm[:, None])


def _features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    n = np.array([len(w) for w in words], np.int64)
    buf = np.frombuffer(b"".join(words), np.uint8)
    e = np.cumsum(n)
    return _flat(buf, e - n, e)


def _landmark_table(words: list[bytes]) -> np.ndarray:
    """Places x landmarks: the unit feature vector of each landmark."""
    x, offs = _features(words)
    of, norm, out = np.repeat(np.arange(len(words)), np.diff(offs)), np.zeros(len(words)), np.zeros((1 << TABLE_BITS, len(words)), np.float32)
    for at, place, w in _steps(x, offs):
        norm += np.bincount(of[at], minlength=len(words)) * (w * w)
        np.add.at(out, (place, of[at]), w)
    return out / np.sqrt(np.maximum(norm, 1e-12)).astype(np.float32)


def _bent(word: bytes) -> list[bytes]:
    """Four copies of a toxic string as people bend it: two with a byte inserted, two with a byte doubled, at places that its hash gives."""
    h = int(tv.mix64(np.array([sum(x * 257**k for k, x in enumerate(word[:8])) % (1 << 63)], np.uint64))[0])
    out = []
    for k in range(4):
        at = 1 + (h >> (8 * k)) % max(1, len(word) - 1)
        out.append(word[:at] + (bytes([97 + (h >> (40 + 5 * k)) % 26]) if k < 2 else word[at - 1 : at]) + word[at:])
    return out


def _svm(z: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 50.0, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Linear support vector machine with squared hinge loss, by Newton steps on the active rows."""
    z1 = np.c_[z, np.ones(len(z))].astype(np.float64)
    w, reg = np.zeros(z1.shape[1]), np.eye(z1.shape[1])
    reg[-1, -1] = 1e-6
    for _ in range(rounds):
        active = y * (z1 @ w) < 1
        za, wa = z1[active], weight[active] * c
        new = np.linalg.solve(reg + (za * wa[:, None]).T @ za, (za * wa[:, None]).T @ y[active])
        if np.abs(new - w).max() < 1e-7:
            break
        w = new
    return w[:-1], w[-1]


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the last entry is the constant."""
    x1 = np.c_[x, np.ones(len(x))]
    w = np.zeros(x1.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        g = x1.T @ (weight * (p - y)) + 1e-2 * w
        h = (x1 * (weight * p * (1 - p))[:, None]).T @ x1 + 1e-2 * np.eye(len(w))
        w -= np.clip(np.linalg.solve(h, g), -5, 5)
    return w


def _prepare(text: pa.Array) -> pa.Array:
    return pc.utf8_lower(pc.fill_null(text, ""))


def tops(text: pa.Array, table: np.ndarray, bias: float) -> np.ndarray:
    """For each text the margins of its three strongest strings (repeats count), lowest first; absent ones are the lowest margin."""
    out = []
    for _, _, buf, offs in tv.slices(_prepare(text)):
        s, e, doc = strings(buf, offs)
        top = np.full((len(offs) - 1, 3), _LOWEST)
        if len(s):
            h, rep, back = np.unique(tv.hashes(buf, s, e), return_index=True, return_inverse=True)
            g = np.maximum(project(*_flat(buf, s[rep], e[rep]), table) + bias, _LOWEST)[back]
            joined, of = spaced_out(buf, offs)
            if len(joined):
                g, doc = np.r_[g, np.maximum(project(*_features(list(joined)), table) + bias, _LOWEST)], np.r_[doc, of]
            # only strings near or above the boundary can matter where a document has three of them
            o = np.lexsort((g, doc))
            g, doc = g[o], doc[o]
            end = np.searchsorted(doc, np.arange(len(offs) - 1), "right")
            start = np.searchsorted(doc, np.arange(len(offs) - 1), "left")
            for k in range(3):
                has = end - start > k
                top[has, 2 - k] = g[end[has] - 1 - k]
        out.append(top)
    return np.concatenate(out) if out else np.zeros((0, 3))


def _vocabulary(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The different strings of the texts, one after the other, their starts and ends; and each text with each of its strings once (text, string)."""
    parts, docs, keys = [], [], []
    for lo, _, buf, offs in tv.slices(_prepare(texts)):
        s, e, doc = strings(buf, offs)
        joined, of = spaced_out(buf, offs)
        n = np.array([len(w) for w in joined], np.int64)
        end = len(buf) + np.cumsum(n)
        buf = np.r_[buf, np.frombuffer(b"".join(joined), np.uint8)]
        s, e, doc = np.r_[s, end - n], np.r_[e, end], np.r_[doc, of]
        h = tv.hashes(buf, s, e)
        o = np.lexsort((h, doc))
        o = o[np.r_[True, (h[o][1:] != h[o][:-1]) | (doc[o][1:] != doc[o][:-1])]] if len(o) else o
        docs.append(doc[o] + lo)
        keys.append(h[o])
        u, rep = np.unique(h, return_index=True)
        at, size = tv.take_ranges(s[rep], e[rep])
        parts.append((u, buf[at], np.diff(size)))
    if not parts:
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint8), z, z, z, z
    h, size = np.concatenate([p[0] for p in parts]), np.concatenate([p[2] for p in parts])
    end = np.cumsum(size)
    u, rep = np.unique(h, return_index=True)
    return np.concatenate([p[1] for p in parts]), (end - size)[rep], end[rep], np.concatenate(docs), np.searchsorted(u, np.concatenate(keys))


def fit(texts: pa.Array | list[str], labels: list[int], base_rate: float | None = None, rounds: int = 3, seed: int = 11) -> dict:
    """Trains on labelled texts; deterministic. base_rate: the share of toxic rows among all labelled ones (by default: in the sample)."""
    texts, y = pa.array(texts, pa.string()), np.array([int(x) for x in labels], np.int64)
    if not len(y) or y.min() == y.max():
        return {"table": np.zeros(1 << TABLE_BITS, np.float32), "bias": 0.0, "calibration": np.array([0.0, 0.0, 0.0, -50.0])}
    buf, s, e, doc, string = _vocabulary(texts)
    word = lambda k: buf[s[k] : e[k]].tobytes()
    toxic = y[doc] == 1
    df = [np.bincount(string[~toxic], minlength=len(s)), np.bincount(string[toxic], minlength=len(s))]
    odds = np.log((df[1] + 0.3) / (y.sum() + 0.6)) - np.log((df[0] + 0.3) / ((1 - y).sum() + 0.6))
    rng = np.random.default_rng(seed)
    score, table, bias = np.where(df[1] > 1, odds, np.minimum(odds, 0.0)), None, 0.0
    for r in range(rounds):
        d, k = doc[toxic], string[toxic]
        if not r:  # the two strings of each toxic text that speak most for the class
            o = np.lexsort((k, -score[k], d))
            first = np.flatnonzero(np.r_[True, d[o][1:] != d[o][:-1]]) if len(o) else np.zeros(0, np.int64)
            chosen = np.unique(k[o[np.unique(np.r_[first, np.minimum(first + 1, len(o) - 1)])]])
            chosen = chosen[score[chosen] > 0.5]
        else:  # all that the machine takes for toxic and that the labels bear out
            chosen = np.unique(k[(score[k] > 0) & (df[0][k] * 4 <= df[1][k]) & (df[1][k] > 1)])
        if not len(chosen):
            break
        neg = np.flatnonzero((df[0] > 0) & ~np.isin(np.arange(len(s)), chosen))
        hard = neg[np.argsort(-score[neg], kind="stable")[:6000]]
        neg = np.unique(np.r_[hard, rng.choice(neg, min(len(neg), 14_000), replace=False), neg[np.argsort(-df[0][neg], kind="stable")[:2000]]])
        marks = np.unique(np.r_[chosen[np.argsort(-df[1][chosen], kind="stable")[: LANDMARKS // 2]], rng.choice(neg, min(len(neg), LANDMARKS // 2), replace=False)])
        lt = _landmark_table([word(k) for k in marks])
        bent = [v for k in chosen for v in _bent(word(k))]
        z = [project(*_flat(buf, s[at], e[at]), lt).astype(np.float32) for own in (chosen, neg) for at in np.array_split(own, -(-len(own) // 2000))]
        z.insert(-(-len(chosen) // 2000), np.concatenate([project(*_features(bent[k : k + 2000]), lt).astype(np.float32) for k in range(0, len(bent), 2000)]))
        values, vectors = np.linalg.eigh(project(*_flat(buf, s[marks], e[marks]), lt))
        root = vectors[:, values > 1e-6] / np.sqrt(values[values > 1e-6])
        n_pos = len(chosen) + len(bent)
        # a string weighs by the toxic texts that have it beyond what chance would give
        seen = np.minimum(df[1][chosen], 20.0) * np.clip(odds[chosen] / 4, 0.1, 1.0)
        yy = np.r_[np.ones(n_pos), -np.ones(len(neg))]
        weight = np.r_[seen, np.repeat(seen, 4) / 4, np.minimum(df[0][neg], 20.0)]
        weight[:n_pos] *= 0.5 * weight.sum() / weight[:n_pos].sum()
        w, bias = _svm(np.concatenate(z) @ root, yy, weight / weight.mean())
        table = (lt @ (root @ w)).astype(np.float32)
        score = np.concatenate([project(*_flat(buf, s[k : k + 20_000], e[k : k + 20_000]), table) for k in range(0, len(s), 20_000)]) + bias
    if table is None:
        table = np.zeros(1 << TABLE_BITS, np.float32)
    top = tops(texts, table, bias)
    rate = base_rate if base_rate is not None else y.mean()
    weight = np.where(y == 1, rate / y.mean(), (1 - rate) / (1 - y.mean()))
    return {"table": table, "bias": float(bias), "calibration": _logistic(np.clip(top, _LOWEST, 2.0), y, weight)}


def predict(text: pa.Array, model: dict) -> np.ndarray:
    top = np.clip(tops(text, model["table"], model["bias"]), _LOWEST, 2.0)
    w = model["calibration"]
    return 1 / (1 + np.exp(-np.clip(top @ w[:-1] + w[-1], -40, 40)))


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", learn=None, sample_rows: int = SAMPLE_ROWS, sample_chars: int = SAMPLE_CHARS) -> dict:
    """Fits on labelled rows: per class the first sample_rows in the order of a hash of the key, of texts with sample_chars characters at most. learn: condition on labels' rows.

    One task on an executor gathers this bounded sample and fits; the driver gets the machine's table and four numbers.
    """
    lab = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    lab = (lab if learn is None else lab.filter(learn)).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("_y"))
    n = {r["_y"]: r["n"] for r in lab.groupBy("_y").agg(F.count(F.lit(1)).alias("n")).collect()}
    part = lambda c: lab.filter(F.col("_y") == c).orderBy(F.xxhash64("_id"), "_id").limit(sample_rows)
    few = part(0).unionByName(part(1))
    text = docs.select(F.col(id_col).alias("_of"), F.col(text_col).alias("_text")).filter(F.length("_text") <= sample_chars)
    rows = text.join(F.broadcast(few), F.col("_of") == F.col("_id")).select(F.col("_id").cast("string"), "_y", "_text")
    total = n.get(0, 0) + n.get(1, 0)
    rate = n.get(1, 0) / total if total else None

    def run(batches):
        found = pa.Table.from_batches([pa.RecordBatch.from_arrays(b.columns, ["_id", "_y", "_text"]) for b in batches], pa.schema([("_id", pa.string()), ("_y", pa.int32()), ("_text", pa.string())]))
        found = found.sort_by([("_id", "ascending"), ("_text", "ascending")]).combine_chunks()
        model = fit(found["_text"].combine_chunks(), found["_y"].to_pylist(), rate)
        yield pa.RecordBatch.from_arrays([pa.array([model["table"].tobytes()], pa.binary()), pa.array([model["bias"]]), pa.array([model["calibration"].tobytes()], pa.binary())], ["machine", "bias", "calibration"])

    made = rows.repartition(1).mapInArrow(run, "machine binary, bias double, calibration binary").first()
    if made is None:
        return fit([], [])
    return {"table": np.frombuffer(made["machine"], np.float32), "bias": made["bias"], "calibration": np.frombuffer(made["calibration"])}


def score(docs: DataFrame, model: dict, *, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """id_col, the columns in keep, score and predicted for each row of docs; whole texts."""
    cols = [id_col, *keep]
    fields = [docs.schema[c] for c in cols]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            p = predict(b.column(len(cols)), shared.value)
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(len(cols))), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], [*cols, "score", "predicted"])

    from pyspark.sql import types as T

    out = T.StructType([*fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return docs.select(*cols, F.col(text_col).alias("_text")).mapInArrow(run, out)


def reject(docs: DataFrame, model: dict, *, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, whose text scores below one half."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            yield b.filter(pa.array(predict(b.column(at), shared.value) < 0.5))

    return docs.mapInArrow(run, docs.schema)
