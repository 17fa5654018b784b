import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ledgerlight.llm import context_lm as lm
from ledgerlight.llm.common import ship

from .fixtures import SF, awkward, docs, empty


def tokens(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]


def base(rows):
    held = [zlib.crc32(str(i).encode() if i is not None else b"") % 7 == 2 for i, _ in rows]
    c = Counter(t for (_, x), h in zip(rows, held, strict=True) if not h for t in tokens(x))
    n, v = sum(c.values()), len(c)
    return sorted(((i, h, len(tokens(x)), sum(c[t] > 0 for t in tokens(x)), n, round(sum(math.log10((c[t] + 1) / (n + v + 1)) for t in tokens(x)), 6)) for (i, x), h in zip(rows, held, strict=True)), key=str)


def rows_of(df):
    return sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in df.collect()), key=str)


def test_base_columns_and_bits(spark):
    ship(spark)
    d = spark.read.parquet(f"{SF}/documents.parquet")
    got = lm.by_remainder(d).cache()
    assert rows_of(got) == base([(r.doc_id, r.text) for r in d.collect()])
    held = [r for r in got.collect() if r.held_out]
    assert all(r.score < 0 for r in held)
    # 200 documents: well below the 4.4 bits a byte that byte frequencies alone give
    sizes = {r.doc_id: len((r.text or "").encode()) for r in d.collect()}
    assert -sum(r.score for r in held) * math.log2(10) / sum(sizes[r.doc_id] for r in held) < 3.2


def test_awkward_rows(spark):
    ship(spark)
    d = awkward(spark)
    assert rows_of(lm.by_remainder(d)) == base([(r.doc_id, r.text) for r in d.collect()])
    assert lm.by_remainder(empty(spark)).collect() == []


def test_bits_are_a_distribution():
    """Over all bytes, the probabilities of one more byte after any context add up to one, with and without its own occurrence."""
    rng = np.random.default_rng(1)
    bits = lm.table_bits(1000)
    size = lm.shifts(bits)[-1]
    model = {"bits": bits, "states": lm.states(rng.integers(0, 50, size), rng.integers(0, 50, size)), "lookup": lm.lookup(rng.random((lm.ORDERS, lm.GATES))), "map": rng.normal(0, 0.3, 256 * 48).astype(np.float32)}
    key = (np.uint64(int.from_bytes(b"abcab")) << np.uint64(8)) | np.arange(256, dtype=np.uint64)
    assert abs(np.exp(lm.byte_logs(key, np.zeros(256, bool), model)).sum() - 1) < 1e-4


def test_levels():
    """Small counts are exact, large ones within a step, and one occurrence less leads to the state of one less."""
    assert (lm.LEVEL[:32] == np.arange(32)).all() and (np.diff(lm.LEVEL.astype(int)) >= 0).all()
    n = np.arange(32, 65536)
    assert (np.abs(np.log2(lm.CENTRE[lm.LEVEL[n]] / n)) < 1 / 16).all()
    for a, b in ((0, 1), (1, 0), (5, 7), (31, 31)):
        s = int(lm.states(np.array([a]), np.array([b]))[0])
        assert lm.WITHOUT[0][s] == lm.states(np.array([max(a - 1, 0)]), np.array([b]))[0] and lm.WITHOUT[1][s] == lm.states(np.array([a]), np.array([max(b - 1, 0)]))[0]


def naive(rows, held, model):
    """Natural logarithms of the texts' probabilities bit by bit, with counts in dictionaries; weights and map are the model's."""

    def parts(text):
        out, now = [], []
        for w in tokens(text):
            h = lm._END if w is None else lm.tv.hashes(np.frombuffer(w.encode(), np.uint8), np.array([0]), np.array([len(w.encode())]))[0]
            now.append((w, int(h)))
            if w is None or int(h) % 16 == 0:
                out.append(tuple(now))
                now = []
        return out

    def bits_of(chunk, before):
        """(contexts with the bits so far, bit) of a chunk's bytes, and the bytes up to its end."""
        data = b"".join((w.encode() + b" ") if w is not None else b"\n" for w, _ in chunk)
        events = []
        for byte in data:
            node = 1
            for k in range(7, -1, -1):
                bit = byte >> k & 1
                events.append(([(j, before[-j:].rjust(j, b"\0") if j else b"", node) for j in range(lm.ORDERS)], bit, node))
                node = node * 2 + bit
            before += bytes([byte])
        return events, before

    n, follow = Counter(), {}
    for (_, text), out in zip(rows, held, strict=True):
        before, last = b"", None
        for chunk in parts(text):
            events, before = bits_of(chunk, before)
            if not out:
                for contexts, bit, _ in events:
                    for c in contexts:
                        n[c, bit] += 1
                if last is not None:
                    follow.setdefault(last, Counter())[chunk] += 1
            last = chunk
    level = lambda k: min(int(math.log2(k)), lm.LEVELS - 2)
    place = lambda hits, misses: (level(hits), 0 if misses < 1 else 1 + level(misses))
    # of the chunks that follow equally often, the choice goes by hash
    number = lambda chunk: int(lm.chunks(np.array([h for _, h in chunk], np.uint64), np.zeros(len(chunk), int))[1].view(np.int64)[0])
    best = {c: max(f.items(), key=lambda x: (x[1], number(x[0]))) for c, f in follow.items()}
    flags = {}
    for c, f in follow.items():
        total = sum(f.values())
        for chunk, k in f.items():
            own = chunk == best[c][0]
            hits = best[c][1] - own
            if total > 1:
                at = place(max(hits, 1), total - 1 - max(hits, 1))
                a, b = flags.get(at, (0, 0))
                flags[at] = (a + k * (own and hits > 0), b + k)
    out = []
    for (_, text), other in zip(rows, held, strict=True):
        before, last, total = b"", None, 0.0
        for chunk in parts(text):
            events, before = bits_of(chunk, before)
            spelled = 0.0
            for contexts, bit, node in events:
                mixed = 0.0
                for j, c in enumerate(contexts):
                    k = [n[c, 0], n[c, 1]]
                    if not other:
                        k[bit] -= 1
                    k = [lm.CENTRE[lm.LEVEL[x]] for x in k]
                    gate = min(int(math.log2(sum(k) + 1)), lm.GATES // 2 - 1) * 2 + (min(k) > 0)
                    mixed += model["weights"][j][gate] * math.log((k[1] + lm.PRIOR) / (k[0] + lm.PRIOR))
                mixed += 0.5 * model["map"][node * 48 + int(np.clip(np.rint(mixed * 2) + 24, 0, 47))]
                spelled -= math.log1p(math.exp(-mixed if bit else mixed))
            seen = sum(follow.get(last, {}).values()) - (not other) if last is not None else 0
            if last is None or seen < 1:
                total += spelled
            else:
                own = best[last][0] == chunk
                hits = best[last][1] - (own and not other)
                a, b = flags.get(place(max(hits, 1), seen - max(hits, 1)), (0, 0))
                p = (a + lm.PRIOR) / (b + 2 * lm.PRIOR) if b else 0.5
                total += math.log(p) if own and hits > 0 else math.log1p(-p) + spelled
            last = chunk
        out.append(total)
    return out


def test_score_against_brute_force(spark, monkeypatch):
    """Every document's score bit by bit, with dictionaries in place of tables (so large here that few contexts share a slot)."""
    monkeypatch.setattr(lm, "LEAST_BITS", 20)
    r = random.Random(5)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(60)]
    rows = [(k, " ".join(r.choice(words) for _ in range(r.randint(0, 70)))) for k in range(24)]
    long = " ".join(r.choice(words) for _ in range(200))
    rows += [(30, long), (31, long[:300] + " Zz " + long[300:]), (32, long), (36, long), (37, long[200:] + " b"), (33, ""), (34, "É ü \n\t x"), (35, "q" * 500)]
    held = [k % 5 == 2 for k, _ in rows]
    ship(spark)
    d = docs(spark, rows)
    model = lm.train(d.filter("doc_id % 5 <> 2").select("text"), 60)
    exact = dict(zip([k for k, _ in rows], naive(rows, held, model), strict=True))
    got = lm.score(d, held_out=F.col("doc_id") % 5 == 2).collect()
    assert next(x.score for x in got if x.doc_id == 36) > 0.5 * next(x.score for x in got if x.doc_id == 21) * 200 / 65
    for x in got:
        assert abs(x.score * math.log(10) - exact[x.doc_id]) < 0.02 * abs(exact[x.doc_id]) + 0.1, x.doc_id


def test_order_and_repetition_count(spark):
    """A held-out text scores better than its words in another order; texts that occur twice stand apart from those that occur once, learned from or not."""
    ship(spark)
    r = random.Random(3)
    vocabulary = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 8))) for _ in range(400)]
    texts = [" ".join(r.choice(vocabulary) for _ in range(150)) for _ in range(60)]
    mixed = texts[0].split()
    r.shuffle(mixed)
    rows = [*enumerate(texts), *((100 + k, texts[k]) for k in range(10)), (200, " ".join(mixed)), (201, texts[0])]
    got = {x.doc_id: x for x in lm.score(docs(spark, rows), held_out=F.col("doc_id") >= 200).collect()}
    assert got[201].score > 0.5 * got[200].score and math.isclose(got[200].base_score, got[201].base_score)
    twice = [got[k].bits_per_byte for k in (*range(10), *range(100, 110))]
    once = [got[k].bits_per_byte for k in range(10, 60)]
    assert max(twice) < 0.7 * min(once)


def test_held_out_texts(spark):
    """Far below the bits of byte frequencies alone; beside the base, which gives every unknown word its probability without spelling it, within a twentieth on 3 MB."""
    ship(spark)
    d = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet")
    rows = lm.by_remainder(d).collect()
    held = {r.doc_id for r in rows if r.held_out}
    n = Counter(b for r in d.collect() for t in tokens(r.text) if r.doc_id not in held for b in (t.encode() + b" " if t is not None else b"\n"))
    order0 = sum(math.log10((n[b] + 1) / (sum(n.values()) + 256)) for r in d.collect() if r.doc_id in held for t in tokens(r.text) for b in (t.encode() + b" " if t is not None else b"\n"))
    mine, base = (sum(r[c] for r in rows if r.held_out) for c in ("score", "base_score"))
    assert mine > 0.75 * order0 and mine > 1.05 * base


def test_one_very_long_word_and_a_text_in_many_blocks(spark, monkeypatch):
    """Blocks of bytes don't change a score."""
    ship(spark)
    rows = [(1, "ab" * 40_000), (2, "one two three " * 3000), (3, "ab cd")]
    whole = {r.doc_id: r.score for r in lm.score(docs(spark, rows)).collect()}
    model = lm.train(docs(spark, rows).select("text"), 10)
    monkeypatch.setattr(lm, "BLOCK", 1000)
    text = pa.array([rows[0][1]])
    ((_, _, buf, s, e, h, doc),) = lm._parts(text)
    first, _, _ = lm.chunks(h, doc)
    log = lm.chunk_logs(lm.Memory(model), buf, s, e, doc, np.array([True]), first)
    assert len(buf) > 50 * lm.BLOCK and math.isclose(log.sum() / math.log(10), whole[1], rel_tol=1e-4)


def test_frequent_words_are_bounded_and_change_no_score(spark, monkeypatch):
    """Words that are known without the join, and those that need it, give the same rows."""
    ship(spark)
    d = spark.read.parquet(f"{SF}/documents.parquet")
    whole = {r.doc_id: r for r in lm.by_remainder(d).collect()}
    words = spark.createDataFrame([(k, 1 + k % 7) for k in range(1000)], "h long, n long")
    for most in (0, 300, 5000):
        monkeypatch.setattr(lm, "FREQUENT", most)
        assert (lm._frequent(words)["counts"] > 0).sum() <= most
        got = {r.doc_id: r for r in lm.by_remainder(d).collect()}
        assert all(got[i].n_known == r.n_known and math.isclose(got[i].base_score, r.base_score, rel_tol=1e-9) and math.isclose(got[i].score, r.score, rel_tol=1e-9) for i, r in whole.items())
