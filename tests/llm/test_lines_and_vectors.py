"""Fill-in-the-middle, line dedup and centroid clustering against plain versions."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyfold.llm import centroids, cuckoo, dual_tree, fill_middle, line_dedup

TEXTS = [
    None, "", "a", "A b", "Éa é ß 漢字 😀𝄞 x", "\x01\x02\x03\x04 \x02\x01d\x02e\x01", "x\x01y" * 50, "a <P> marker", "<S", "> < P <<S", "<M>", "line\nline\r\n\n", "x " * 4000, "y" * 20000,
    "don't stop, 3.14 and\tmore\x00", "$1 \\1 $0 \\", *[f"some text number {i}, with <, > and S> M> <P in it" for i in range(60)],
]


def documents(spark, texts):
    """Rows with clashing extra columns and no id here and there; the last text stands twice with one id."""
    rows = [(None if i % 9 == 4 else i, t, "en", i, "x", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[-1]], "doc_id long, text string, lang string, id long, t string, n int")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# 11


def plain_fim(doc_id, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    digest, n = sha(f"1:{'' if doc_id is None else doc_id}"), len(units)
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    if h[3] % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fill_middle(spark, sf_dir):
    for docs in (documents(spark, TEXTS), spark.read.parquet(f"{sf_dir}/documents.parquet")):
        d = fill_middle.transform(docs).withColumn("again", fill_middle.restored(F.col("output"), F.col("form")))
        got = sorted((tuple(r) for r in d.collect()), key=repr)
        want = [(r["doc_id"], *plain_fim(r["doc_id"], r["text"]), r["text"] or "") for r in docs.select("doc_id", "text").collect()]
        assert got == sorted(want, key=repr)
        assert {g[2] for g in got} == {"plain", "psm", "spm"}
    assert fill_middle.transform(documents(spark, ["a"]).filter("false")).isEmpty()


def test_fill_middle_long_text(spark):
    text = "word, \x01\x02 é " * 400_000
    r = fill_middle.transform(spark.createDataFrame([(i, text) for i in range(8)], "doc_id long, text string")).select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(F.col("output").cast("binary"), 256)).collect()
    assert sorted(tuple(x) for x in r) == [(i, *w[:4], sha(w[4])) for i in range(8) for w in [plain_fim(i, text)]]


# 12


def plain_lines(texts, counted=None, threshold=10, least=1):
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
    n = collections.Counter(k for t in (texts if counted is None else counted) for k in {key(x) for x in (t or "").split("\n")})
    out = []
    for t in texts:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < least or n[key(x)] < threshold]
        out.append((len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def lined(rnd, n):
    pool = ["Shared LINE", " shared line\t", "\x0bother é line", "É stays", "é stays", "", " ", "😀", *[f"line {k}" for k in range(40)]]
    return [None, "", "\n", "\n\n x", *["\n".join(rnd.choice(pool) if rnd.random() < 0.7 else f"own {rnd.random()}" for _ in range(rnd.randrange(12))) for _ in range(n)]]


def rows_of(df):
    return sorted(((r["n_lines"], r["n_dropped"], r["kept"]) for r in df.collect()), key=repr)


def test_line_dedup(spark, sf_dir):
    small = [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    for texts in (small, lined(random.Random(3), 90), TEXTS):
        docs = documents(spark, texts)
        assert rows_of(line_dedup.dedup(docs)) == sorted(plain_lines([*texts, texts[-1]]), key=repr)
    assert line_dedup.dedup(docs.filter("false")).isEmpty()
    few = documents(spark, lined(random.Random(4), 40))
    texts = [r["text"] for r in few.collect()]
    assert rows_of(line_dedup.dedup(few, threshold=3, min_chars=7)) == sorted(plain_lines(texts, threshold=3, least=7), key=repr)


def test_lines_in_and_out_again(spark, tmp_path):
    """Documents are put in in three batches, with several shards, and taken out: as if they never had been there."""
    rnd = random.Random(7)
    batches = [lined(rnd, 60) for _ in range(3)]
    frames = [documents(spark, b) for b in batches]
    texts = [[r["text"] for r in f.collect()] for f in frames]
    index = line_dedup.empty(spark)
    seen = []
    for f, t in zip(frames, texts, strict=True):
        index = line_dedup.insert(index, f, shard_keys=6)
        seen += t
        assert rows_of(line_dedup.drop_lines(frames[0], index)) == sorted(plain_lines(texts[0], seen), key=repr)
    assert index.bits >= 2 and index.filters.count() > 2
    line_dedup.save(index, f"{tmp_path}/index")
    index = line_dedup.load(spark, f"{tmp_path}/index")
    assert rows_of(line_dedup.by_join(frames[0], index, hot=3)) == sorted(plain_lines(texts[0], seen), key=repr)
    assert rows_of(line_dedup.drop_lines(frames[0], index, limit=cuckoo.SHARD_BYTES)) == sorted(plain_lines(texts[0], seen), key=repr)
    index = line_dedup.delete(line_dedup.delete(index, frames[2]), frames[1])
    once = line_dedup.insert(line_dedup.empty(spark), frames[0])
    assert sorted(map(tuple, index.refs.collect())) == sorted(map(tuple, once.refs.collect()))
    prints = lambda i: sorted(x for r in i.filters.collect() for x in np.frombuffer(r["table"], np.uint16)[np.frombuffer(r["table"], np.uint16) > 0].tolist())
    assert prints(index) == prints(once)
    assert rows_of(line_dedup.drop_lines(frames[0], index)) == sorted(plain_lines(texts[0]), key=repr)
    with pytest.raises(Exception, match="never put in"):
        line_dedup.delete(index, documents(spark, ["not there"])).refs.count()


def test_wrong_suspects_stay(spark):
    """Lines that a filter suspects wrongly, here all of them, are found in the exact table."""
    texts = lined(random.Random(5), 60)
    docs = documents(spark, texts)
    index = line_dedup.insert(line_dedup.empty(spark), docs)
    rows, shard = index.refs.collect(), cuckoo.Shard()
    hi, lo = (np.array([r[c] for r in rows], np.int64).view(np.uint64) for c in ("hi", "lo"))
    shard.add(*cuckoo.prints(hi, lo))
    fooled = line_dedup.Index(index.refs, spark.createDataFrame([(0, shard.table.tobytes(), shard.stash.tobytes())], "shard int, table binary, stash binary"), 0)
    assert rows_of(line_dedup.drop_lines(docs, fooled)) == sorted(plain_lines([*texts, texts[-1]]), key=repr)


@pytest.mark.parametrize("n", [0, 1, 5, 1000, 100_000, cuckoo.BUCKETS * cuckoo.SLOTS + 700])
def test_cuckoo_shard(n):
    rng = np.random.default_rng(n)
    hi, lo = (rng.integers(0, 1 << 64, n, dtype=np.uint64) for _ in range(2))
    hi, lo = np.concatenate([hi, hi[:3], hi[:3]]), np.concatenate([lo, lo[:3], lo[:3]])
    s = cuckoo.Shard()
    s.add(*cuckoo.prints(hi, lo))
    asked = lambda: cuckoo.Filter(0, [(0, s.table.tobytes(), s.stash.tobytes())])
    assert asked().has(hi, lo).all()
    assert n <= cuckoo.SHARD_KEYS * 1.2 and not len(s.stash) or n > cuckoo.BUCKETS * cuckoo.SLOTS
    gone = rng.random(len(hi)) < 0.5
    s.take(*cuckoo.prints(hi[gone], lo[gone]))
    assert asked().has(hi[~gone], lo[~gone]).all()
    if n == 100_000:
        assert asked().has(*(rng.integers(0, 1 << 64, n, dtype=np.uint64) for _ in range(2))).mean() < 3e-4
    s.take(*cuckoo.prints(hi[~gone], lo[~gone]))
    assert not s.table.any() and not len(s.stash)


# 13


@pytest.mark.parametrize("n,k,dims,spread", [(1, 1, 3, 9), (700, 40, 64, 256), (900, 40, 5, 6), (300, 7, 2, 2), (400, 12, 8, 1 << 26)])
def test_dual_tree(n, k, dims, spread):
    rng = np.random.default_rng(n)
    x, c = rng.integers(-spread, spread, (n, dims)), rng.integers(-spread, spread, (k, dims))
    x[: n // 3] = x[0]
    t, ct = dual_tree.cover_tree(x), dual_tree.cover_tree(c, 1)
    assert sorted(t.order.tolist()) == list(range(n))
    best, far = dual_tree.nearest(x[t.order], t, c, ct)
    d = ((x[t.order][:, None] - c[None]) ** 2).sum(axis=2)
    assert (best == d.argmin(axis=1)).all() and (far == d.min(axis=1)).all()


def test_cover_tree_keeps_its_promises():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 4)) * np.exp(rng.normal(size=(300, 1)))
    centres, near, parent = dual_tree.farthest_first(x, 60)
    d = np.sqrt(((x[centres][:, None] - x[centres][None]) ** 2).sum(axis=2))
    level = [math.inf] + [math.ceil(math.log2(d[j, :j].min())) - 1 for j in range(1, len(centres))]
    for j in range(1, len(centres)):
        assert level[parent[j]] > level[j] and d[j, parent[j]] <= 2 ** (level[j] + 1) * (1 + 1e-9)
        assert all(d[j, i] > 2 ** level[j] * (1 - 1e-9) for i in range(len(centres)) if i != j and level[i] >= level[j])
    assert (near == np.sqrt(((x[:, None] - x[centres][None]) ** 2).sum(axis=2)).argmin(axis=1)).all()


def test_cover_tree_prunes():
    rng = np.random.default_rng(4)
    x = rng.integers(-200, 200, (20, 64))[rng.integers(0, 20, 1000)] + rng.integers(-9, 9, (1000, 64))
    c = x[:40]
    t, ct = dual_tree.cover_tree(x), dual_tree.cover_tree(c, 1)
    leaf, _ = dual_tree.leaf_pairs(x[t.order], t, c[ct.order], ct)
    assert (t.hi[leaf] - t.lo[leaf]).sum() < 0.2 * 1000 * 40


def plain_lloyd(rows, k=40, dims=64, rounds=5):
    kept = [(i, [math.floor(256 * float(e)) for e in v]) for i, v in rows if v is not None and len(v) == dims and all(e is not None and math.isfinite(e) for e in v)]
    start = sorted((sha(f"2:{'' if i is None else i}"), v) for i, v in kept)[:k]
    x, c = np.array([v for _, v in kept], np.int64), np.array([v for _, v in start], np.int64)
    near = lambda: ((x[:, None] - c[None]) ** 2).sum(axis=2)
    for _ in range(rounds):
        a = near().argmin(axis=1)
        for j in set(a.tolist()):
            c[j] = x[a == j].sum(axis=0) // (a == j).sum()
    a, d = near().argmin(axis=1), near().min(axis=1)
    return sorted(((i, int(j), int(f), int(d[a == j].sum()), int(d.sum()), sha(",".join(map(str, c[j].tolist())))) for (i, _), j, f in zip(kept, a, d, strict=True)), key=repr)


def test_centroids(spark, sf_dir):
    rnd = random.Random(1)
    inf, one = float("inf"), [rnd.gauss(0, 1) for _ in range(64)]
    made = [(i, [rnd.gauss(0, 1) for _ in range(64)]) for i in range(300)] + [(500 + i, one) for i in range(200)]
    made += [(None, one), (7, one), (1, None), (2, []), (3, [0.5] * 63), (4, [0.5] * 65), (5, [inf] + [0.0] * 63), (6, [float("nan")] * 64), (8, [None] + [0.0] * 63), (9, [-inf] * 64), (None, [-0.001] * 64)]
    schema = "vec_id long, embedding array<float>, label int, id long, v string, cluster int"
    odd = spark.createDataFrame([(i, v, 1, 2, "x", 3) for i, v in made], schema)
    few = odd.filter("vec_id between 20 and 29")
    for d in (odd, few, spark.read.parquet(f"{sf_dir}/embeddings.parquet")):
        rows = [(r["vec_id"], r["embedding"]) for r in d.collect()]
        got = centroids.cluster(d)
        assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
        assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_lloyd(rows)
    assert centroids.cluster(odd.filter("vec_id between 1 and 6 and label = 9")).isEmpty()
    with pytest.raises(Exception, match="beyond"):
        centroids.cluster(spark.createDataFrame([(1, [1e30] * 64)], "vec_id long, embedding array<float>")).count()


def test_blocks_hold_every_vector_once(spark):
    d = spark.range(700).select(F.col("id"), F.transform(F.sequence(F.lit(1), F.lit(4)), lambda k: F.pmod(F.xxhash64("id", k), F.lit(50)).cast("int")).alias("v"))
    made = centroids.blocks(d.coalesce(1), 64).collect()
    assert len(made) == 11 and sorted(i for r in made for i in r["ids"]) == list(range(700))
