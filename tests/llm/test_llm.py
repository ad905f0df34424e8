"""The language-model data operators against brute force, round trips and held-out accuracy, with nulls, empty and long texts, ties and clashing names."""

import os
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from mailloom.llm import bpe, fingerprint, langid, lm, multiindex, packing, secretscan, simhash, tokenfile, toxicity
from mailloom.llm import kernels as K
from mailloom.llm import queries as Q

DIR = "/root/testdata/sf0.001"
LONG = "lorem ipsum dolor sit amet " * 20000
ODD = [(1, None, "en", "a", None), (2, "", "en", "a", 0), (3, LONG, "en", "a", len(LONG)), (4, "same text here of some words", "en", "b", 28), (5, "same text here of some words", "en", "b", 28), (5, "same text here of some words", "en", "b", 28), (None, "no id at all", None, None, 12), (6, "!!! ... \n", "fr", "a", 9), (7, "żółć 字字 \U0001f600 é", "pl", "a", 11)]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Columns with the names that the operators use themselves.
CLASH = ["row", "key", "id", "vec", "hi", "lo", "node", "root", "group_id", "kept", "_id", "_text", "ids", "f", "s", "near", "block", "window", "w", "count", "f.g"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DIR}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    rows = spark.createDataFrame(ODD, SCHEMA)
    return rows.select("*", *(F.lit(1).alias(c) for c in CLASH))


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


def arrays(texts):
    return K.utf8(pa.array(texts, pa.string()))


# 1


M = 2**64


def brute_mix(x, seed=0):
    x = (x + 0x9E3779B97F4A7C15 * (seed + 1)) % M
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % M
    x = (x ^ x >> 27) * 0x94D049BB133111EB % M
    return x ^ x >> 31


def brute_sketch(text, width, bins, bits):
    """From the text, without the operator's kernels."""
    words = [brute_mix(sum((c + 1) * pow(0x5851F42D4C957F2D, k, M) for k, c in enumerate(w)) % M) for w in re.findall(rb"[0-9A-Za-z\x80-\xff]+", text.encode())]
    runs = [words[k : k + width] for k in range(max(1, len(words) - width + 1))] if words else []
    low = [None] * bins
    for run in runs:
        x = run[0]
        for h in run[1:]:
            x = (x * 0x9E3779B97F4A7C15 + h) % M
        x = brute_mix(x, 3)
        b = x >> (64 - bins.bit_length() + 1)
        rest = (x << (bins.bit_length() - 1)) % M
        low[b] = rest if low[b] is None else min(low[b], rest)
    if all(x is None for x in low):
        return None
    ask = lambda b, k: brute_mix(b * (1 << 20) + k, 11) >> (64 - bins.bit_length() + 1)
    full = [low[b] if low[b] is not None else next(low[a] for k in range(1, 10**6) if low[a := ask(b, k)] is not None) for b in range(bins)]
    cut = [brute_mix(x, 5) % 2**bits for x in full]
    words = [sum(v << (k * bits) for k, v in enumerate(cut[i : i + 64 // bits])) for i in range(0, bins, 64 // bits)]
    return [w - M if w >> 63 else w for w in words]


def test_fingerprints(spark, docs, odd, none):
    for r in fingerprint.fingerprints(odd).collect():
        text = next(t for i, t, *_ in ODD if i == r.doc_id)
        assert (r.fingerprint is None) == (text is None or not K.words(*arrays([text]))[0].size)
        assert (r.n_shingles is None) == (text is None)
    few = docs.where("doc_id < 12").collect()
    got = {r.doc_id: r.fingerprint for r in fingerprint.fingerprints(docs.where("doc_id < 12")).collect()}
    for r in few:
        assert got[r.doc_id] == brute_sketch(r.text.lower(), 3, 256, 4)
    assert fingerprint.fingerprints(none).count() == 0
    for wrong in ({"bins": 8, "bits": 4}, {"bins": 100}, {"bits": 3}, {"width": 0}):
        with pytest.raises(ValueError):
            fingerprint.fingerprint("text", **wrong)
    words = [f"w{k}" for k in range(4000)]
    a = " ".join(words[:2000])
    errors = []
    for cut in (200, 600, 1000, 1600):
        b = " ".join(words[cut : 2000 + cut])
        pair = spark.createDataFrame([(a, b)], "a string, b string").select(fingerprint.fingerprint(F.col("a")).fingerprint.alias("a"), fingerprint.fingerprint(F.col("b")).fingerprint.alias("b"))
        x, y = ({" ".join(t.split()[k : k + 3]) for k in range(1998)} for t in (a, b))
        errors.append(pair.select(fingerprint.similarity(F.col("a"), F.col("b"))).first()[0] - len(x & y) / len(x | y))
    assert max(map(abs, errors)) < 0.12


# 2


def brute_neighbours(v, ids, k):
    d = ((v[:, None].astype(float) - v[None]) ** 2).sum(-1)
    np.fill_diagonal(d, np.inf)
    return {ids[i]: [ids[j] for j in sorted(range(len(v)), key=lambda j: (round(d[i, j], 9), ids[j]))[:k]] for i in range(len(v))}


def test_neighbours(spark):
    rng = np.random.default_rng(1)
    v = np.concatenate([rng.standard_normal((300, 9)), np.repeat(rng.standard_normal((4, 9)), 25, 0)]).astype(np.float32)
    rows = [(k, x.tolist(), 0) for k, x in enumerate(v)] + [(900, None, 0), (901, [1.0, None] + [0.0] * 7, 0), (902, [float("nan")] * 9, 0), (903, [1.0], 0)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, row int").repartition(5)
    found = multiindex.neighbours(table, 5).toPandas()
    want = brute_neighbours(v, list(range(len(v))), 5)
    got = found.sort_values("rank").groupby("vec_id").neighbour.apply(list)
    assert set(got.index) == set(range(400)) and all(len(x) == 5 for x in got)
    assert np.mean([len(set(got[i]) & set(want[i])) / 5 for i in want]) >= 0.9
    for i in range(300, 400):
        assert got[i] == want[i]
    assert (found.vec_id != found.neighbour).all()
    assert multiindex.neighbours(table.limit(0)).count() == 0
    two = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [0.0, 1.0])], "vec_id bigint, embedding array<float>")
    assert sorted((r.vec_id or -1, r.rank, r.neighbour or -1) for r in multiindex.neighbours(two, 3).collect()) == [(-1, 1, 1), (-1, 2, 1), (1, 1, 1), (1, 1, 1), (1, 2, -1), (1, 2, -1)]


def test_traversal():
    rng = np.random.default_rng(2)
    a, b = rng.random(7), rng.random(5)
    got = list(multiindex.traverse(a, b))
    assert [s for s, _, _ in got] == sorted(x + y for x in a for y in b) and len({(i, j) for _, i, j in got}) == 35


def test_recall_on_the_table(spark):
    table = spark.read.parquet(f"{DIR}/embeddings.parquet")
    rows = table.toPandas()
    want = brute_neighbours(np.array(rows.embedding.tolist()), rows.vec_id.tolist(), 10)
    got = Q.op2_neighbours(spark, DIR).toPandas().groupby("vec_id").neighbour.apply(set)
    assert np.mean([len(got[i] & set(want[i])) / 10 for i in want]) >= 0.9


# 3


def test_toxicity(spark, odd, none):
    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet").join(labels, "doc_id", "left_semi")
    held = labels.where("doc_id % 3 = 0")
    said = {r.doc_id: r.toxic for r in toxicity.classify(docs, labels.where("doc_id % 3 <> 0")).collect()}
    truth = {r.doc_id: bool(r.toxic) for r in held.collect()}
    assert np.mean([said[i] for i, t in truth.items() if t]) > 0.8 and np.mean([said[i] for i, t in truth.items() if not t]) < 0.01
    marks = spark.createDataFrame([(3, 1), (4, 0), (None, 1), (5, None), (7, 9)], "doc_id bigint, toxic int")
    assert toxicity.reject_toxic(odd, marks).columns == odd.columns
    assert {r.doc_id: r.score for r in toxicity.classify(odd, marks).collect()}[1] is None
    assert toxicity.reject_toxic(odd, marks.limit(0)).count() == len(ODD)
    assert toxicity.classify(none, marks).count() == 0


def brute_toxicity(text, model):
    ids = set()
    padded = f" {text.lower()} "
    for n in toxicity.ORDERS:
        for k in range(len(padded) - n + 1):
            g = ord(padded[k]) + 1
            for c in padded[k + 1 : k + n]:
                g = (g * 0x100000001B3 + ord(c) + 1) % 2**64
            ids.add((g * 0x9E3779B97F4A7C15 + (n << 40)) % 2**64 >> 64 - toxicity.HASH_BITS)
    return 1 / (1 + np.exp(-(model.bias + sum(float(model.weights[i]) for i in ids))))


def test_toxicity_by_brute_force(spark, docs):
    labels = spark.read.parquet(f"{DIR}/labels.parquet")
    model = toxicity.train(docs, labels)
    assert (model.weights != 0).sum() > 50
    got = {r.doc_id: r.score for r in toxicity.classify(docs, labels).collect()}
    for r in docs.collect():
        assert np.isclose(got[r.doc_id], brute_toxicity(r.text, model), atol=1e-5)
    # The weights are ratios of counts over documents, moved towards 0, times factors that all begin alike.
    texts = ["aaa bbb"] * 20 + ["ccc ddd"] * 20
    fitted = toxicity.fit(pa.array(texts), np.array([1] * 20 + [0] * 20))
    assert brute_toxicity("aaa bbb", fitted) > 0.9 and brute_toxicity("ccc ddd", fitted) < 0.1 and abs(brute_toxicity("xyz", fitted) - 0.5) < 0.2
    # Repeated ids bring one text each.
    many = docs.unionByName(docs).unionByName(docs.withColumn("text", F.concat(F.lit("\U0010ffff"), "text")))
    assert np.array_equal(toxicity.train(many, labels).weights, model.weights)


# 4


def test_language(spark, docs, odd, none):
    found = langid.classify(docs).toPandas().set_index("doc_id")
    lang = docs.toPandas().set_index("doc_id").lang
    assert (found.detected == lang).mean() > 0.98 and found.accepted.mean() > 0.97
    import duckdb

    want = duckdb.sql(langid.SQL.format(docs=f"'{DIR}/documents.parquet'")).df().set_index("doc_id")
    assert (want.distance.sort_index() == found.distance.sort_index()).all()
    kept = langid.reject_unknown(odd)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} >= {3, 4, 5} and 1 not in {r.doc_id for r in kept.collect()}
    assert langid.classify(none).count() == 0 and langid.reject_unknown(none).count() == 0
    junk = [(9001, "zzqxj wqzx " * 40), (9002, "これは日本語の文章です。" * 20), (9003, "12345 67890 " * 30), (9004, "".join(chr(0x10A0 + (7 * k) % 40) + (" " if k % 6 == 0 else "") for k in range(600)))]
    planted = docs.unionByName(spark.createDataFrame([(i, t, "en", "planted", len(t)) for i, t in junk], docs.schema))
    assert {i for i, _ in junk} & {r.doc_id for r in langid.reject_unknown(planted).collect()} == set()


# 5


def test_near_duplicates(spark, docs, odd, none):
    rng = np.random.default_rng(3)
    words = [f"word{k}" for k in range(5000)]
    texts = []
    for g in range(30):
        base = rng.choice(words, 300)
        for c in range(4):
            copy = base.copy()
            copy[rng.integers(0, 300, 3 * c)] = "changed"
            texts.append((4 * g + c, " ".join(copy)))
    texts += [(200 + k, "many copies of one text") for k in range(600)]
    table = spark.createDataFrame(texts, "doc_id bigint, text string")
    got = {r.doc_id: r.group_id for r in simhash.groups(table).collect()}
    assert all(got[4 * g + c] == 4 * g for g in range(30) for c in range(4)) and all(got[200 + k] == 200 for k in range(600))
    sig = {r.doc_id: (np.uint64(r.s.hi & 2**64 - 1), np.uint64(r.s.lo & 2**64 - 1)) for r in docs.select("doc_id", simhash.signature(F.col("text")).alias("s")).collect()}
    near = {r.doc_id: r.group_id for r in simhash.groups(docs).collect()}
    ids = sorted(sig)
    pairs = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if sum(int(x ^ y).bit_count() for x, y in zip(sig[a], sig[b])) <= simhash.MAX_DISTANCE]
    assert pairs and np.mean([near[a] == near[b] for a, b in pairs]) >= 0.95
    linked = {x for p in pairs for x in p}
    assert all(near[i] == i for i in ids if i not in linked)
    left = simhash.drop_near_duplicates(odd)
    assert left.columns == odd.columns and sorted(r.doc_id or 0 for r in left.collect()) == [0, 1, 2, 3, 4, 6, 7]
    assert simhash.groups(none).count() == 0 and simhash.drop_near_duplicates(none).count() == 0
    again = spark.createDataFrame([(1, f"quite another text of number {k} and nothing else", k) for k in range(40)] + [(None, "x", 0)] * 2, "doc_id bigint, text string, extra int")
    left = [tuple(simhash.drop_near_duplicates(again.repartition(n)).orderBy("doc_id").collect()) for n in (1, 7)]
    assert left[0] == left[1] and len(left[0]) == 3


def test_oversized_buckets():
    rng = np.random.default_rng(4)
    sig = rng.integers(0, 2**63, (1000, 2)).astype(np.uint64)
    sig[:, 0] &= np.uint64(0xFFFF)
    sig[500:] = sig[:500] ^ np.uint64(1)
    a, b = simhash.bucket_pairs(sig, np.zeros(1000, np.int64), 0, cap=64)
    assert len({(min(x, y), max(x, y)) for x, y in zip(a, b)} & {(k, k + 500) for k in range(500)}) >= 450


def test_skewed_bucket():
    rng = np.random.default_rng(9)
    n, bits = 12000, rng.integers(0, 2, simhash.BITS).astype(np.uint8)
    free = simhash.coordinates(0)[simhash.SAMPLE :]
    rows = np.tile(bits, (n, 1))
    rows[:, free] ^= rng.random((n, len(free))) < np.where(np.arange(n) < n // 2, 0.2, 0.5)[:, None]
    copies = rows[::10].copy()
    for k in range(len(copies)):
        copies[k, rng.choice(free, 16 + k % 5, replace=False)] ^= 1
    both = np.concatenate([rows, copies])
    sig = np.packbits(both, axis=1, bitorder="little").view(np.uint64)
    a, b = simhash.bucket_pairs(sig, np.zeros(len(sig), np.int64), 0)
    least = np.arange(len(sig))
    member, root = simhash.local_links(np.arange(len(sig)), a, b)
    least[member] = root
    for d in range(5):
        at = np.arange(d, len(copies), 5)
        assert np.mean(least[n + at] == least[10 * at]) >= 0.92
    # Rows near none stay alone.
    far = rng.integers(0, 2**63, (600, 2)).astype(np.uint64)
    assert all(simhash.distance(far[x], far[y]) <= simhash.MAX_DISTANCE for x, y in zip(*simhash.bucket_pairs(far, np.zeros(600, np.int64), 0)))


def test_buckets_beyond_a_task(spark):
    rng = np.random.default_rng(21)
    bits = np.tile(rng.integers(0, 2, simhash.BITS).astype(np.uint8), (900, 1))
    bits ^= (rng.random((900, simhash.BITS)) < 0.12).astype(np.uint8)
    pairs = bits[:200].copy()
    for k in range(200):
        pairs[k, rng.choice(simhash.BITS, 1 + k % 20, replace=False)] ^= 1
    sig = np.packbits(np.concatenate([bits, pairs]), axis=1, bitorder="little").view(np.int64)
    reps = spark.createDataFrame([(k, int(h), int(w)) for k, (h, w) in enumerate(sig.tolist())], "id bigint, hi bigint, lo bigint").repartition(3)
    near = {(a, b) for a in range(len(sig)) for b in np.flatnonzero(simhash.distance(sig.view(np.uint64)[a + 1 :], sig.view(np.uint64)[a]) <= simhash.MAX_DISTANCE) + a + 1}
    for cap in (1 << 22, 40):
        least = np.arange(len(sig))
        links = simhash.links(reps, cap=cap).collect()
        member, root = simhash.local_links(np.arange(len(sig)), np.array([r.src for r in links]), np.array([r.dst for r in links]))
        least[member] = root
        assert len(near) > 200 and np.mean([least[a] == least[b] for a, b in near]) >= 0.95
    rows = reps.select("id", "hi", "lo", F.lit(0).alias("t"), F.lit("").alias("w"), F.lit(0).cast("bigint").alias("b"))
    left = simhash.spread(rows, simhash.SAMPLE, 200, simhash.MAX_DISTANCE)
    assert left.groupBy("b").count().agg(F.max("count")).first()[0] <= 200 and left.select("id").distinct().count() == len(sig)


# 6


def test_token_files(spark, docs, odd, none):
    index = tokenfile.token_files(docs)
    back = {r.doc_id: list(r.ids) for r in tokenfile.read_tokens(index).collect()}
    encode = tokenfile.encoder()
    assert back == {r.doc_id: encode(r.text) for r in docs.collect()}
    some = index.where("doc_id = 7")
    assert tokenfile.read_tokens(some).count() == 1
    shard = index.first().shard
    raw = open(shard.removeprefix("file:").replace("//", "/"), "rb").read()
    assert len(zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True).read()) > 0
    rows = {(r.doc_id, r.frame): r.n_tokens for r in tokenfile.token_files(odd).collect()}
    assert len(rows) == len(ODD) and rows[1, None] is None and {v for (i, _), v in rows.items() if i == 2} == {0}
    assert tokenfile.token_files(none).count() == 0
    path = shard.removeprefix("file:").replace("//", "/")
    # What failed attempts left is removed; here such a shard lies in the folder before.
    folder = path.rpartition("/")[0] + "-more"
    os.makedirs(folder)
    open(f"{folder}/shard-lost.zst", "wb").close()
    assert tokenfile.write_tokens(docs, f"file://{folder}").count() == docs.count() and not os.path.exists(f"{folder}/shard-lost.zst")
    broken = bytearray(raw)
    broken[6] ^= 255
    open(path + ".broken", "wb").write(broken)
    with pytest.raises((ValueError, zstandard.ZstdError)):
        [x for k in range(3) for x in tokenfile.Reader(f"file://{path}.broken")[k]]


# 7


def test_byte_bpe(docs, odd, none):
    encode = tokenfile.encoder()
    got = {r.doc_id: r for r in bpe.encode_documents(docs).collect()}
    assert all(list(got[r.doc_id].ids) == encode(r.text) and got[r.doc_id].exact for r in docs.collect())
    rows = bpe.encode_documents(odd).collect()
    assert len(rows) == len(ODD)
    for r in rows:
        text = next(t for i, t, *_ in ODD if i == r.doc_id)
        assert (r.ids is None and r.exact is None) if text is None else (list(r.ids) == encode(text) and r.exact)
    assert bpe.encode_documents(none).count() == 0


def test_byte_bpe_of_rare_and_long_words(spark, docs):
    encode = tokenfile.encoder()
    # Nearly all words are beyond the head and come by the join.
    got = {r.doc_id: r for r in bpe.encode_documents(docs, most=300).collect()}
    assert all(list(got[r.doc_id].ids) == encode(r.text) and got[r.doc_id].exact for r in docs.collect())
    rng = np.random.default_rng(0)
    draw = lambda letters, n: "".join(rng.choice(list(letters), n))
    texts = ["a" * n for n in (64, 65, 257, 1000)] + [" " * 300 + "x", "ab" * 500, "-" * 777, "aba" * 200, "字" * 300, "的是不我在有" * 150, draw("abcdefghijklmnopqrstuvwxyz", 1 << 20), draw("acgt", 3000), draw("0123456789", 3000), draw("aei", 2000)]
    found = {r.doc_id: r for r in bpe.encode_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), most=3).collect()}
    assert all(list(found[k].ids) == encode(t) and found[k].exact for k, t in enumerate(texts))


# 8


CODE = """
API_KEY = "q7Zp92LmXc81VbTq"
name: str = "short"
part = "Zk39fjw0"
password = part + "LLq81mzpw"
db.password = ${password}
config['auth_token'] = 'a8f7d6e5c4b3a291'
max_tokens = "1234567890abcdef"
password = "changeme"
<token>9f8e7d6c5b4a39281706</token>
{"client_secret": "GHq8-29ax-P0dk-mm31"}
export AWS_SECRET_ACCESS_KEY=wJalrXUtnFEMIK7MDENGbPxRfiCY
token = get_token()
"""


#: Texts and the literals that are to be found.
SYNTAX = [
    ('password = "correct horse battery staple"', ["correct horse battery staple"]),
    ('{"%s_password": "Zk39fjw0Zk39"}' % ("x" * 90), ["Zk39fjw0Zk39"]),
    ('api_key = "wJalrXUtnFEMIexampleKEY99"', ["wJalrXUtnFEMIexampleKEY99"]),
    ('def f():\n    x="Zk39fjw0qq"\ndef g():\n    x=None\n    password=x\n', []),
    ('def f():\n    x="Zk39fjw0qq"\n    password=x\n', ["Zk39fjw0qq"]),
    ('x = "Zk39fjw0qq"\nx = f()\npassword = x', []),
    ('function f(){ var k="Zk39fjw0qq"; } secret = k;', []),
    ('if (a) { k="Zk39fjw0qq"; } secret = k;', ["Zk39fjw0qq"]),
    ('password = getenv("X") or "Zk39fjw0qq"', ["Zk39fjw0qq"]),
    ('password = os.environ.get("PASSWORD", "Zk39fjw0qq")', ["Zk39fjw0qq"]),
    ('secret = c ? "Zk39fjw0qq" : "Qq39fjw0zz"', ["Zk39fjw0qq", "Qq39fjw0zz"]),
    ('secret = "Zk39fjw0qq" if c else "Qq39fjw0zz"', ["Zk39fjw0qq", "Qq39fjw0zz"]),
    ("DB_PASSWORD=SuperSecretPassphrase\n", ["SuperSecretPassphrase"]),
    ("db:\n  password: SuperSecretPassphrase\n", ["SuperSecretPassphrase"]),
    ("Authorization: Bearer eyJhbGciOi.J9x.Zz\n", ["eyJhbGciOi.J9x.Zz"]),
    ('// password = "Zk39fjw0qq"\n', ["Zk39fjw0qq"]),
    ("don't use password = 'Zk39fjw0qq' ok", ["Zk39fjw0qq"]),
    ('password: "Password must be at least 8 characters"', []),
    ('password = input("Password: ")', []),
    ('<add key="ApiKey" value="Zk39fjw0qq11"/>', ["Zk39fjw0qq11"]),
    ('$password = "Zk39aa" . "fjw0qq";', ["Zk39aa", "fjw0qq"]),
    ("The key: value pairs, a token: it is prose. Password = nothing", []),
]


def test_long_and_nested_sources():
    for text in ('x = "a1b2c3d4e5";\n' * 20000, "`" + '"' * 100001 + "\'\'\'" * 3000 + '("' * 5000 + "{" * 30000 + ")" * 3000, "(a{" * 20000, "password = " * 20000, "password = (" * 20000):
        whole = text + "\npassword=a1b2c3d4e5"
        assert [whole[a : a + c] for _, _, a, c, _ in secretscan.findings(whole)][-1:] in ([], ["a1b2c3d4e5"])


def test_generated_assignments():
    """A generator that knows what it writes stands for a brute-force version: each sensitive name's literal is found, no other."""
    rng = np.random.default_rng(13)
    letters = list("abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789")
    forms = ['{n} = "{v}"', "{n} := '{v}'", '"{n}": "{v}",', "export {n}={v}", "<{n}>{v}</{n}>", "{n}: {v}", "x['{n}'] = \"{v}\"", "const {n} = `{v}`;", 'c{k} = "{v}"\n{n} = c{k}', 'c{k} = "{v}"\nc{k} = g()\n{n} = c{k}']
    for _ in range(60):
        lines, want = [], []
        for k in range(int(rng.integers(1, 12))):
            value, form = "".join(rng.choice(letters, 16)) + "7", int(rng.integers(0, len(forms)))
            secret = rng.random() < 0.5
            name = str(rng.choice(["password", "api_key", "AUTH_TOKEN", "client_secret", "dbPasswd"] if secret else ["colour", "max_tokens", "user_name", "password_hint", "monkey_island"]))
            lines.append(forms[form].format(n=name, v=value, k=k))
            if secret and form != len(forms) - 1:
                want.append(value)
        text = "\n".join(lines)
        assert sorted(text[a : a + c] for _, _, a, c, _ in secretscan.findings(text)) == sorted(want), text


def test_secrets(spark, odd, none):
    found = [(n, CODE[a : a + c]) for n, _, a, c, _ in secretscan.findings(CODE)]
    literals = {x for _, x in found}
    assert {"q7Zp92LmXc81VbTq", "Zk39fjw0", "LLq81mzpw", "a8f7d6e5c4b3a291", "9f8e7d6c5b4a39281706", "GHq8-29ax-P0dk-mm31", "wJalrXUtnFEMIK7MDENGbPxRfiCY"} <= literals
    assert not {"changeme", "1234567890abcdef", "short", "get_token()"} & literals
    for text, want in SYNTAX:
        assert [text[a : a + c] for _, _, a, c, _ in secretscan.findings(text)] == want, text
    rows = spark.createDataFrame([(1, CODE, 5), (1, CODE, 5), (2, None, None), (3, "", 0), (4, "plain prose: nothing here", 25)], "doc_id bigint, text string, n_chars int")
    assert secretscan.secrets(rows).count() == 2 * len(found)
    after = {r.doc_id: r for r in secretscan.redact(rows).collect()}
    assert not any(x in after[1].text for x in literals) and after[1].n_chars == len(after[1].text)
    assert after[2].text is None and after[3].text == "" and after[4].text == "plain prose: nothing here" and after[4].n_chars == 25
    assert secretscan.redact(odd).columns == odd.columns and secretscan.redact(odd).count() == len(ODD)
    assert secretscan.secrets(none).count() == 0 and secretscan.redact(none).count() == 0


def test_secrets_in_the_table(docs):
    text = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id for r in secretscan.secrets(docs).collect()}
    assert {i for i, t in text.items() if " = " in t and "token" in t} == got


# 9


def brute_paths(links):
    free, path, out = {}, {}, []
    degree = Counter(x for _, u, v in links for x in (u, v))
    for _, _, u, v in sorted((min(degree[u], degree[v]), d, u, v) for d, u, v in links):
        a, b = path.get(u, {u}), path.get(v, {v})
        if free.get(u, 2) and free.get(v, 2) and not a & b:
            out.append((u, v))
            free[u], free[v] = free.get(u, 2) - 1, free.get(v, 2) - 1
            path |= dict.fromkeys(a | b, a | b)
    return out, path


def test_links_across_blocks(spark):
    rng = np.random.default_rng(8)
    n = 300
    links = {(int(u), int(v)): float(rng.integers(0, 50)) for u, v in np.sort(rng.integers(0, n, (900, 2)), axis=1) if u != v}
    links = [(d, u, v) for (u, v), d in links.items()]
    want, path = brute_paths(links)
    graph = spark.createDataFrame(links, "d double, u bigint, v bigint").repartition(4)
    nodes = spark.createDataFrame([(k, k % 7, k % 3) for k in range(n)], "key bigint, cell int, group int")
    steps = []
    for settled, long in ((10**6, 10**6), (40, 3)):
        got = packing.paths(graph, nodes, settled, long).toPandas().sort_values(["block", "cell", "path", "step"])
        steps.append(got.set_index("key").step.to_dict())
        assert sorted(got.key) == list(range(n)) and all(min(path.get(k, {k})) == p for k, p in zip(got.key, got.path))
        beside = {tuple(sorted((a, b))) for a, b, p, q in zip(got.key, got.key[1:], got.path, got.path[1:]) if p == q}
        assert beside == set(want) and any(u % 3 != v % 3 for u, v in want)
    assert steps[0] == steps[1] and max(steps[0].values()) > 3


def test_packing(docs, odd, none):
    for table, window in ((docs, 8192), (odd, 100), (odd, 8192)):
        text = table.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("n")).toPandas()
        got = packing.pack(table, window=window).toPandas()
        size = got.end - got.begin
        assert size.sum() == text.n.sum() and (size >= 0).all()
        assert set(got.doc_id.fillna(-1)) == set(text.doc_id.fillna(-1))
        full = got.assign(size=size).sort_values(["block", "part", "window", "position"])
        for _, block in full.groupby(["block", "part"]):
            sums = block.groupby("window")["size"].sum()
            assert (sums.iloc[:-1] == window).all() and (block.position + block["size"] <= window).all()
        for (_, _, i), g in got.assign(size=size).groupby(["block", "part", got.doc_id.fillna(-1)]):
            if list(text.doc_id.fillna(-1)).count(i) == 1:
                g = g.sort_values("begin")
                assert g.begin.iloc[0] == 0 and (g.begin.iloc[1:].values == g.end.iloc[:-1].values).all()
    assert packing.pack(none).count() == 0


def test_large_blocks_have_parts(spark, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK", 50)
    rows = [(k, "the same words in each") for k in range(120)] + [(k, f"text number {k} of many {k % 9}") for k in range(200, 300)] + [(k, "!!!") for k in range(400, 520)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id bigint, text string"), window=64).toPandas()
    assert set(got.doc_id) == {k for k, _ in rows} and (got.end - got.begin).sum() == sum(len(t) for _, t in rows)
    assert got[got.block == -1].part.nunique() == 3 and got.groupby(["block", "part"]).doc_id.nunique().max() < 120


def test_related_lie_together(spark):
    rng = np.random.default_rng(6)
    topics = [[f"t{t}x{k}" for k in range(80)] for t in range(5)]
    rows = [(k, " ".join(rng.choice(topics[k % 5], 60))) for k in range(100)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id bigint, text string")).toPandas().sort_values(["block", "window", "position"]).drop_duplicates("doc_id")
    order = (got.doc_id % 5).tolist()
    assert np.mean([a == b for a, b in zip(order, order[1:])]) > 0.8


# 10


def test_subwords():
    texts = ["", "plain words  and\n\tblanks!", "żółć 字字 \U0001f600 don't 12345", LONG[:5000], "x"]
    encode, decode = lm.Subwords(), lm.encoding().decode
    for _ in range(2):
        ids, off = encode(*arrays(texts))
        assert [decode(ids[off[k] : off[k + 1]].tolist()) for k in range(len(texts))] == texts


def brute_log_prob(ids, model):
    """Each id by a window of its own: the block of STEP places that it lies in and the block before."""
    p, start, total = model.p, len(model.kind), 0.0
    given = [start, *ids[:-1]]
    for t, want in enumerate(ids):
        block = t // lm.STEP
        lo = max(0, (block - 1) * lm.STEP)
        x = p["ids"][given[lo : t + 1]].astype(float)
        q, k, v = np.split(x @ p["wqkv"], 3, axis=1)
        where = np.arange(lo, t + 1) - (block - 1) * lm.STEP
        a = k @ q[-1] + p["place"][t % lm.STEP, where]
        a = np.exp(a - a.max())
        y = x[-1] + (a / a.sum()) @ v @ p["wo"]
        z = np.maximum(y @ p["w1"] + p["b1"], 0) @ p["wc"] + p["bc"]
        total += z[model.kind[want]] - np.log(np.exp(z).sum()) + model.within[want]
    return total


def test_model():
    rng = np.random.default_rng(7)
    texts = [rng.integers(0, 50, n) for n in (0, 1, 15, 16, 17, 32, 33, 100)]
    ids, off = np.concatenate(texts), np.r_[0, np.cumsum([len(t) for t in texts])]
    model = lm.fresh(np.bincount(ids, minlength=60))
    model.p["place"] = rng.standard_normal(model.p["place"].shape).astype(np.float32)
    assert np.allclose(lm.log_probs(ids, off, model, at_once=3), [brute_log_prob(t.tolist(), model) for t in texts], atol=1e-3)
    share = np.exp(model.within)
    assert np.allclose(np.bincount(model.kind, share, lm.CLASSES)[np.unique(model.kind)], 1)
    inputs, goal, _, first = lm.blocks(ids, off, 60)
    p = {k: v.astype(np.float64) for k, v in model.p.items()}
    want = np.where(goal.ravel() >= 0, model.kind[goal.ravel()], -1)

    def loss():
        z = lm.forward(p, inputs, first)[0].astype(float)
        live = want >= 0
        return -(z[live, want[live]] - np.log(np.exp(z[live]).sum(1))).mean()

    g = lm.backward(p, want, lm.forward(p, inputs, first))
    for name in lm._DENSE:
        at = np.unravel_index(np.abs(g[name]).argmax(), g[name].shape)
        old = p[name][at]
        p[name][at] = old + 1e-3
        up = loss()
        p[name][at] = old - 1e-3
        down = loss()
        p[name][at] = old
        assert np.isclose((up - down) / 2e-3, g[name][at], rtol=5e-2, atol=1e-5)


def test_training_makes_few_arrays():
    rng = np.random.default_rng(13)
    model = lm.fresh(np.ones(500))
    inputs, goal, _, first = lm.blocks(rng.integers(0, 500, 128 * lm.STEP), np.array([0, 128 * lm.STEP]), 500)
    want = np.where(goal.ravel() >= 0, model.kind[goal.ravel()], -1)
    kept = lm.forward(model.p, inputs, first)
    tracemalloc.start()
    lm.backward(model.p, want, kept)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2 * kept[0].nbytes


def test_logits_are_bounded():
    model = lm.fresh(np.ones(50))
    inputs, _, _, first = lm.blocks(np.arange(40), np.array([0, 40]), 50)
    model.p["bc"] = np.full_like(model.p["bc"], 1000)
    assert (lm.forward(model.p, inputs, first)[0] == 60).all()


def test_scores(spark, docs, odd, none):
    scored = lm.score(docs).toPandas()
    assert sorted(scored.doc_id) == sorted(r.doc_id for r in docs.select("doc_id").collect())
    tokens = lm.token_table(docs)
    counts = lm.id_counts(tokens, 50256)
    assert scored.n_tokens.sum() == counts.sum()
    plain = -(counts[counts > 0] * np.log(counts[counts > 0] / counts.sum())).sum()
    assert -scored.log_prob.sum() < plain
    rows = {r.doc_id: r for r in lm.score(odd).collect()}
    assert rows[1].n_tokens is None and rows[1].log_prob is None and rows[2].log_prob == 0 and rows[2].perplexity is None and rows[3].perplexity > 1
    assert lm.score(odd).count() == len(ODD) and lm.score(none).count() == 0


def brute_memory(texts, model, memory):
    """Each full block's own product of probabilities, mixed with its share of all other full blocks."""
    blocks = [[tuple(t[k : k + lm.STEP]) for k in range(0, len(t) - lm.STEP + 1, lm.STEP)] for t in texts]
    every = [b for bs in blocks for b in bs]
    out = []
    for t, bs in zip(texts, blocks):
        total = 0.0
        for k in range(0, len(t), lm.STEP):
            p = brute_log_prob(t[: k + lm.STEP], model) - brute_log_prob(t[:k], model)
            if k // lm.STEP < len(bs):
                share = (every.count(bs[k // lm.STEP]) - 1) / max(1, len(every) - 1)
                p = np.logaddexp(np.log1p(-memory) + p, np.log(memory * share)) if share else np.log1p(-memory) + p
            total += p
        out.append(total)
    return out


def test_memory_of_blocks(spark):
    rng = np.random.default_rng(11)
    a, b = rng.integers(0, 40, 40).tolist(), rng.integers(0, 40, 50).tolist()
    texts = [a, b, a, a[:20], b[:32] + [1, 2, 3], [], [7] * 16]
    rows = [(k, k, np.array(t, "<u2").tobytes()) for k, t in enumerate(texts)] + [(90, 90, None)]
    tokens = spark.createDataFrame(rows, "row bigint, doc_id bigint, ids binary").repartition(3)
    model = lm.fresh(np.bincount(np.concatenate(texts).astype(int), minlength=50))
    got = {r.doc_id: r for r in lm.score_tokens(tokens, model, 0.05).collect()}
    assert np.allclose([got[k].log_prob for k in range(len(texts))], brute_memory(texts, model, 0.05), atol=1e-3) and got[90].log_prob is None
    assert got[0].log_prob > got[1].log_prob and got[5].log_prob == 0


def test_every_text_trains_once(spark):
    rng = np.random.default_rng(12)
    texts = [rng.integers(0, 200, int(n)).astype("<u2").tobytes() for n in rng.integers(0, 900, 300)]
    rows = [(k, k, x) for k, x in enumerate([*texts, *texts[:50], *texts[:1] * 40, None])]
    tokens = spark.createDataFrame(rows, "row bigint, doc_id bigint, ids binary")
    for parts in (1, 5):
        seen = {}
        for shard, batches in lm.distinct_texts(tokens.repartition(parts), 7).toPandas().groupby("shard"):
            for r in batches.itertuples():
                seen.setdefault((r.one, r.two), [shard, None, 0])
                seen[r.one, r.two][1] = r.ids or seen[r.one, r.two][1]
                seen[r.one, r.two][2] += r.n
                assert seen[r.one, r.two][0] == shard
        counts = {t: 0 for t in texts if t}
        for _, _, t in rows:
            if t:
                counts[t] += 1
        assert {bytes(x[1]): x[2] for x in seen.values()} == counts


def test_partitions_do_not_matter(spark, docs):
    tokens = lm.token_table(docs)
    few = [lm.train(tokens.repartition(n), 50256, shard=1 << 15) for n in (1, 8)]
    assert all(np.allclose(few[0].p[k], few[1].p[k], atol=1e-6) for k in few[0].p)
    start = lm.fresh(lm.id_counts(tokens, 50256))
    ids = np.concatenate([np.frombuffer(r.ids, "<u2")[:-1] for r in tokens.collect()])
    # Every id that is an input has trained.
    assert (few[0].p["ids"] != start.p["ids"]).any(1)[np.unique(ids)].all()
    scores = [{r.doc_id: r.log_prob for r in lm.score(docs.repartition(n)).collect()} for n in (1, 8)]
    assert all(abs(scores[0][i] - scores[1][i]) <= 1e-6 * abs(scores[0][i]) for i in scores[0])


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, kept, DIR)
        assert now.columns == docs.columns, name
        kept = spark.createDataFrame(now.collect(), docs.schema)
    bad = {r.doc_id for r in toxicity.classify(docs, spark.read.parquet(f"{DIR}/labels.parquet")).where("toxic").collect()}
    left = docs.where(~F.col("doc_id").isin(list(bad)))
    langs = {r.doc_id for r in langid.classify(left).where("accepted").collect()}
    groups = simhash.groups(left.where(F.col("doc_id").isin(list(langs))))
    want = {r.doc_id for r in groups.where("kept").collect()}
    assert {r.doc_id for r in kept.collect()} == want
    pieces = corpus_pipeline.run(spark, DIR).toPandas()
    assert set(pieces.doc_id) == want
    # The last two stages by brute force: literals replaced, then all characters in windows.
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in kept.collect():
        whole, at, parts = text[r.doc_id], 0, []
        for _, _, start, length, _ in secretscan.findings(whole):
            if start >= at:
                parts += [whole[at:start], "[SECRET]"]
                at = start + length
        assert r.text == "".join([*parts, whole[at:]]) and (r.n_chars == len(r.text) or r.text == whole)
    assert (pieces.end - pieces.begin).sum() == sum(len(r.text) for r in kept.collect())


def test_pipeline_of_odd_rows(spark, odd, none, tmp_path):
    import corpus_pipeline

    marks = spark.createDataFrame([(3, 0, 1), (4, 1, 0), (None, 1, 1), (5, 0, None)], "doc_id bigint, quality int, toxic int")
    for name, table in (("odd", odd), ("none", none)):
        folder = f"{tmp_path}/{name}"
        table.drop("f.g").write.parquet(f"{folder}/documents.parquet")
        marks.write.parquet(f"{folder}/labels.parquet")
        found = corpus_pipeline.run(spark, folder)
        assert ({r.doc_id for r in found.collect()} <= {i for i, *_ in ODD}) and (found.count() > 0) == (name == "odd")
