import hashlib
import math
import re
import struct
import zlib
from collections import Counter
from fractions import Fraction

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from caseloom.llm import fingerprint, prefix_trie, queries, whitening

SF = "/root/testdata/sf0.001"


def brute_trie(rows):
    """Nodes by the definition, from (conv_id, turn, role, text)."""
    convs = {}
    for c, t, r, x in rows:
        if c is not None:
            convs.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    told = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in convs.items()}
    seqs = {}
    for c, own in told.items():
        h = zlib.crc32(str(c).encode()) % 4
        seqs[c] = tuple(told.get(c - int(math.fmod(c, 20)), [])[:h] + own[h:])
    members = {}
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members.setdefault(s[:d], []).append(c)
    out = []
    for node, held in members.items():
        inside = [m for m in members if m[: len(node)] == node]
        child = lambda n: [m for m in members if len(m) == len(n) + 1 and m[: len(n)] == n]
        saved = sum((len(members[m]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", m[-1][1])) for m in inside if m)
        ends = ",".join(str(c) for c in sorted(c for c in held if len(seqs[c]) == len(node)))
        out.append((min(held), len(node), min(members[node[:-1]]) if node else None, len(held), len(child(node)), sum(not child(m) for m in inside), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


TURNS = "conv_id long, turn long, role string, text string, node string, depth int"


def trie_of(spark, rows):
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], TURNS)
    got = prefix_trie.trie(*prefix_trie.rebuilt(prefix_trie.ordered_turns(df))).select(*prefix_trie.NODE)
    return sorted((tuple(r) for r in got.collect()), key=str)


def test_trie_against_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(c, t, "user" if t % 2 else None, [None, "", "a b", "c\td e", "f"][rng.integers(0, 5)]) for c in range(-3, 45) for t in range(rng.integers(0, 6))]
    rows += [(60, None, "user", "null turn"), (60, 0, "user", "x"), (60, 0, "user", "x"), (60, 0, "assistant", "x")]  # ties and a repeated row
    rows += [(None, 0, "user", "no id")]
    rows += [(c, t, "user", f"same {t}") for c in (100, 101, 102, 103, 104, 105, 119, 120) for t in range(9)]  # copies, the last of another base
    rows += [(140, t, "user", "a b c d") for t in range(30)] + [(141, t, "user", "a b c d") for t in range(31)]  # one is the other's prefix
    assert trie_of(spark, rows) == brute_trie(rows)


def test_trie_of_blocks_and_no_rows(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK", 4)
    rows = [(c, t, "user", f"{t} " * (t % 5)) for c in (20, 40, 60) for t in range(23)] + [(7, 0, "user", "dropped, and no base")]
    assert trie_of(spark, rows) == brute_trie(rows)
    assert trie_of(spark, []) == []


@pytest.mark.parametrize("name", ["op11_conversation_trie"])
def test_query_equals_sql(spark, name):
    got = queries.QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    want = con.sql(queries.ORACLE[name]).select(*cols).fetchall()
    assert sorted((tuple(r) for r in got.select(*cols).collect()), key=str) == sorted(want, key=str) and want


def xx(data, seed=42):
    v = xxhash.xxh64_intdigest(data, seed=seed)
    return v, v - (1 << 64) if v >= 1 << 63 else v


def brute_fingerprint(text, samples):
    """The definition with r, c and b, not the shortened form of the operator."""
    out = []
    terms = [(xx(w.encode())[1], n) for w, n in Counter(re.findall(r"[^\x20\x09-\x0D]+", text or "")).items()]
    for k in range(samples):
        best = None
        for term, s in terms:
            h = xx(struct.pack("<i", k), xx(struct.pack("<q", term))[0])[0]
            g = xx(struct.pack("<i", 1), h)[0]
            u1, u2 = ((h >> 32) + 0.5) * 2.0**-32, ((g >> 12) + 0.5) * 2.0**-52
            c = -math.log((((h >> 16) & 0xFFFF) + 0.5) * ((h & 0xFFFF) + 0.5) * 2.0**-32)
            r = -math.log(u1) - math.log(u2)
            b = -math.log(u2) / r
            t = math.floor(math.log(s) / r + b)
            a = c / (math.exp(r * (t - b)) * math.exp(r))
            if best is None or a < best[0]:
                best = (a, c * u1 * (u1 * u2) ** t, term, t)
        out.append(best)
    return out


def likeness(a, b):
    if not a[0] or not b[0]:
        return float(not a[0] and not b[0])
    return sum(x[2:] == y[2:] for x, y in zip(a, b, strict=True)) / len(a)


def brute_edits(rows, samples):
    signed = lambda v: v - (1 << 64) if v >= 1 << 63 else v
    rows = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), signed(xxhash.xxh64_intdigest(r[1].encode(), seed=42)), r[1]))
    out = []
    for i, (d, t) in enumerate(rows):
        follows = rows[(i + 1) % len(rows)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + follows[:half]
        a, b, c = (brute_fingerprint(x, samples) for x in (t, edited, follows))
        out.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest(), likeness(a, b), likeness(a, c)))
    return out


def test_fingerprints_against_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i * 7), " ".join(f"w{x}" for x in rng.zipf(1.6, n) % 50)) for i, n in enumerate(rng.integers(1, 60, 30))]
    rows += [(3, None), (4, ""), (5, " \n\t"), (6, "ünï 😀 cödé x"), (7, "é"), (8, "same words here"), (8, "same words here"), (8, "other"), (None, "no id"), (None, "no id too"), (9, "long " * 5000)]
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, range int, at string")
    got = fingerprint.compare_edits(df, 16, 3)
    assert got.columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    got = got.collect()
    key = lambda r: (str(r[0]), *r[1:])
    assert sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"], r["near_edited"], r["near_next"]) for r in got), key=key) == sorted(brute_edits(rows, 16), key=key)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r["fingerprint"])
    assert len(by[8]) == 3 and len(set(by[8])) == 2 and by[3] == by[4] == by[5] == [""] and len(by[9][0]) == 64
    one = fingerprint.compare_edits(df.where("doc_id = 6"), 16, 3).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0 and fingerprint.compare_edits(df.where("doc_id = -1"), 16, 3).count() == 0


def test_fingerprint_query_against_brute_force(spark):
    got = {r["doc_id"]: r for r in queries.QUERIES["op12_document_fingerprints"](spark, SF).collect()}
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = brute_edits(rows, fingerprint.SAMPLES)
    assert len(got) == len(want)
    for d, n, sha, edited, follows in want:
        r = got[d]
        assert (r["n_chars"], r["edited_sha256"], r["near_edited"], r["near_next"]) == (n, sha, edited, follows)
    prints = {}
    for d, t in rows:
        prints.setdefault(t, set()).add(got[d]["fingerprint"])
    assert all(len(p) == 1 for p in prints.values())


def test_collision_rate_is_generalised_jaccard(spark):
    """Samples drawn of weighted terms, not of texts: weights need not be integers."""
    rng = np.random.default_rng(9)
    weights = rng.gamma(1.0, 4.0, (2, 40)) * (rng.random((2, 40)) < 0.7)
    terms = spark.createDataFrame([(1, int(i) * 7919, float(a), float(b)) for i, (a, b) in enumerate(weights.T)], "id int, term long, n0 double, n1 double")
    r = fingerprint.weighted_samples(terms, ["id"], ["n0", "n1"], 96).select(fingerprint.likeness(F.col("n0"), F.col("n1"))).first()[0]
    want = np.minimum(*weights).sum() / np.maximum(*weights).sum()
    assert abs(r - want) < 4 * math.sqrt(want * (1 - want) / 96)


def exact_covariance(x):
    n, d = len(x), len(x[0])
    s = [sum(r[j] for r in x) for j in range(d)]
    y = [[n * r[j] - s[j] for j in range(d)] for r in x]
    return s, [[Fraction(sum(r[i] * r[j] for r in y), n**3) for j in range(d)] for i in range(d)]


def check_whitening(rows, got):
    """rows: (vec_id, vector or None); got: collected rows. Against exact rationals."""
    kept = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = [(i, tuple(math.floor(64 * c) + 1000000 for c in v)) for i, v in kept]
    fit = sorted({v for _, v in x})
    s, cov = exact_covariance(fit)
    n, d = len(fit), len(fit[0])
    e, vectors = np.linalg.eigh(np.array([[float(c) for c in r] for r in cov]))
    e, vectors = e[::-1], vectors[:, ::-1]
    k = min(16, int((e > e[0] * d * 2.0**-52).sum()))
    assert len(got) == len(x) * k
    want = {(i, v): sum((n * a - b) ** 2 for a, b in zip(v, s, strict=True)) for i, v in x}
    assert sorted(set(want.values())) == sorted({r["deviation"] for r in got})
    by = {}
    for r in got:
        by.setdefault((r["vec_id"], r["deviation"]), {}).setdefault(r["component"], r["whitened"])
        assert r["n"] == n and abs(r["explained"] / (e[r["component"] - 1] / float(sum(cov[j][j] for j in range(d)))) - 1) < 1e-4 and r["identity_error"] < 1e-4
    sign = {}
    for i, v in x:
        centred = np.array([float(Fraction(n * a - b, n)) for a, b in zip(v, s, strict=True)])
        for j in range(k):
            w, g = centred @ vectors[:, j] / math.sqrt(e[j]), by[(i, want[(i, v)])][j + 1]
            if abs(w) > 1e-6:
                sign.setdefault(j, math.copysign(1, w * g))
            assert abs(g - sign.get(j, 1) * w) < 1e-6


def test_whitening_against_exact_rationals(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(0, 1, (60, 5)) * [5, 3, 2, 1, 0.5]
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(base)]
    rows += [(100, rows[0][1]), (100, rows[0][1]), (101, rows[1][1])] + [(200 + i, rows[2][1]) for i in range(50)]  # repeated rows and copies of one vector
    rows += [(300, None), (301, [1.0, None, 0.0, 0.0, 0.0]), (302, [float("nan")] + [0.0] * 4), (303, [float("inf")] + [0.0] * 4), (None, rows[3][1])]
    schema = "vec_id long, embedding array<double>, n int, x string"
    df = spark.createDataFrame([(i, v, 1, "clash") for i, v in rows], schema)
    check_whitening(rows, whitening.whiten(df).collect())
    other = df.unionByName(spark.createDataFrame([(9999, [1.0, 2.0], 1, "x"), (9998, [], 1, "x")], schema))  # other dimensions take no part
    assert whitening.whiten(other).count() == whitening.whiten(df).count()
    assert whitening.whiten(df.where("vec_id = 100")).count() == 0 and whitening.whiten(df.where("vec_id = -1")).count() == 0


def test_whitening_query_against_exact_rationals(spark):
    rows = [(r["vec_id"], list(r["embedding"])) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    check_whitening(rows, queries.QUERIES["op13_embedding_whitening"](spark, SF).collect())


@pytest.mark.parametrize("size", [1, 40, 10**9, 10**17])
def test_limb_products_are_exact(size, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK", 64)
    rng = np.random.default_rng(4)
    y = rng.integers(-size, size + 1, (150, 6))
    for m in (y, y.astype(object) * 10**12):
        assert (whitening.gram(m) == m.astype(object).T @ m.astype(object)).all()
    assert all(np.abs(x).max(initial=0) <= 1 << (whitening.LIMB - 1) for x in whitening.limbs(y))
