"""Licence scan, whitening and prefix trie against brute force."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from tracelens.llm import license_scan as L
from tracelens.llm import prefix_trie as P
from tracelens.llm import whitening as W
from tracelens.llm.common import table
from tracelens.llm.queries import QUERIES


def brute_scan(rows):
    texts = [re.sub("[A-Z]", lambda m: m[0].lower(), t or "") for _, t in rows]
    words = [[w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", t) if w] for t in texts]
    frequency = collections.Counter(w for ws in words for w in set(ws))
    rank = {w: k for k, w in enumerate(sorted(L.vocabulary(), key=lambda w: (frequency[w], w)))}
    out = []
    for (doc, _), ws in zip(rows, words, strict=True):
        base = [(i, label) for phrase, label in L.BASE for i in range(len(ws)) if ws[i : i + len(phrase.split())] == phrase.split()]
        labels, best = {x for _, x in base}, 0.0
        for label, text, phrases in L.TEMPLATES:
            own = text.split()
            present = set(own) & set(ws)
            if sum(w in present for w in own) * 10 < len(own) * L.LEAST_TENTHS:
                continue
            top = sorted(present, key=rank.get)[: L.LOOKED_UP]
            votes = collections.Counter(i - p for i, w in enumerate(ws) if w in top for p, x in enumerate(own) if x == w)
            for at in (a for a, n in votes.items() if n >= L.NEEDED):
                share = sum(0 <= at + p < len(ws) and ws[at + p] == x for p, x in enumerate(own)) / len(own)
                best = max(best, share)
                starts = [at + text.split(f"{p}")[0].count(" ") for p in phrases]
                if share * 10 >= L.LEAST_TENTHS and all(s >= 0 and ws[s : s + len(p.split())] == p.split() for s, p in zip(starts, phrases, strict=True)):
                    labels.add(label)
        places = [i for i, _ in base]
        out.append((doc, len(ws), len(base), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in base})), ",".join(sorted(labels)), 1.0 if base else best))
    return sorted(out, key=repr)


def licence_rows(seed):
    rng = random.Random(seed)
    filler = lambda n: " ".join(rng.choice(["the", "of", "and", "software", "license", "wozu", "x9", "this", "public", "é"]) for _ in range(n))
    rows = [(1, None), (2, ""), (3, "... -- \n"), (4, "MIT License, mit-license; APACHE\nLICENSE"), (5, "submit license mit licensed"), (None, "General Public License"), (7, filler(30_000) + " " + L.TEMPLATES[0][1])]
    for k, (_, text, _) in enumerate(L.TEMPLATES):
        own = text.split()
        rows += [(100 + k, f"{filler(20)} {text.upper()}. {filler(9)}"), (200 + k, text), (200 + k, text), (300 + k, " ".join(own[: len(own) // 2])), (400 + k, f"{text}\n" * 60)]
        worn = [w if rng.random() < 0.85 else "zz" for w in own]
        rows += [(500 + k, " ".join(worn)), (600 + k, " ".join([*own[: len(own) // 2], "indeed", *own[len(own) // 2 :]]))]
    return rows + [(1000 + k, filler(rng.randrange(200))) for k in range(60)]


@pytest.mark.parametrize("seed", [1, 2])
def test_licence_scan_against_brute_force(spark, seed):
    rows = licence_rows(seed)
    docs = spark.createDataFrame([(d, t, "x", 1.0) for d, t in rows], "doc_id LONG, text STRING, labels STRING, r DOUBLE")
    found = sorted([tuple(r) for r in L.scan_licenses(docs).collect()], key=repr)
    assert found == brute_scan(rows)
    labels = {r[0]: r[6] for r in found}
    for k, (label, _, _) in enumerate(L.TEMPLATES):
        assert label in labels[100 + k].split(",") and label in labels[400 + k].split(",")


def test_licence_scan_of_nothing(spark):
    assert L.scan_licenses(spark.createDataFrame([], "doc_id LONG, text STRING")).count() == 0


def brute_white(rows, weights="count"):
    good = [(i, [math.floor(64 * c) + 1_000_000 for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = [list(x) for x in {tuple(x) for _, x in good}] if weights == "one" else [x for _, x in good]
    n, dims = len(fit), range(len(fit[0]))
    sums = [sum(x[d] for x in fit) for d in dims]
    centred = lambda xs: np.array([[(n * x[d] - sums[d]) / n for d in dims] for x in xs])
    covariance = centred(fit).T @ centred(fit) / n
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1][:32], vectors[:, ::-1][:, :32]
    return [i for i, _ in good], n, [sum((n * x[d] - sums[d]) ** 2 for d in dims) for _, x in good], centred([x for _, x in good]) @ vectors, values, np.trace(covariance)


def check_white(found, rows, weights="count"):
    ids, n, gaps, projected, values, trace = brute_white(rows, weights)
    assert len(found) == len(ids) * len(values) and {r.n for r in found} == {n}
    by_id = collections.defaultdict(list)
    for r in found:
        by_id[r.vec_id].append(r)
    for c, value in enumerate(values):
        own = np.array([next(r.whitened for r in by_id[i] if r.component == c + 1) for i in ids])
        assert abs(np.abs(own @ projected[:, c]) / np.linalg.norm(own) / np.linalg.norm(projected[:, c]) - 1) < 1e-9
        assert np.allclose(np.abs(own), np.abs(projected[:, c]) / math.sqrt(value), atol=1e-7)
    assert all(r.deviation == g and int(r.deviation_exact) == g for i, g in zip(ids, gaps, strict=True) for r in by_id[i])
    assert all(abs(r.explained - values[r.component - 1] / trace) < 1e-6 * r.explained for r in found)
    assert {r.identity_error for r in found} == {found[0].identity_error} and found[0].identity_error < 1e-9


@pytest.mark.parametrize("weights", ["count", "one"])
def test_whitening_of_planted_rows(spark, weights, monkeypatch):
    rng = random.Random(3)
    vector = lambda: [rng.gauss(0, 0.3 + k / 4) for k in range(5)]
    same = vector()
    rows = [(k, vector()) for k in range(200)] + [(1000 + k, same) for k in range(120)]
    rows += [(2000, None), (2001, [1.0, None, 2.0, 3.0, 4.0]), (2002, [1.0, float("nan"), 0.0, 0.0, 0.0]), (2003, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (2004, [float("-inf"), 0.0, 0.0, 0.0, 0.0])]
    monkeypatch.setattr(W, "HEAVY", 8)
    frame = spark.createDataFrame([(i, v, 1, "w", 2) for i, v in [*rows, (3000, [1.0]), (3001, [])]], "vec_id LONG, embedding ARRAY<DOUBLE>, x INT, copies STRING, weight LONG").repartition(5)
    check_white(W.whiten(frame, weights=weights).collect(), rows, weights)


def test_whitening_of_the_table(spark, data):
    rows = [(r.vec_id, r.embedding) for r in table(spark, data, "embeddings").collect()]
    check_white(QUERIES["op12_whitening"](spark, data).collect(), rows)


def test_whitening_without_variance_and_beyond_longs(spark):
    shape = "vec_id LONG, embedding ARRAY<FLOAT>"
    flat = W.whiten(spark.createDataFrame([(None, [1.0, 2.0]), (None, [1.0, 2.0])], shape)).collect()
    assert [(r.vec_id, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in flat] == [(None, 2, 0, None, None, None)] * 4
    line = W.whiten(spark.createDataFrame([(k, [float(k), 0.5]) for k in range(4)], shape)).collect()
    assert {r.component: r.whitened is None for r in line} == {1: False, 2: True} and line[0].identity_error < 1e-12
    wide = W.whiten(spark.createDataFrame([(1, [1e30, 0.0]), (2, [-1e30, 1.0]), (3, [5.0, 2.0])], shape)).collect()
    assert {r.deviation for r in wide if r.vec_id == 1} == {None} and all(r.deviation_exact is not None for r in wide)
    assert W.whiten(spark.createDataFrame([], shape)).count() == 0
    assert W.whiten(spark.createDataFrame([(1, []), (2, None)], shape)).count() == 0


def brute_trie(rows):
    turns = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            digest = hashlib.sha256(f"{len(role or '')}:{role or ''}{text or ''}".encode()).hexdigest()
            turns[conv].append((turn is not None, turn or 0, digest, role or "", text or ""))
    turns = {c: [t[3:] for t in sorted(v)] for c, v in turns.items()}
    built = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = turns.get(c - c % 20, [])[:h] + own[h:]
    members = collections.defaultdict(list)
    for c, own in built.items():
        for d in range(len(own) + 1):
            members[tuple(own[:d])].append(c)
    children = collections.Counter(p[:-1] for p in members if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, m in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            saved[p[:d]] += (len(m) - 1) * words
            leaves[p[:d]] += not children[p]
    ids = lambda p: ",".join(map(str, sorted(c for c in members[p] if len(built[c]) == len(p))))
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), children[p], leaves[p], saved[p], hashlib.sha256(ids(p).encode()).hexdigest()) for p, m in members.items())


def planted_conversations(seed):
    rng = random.Random(seed)
    texts = ["hi there", "go on", "", None, "a b c\td", "é  ü"]
    rows = [(c, t, rng.choice(["user", "assistant", None]), rng.choice(texts)) for c in range(160) for t in range(rng.randrange(1, 6))]
    rows += [(5000 + k, t, "user", f"same {t}") for k in range(0, 9000, 20) for t in range(4)]  # one large group of copies, in several blocks of ids
    rows += [(20_000, t, "user", f"long {t}") for t in range(700)] + [(20_020, t, "user", f"long {t}") for t in range(650)]
    rows += [(30_001, 0, "user", "orphan"), (30_003, None, "user", "null first"), (30_003, 0, None, None), (30_003, 0, None, None), (None, 0, "user", "no id")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("options", [{}, {"limit": 5, "shard_nodes": 40}, {"limit": 1, "shard_nodes": 10}, {"limit": 100_000}])
def test_trie_against_brute_force(spark, options):
    rows = planted_conversations(len(options))
    frame = spark.createDataFrame([(*r, "d", 1) for r in rows], "conv_id LONG, turn LONG, role STRING, text STRING, digest STRING, depth INT").repartition(7)
    found = sorted((r[0], r[1], -1 if r[2] is None else r[2], *r[3:]) for r in P.conversation_trie(frame, **options).collect())
    assert found == brute_trie(rows)


def test_trie_of_nothing(spark):
    assert P.conversation_trie(spark.createDataFrame([], "conv_id LONG, turn LONG, role STRING, text STRING")).count() == 0
    turnless = P.conversation_trie(spark.createDataFrame([(1, 0, "user", "x")], "conv_id LONG, turn LONG, role STRING, text STRING")).collect()
    assert zlib.crc32(b"1") % 4 == 3 and [tuple(r)[:7] for r in turnless] == [(1, 0, None, 1, 0, 1, 0)]


def test_node_table_gives_each_digest_a_slot_of_its_own():
    keys = np.frombuffer(b"".join(hashlib.md5(str(k).encode()).digest() for k in range(5000)), np.uint64).reshape(-1, 2)
    nodes = P.NodeTable(keys[:4000])
    assert sorted(nodes.lookup(keys[:4000])) == list(range(4000)) and (nodes.lookup(keys[4000:]) == -1).all()
    with pytest.raises(ValueError):
        P.NodeTable(np.vstack([keys[:10], keys[:1]]))
