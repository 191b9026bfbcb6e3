"""Quality rules, mixing, n-gram join, decontamination and sharding against brute force."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelens.llm import decontamination as D
from tracelens.llm import mixing as M
from tracelens.llm import ngram_join as N
from tracelens.llm import quality_rules as Q
from tracelens.llm import sharding as H
from tracelens.llm.components import components

WORD = r"[^\x20\x09-\x0D]+"
DOC = "doc_id LONG, text STRING, lang STRING, source STRING"


def prose(rng, n, vocabulary=2000):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def brute_counts(text):
    words = re.findall(WORD, text or "")
    seen = collections.Counter(zip(words, words[1:], words[2:]))
    inside = {i + k for i in range(len(words) - 2) if seen[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(WORD, x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for w in words for c in w), len(lines) - len(set(lines)), len(inside)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_counts_against_brute_force(seed):
    rng = random.Random(seed)
    for _ in range(150):
        text = "".join(rng.choice(["a", "b", "é", " ", "\n", "\t", "\x1c", " ", "#", "<", "a b c ", "日"]) for _ in range(rng.randrange(60)))
        assert Q.counts_of(text.encode(), {})[:5] == brute_counts(text)


def test_numbers_beyond_a_packed_word(monkeypatch):
    text = ("x y z q " * 5).encode()
    big = {f"n{k}".encode(): k for k in range((1 << 21) + 1)}
    assert Q.repeated_words(text.split(), big) == Q.repeated_words(text.split(), {}) == 20


def quality_docs(spark, extra=()):
    rng = random.Random(4)
    rows = [(k, prose(rng, 120), "en", "a") for k in range(80)] + [(k + 100, prose(rng, 120), "en", None) for k in range(3)]
    rows += [(200, " ".join(f"w{k}%%%$$$" for k in range(120)), "en", "a"), (201, prose(rng, 120).upper(), "en", "a"), (202, "few words", "en", "a"), (203, None, None, None), (204, "", "en", "a"), (205, prose(rng, 20_000, 9999), "en", "a")]
    return spark.createDataFrame(rows + list(extra), DOC)


def test_quality_rejects_outliers_of_a_group_and_keeps_the_rest(spark):
    found = {r.doc_id: r for r in Q.quality_report(quality_docs(spark)).collect()}
    assert {k for k, r in found.items() if not r.kept} == {200, 201, 202, 203, 204}
    assert found[202].base_failed and found[203].base_failed and not found[200].base_failed
    assert found[203].n_words == 0


def test_quality_filter_keeps_all_columns_and_agrees_with_the_report(spark):
    docs = quality_docs(spark, [(5, "few", "en", "a")]).withColumns({"n_words": F.lit("mine"), "row": F.lit(1), "limits": F.col("lang"), "kept": F.lit(False)})
    kept = Q.filter_documents(docs)
    assert kept.columns == docs.columns and kept.where("n_words <> 'mine'").count() == 0
    report = Q.quality_report(docs)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in report.where("kept").collect())
    assert Q.filter_documents(docs.limit(0)).count() == 0 and Q.quality_report(docs.limit(0)).count() == 0


def test_sketches_merge_and_small_groups_borrow(spark):
    rows = Q.with_counts(quality_docs(spark).select(*Q._keys("lang", "source"), "text"), "text")
    halves = [Q.sketches(rows.where(F.pmod(F.xxhash64("n_words", "word_chars"), F.lit(2)) == k)) for k in (0, 1)]
    merged = halves[0].unionByName(halves[1]).groupBy("lang", "source", "feature", "bucket").agg(F.sum("n").alias("n"))
    assert sorted(map(tuple, Q.fences(merged).collect())) == sorted(map(tuple, Q.fences(Q.sketches(rows)).collect()))
    found = {r.source: r for r in Q.fences(Q.sketches(rows)).collect()}
    lang = Q.fences(Q.sketches(rows.withColumn("source", F.lit("=a")))).first()
    assert found["null"].symbols_max == lang.symbols_max and found["null"].word_length_min == lang.word_length_min


def test_sources_judge_the_same_value_differently(spark):
    """A share of symbols that is usual in code and odd in prose; a small source leans on its language, a large one does not."""
    rng = random.Random(6)
    signs = lambda n, share: " ".join(f"w{rng.randrange(2000)}" + ("%" if rng.random() < share else "") for _ in range(n))
    rows = [(k, prose(rng, 120), "en", "prose") for k in range(400)] + [(1000 + k, signs(120, 0.3 + k % 7 / 20), "en", "code") for k in range(400)]
    rows += [(5000, signs(120, 0.5), "en", "prose"), (5001, signs(120, 0.5), "en", "code"), (5002, prose(rng, 120), "en", "new"), (5003, signs(120, 0.5), "fr", "code")]
    found = {r.doc_id: r for r in Q.quality_report(spark.createDataFrame(rows, DOC)).collect()}
    assert abs(found[5000].symbols - found[5001].symbols) < 40
    assert not found[5000].kept and found[5001].kept and found[5002].kept
    # No one cutoff on the feature gives these verdicts.
    judged = [(r.symbols, r.kept) for r in found.values() if not r.base_failed]
    assert max(v for v, k in judged if k) > min(v for v, k in judged if not k)


def mix_docs(spark, sizes, words=30):
    rng = random.Random(5)
    rows = [(f * 10_000 + k, prose(rng, rng.randrange(1, words)), "en", s) for f, (s, n) in enumerate(sizes.items()) for k in range(n)]
    return spark.createDataFrame(rows, DOC)


def test_mixing_meets_entropy_quotas_and_whole_passes(spark):
    docs = mix_docs(spark, {"big": 900, "mid": 120, "small": 60, None: 30})
    tokens = collections.Counter()
    for r in docs.collect():
        tokens[r.source] += len(r.text.split())
    total = sum(tokens.values())
    rows = M.mix_report(docs, entropy=0.8, repeats=50.0).collect()
    weight = {r.source: r.weight for r in rows}
    share = -sum(w * math.log(w) for w in weight.values()) / math.log(4)
    assert abs(share - 0.8) < 1e-3 and abs(sum(weight.values()) - 1) < 1e-9
    alpha = [math.log(weight["big"] / weight[s]) / math.log(tokens["big"] / tokens[s]) for s in ("mid", "small", None)]
    assert max(alpha) - min(alpha) < 1e-6 and 0 < alpha[0] < 1
    got = collections.Counter()
    for r in rows:
        got[r.source] += r.n_tokens
    copies = collections.defaultdict(collections.Counter)
    for r in rows:
        copies[r.source][r.doc_id] += 1
    for s, w in weight.items():
        quota = round(w * total)
        assert quota - 30 <= got[s] <= quota
        times = [copies[s].get(r.doc_id, 0) for r in docs.where(F.col("source").eqNullSafe(s)).collect()]
        assert max(times) - min(times) <= 1 and min(times) == quota // tokens[s]


def test_mixing_respects_the_repetition_limit(spark):
    docs = mix_docs(spark, {"big": 500, "tiny": 10})
    rows = M.mix_report(docs, entropy=1.0, repeats=3.0).collect()
    most = collections.Counter((r.source, r.doc_id) for r in rows)
    assert max(most.values()) <= 3 and max(v for (s, _), v in most.items() if s == "tiny") >= 2


@pytest.mark.parametrize("entropy, repeats, budget", [(0.8, 50.0, None), (0.95, 2.0, 9000), (0.5, 1.5, 500)])
def test_mixing_chooses_the_documents_that_brute_force_does(spark, entropy, repeats, budget):
    docs = mix_docs(spark, {"big": 400, "mid": 90, "small": 40, None: 20})
    block, place = M._order(1)
    rows = docs.select("doc_id", "text", *M._rows(docs, 1, "doc_id", "text", "source")).select("*", block.alias("block"), place.alias("place")).collect()
    tokens = collections.Counter()
    for r in rows:
        assert r.tokens == len(re.findall(WORD, r.text))
        tokens[r.source] += r.tokens
    total = sum(tokens.values())
    budget_ = budget or total

    def weights(alpha):
        raw = {s: n**alpha for s, n in tokens.items()}
        return {s: x / sum(raw.values()) for s, x in raw.items()}

    def bisected(holds, low, high):
        for _ in range(60):
            low, high = (low, (low + high) / 2) if holds((low + high) / 2) else ((low + high) / 2, high)
        return high

    spread = lambda a: -sum(w * math.log(w) for w in weights(a).values())
    fits = lambda a: max(budget_ * w / tokens[s] for s, w in weights(a).items()) <= max(repeats, budget_ / total) * (1 + 1e-9)
    alpha = 1.0 if spread(1.0) >= entropy * math.log(4) else -bisected(lambda a: spread(-a) >= entropy * math.log(4), -1.0, 0.0)
    alpha = alpha if fits(alpha) else bisected(fits, alpha, 1.0)
    want, near = collections.Counter(), set()
    for s, w in weights(alpha).items():
        passes, part = divmod(round(w * budget_), tokens[s])
        upto, own = 0, sorted((r for r in rows if r.source == s), key=lambda r: (r.place, r.block, r.h))
        for r in own:
            want[r.doc_id] += passes + (upto + r.tokens <= part)
            if abs(upto + r.tokens - part) <= 2:  # the query's exponent is bisected less finely: a token more or less
                near.add(r.doc_id)
            upto += r.tokens
            if upto > part:
                upto += 10**9
    got = collections.Counter(r.doc_id for r in M.mix_report(docs, entropy=entropy, repeats=repeats, budget=budget).collect())
    assert {k for k in want | got if want[k] != got[k]} <= near


def test_mixing_defined_cases(spark):
    docs = spark.createDataFrame([(1, None, "en", "empty"), (2, "a b c", "en", "full"), (2, "a b c", "en", "full"), (None, "d e", "en", None)], DOC).withColumns({"tokens": F.lit(1), "pass": F.lit(2), "copies": F.lit("c"), "h": F.lit(0)})
    mixed = M.mix_documents(docs)
    assert mixed.columns == docs.columns and mixed.where("source = 'empty'").count() == 1
    assert mixed.where("source = 'full'").count() in (0, 2, 4)
    assert M.mix_documents(docs.limit(0)).count() == 0 and M.mix_documents(docs.where("doc_id = 1")).count() == 1


def near_copies(rng, base, edits):
    words = base.split()
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10_000)}"
    return " ".join(words)


def brute_components(rows):
    sets = {}
    for d, t in rows:
        w = re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.setdefault(d, []).append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    flat = [(d, s) for d, many in sets.items() for s in many]
    parent = list(range(len(flat)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (_, a) in enumerate(flat):
        for j in range(i):
            b = flat[j][1]
            both = len(a & b)
            if both and 100 * both >= 80 * (len(a) + len(b) - both):
                x, y = find(i), find(j)
                if flat[x][0] < flat[y][0]:
                    x, y = y, x
                parent[x] = y
    return sorted((d, len(s), flat[find(i)][0]) for i, (d, s) in enumerate(flat))


def similar(spark, rows):
    docs = spark.createDataFrame([(d, t, "node") for d, t in rows], "doc_id LONG, text STRING, node STRING")
    return sorted(map(tuple, N.similar_documents(docs).collect()))


@pytest.mark.parametrize("seed, small", [(6, 32), (7, 4)])
def test_ngram_join_against_brute_force(spark, monkeypatch, seed, small):
    """The second run has tiny groups and blocks, so that the blocked comparison does most of the work."""
    monkeypatch.setattr(N, "SMALL", small)
    monkeypatch.setattr(N, "BLOCK", 1024 if small > 4 else 8)
    rng = random.Random(seed)
    passage, rows = prose(rng, 60), []
    for _ in range(12):
        base = prose(rng, rng.choice([3, 6, 12, 40, 90, 200]))
        rows += [near_copies(rng, base, rng.randrange(0, 4)) for _ in range(rng.randrange(1, 8))] + [base.upper()]
    rows += [near_copies(rng, passage, k % 7) for k in range(40)] + [f"{prose(rng, 30)} {passage} {prose(rng, 30)}" for _ in range(40)] + [passage] * 5 + [None, "", " \n", "one", "one", "two words"]
    rng.shuffle(rows)
    listed = list(enumerate(rows))
    assert similar(spark, listed) == brute_components(listed)


def test_ngram_join_defined_cases(spark):
    long = prose(random.Random(8), 30_000, 50_000)
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (1, "completely other words stand in this one"), (4, long), (3, long + " tail"), (5, None)]
    assert similar(spark, rows) == brute_components(rows)
    docs = spark.createDataFrame([(None, "a b c d e f"), (2, "a b c d e f")], "doc_id LONG, text STRING")
    assert sorted(map(tuple, N.similar_documents(docs).collect()), key=str) == [(2, 2, 2), (None, 2, None)]
    assert N.similar_documents(docs.limit(0)).count() == 0


@pytest.mark.parametrize("signatures, most", [(200, 1), (3, 3)])
def test_pairs_of_many_signatures_are_offered_once(spark, signatures, most):
    """Forty sets that sketches can't tell apart share all their signatures: before, each of 200 signatures gave every pair out."""
    nodes = spark.createDataFrame([(k, 20, np.array([7], np.uint64).tobytes()) for k in range(40)], "node LONG, n INT, bits BINARY")
    split = spark.createDataFrame([(s * 7919, k, k, 40) for s in range(signatures) for k in range(40)], "sig LONG, node LONG, root LONG, members LONG")
    pairs = [(r.u, r.v) for r in N.offered(split, nodes, 80, 100).collect()]
    assert set(pairs) == {(u, v) for v in range(40) for u in range(v)}
    assert len(pairs) <= most * 780


def test_one_document_of_each_group_stays(spark):
    docs = spark.createDataFrame([(3, "a b c d e f", 1), (2, "a b c d e f", 2), (2, "a b c d e f", 3), (9, "", 4), (8, None, 5)], "doc_id LONG, text STRING, component_id INT")
    kept = N.one_of_each(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 8, 9]


def test_rows_that_share_an_id_are_judged_by_their_own_texts(spark):
    rows = [(5, "a b c d e f g"), (5, "totally other words stand here now"), (7, "a b c d e f g"), (7, "m n o p q r s"), (7, "m n o p q r s"), (8, "M N O P Q R S"), (9, "alone in the world as it is"), (None, "m n o p q r s"), (5, ""), (6, "totally other words stand here now")]
    kept = N.one_of_each(spark.createDataFrame(rows, "doc_id LONG, text STRING"))
    want = [(5, "a b c d e f g"), (5, "totally other words stand here now"), (7, "m n o p q r s"), (9, "alone in the world as it is"), (None, "m n o p q r s"), (5, "")]
    assert sorted(map(tuple, kept.collect()), key=str) == sorted(want, key=str)


def test_packed_signatures_come_back():
    rng = np.random.default_rng(3)
    sig = np.sort(rng.integers(0, 1 << 48, 700).astype(np.uint64))
    node = rng.choice(rng.integers(0, 1 << 62, 300), 700)
    found = N.unpacked(N.packed(sig, node))
    assert (found[0] == sig).all() and (found[1] == node).all()


@pytest.mark.parametrize("seed", range(4))
def test_similar_sets_share_a_signature(seed):
    rng = np.random.default_rng(seed)
    for _ in range(150):
        n = int(rng.choice([4, 5, 6, 9, 17, 40, 150, 900]))
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        gone = rng.integers(0, n // 9 + 1)
        b = np.unique(np.concatenate([a[gone:], rng.integers(0, 1 << 63, rng.integers(0, n // 9 + 1)).astype(np.uint64)]))
        both = len(np.intersect1d(a, b))
        if 100 * both >= 80 * (len(a) + len(b) - both) and N.set_hash(a) != N.set_hash(b):
            assert len(np.intersect1d(N.signatures(a), N.signatures(b)))
            assert N.apart(N.sketch(a), N.sketch(b)) <= len(a) + len(b) - 2 * both


def test_components_of_chains_stars_and_rings(spark):
    edges = [(k, k + 1) for k in range(1, 40)] + [(100, 100 + k) for k in range(1, 30)] + [(200, 201), (201, 202), (202, 200), (300, 300)]
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "u LONG, v LONG")).collect()}
    assert found == {k: 1 for k in range(1, 41)} | {100 + k: 100 for k in range(30)} | {200 + k: 200 for k in range(3)}


def edit_distance(item, window):
    row = [0] * (len(window) + 1)
    for k, c in enumerate(item, 1):
        before, row = row, [k]
        for j, w in enumerate(window, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (c != w)))
    return min(row)


@pytest.mark.parametrize("seed", range(3))
def test_bit_parallel_distance(seed):
    rng = random.Random(seed)
    for _ in range(60):
        item, window = ("".join(rng.choice("abé ") for _ in range(n)) for n in (rng.randrange(1, 90), rng.randrange(0, 120)))
        assert D.Item(1, item).distance(window) == edit_distance(item, window)


def test_decontamination_finds_edited_items_and_leaves_others(spark, monkeypatch):
    rng = random.Random(9)
    items = [(k, prose(rng, 30)) for k in range(20)] + [(90, "short"), (91, None)]
    budget = len(items[0][1]) * D.RATE // 100
    edited = list(items[0][1])
    for k in rng.sample(range(len(edited)), budget):
        edited[k] = "#"
    docs = [(1, prose(rng, 50) + " " + items[3][1].upper() + "\n" + prose(rng, 20)), (2, "".join(edited)), (3, prose(rng, 500)), (4, None), (5, ""), (6, items[5][1].replace(" ", " \n\t ")), (None, items[7][1]), (8, items[7][1][:60]), (9, "short"), (1, items[4][1])]
    docs = spark.createDataFrame([(*d, "x") for d in docs], "doc_id LONG, text STRING, item_id STRING")
    table = spark.createDataFrame(items, "item_id LONG, text STRING")
    want = {(1, 3), (2, 0), (6, 5), (None, 7), (1, 4), (9, 90)}
    for block in (D.BLOCK_CHARS, 600):
        monkeypatch.setattr(D, "BLOCK_CHARS", block)
        found = D.contaminated(docs, table).collect()
        assert {(r.doc_id, r.item_id) for r in found} == want and {r.distance for r in found if r.item_id == 0} == {budget}
        clean = D.clean_documents(docs, table)
        assert clean.columns == docs.columns and sorted(r.doc_id for r in clean.collect()) == [3, 4, 5, 8]
        assert {(r.doc_id, r.item_id) for r in D.contaminated(docs, table, short=False).collect()} == want - {(9, 90)}
    assert D.contaminated(docs, table.limit(0)).count() == 0 and D.clean_documents(docs.limit(0), table).count() == 0


def test_decontamination_of_every_document_against_the_distance_over_whole_texts(spark, data):
    docs, items = (spark.read.parquet(f"{data}/{t}.parquet").select(k, "text") for t, k in (("documents", "doc_id"), ("benchmark", "item_id")))
    normal = [(r.doc_id, D.normal(r.text)) for r in docs.collect()]
    listed = [D.Item(r.item_id, D.normal(r.text)) for r in items.collect() if D.normal(r.text or "")]
    want = {(i, x.item_id, d) for i, t in normal for x in listed if (d := x.distance(t)) <= x.budget}
    assert set(map(tuple, D.contaminated(docs, items).collect())) == want and want


def test_decontamination_folds_the_case_of_every_letter(spark):
    items = [(1, "mañana él volverá según dirá allí también él, así será después"), (2, "die straße führt über größere flüße, äußerst schöne höfe und gärten"), (3, "ο κόσμος είναι μεγάλος και ο δρόμος μας είναι πάντα ανοιχτός")]
    docs = spark.createDataFrame([(i, f"x {t.upper()} y") for i, t in items] + [(9, "x y")], "doc_id LONG, text STRING")
    table = spark.createDataFrame([(i, t.title() if i == 1 else t) for i, t in items], "item_id LONG, text STRING")
    assert sorted(tuple(r) for r in D.contaminated(docs, table).collect()) == [(i, i, 0) for i, _ in items]
    assert [r.doc_id for r in D.clean_documents(docs, table).collect()] == [9]


def test_decontamination_finds_short_items_as_whole_words(spark, tmp_path):
    import corpus_pipeline
    from tracelens.llm import queries

    texts = ["They won; FORTY  two.", "forty twofold", "a forty two", "xforty two forty two", "forty tw0", "été", "étés", "(x) y", "cafe\u0301", None, ""]
    items = [(1, "Forty two"), (2, "Été"), (3, "(x)"), (4, "cafe"), (5, ""), (6, None)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id LONG, text STRING").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id LONG, text STRING").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = queries.op6_decontamination(spark, str(tmp_path)).collect()
    assert sorted(tuple(r) for r in found) == [(0, 1, 0), (2, 1, 0), (3, 1, 0), (5, 2, 0), (7, 3, 0)]
    clean = corpus_pipeline.decontamination(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))
    assert sorted(r.doc_id for r in clean.collect()) == [1, 4, 6, 8, 9, 10]


def test_decontamination_gives_short_items_their_edits(spark):
    items = spark.createDataFrame([(1, "seventeen letters"), (2, "a quick brown fox jumps"), (3, "sixteen letters.")], "item_id LONG, text STRING")
    docs = spark.createDataFrame([(1, "xx seventeen lettXrs yy"), (2, "a quick br0wn fox jumps"), (3, "a qu1ck br0wn fox jumps"), (4, "sixteen lett3rs."), (5, "so sixteen letters. and a quick brown fox jumps " * 2)], "doc_id LONG, text STRING")
    assert sorted(tuple(r) for r in D.contaminated(docs, items).collect()) == [(1, 1, 1), (2, 2, 1), (5, 2, 0), (5, 3, 0)]


def test_growth_moves_rows_only_into_the_new_shard():
    owner = H.first_map(24)
    sizes = collections.Counter(owner)
    assert len(sizes) == 24 and max(sizes.values()) - min(sizes.values()) <= 1
    more = H.grown(owner)
    assert all(b in (a, 24) for a, b in zip(owner, more)) and collections.Counter(more)[24] == H.SLOTS // 25


def test_rebalance_evens_bytes_without_other_moves():
    rng = random.Random(10)
    owner, size = H.first_map(8, 256), [rng.randrange(1000) for _ in range(256)]
    size[3] = 20_000
    after = H.rebalance(owner, size)
    total = lambda m: [sum(s for s, o in zip(size, m) if o == k) for k in range(8)]
    assert max(total(after)) - min(total(after)) < max(total(owner)) - min(total(owner))
    assert sum(a != b for a, b in zip(owner, after)) < 128


def test_sharding_every_row(spark):
    rows = [(k, f"text {k}" * (k % 7)) for k in range(500)] + [(None, None), (7, "again"), (7, "again")]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id LONG, text STRING, slot INT")
    found = H.shard_documents(docs, 24).collect()
    places = collections.defaultdict(list)
    for r in found:
        places[r.shard].append(r.slot)
        assert r.law == "key" and r.grown_shard in (r.shard, 24)
    assert len(found) == len(rows) and all(sorted(v) == list(range(len(v))) for v in places.values())
    assert sorted((str(r.doc_id), r["size"], r.text_crc32) for r in found) == sorted((str(d), len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in rows)
    half = {r.doc_id: r.shard for r in H.shard_documents(docs.where("doc_id % 2 = 0"), 24).collect()}
    assert all(half[r.doc_id] == r.shard for r in found if r.doc_id in half)
    assert H.shard_documents(docs.limit(0), 24).count() == 0


def test_slot_maps_are_reopened_and_appended(spark, tmp_path):
    path = f"file://{tmp_path}/maps"
    assert H.append_map(spark, path, H.first_map(4, 64)) == 0
    assert H.load_map(spark, path) == H.first_map(4, 64)
    sizes = spark.createDataFrame([(3, 5000), (9, 10), (9 + 1, 70)], "virtual_slot INT, bytes LONG")
    assert H.append_rebalanced(spark, path, sizes) == 1
    size = [{3: 5000, 9: 10, 10: 70}.get(k, 0) for k in range(64)]
    assert H.load_map(spark, path) == H.load_map(spark, path, 1) == H.rebalance(H.first_map(4, 64), size)
    assert H.append_map(spark, path, H.grown(H.load_map(spark, path))) == 2 and H.load_map(spark, path, 0) == H.first_map(4, 64)


def test_rows_are_placed_by_the_stored_version(spark, tmp_path):
    path, rng = f"file://{tmp_path}/maps", random.Random(6)
    docs = spark.createDataFrame([(k, "x" * rng.choice([1, 1, 1, 9000])) for k in range(400)], "doc_id LONG, text STRING")
    first = {r.doc_id: (r.shard, r.balanced_shard, r.law) for r in H.shard_documents(docs, 5, slots=64, maps=path).collect()}
    again = {r.doc_id: (r.shard, r.law) for r in H.shard_documents(docs, 5, slots=64, maps=path).collect()}
    assert H.last_version(spark, path) == 1  # nothing more to move, so no new version
    assert again == {d: (balanced, "map") for d, (_, balanced, _) in first.items()} and {x for _, _, x in first.values()} == {"key"}
    old = {r.doc_id: (r.shard, r.law) for r in H.shard_documents(docs, 5, slots=64, maps=path, version=0).collect()}
    assert old == {d: (shard, law) for d, (shard, _, law) in first.items()}
    more = {r.doc_id: r.shard for r in H.shard_documents(docs, 6, slots=64, maps=path).collect()}
    assert all(s in (again[d][0], 5) for d, s in more.items()) and 5 in more.values()
    with pytest.raises(ValueError):
        H.shard_documents(docs, 4, slots=64, maps=path)


def test_sharding_query_against_brute_force(spark, data):
    import xxhash

    from tracelens.llm import queries

    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    slot = {d: (xxhash.xxh64_intdigest(d.to_bytes(8, "little", signed=True), seed=42)) % H.SLOTS for d in docs}
    owner = H.first_map(24)
    after, size, by_slot = H.grown(owner), {d: len(t.encode()) + 8 for d, t in docs.items()}, collections.Counter()
    for d in docs:
        by_slot[slot[d]] += size[d]
    balanced = H.rebalance(owner, [by_slot[k] for k in range(H.SLOTS)])
    place, nth = {}, collections.Counter()
    crc = {d: zlib.crc32(t.encode()) for d, t in docs.items()}
    for d in sorted(docs, key=lambda d: (slot[d], crc[d] % H.LOTS, d)):
        place[d] = nth[owner[slot[d]]]
        nth[owner[slot[d]]] += 1
    want = {(d, size[d], crc[d], "key", owner[slot[d]], place[d], after[slot[d]], balanced[slot[d]], slot[d], by_slot[slot[d]]) for d in docs}
    assert {tuple(r) for r in queries.op8_sharding(spark, data).collect()} == want


def test_sets_of_any_size_have_a_band():
    low, allowed = N.bands(largest=64)
    assert N.LOW[-1] > 1 << 31 and len(low) < len(N.LOW) and (N.LOW[: len(low)] == low).all() and (N.ALLOWED[: len(low)] == allowed).all()
    own = np.sort(np.random.default_rng(1).integers(0, 1 << 63, 200_000).astype(np.uint64))
    near = np.concatenate([own[:-20_000], own[-20_000:] + np.uint64(1)])
    assert np.intersect1d(N.signatures(own), N.signatures(np.sort(near))).size


@pytest.mark.parametrize("buckets", [1, 7, 51, 1_000_000])
def test_buckets_of_signatures(buckets):
    sig = np.sort(np.concatenate([np.random.default_rng(2).integers(0, 1 << 48, 5000), [0, (1 << 48) - 1]]).astype(np.uint64))
    assert N.bucket_of(sig, buckets).tolist() == [int(s) * buckets >> 48 for s in sig]


def test_a_set_beyond_sixteen_million_shingles():
    band = int(np.searchsorted(N.LOW, 16_330_737 + 1, "right")) - 1
    assert band + 1 < len(N.LOW) and N.LOW[band] <= 16_330_738 < N.LOW[band + 1]
