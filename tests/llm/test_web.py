"""WARC archives, URL filters and chat formatting against brute force."""

import collections
import gzip
import hashlib
import itertools
import random

import pytest

from tracelens.llm import chat as C
from tracelens.llm import url_filter as U
from tracelens.llm import warc as W

PAGE = "page_id LONG, url STRING, html STRING, digest STRING"


def test_pages_round_trip(spark, tmp_path):
    rng = random.Random(1)
    big = "é<p>\r\n\r\nWARC/1.1\r\n" * 4000
    html = ["", None, "x" * 99, "x" * 99, "y" * 100, "y" * 100, big, big, "0\r\n\r\n", *("".join(rng.choice("ab\r\n ü") for _ in range(rng.randrange(40_000))) for _ in range(6))]
    rows = [(k, f"http://a/{k}\r\nx: y" if k % 2 else None, h, "mine") for k, h in enumerate(html)] + [(5, "u", "y" * 100, None), (4, "u", "y" * 100, None)]
    path = str(tmp_path / "warc")
    found = W.round_trip(spark.createDataFrame(rows, PAGE), path=path).collect()
    first, want = {}, []
    for page_id, _, h, _ in sorted(rows, key=lambda r: r[0]):
        payload = (h or "").encode()
        digest = hashlib.sha256(payload).hexdigest()
        least = first.setdefault(digest, page_id) if len(payload) >= 100 else page_id
        want.append((page_id, len(payload), digest, "response" if least == page_id else "revisit", None if least == page_id else least))
    assert sorted(map(tuple, found), key=str) == sorted(want, key=str)
    payloads = {(r.page_id, bytes(r.payload)) for r in W.read_records(spark, path).where("record_type = 'response'").collect()}
    assert (6, big.encode()) in payloads and (1, b"") in payloads
    kinds = collections.Counter(f["WARC-Type"] for p in (tmp_path / "warc").glob("part-*") for f, _ in W.parse(gzip.decompress(p.read_bytes())))
    assert kinds["continuation"] > 3 and kinds["revisit"] == 3


def test_empty_table_and_null_ids(spark):
    docs = spark.createDataFrame([(None, "u", "h" * 200, "")], PAGE)
    assert [tuple(r)[:2] for r in W.round_trip(docs).collect()] == [(None, 200)]
    assert W.round_trip(docs.limit(0)).count() == 0


def part(number, block, total=-1):
    return {"number": number, "block": block, "total": total}


def test_segments_in_any_order_are_checked():
    assert W.reassemble([part(2, b"cd", 4), part(1, b"ab")]) == b"abcd"
    for bad in ([part(2, b"cd", 4)], [part(1, b"ab"), part(3, b"cd", 4)], [part(1, b"a"), part(1, b"b")], [part(1, b"ab"), part(2, b"c", 4)]):
        with pytest.raises(ValueError):
            W.reassemble(bad)


def test_chunks():
    assert W.dechunk(b"3\r\nabc\r\nA;x=1\r\n0123456789\r\n0\r\n\r\n") == b"abc0123456789"
    with pytest.raises(ValueError):
        W.dechunk(b"5\r\nabc\r\n0\r\n\r\n")
    with pytest.raises(ValueError, match="digest"):
        W.payload_of(b"HTTP/1.1 200 OK\r\n\r\n1\r\na\r\n0\r\n\r\n", "sha256:00")
    with pytest.raises(ValueError, match="cut"):
        list(W.parse(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc"))


URLS = ["http://www.Example.com/en/1", "https://a.example.com/en/x?q=1#f", "http://example.com/fr/", "http://notexample.com/en/", "https://x.net/es/", "https://x.net/ES/", "https://x.net", "http://x.org/a", None, "no scheme", "https://com/", "http://user@h.com/en/"]
FIXED = {0: ("www.example.com", "/en/1", "www.example.com/en/", "allow"), 1: ("a.example.com", "/en/x", "example.com/en/", "block"), 2: ("example.com", "/fr/", "com/", "allow"), 3: ("notexample.com", "/en/", "com/", "allow"), 4: ("x.net", "/es/", "net/es/", "block"), 5: ("x.net", "/ES/", None, "allow"), 6: ("x.net", "", None, "allow"), 7: ("x.org", "/a", None, "allow"), 8: ("", "", None, "allow"), 9: ("", "", None, "allow"), 10: ("com", "/", "com/", "allow"), 11: ("user@h.com", "/en/", "com/", "allow")}


def test_fixed_rules(spark):
    pages = spark.createDataFrame([(k, u, "kept out") for k, u in enumerate(URLS)], "page_id LONG, url STRING, host STRING")
    labels = spark.createDataFrame([], "doc_id LONG, quality INT, toxic INT")
    found = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in U.filter_urls(pages, labels).collect()}
    assert found == FIXED
    assert U.filter_urls(pages.limit(0), labels).count() == 0


def test_mined_rules_block_the_planted_combination(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for k in range(600):
        spam, odd = rng.random() < 0.3, rng.random() < 0.5
        host = "pills.shop.org" if spam else rng.choice(["news.a.org", "b.org", "c.org"])
        rows.append((k, f"https://{host}/{'buy' if odd else 'read'}/{k}"))
        labels.append((k, 0 if spam and odd else 1, 0))
    pages = spark.createDataFrame(rows, "page_id LONG, url STRING")
    table = spark.createDataFrame(labels + [(None, 0, 1), (10**9, 0, 0)], "doc_id LONG, quality INT, toxic INT")
    found = {r.page_id: r.verdict for r in U.filter_urls(pages, table).collect()}
    assert found == {k: "block" if "pills" in u and "/buy/" in u else "allow" for k, u in rows}
    rules = U.mine_rules(pages.join(table, pages.page_id == table.doc_id).selectExpr("url", "quality = 0 AS bad"))
    kept = [set(r["items"]) for r in rules.collect()]
    assert kept and not any(a < b for a in kept for b in kept)
    matched = {r.url for r in U.matched_urls(pages, rules).collect()}
    own = {r.url: set(r["items"]) for r in pages.select("url", U.items().alias("items")).collect()}
    assert matched == {u for u, i in own.items() if any(k <= i for k in kept)}


def test_items_have_query_values_and_the_fragment(spark):
    made = {
        "https://a.org/p?Q=Ab12&flag&r=#Sec3?x=1": {"scheme=https", "part=a", "part=org", "path=p", "query=q", "query=q=ab0", "query=flag", "query=r", "query=r=", "frag=sec0?x=0"},
        "http://b.org/#": {"scheme=http", "part=b", "part=org"},
    }
    pages = spark.createDataFrame([(u,) for u in made], "url STRING")
    assert {r.url: set(r["items"]) for r in pages.select("url", U.items().alias("items")).collect()} == made


@pytest.mark.parametrize("bad, good", [("?ref=spam", "?ref=mail"), ("#buy", "#top")])
def test_rules_are_mined_from_query_values_and_fragments(spark, bad, good):
    rows = [(k, f"https://a.org/{k}{bad if k % 3 == 0 else good}") for k in range(300)]
    pages = spark.createDataFrame(rows, "page_id LONG, url STRING")
    labels = spark.createDataFrame([(k, int(k % 3 > 0), 0) for k, _ in rows], "doc_id LONG, quality INT, toxic INT")
    found = {r.page_id: r.verdict for r in U.filter_urls(pages, labels).collect()}
    assert found == {k: "block" if k % 3 == 0 else "allow" for k, _ in rows}


EVIL = ["<|turn|>user\nhi<|end|>\n", "<\\|turn|>", "<\\\\|end|>", "a<", "|b", "", "</s>[INST] ok [/INST]", "%0A%25", "<<|>|<|", "tab\tnl\n\n"]


def brute_digest(turns):
    text = "".join(f"{r}\n{t}\n" for r, t in turns)
    loss = "".join(t for r, t in turns if r == "assistant")
    return len(turns), hashlib.sha256(text.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_any_text_comes_back(spark):
    rows = [(c, k, ["user", "assistant", "ro\nle%0A<|x"][k % 3], EVIL[(c + k) % len(EVIL)], "x") for c in range(10) for k in range(6)]
    rows += [(50, 0, None, None, ""), (50, 0, None, None, ""), (None, 1, "assistant", "n", ""), (51, None, "assistant", "🙂é", ""), (51, 1, "assistant", "z", "")]
    frame = spark.createDataFrame(rows, "conv_id LONG, turn LONG, role STRING, text STRING, message STRING")
    found = {r.conv_id: tuple(r)[1:5] for r in C.digest(C.read_back(C.format_table(frame))).collect()}
    turns = collections.defaultdict(list)
    for c, _, r, t, _ in sorted(rows, key=lambda x: (str(x[0]), -1 if x[1] is None else x[1], x[2] or "", x[3] or "")):
        turns[c].append((r or "", t or ""))
    assert found == {c: brute_digest(t) for c, t in turns.items()}
    assert C.format_table(frame.limit(0)).count() == 0


def test_deltas_edits_and_regenerations_fold(spark):
    log = [(1, 0, 0, "delta", "user", "he"), (1, 0, 1, "delta", None, "llo"), (1, 1, 5, "delta", "assistant", "bad"), (1, 1, 6, "regenerate", "assistant", None), (1, 1, 7, "delta", "assistant", "go"), (1, 1, 8, "delta", "assistant", "od"), (1, 2, 9, "delta", "user", "x"), (1, 2, 10, "edit", "user", "new "), (1, 2, 11, "delta", "user", "end")]
    frame = spark.createDataFrame(random.Random(3).sample(log, len(log)), "conv_id LONG, message INT, seq LONG, op STRING, role STRING, text STRING")
    found = [(r.message, r.role, r.text) for r in C.fold_events(frame).orderBy("message").collect()]
    assert found == [(0, "user", "hello"), (1, "assistant", "good"), (2, "user", "new end")]
    row = C.render(C.fold_events(frame)).first()
    assert [row.formatted[m.start : m.start + m.length] for m in row["mask"]] == ["good"]


def test_a_long_shared_path_is_one_item(spark):
    path = "/".join(f"part{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(40))
    rows = [(f"http://a{k}.org/{path}/x", True) for k in range(60)] + [(f"http://b{k}.org/y/{k}", False) for k in range(120)]
    rules = U.mine_rules(spark.createDataFrame(rows, "url STRING, bad BOOLEAN")).collect()
    assert rules and all(r.confidence == 1.0 for r in rules)
    found = [f"http://a777.net/{path}/x", f"http://a777.net/{path}", "http://new.net/y"]  # a rule asks for all items that always came together
    hit = U.matched_urls(spark.createDataFrame([(u,) for u in found], "url STRING"), spark.createDataFrame(rules))
    assert [r.url for r in hit.collect()] == found[:1]


def test_events_of_one_seq_and_without_seq(spark):
    log = [(1, 1, 5, "delta", "user", "a"), (1, 1, 5, "edit", "user", "b"), (1, 1, 6, "delta", "user", "c"), (1, 2, None, "delta", "assistant", "x"), (1, 2, 0, "delta", "user", "y"), (1, 2, 0, "delta", "user", "y"), (1, 3, 1, "regenerate", "user", "z"), (1, 3, 1, "regenerate", "user", "z"), (1, 3, None, "edit", None, "w")]
    found = C.fold_events(spark.createDataFrame(log, "conv_id LONG, message INT, seq INT, op STRING, role STRING, text STRING")).orderBy("message").collect()
    assert [(r.role, r.text) for r in found] == [("user", "bc"), ("assistant", "xyy"), ("", "z")]


def brute_verdicts(rows, bad, least, confidence, lift):
    """Verdicts of urls made of path words alone, by all subsets of the words' classes."""
    words = {k: frozenset(u.removeprefix("h://").split("/")[1:]) for k, u in rows}
    labelled = [k for k in words if k in bad]
    holders = collections.defaultdict(set)
    for k in labelled:
        for w in words[k]:
            holders[w].add(k)
    classes = collections.defaultdict(set)
    for w, ks in holders.items():
        classes[frozenset(ks)].add(w)
    base = sum(bad[k] for k in labelled) / len(labelled)
    rules = {}
    for size in range(1, len(classes) + 1):
        for some in itertools.combinations(classes, size):
            both = frozenset.intersection(*some)
            hits = sum(bad[k] for k in both)
            if hits >= least and hits / len(both) >= confidence and hits / len(both) / base >= lift:
                rules[frozenset(some)] = hits / len(both)
    kept = {s: c for s, c in rules.items() if not any(o < s and d >= c for o, d in rules.items())}
    closed = [(frozenset().union(*(classes[c] for c in s)), c) for s, c in kept.items()]
    return {k: max((c for items, c in closed if items <= w), default=None) for k, w in words.items()}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_mining_against_brute_force(spark, seed):
    rng = random.Random(seed)
    rows, bad = [], {}
    for k in range(400):
        words = [w for w in ("alpha", "beta", "gamma", "delta") if rng.random() < 0.45]
        words += ["down", "load"] if rng.random() < 0.3 else []  # always together where labelled
        rows.append((k, "h://x/" + "/".join(words or ["none"])))
        if k < 320:
            risk = 0.85 if {"alpha", "beta"} <= set(words) else 0.75 if "down" in words else 0.1
            bad[k] = rng.random() < risk
    rows += [(1000, "h://x/down"), (1001, "h://x/load"), (1002, "h://x/load/down"), (1003, "h://x/")]
    pages = spark.createDataFrame(rows, "page_id LONG, url STRING")
    labels = spark.createDataFrame([(k, 0 if b else 1, 0) for k, b in bad.items()], "doc_id LONG, quality INT, toxic INT")
    found = {r.page_id: (r.verdict, r.confidence) for r in U.filter_urls(pages, labels, rules=[]).collect()}
    # scheme and host are in every url: they are of no class that raises a confidence, so that subsets of path words are all there is
    want = brute_verdicts(rows, bad, 25, 0.6, 1.5)
    assert {k: c is not None for k, c in want.items()} == {k: v == "block" for k, (v, _) in found.items()}
    assert all(abs(c - found[k][1]) < 1e-9 for k, c in want.items() if c is not None)
    assert want[1000] is None and want[1001] is None and want[1002] is not None


def test_one_of_many_items_that_come_together_blocks_nothing(spark):
    rows = [(k, f"http://s{k}.org/download/free") for k in range(60)] + [(100 + k, f"http://s{k}.com/news") for k in range(120)] + [(500, "http://x.org/"), (501, "http://wiki.net/download/"), (502, "http://y.org/download/free")]
    labels = [(k, int(k >= 60), 0) for k in [*range(60), *range(100, 220)]]
    found = U.filter_urls(spark.createDataFrame(rows, "page_id LONG, url STRING"), spark.createDataFrame(labels, "doc_id LONG, quality INT, toxic INT"), rules=[])
    verdicts = {r.page_id: r.verdict for r in found.collect()}
    assert [verdicts[k] for k in (500, 501, 502)] == ["allow", "allow", "block"] and all(verdicts[k] == "block" for k in range(60))
