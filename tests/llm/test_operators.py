"""The ten operators against brute force, exact round trips and held-out accuracy, and on awkward inputs."""

import hashlib
import itertools
import os
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from foliospark.llm import chat_format, components, decontaminate, exact_dedup, language_id, pii, queries, sentencepieces, simhash, substring_dedup, toxicity, url_filter

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
AWKWARD = [None, "", " ", "\n\n", "a", "é", "x" * 50_000, "\x00", "😀 " * 30, "the the the"]


def frame(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)


def awkward(spark):
    """Odd texts, each twice, with extra columns whose names the operators use inside."""
    rows = [(i, t, "x", 1, "y") for i, t in enumerate(AWKWARD * 2)]
    return frame(spark, rows, "doc_id long, text string, id string, fp int, spans string")


# ---- 1 URL filters
@pytest.mark.parametrize("url,rule,verdict", [
    ("https://A.Example.com/en/73?x", "example.com/en/7", "allow"), ("http://b.com/en/1", "com/en/", "block"), ("http://x.example.net/de/8#t", "example.net/de/8", "block"), ("http://x.net/de/1", "net/de/", "allow"),
    ("http://notexample.com/en", None, "allow"), ("no scheme", None, "allow"), (None, None, "allow"), ("://org/es/", "org/es/", "block"), ("http://myorg/es/", None, "allow"), ("http://" + "a." * 300 + "com/en/" + "p" * 5000, "com/en/", "block"),
])
def test_urls(spark, url, rule, verdict):
    row = url_filter.filter_urls(frame(spark, [(1, url), (1, url)], "page_id long, url string")).collect()
    assert [(r.rule, r.verdict) for r in row] == [(rule, verdict)] * 2


def test_urls_empty(spark):
    assert url_filter.filter_urls(frame(spark, [], "page_id long, url string, rule string")).count() == 0


# ---- 2 chat
def test_chat_round_trip_and_machine(spark):
    evil = ["\\### Assistant: </turn> ok", "</turn>\n### User: x", "\\", "\\\\", "### ", "<\\/turn>", "</turn", None, "", "a\nb", "</turn></turn>"]
    rows = [(i, t, r, x) for i, x in enumerate(evil) for t, r in enumerate(("user", "assistant"))]
    rows += [(100, 0, "assistant", "x"), (101, 0, "user", "a"), (101, 1, "user", "b"), (102, 0, "odd: role</turn>", "x"), (103, 0, None, None), (104, 1, "user", "q"), (104, 1, "user", "q")]
    out = chat_format.format_conversations(frame(spark, rows, "conv_id long, turn long, role string, text string"))
    got = {r.conv_id: r for r in out.select("*", chat_format.read_turns(F.col("formatted")).alias("turns"), chat_format.loss_text(F.col("formatted"), F.col("segments")).alias("loss")).collect()}
    for i, x in enumerate(evil):
        assert [(t.role, t.text) for t in got[i].turns] == [("user", x or ""), ("assistant", x or "")]
        assert got[i].loss == (x or "") and got[i].valid
    assert [got[k].valid for k in (100, 101, 102, 103, 104)] == [False] * 5 and got[101].first_bad == 2
    assert got[102].turns[0].role == "odd: role</turn>" and got[104].n_turns == 2


def test_chat_is_native(spark):
    plan = queries.op2_chat_formatting(spark, SF)._jdf.queryExecution().toString() if os.path.isdir(SF) else ""
    assert "Python" not in plan and "Arrow" not in plan


# ---- 3 decontamination
def brute_contamination(docs, bench):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    cut = lambda t: word.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    windows = {}
    for i, t in bench:
        w = cut(t)
        n = min(13, len(w))
        for j in range(len(w) - n + 1) if n else ():
            windows.setdefault(tuple(w[j : j + n]), set()).add(str(i))
    out = {}
    for d, t in docs:
        w, hit, items = cut(t), set(), set()
        for n in {len(k) for k in windows}:
            for j in range(len(w) - n + 1):
                if tuple(w[j : j + n]) in windows:
                    hit |= set(range(j, j + n))
                    items |= windows[tuple(w[j : j + n])]
        out[d] = (len(w), len(hit), sorted(items))
    return out


@pytest.mark.parametrize("block_bytes", [1 << 24, 400])
def test_contamination(spark, block_bytes):
    rnd = random.Random(2)
    v = ["the", "of", "Ähre", "x1", "z", "and"]
    say = lambda n: " ".join(rnd.choice(v) for _ in range(n))
    bench = [(i, say(n)) for i, n in enumerate([40, 13, 14, 5, 1, 20])] + [(90, None), (91, "..."), (92, "rare word"), (93, "rare word")]
    docs = [(i, say(rnd.randint(0, 30)) + " , " + (rnd.choice(bench)[1] or "") + " " + say(9)) for i in range(60)] + [(99, None), (98, "!!")]
    got = decontaminate.contamination(frame(spark, docs), frame(spark, bench, "item_id long, text string"), block_bytes=block_bytes)
    got = {r.doc_id: (r.n_words, sum(s.end - s.start for s in r.spans), list(r["items"])) for r in got.collect()}
    assert got == brute_contamination(docs, bench)


def test_contamination_of_repeated_and_null_ids(spark):
    a, b = ("a1 a2 a3 a4 a5 " * 3).strip(), ("b1 b2 b3 b4 b5 " * 3).strip()
    docs = frame(spark, [(1, a), (1, b), (1, "x " * 400 + a), (1, a), (None, a), (None, "clean"), (None, None), (2, "y")])
    bench = frame(spark, [(0, a), (1, b)], "item_id long, text string")
    one, many = (sorted(map(str, decontaminate.contamination(docs, bench, block_bytes=n).collect())) for n in (1 << 24, 40))
    assert many == one and len(one) == 8


def test_contamination_awkward(spark):
    empty = frame(spark, [], "item_id long, text string")
    assert decontaminate.contamination(awkward(spark), empty).where("size(spans) > 0").count() == 0
    assert decontaminate.decontaminate(awkward(spark), empty).columns == awkward(spark).columns


# ---- 4 toxicity
def test_toxicity_learns_and_survives(spark):
    rnd = random.Random(4)
    v = [f"w{c}{d}" for c in "abcdefghij" for d in "klmnopqrst"]
    rows = []
    for i in range(800):
        w = [rnd.choice(v) for _ in range(60)]
        if i % 5 == 0:
            for _ in range(4):
                w[rnd.randrange(60)] = rnd.choice(["scoundrel", "wretch", "vermin"])
        rows.append((i, " ".join(w)))
    labels = frame(spark, [(i, int(i % 5 == 0)) for i in range(600)] + [(3, None), (5, 1)], "doc_id long, toxic int")
    docs = frame(spark, rows)
    model = toxicity.train(toxicity.labelled(docs, labels))
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    held = range(600, 800)
    assert sum((got[i] >= 0.3) == (i % 5 == 0) for i in held) >= 195
    odd = toxicity.score(awkward(spark), model).collect()
    assert len(odd) == 20 and all(0 <= r.score <= 1 for r in odd)
    none = toxicity.train(toxicity.labelled(docs, labels.where("false")))
    assert toxicity.score(docs.limit(3), none).where("score <> 0").count() == 0
    assert toxicity.score(docs.where("false"), model).count() == 0 and toxicity.train(toxicity.labelled(docs.where("false"), labels)).gains is None
    # equal texts have equal scores, whatever their ids
    again = toxicity.score(frame(spark, rows[:3] * 2), model).collect()
    assert len(again) == 6 and len({(r.doc_id, r.score) for r in again}) == 3


def brute_models(rows):
    """Probability of every word after every word in both classes, by the formulas of the module, in plain loops."""
    D, D2, R, d = toxicity.DISCOUNT, toxicity.PAIR_DISCOUNT, toxicity.RATIO, toxicity.SHARED_DISCOUNT
    one, two = [Counter(), Counter()], [Counter(), Counter()]
    for _, text, c in rows:
        w = re.findall(r"[a-z\x80-\U0010ffff]+", (text or "").lower())
        one[c].update(set(w))
        two[c].update(set(zip(["^", *w], w)))
    words, pairs = set(one[0]) | set(one[1]), set(two[0]) | set(two[1])
    before = Counter()
    for c in (0, 1):
        for (_, w), k in two[c].items():
            before[w] += k
    n = [sum(x.values()) for x in one]
    shared = {w: (before[w] - d + d * len(words) / (len(words) + 1)) / sum(before.values()) for w in words}

    def excess(c, w):
        return max(0, one[c][w] / n[c] - max(D / min(n), R * one[1 - c][w] / n[1 - c]))

    free = [1 - sum(excess(c, w) for w in words) for c in (0, 1)]
    p = [{w: excess(c, w) + free[c] * shared[w] for w in words} for c in (0, 1)]
    total = [Counter(), Counter()]
    for c in (0, 1):
        for (v, _), k in two[c].items():
            total[c][v] += k

    def pair_excess(c, v, w):
        share = [two[k][v, w] / total[k][v] if total[k][v] else 0 for k in (0, 1)]
        return max(0, share[c] - max(D2 * n[c] / min(n) / total[c][v], R * share[1 - c], R * p[c][w])) if total[c][v] else 0

    kept = [Counter(), Counter()]
    for v, w in pairs:
        for c in (0, 1):
            kept[c][v] += pair_excess(c, v, w)

    def prob(c, v, w):
        return (pair_excess(c, v, w) if (v, w) in pairs else 0) + (1 - kept[c][v]) * p[c][w]

    return prob, words, free


def test_toxicity_against_brute_force(spark):
    rnd = random.Random(11)
    rows = []
    for i in range(240):
        w = [rnd.choice("abcdefghij") + rnd.choice("klm") for _ in range(rnd.randint(0, 30))]
        if i % 3 == 0:
            w += ["go", "away"] * rnd.randint(0, 2) + ["vermin"] * rnd.randint(0, 2)
        elif i % 3 == 1:
            w += ["do", "stay", "go", "on"]
        rnd.shuffle(w) if i % 2 else None
        rows.append((i, " ".join(w), int(i % 3 == 0)))
    frame_ = frame(spark, rows, "id long, text string, toxic int").withColumn("part", F.lit(0))
    table, constant = toxicity.gains(toxicity.count(frame_), *toxicity.PARTS[0])
    hashed = toxicity.gains(toxicity.count(frame_, 0), *toxicity.PARTS[0])
    assert hashed[1] == constant and sorted(map(str, hashed[0].collect())) == sorted(map(str, table.collect()))
    prob, words, free = brute_models(rows)
    # both are distributions, but for the share of words never seen
    for c in (0, 1):
        for v in ("^", "go", "ak", "unseen"):
            assert 0.99 < sum(prob(c, v, w) for w in words) <= 1 + 1e-9
    assert abs(constant - np.log(free[1] / free[0])) < 1e-12 and table.count() > 4
    want = {}
    for i, text, _ in rows:
        w = text.split()
        want[i] = sum(np.log(prob(1, v, x) / prob(0, v, x)) for v, x in zip(["^", *w], w)) / max(len(w), 1)
    for most in (1 << 20, 0):
        got = {r.id: r.ratio for r in toxicity.ratios(frame_, table, constant, most=most).collect()}
        assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in want)


def test_toxicity_counts_every_word_and_pair(spark):
    rnd = random.Random(12)
    rows = []
    for i in range(60):
        w = [rnd.choice("abcdefgh") + rnd.choice("klm") for _ in range(rnd.randint(0, 12))]
        rows.append((i, " ".join([*w, f"once{chr(97 + i % 26)}{chr(97 + i // 26)}"] if i % 4 else w), int(i % 3 == 0)))
    frame_ = frame(spark, rows, "id long, text string, toxic int").withColumn("part", F.lit(0))
    one, two, before = [Counter(), Counter()], [Counter(), Counter()], Counter()
    for _, text, c in rows:
        w = text.split()
        one[c].update(set(w))
        two[c].update(set(zip(["^", *w], w)))
    for c in (0, 1):
        for (_, w), k in two[c].items():
            before[w] += k
    d, words = toxicity.WHOLE_DISCOUNT, set(one[0]) | set(one[1])
    s = toxicity.SHARED_DISCOUNT
    shared = {w: (before[w] - s + s * len(words) / (len(words) + 1)) / sum(before.values()) for w in words}

    def prob(c, v, w):
        n, after = sum(one[c].values()), {x: k for (u, x), k in two[c].items() if u == v}
        lower = max(one[c][w] - d, 0) / n + d * len(one[c]) / n * shared[w]
        total = sum(after.values())
        return max(after.get(w, 0) - d, 0) / total + d * len(after) / total * lower if total else lower

    for v in ("^", "ak", "unseen"):
        assert all(0.98 < sum(prob(c, v, w) for w in words) <= 1 + 1e-9 for c in (0, 1))
    table, constant = toxicity.gains(toxicity.count(frame_), *toxicity.PARTS[0], toxicity.WHOLE)
    pairs = set(two[0]) | set(two[1])
    # a row for every word, every context and every pair, seen once or often, in either class
    assert table.count() == len(words) + len({v for v, _ in pairs}) + len(pairs)
    want = {i: sum(np.log(prob(1, v, x) / prob(0, v, x)) for v, x in zip(["^", *text.split()], text.split())) / max(len(text.split()), 1) for i, text, _ in rows}
    # all keys broadcast, the commonest broadcast, none
    for most in (1 << 20, 60, 0):
        got = {r.id: r.ratio for r in toxicity.ratios(frame_, table, constant, most=most).collect()}
        assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in want)
    # and the operator's own table has them all
    labelled = frame(spark, rows, "id long, text string, toxic int")
    assert toxicity.train(labelled).gains.where("gain <> 0").count() > 0.9 * table.count()


def test_toxicity_packs_its_pairs(spark):
    """All pairs on little disk, with the scores that the table of all gains leads to."""
    from foliospark.llm import common

    rnd = np.random.default_rng(13)
    v = np.array([f"{a}{b}{c}" for a in "abcdefghijklm" for b in "aeiou" for c in "nopqrstuvw"])
    rows = [(i, " ".join(v[np.minimum(rnd.zipf(1.3, 120) - 1, len(v) - 1)]), int(i % 3 == 0)) for i in range(1500)] + [(-1, None, 0), (-2, "", 1)]
    pairs = {p for _, text, _ in rows for w in [(text or "").split()] for p in zip(["^", *w], w)}
    labelled = frame(spark, rows, "id long, text string, toxic int")
    docs = frame(spark, [(i, t) for i, t, _ in rows] * 2 + [(9000, "unheard ann of"), (9001, "ann"), (9002, "unheard")], "doc_id long, text string")
    common.drop_tables(spark)
    model = toxicity.train(labelled)
    got = {(r.doc_id, r.score) for r in toxicity.score(docs, model).collect()}
    size = sum(os.path.getsize(os.path.join(d, f)) for p in common._written for d, _, names in os.walk(p.removeprefix("file:")) for f in names)
    assert len(pairs) > 20_000 and size < 12 * len(pairs)
    # sums run in another order: equal texts have equal scores even so
    assert len(got) == len(rows) + 3
    table = toxicity.ratios(docs.withColumnRenamed("doc_id", "id"), *model.table())
    want = {r.id: 1 / (1 + np.exp(-(r.ratio + model.offset))) for r in table.collect()}
    assert all(abs(want[i] - s) < 1e-9 for i, s in got)


def test_packed_arrays_come_back():
    from foliospark.llm import common

    a, b, c = np.array([0, 1, 255, 256, 1 << 40]), np.array([-1.5, 0.0, 3e300]), np.zeros(0, np.int64)
    x, y, z = common.unpack(common.pack(a, b, c))
    assert (x == a).all() and (y.view(np.float64) == b).all() and len(z) == 0 and len(common.unpack(common.pack(c))[0]) == 0
    code = np.unique(np.random.default_rng(1).integers(0, 5, 200) << toxicity._WORD_BITS | np.random.default_rng(2).integers(0, 1000, 200))
    assert (toxicity._unpack_pairs(toxicity._pack_pairs(code))[0] == code).all()
    assert not len(toxicity._unpack_pairs(toxicity._pack_pairs(code[:0]))[0])


def test_ratios_of_repeated_and_null_ids(spark):
    words = ["scoundrel", "wretch", "vermin", "cur"]
    keys = pa.array(toxicity._words(pa.array(words))[0]).to_pylist()
    gains = spark.createDataFrame([(h, 1.0 + i) for i, h in enumerate(keys)], "key long, gain double")
    docs = frame(spark, [(1, "a wretch"), (1, "a wretch"), (1, "cur and vermin"), (None, "scoundrel"), (None, "a b"), (None, None), (2, "x")], "id long, text string")
    got = []
    for most in (1 << 20, 1):
        out = toxicity.ratios(docs, gains, -0.25, most=most)
        assert out.columns == ["id", "ratio"]
        got.append(sorted((str(r.id), round(r.ratio, 9)) for r in out.collect()))
    assert got[0] == got[1] and len(got[0]) == 7


# ---- 5 pieces
TEXTS = ["", " ", "Hello  wörld\n\nfoo\t bar ", "a" * 3000, " " * 23, "x" + " " * 16 + "y", "😀 test \x00 nul\x00", "<s> </s> <0x0A> <unk>", "bababababa aaaa zzzzzz", "Straße ñandú 日本語", "　 ﬁ½"]


def test_pieces_equal_the_library_and_round_trip():
    import sentencepiece

    own, sp = sentencepieces.pieces(sentencepieces.MODEL), sentencepiece.SentencePieceProcessor(model_file=sentencepieces.MODEL)
    rnd = random.Random(1)
    texts = TEXTS + ["".join(rnd.choice("abetinoru 的 \n") for _ in range(rnd.randint(1, 90))) for _ in range(500)]
    ids, at = own.encode(texts)
    assert [ids[a:b].tolist() for a, b in itertools.pairwise(at)] == sp.encode(texts)
    literal = [*texts, "▁a ▁▁ b▁"]
    ids, at = own.encode(literal)
    assert own.decode(ids, at) == literal


def test_pieces_in_small_indexes(monkeypatch):
    own = sentencepieces.pieces(sentencepieces.MODEL)
    whole = own.encode(TEXTS)[0].tolist()
    monkeypatch.setattr(sentencepieces, "INDEX_CHARS", 40)
    assert own.encode(TEXTS)[0].tolist() == whole


def test_pieces_frames(spark):
    got = sentencepieces.encode(awkward(spark), decoded=True).withColumn("again", sentencepieces.decode(F.col("ids"))).collect()
    assert [r.decoded for r in sorted(got, key=lambda r: r.doc_id)] == [t or "" for t in AWKWARD * 2]
    assert all(r.again == r.decoded for r in got)


# ---- 6 SimHash
def brute_fingerprint(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints():
    texts = AWKWARD + ["A b", " a  b\tc\nd ", "one two three four " * 300]
    assert simhash.fingerprint_array(pa.array(texts)).tolist() == [brute_fingerprint(t) for t in texts]


def test_covering_leaves_no_pair_out():
    rnd = random.Random(0)
    for bits in (rnd.sample(range(64), 3) for _ in range(3000)):
        assert any(not any(m >> b & 1 for b in bits) for m in simhash.FIRST)
    for first, row in zip(simhash.FIRST, simhash.SECOND, strict=True):
        free = [b for b in range(64) if not first >> b & 1]
        for bits in (rnd.sample(free, 3) for _ in range(200)):
            assert any(not any(m >> b & 1 for b in bits) for m in row)
        assert all(64 - m.bit_count() <= 17 for m in row)


def linked(fp, ids):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for (a, x), (b, y) in itertools.combinations(zip(ids, fp, strict=True), 2):
        if (x ^ y).bit_count() <= 3:
            p, q = find(a), find(b)
            up[max(p, q)] = min(p, q)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("bucket", [2048, 3])
def test_near_duplicates(spark, monkeypatch, bucket):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    rnd = random.Random(6)
    base = [[f"w{rnd.randrange(400)}" for _ in range(150)] for _ in range(5)]
    rows = []
    for i in range(120):
        w = list(rnd.choice(base))
        for _ in range(rnd.randint(0, 2)):
            w[rnd.randrange(150)] = "q"
        rows.append((i * 3 % 121, " ".join(w)))
    rows += [(200 + i, t) for i, t in enumerate(AWKWARD)]
    got = {r.doc_id: r for r in simhash.near_duplicates(frame(spark, rows)).collect()}
    fp = [brute_fingerprint(t) for _, t in rows]
    assert {i: r.component_id for i, r in got.items()} == linked(fp, [i for i, _ in rows])
    assert simhash.drop_near_duplicates(frame(spark, rows)).count() == len({r.component_id for r in got.values()})


@pytest.mark.parametrize("n,bits", [(2, 4), (300, 12), (400, 30)])
def test_spanning(n, bits):
    fp = np.unique(np.random.default_rng(n).integers(0, 1 << bits, n, dtype=np.uint64))
    want = linked(fp.tolist(), list(range(len(fp))))
    assert simhash.spanning(fp).tolist() == [want[i] for i in range(len(fp))]


def test_components(spark):
    rnd = random.Random(9)
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(rnd.randrange(200, 300), rnd.randrange(200, 300)) for _ in range(70)] + [(7, 7)]
    got = {r.node: r.component for r in components.components(frame(spark, edges, "a long, b long")).collect()}
    up = {i: i for e in edges for i in e}
    for _ in range(400):
        for a, b in edges:
            up[a] = up[b] = min(up[a], up[b])
    assert got == {i: c for i, c in up.items() if i != c}


# ---- 7 substrings
def brute_kept(rows):
    first, out = {}, {}
    for i, t in sorted(rows):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        gone = set()
        for j in range(len(w) - 19):
            if first.setdefault(tuple(w[j : j + 20]), (i, j)) != (i, j):
                gone |= set(range(j, j + 20))
        out[i] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    return out


@pytest.mark.parametrize("cap,words", [(4096, 400_000), (4, 200)])
def test_substrings(spark, monkeypatch, cap, words):
    monkeypatch.setattr(substring_dedup, "CAP", cap)
    monkeypatch.setattr(substring_dedup, "INDEX_WORDS", words)
    rnd = random.Random(5)
    v = [f"w{i}" for i in range(30)]
    say = lambda n: " ".join(rnd.choice(v) for _ in range(n))
    base = [say(60) for _ in range(4)]
    rows = []
    for i in range(120):
        near = rnd.choice(base).split()
        near[rnd.randrange(60)] = "X"
        rows.append((i, rnd.choice([rnd.choice(base), "  ".join(near), say(9) + "\n" + " ".join(base[0].split()[10:40]) + " " + say(7), "a b " * rnd.randint(0, 40)])))
    rows += [(500 + i, t) for i, t in enumerate(AWKWARD)]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring_dedup.remove_repeats(frame(spark, rows)).collect()}
    assert got == brute_kept(rows)


def test_wavelet_ranks():
    x = np.random.default_rng(0).integers(0, 37, 1000)
    m = substring_dedup.WaveletMatrix(x, 40)
    c, i = np.random.default_rng(1).integers(0, 41, 500), np.random.default_rng(2).integers(0, 1001, 500)
    assert m.rank(c, i).tolist() == [int((x[:k] == d).sum()) for d, k in zip(c, i, strict=True)]


def test_copies_of_hot_segments_are_cut_once(spark, monkeypatch):
    """A passage in changing surroundings, in 40 copies each: its windows are cut from one of them."""
    monkeypatch.setattr(substring_dedup, "CAP", 3)
    kept, materialise = {}, substring_dedup.materialise

    def spy(df, name):
        kept[name] = materialise(df, name)
        return kept[name]

    monkeypatch.setattr(substring_dedup, "materialise", spy)
    core = [f"c{i}" for i in range(30)]
    rows = [(k * 10 + j, " ".join([*(f"a{j}x{i}" for i in range(25)), *core, *(f"b{j}x{i}" for i in range(25))])) for k in range(40) for j in range(8)]
    got = {r.doc_id: r.n_removed for r in substring_dedup.remove_repeats(frame(spark, rows)).collect()}
    assert got == {i: 0 if i == 0 else 30 if i < 10 else 80 for i, _ in rows}
    own = kept["hot-segments"]
    assert own.count() and own.agg(F.min("times")).first()[0] == 40 and kept["windows"].count() == own.agg(F.sum("n")).first()[0]


# ---- 8 languages
def test_forward_sums_all_segmentations():
    v = language_id.vocabulary(language_id.MODEL)
    where = {p: i for i, p in enumerate(v.pieces)}

    def brute(w):
        w = "▁" + w
        a = [1.0] + [0.0] * len(w)
        for j in range(1, len(w) + 1):
            for n in range(1, min(j, language_id.PIECE_CHARS) + 1):
                if w[j - n : j] in where:
                    a[j] += a[j - n] * v.prior[where[w[j - n : j]]]
            if w[j - 1] not in where:
                a[j] += a[j - 1] * language_id.UNKNOWN
        return np.log(a[-1])

    text = "the cat in 北京 thhereing ሀሁሂ ñandú"
    words = language_id.Words([text], v)
    assert np.allclose(words.likelihoods(v, v.prior[:, None])[words.of][:, 0], [brute(w) for w in text.split()])
    # expected counts are the derivative of the log likelihood by the log probability
    ex = words.expected(v, np.ones((len(words.size), 1)))[:, 0]
    for piece in ("▁the", "in", "ing"):
        p = v.prior.copy()
        p[where[piece]] *= 1 + 1e-5
        rise = (words.likelihoods(v, p[:, None]).sum() - words.likelihoods(v, v.prior[:, None]).sum()) / 1e-5
        assert abs(rise - ex[where[piece]]) < 1e-3


def test_vocabulary_is_whole():
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=language_id.MODEL)
    usual = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
    v = language_id.vocabulary(language_id.MODEL)
    assert v.pieces == usual
    prior = dict(zip(usual, v.prior, strict=True))
    whole = [p for p in usual if len(p) > 8 and p[0] == "▁" and p[1:].isalpha() and p.islower()]
    assert len(whole) > 1000

    def brute(w):
        a = [1.0] + [0.0] * len(w)
        for j in range(1, len(w) + 1):
            a[j] = sum(a[i] * prior.get(w[i:j], 0.0) for i in range(j)) + (a[j - 1] * language_id.UNKNOWN if w[j - 1] not in prior else 0.0)
        return np.log(a[-1])

    words = language_id.Words([" ".join(p[1:] for p in whole)], v)
    assert np.allclose(words.likelihoods(v, v.prior[:, None])[words.of][:, 0], [brute(p) for p in whole])


@needs_data
def test_languages_held_out(spark):
    rows = queries.op8_language_id(spark, SF).join(queries.table(spark, SF, "documents").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.95 * len(rows)


def test_languages_awkward(spark):
    train = frame(spark, [("en", "the house and the dog"), ("de", "das haus und der hund"), (None, "x"), ("fr", None)], "lang string, text string")
    langs, p = language_id.train(train)
    assert langs == ["de", "en"]
    got = {r.doc_id: r for r in language_id.predict(awkward(spark), langs, p).collect()}
    assert [got[i].lang_pred for i in (0, 1, 2, 3, 7, 8)] == ["und"] * 6 and got[9].lang_pred == "en" and all(0 <= r.score <= 1 for r in got.values())
    assert language_id.predict(awkward(spark), *language_id.train(train.where("false"))).where("lang_pred <> 'und'").count() == 0


# ---- 9 PII
BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"), "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def brute_base(t):
    out = []
    for k, r in BASE.items():
        for m in r.finditer(t):
            d = re.sub("[^0-9]", "", m[0])
            bad = {"ip": lambda: any(int(x) > 255 for x in m[0].split(".")), "card": lambda: not (12 <= len(d) <= 19 and pii.luhn(d)), "phone": lambda: not 9 <= len(d) <= 15}.get(k, lambda: False)
            if not bad():
                out.append((k, *m.span()))
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


def test_base_identifiers():
    rnd = random.Random(3)
    for _ in range(20000):
        t = "".join(rnd.choice("a.@1 23+-()._x\n456") for _ in range(rnd.randint(0, 60)))
        assert [s[:3] for s in pii.find(t) if s[3]] == brute_base(t)


@pytest.mark.parametrize("text,kind,span", [
    ("mail bob [at] example [dot] com now", "email", "bob [at] example [dot] com"), ("bob.smith at example dot co dot uk!", "email", "bob.smith at example dot co dot uk"), ("x bob＠example．com y", "email", "bob＠example．com"),
    ("bоb@exаmple.com", "email", "bоb@exаmple.com"), ("call plus one five five five two three four five six seven eight ok", "phone", "plus one five five five two three four five six seven eight"),
    ("ip １９２.168.0.1", "ip", "１９２.168.0.1"), ("one nine two dot one six eight dot zero dot one", "ip", "one nine two dot one six eight dot zero dot one"), ("call +1 (2​55) 555-8013", "phone", "+1 (2​55) 555-8013"),
    ("bob(at)example.com", "email", "bob(at)example.com"), ("bob@example dot com", "email", "bob@example dot com"),
    ("write bob at example.com now", "email", "bob at example.com"), ("call five five five one two three four five six", "phone", "five five five one two three four five six"),
    ("bob    at    example    dot    com", "email", "bob    at    example    dot    com"), ("b" * 70 + " at " + "e" * 70 + " dot com", "email", "b" * 70 + " at " + "e" * 70 + " dot com"),
    ("ip 192    dot    168 dot 0 dot 1", "ip", "192    dot    168 dot 0 dot 1"), ("one     nine two dot one six eight    dot zero dot one", "ip", "one     nine two dot one six eight    dot zero dot one"),
])
def test_disguises(text, kind, span):
    assert [(k, text[a:b]) for k, a, b, base in pii.find(text) if not base] == [(kind, span)]


@pytest.mark.parametrize("text,kind", [
    *((f"john@example{a}.{z}com", "email") for a, z in ("[]", "()", "{}", "<>")), *((f"192{a}.{z}168{a}.{z}0{a}.{z}1", "ip") for a, z in ("[]", "()", "{}", "<>")),
    *((f"john{a}{w}{z}example.com", "email") for a, z in ("[]", "()", "{}", "<>") for w in ("@", " @ ", "at", " at ", " AT", "arroba")), ("john[ arroba ]example[ . ]com", "email"), ("bob at example poİnt com", "email"),
])
def test_disguises_without_another_trigger(text, kind):
    assert pii.find(text) == [(kind, 0, len(text), False)]


@pytest.mark.parametrize("text,kind,span", [
    ("ip 192 dot 168 dot 0 dot 1 up", "ip", "192 dot 168 dot 0 dot 1"), ("call +1 (two one two) 555-0143.", "phone", "+1 (two one two) 555-0143"), ("192 punto one six eight punto 0.1", "ip", "192 punto one six eight punto 0.1"),
    ("plus one (two one two) 555 0143", "phone", "plus one (two one two) 555 0143"), ("+one two one two 555-0143", "phone", "+one two one two 555-0143"), ("one dot two dot 3 dot 4", "ip", "one dot two dot 3 dot 4"),
    ("card 4111 1111 1111 one one 11 ok", "card", "4111 1111 1111 one one 11"), ("+1 two (one) (two) 555-0143", "phone", "+1 two (one) (two) 555-0143"), ("one nine two dot one six eight dot 0 dot 1", "ip", "one nine two dot one six eight dot 0 dot 1"),
    # a word beside a span found before neither widens nor breaks it
    ("at １９２.168.0.1 one", "ip", "１９２.168.0.1"), ("call +1 (2\u200b55) 555-8013 one", "phone", "+1 (2\u200b55) 555-8013"), ("card 4111\u200b 1111 1111 1111 one", "card", "4111\u200b 1111 1111 1111"),
])
def test_disguises_beside_figures(text, kind, span):
    assert [(k, text[a:b]) for k, a, b, base in pii.find(text) if not base] == [(kind, span)]


@pytest.mark.parametrize("text", ["we paid 3 point 5 plus one, in 2023, two of 40 got 7", "version 1 dot 2 dot 3", "300 dot 168 dot 0 dot 1", "one " * 3 + "a+b"])
def test_clean_figures(text):
    assert pii.find(text) == []


@pytest.mark.parametrize("text", ["we met at noon. the dot com boom", "look at one two three", "at home", "точка и запятая", "El punto de vista", "le point est clair"])
def test_clean_texts(text):
    assert pii.find(text) == []


def test_identifiers_frame(spark):
    got = pii.identifiers(awkward(spark)).collect()
    assert len(got) == 20 and all(r.spans == [] for r in got)
    assert pii.find("1" * 200_000 + "." * 5) == [] and pii.find("a" * 200_000 + "@") == []
    for odd in (" " * 200_000, " " * 100_000 + "at" + " " * 100_000, "one " * 20_000 + "," * 100_000 + " two", "[ " * 50_000, "a at " * 40_000, "1 dot " * 40_000, "a." * 100_000):
        assert all(a < b for _, a, b, _ in pii.find(odd))


# ---- 10 exact
@pytest.mark.parametrize("limit", [500_000, 0])
def test_exact(spark, monkeypatch, limit):
    monkeypatch.setattr(exact_dedup, "BROADCAST_KEYS", limit)
    rows = [(i, t) for i, t in enumerate(AWKWARD * 3 + ["x" * 64 + "a", "x" * 64 + "b"])]
    got = {r.doc_id: r for r in exact_dedup.exact_duplicates(frame(spark, rows)).collect()}
    for i, t in rows:
        same = [j for j, s in rows if (s or "") == (t or "")]
        assert (got[i].keep_id, got[i].group_size, got[i].kept) == (max(same), len(same), i == max(same))
    left = exact_dedup.drop_exact_duplicates(frame(spark, rows))
    assert sorted(r.doc_id for r in left.collect()) == sorted(i for i, r in got.items() if r.kept)


def test_empty_tables(spark):
    none = frame(spark, [], "doc_id long, text string, keep_id int, lang string")
    assert exact_dedup.exact_duplicates(none).count() == 0 and simhash.near_duplicates(none).count() == 0
    assert substring_dedup.remove_repeats(none).count() == 0 and pii.identifiers(none).count() == 0
    assert sentencepieces.encode(none).count() == 0 and decontaminate.contamination(none, frame(spark, [], "item_id long, text string")).count() == 0
    assert chat_format.format_conversations(frame(spark, [], "conv_id long, turn long, role string, text string")).count() == 0


CLASHES = ("id", "_id", "_row", "_text", "_len", "_prefix", "_full", "key", "gain", "n", "anchor", "seg", "pos", "fp", "rep", "spans", "items", "ids", "score", "host", "path", "own", "rule", "digest", "short", "lang_pred", "ratio", "part", "places")


def clashing(spark):
    """Repeated rows, null and shared ids, odd texts, and columns named like those that operators make."""
    rows = [(i, t) for i, t in enumerate(AWKWARD[1:])] * 2 + [(None, "a"), (None, None), (3, "another text"), (None, "w " * 60)]
    return frame(spark, rows).select("doc_id", *(F.lit("x").alias(c) for c in CLASHES), "text")


@pytest.mark.parametrize("name", ["contamination", "score", "encode", "near_duplicates", "remove_repeats", "predict", "identifiers", "exact_duplicates", "filter_urls"])
def test_repeated_null_and_clashing(spark, name):
    docs = clashing(spark)
    n = docs.count()
    run = {
        "contamination": lambda d: decontaminate.contamination(d, frame(spark, [(1, "w " * 20), (None, "a"), (2, None), (2, "é")], "item_id long, text string")),
        "score": lambda d: toxicity.score(d, toxicity.train(toxicity.labelled(d, frame(spark, [(1, 1), (2, 0), (3, 1), (8, 0)], "doc_id long, toxic int")))),
        "encode": lambda d: sentencepieces.encode(d, decoded=True).select("doc_id", "ids", "decoded"),
        "near_duplicates": simhash.near_duplicates, "remove_repeats": substring_dedup.remove_repeats,
        "predict": lambda d: language_id.predict(d, *language_id.train(d.withColumn("lang", F.lit("en")))),
        "identifiers": pii.identifiers, "exact_duplicates": exact_dedup.exact_duplicates,
        "filter_urls": lambda d: url_filter.filter_urls(d.withColumn("url", F.col("text")), "doc_id"),
    }[name]
    out = run(docs).collect()
    assert len(out) == n
    # what a row gets is told by its id and text: repeated rows get the same
    assert Counter(r.doc_id for r in out) == Counter(r.doc_id for r in docs.collect())
    same = [tuple(map(str, r)) for r in out if r.doc_id in (0, 1, 4, 5)]
    assert name == "remove_repeats" or all(c % 2 == 0 for c in Counter(same).values())
    assert run(docs.where("false")).count() == 0


def test_tables_are_dropped(spark):
    from foliospark.llm import common

    kept = common.materialise(frame(spark, [(1, "a")]), "t")
    path = kept.inputFiles()[0].removeprefix("file:").rsplit("/", 1)[0].lstrip("/")
    assert os.path.isdir(f"/{path}")
    common.drop_tables(spark)
    assert not os.path.isdir(f"/{path}") and not common._written


# ---- against SQL
@needs_data
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    own, other = queries.QUERIES[name](spark, SF).toArrow(), con.sql(queries.ORACLE_SQL[name]).to_arrow_table()
    rows = lambda t: sorted(map(repr, zip(*[t.column(c).to_pylist() for c in sorted(t.column_names)], strict=True)))
    assert sorted(own.column_names) == sorted(other.column_names) and rows(own) == rows(other)


# ---- pipeline
@needs_data
def test_pipeline(spark):
    import corpus_pipeline

    docs = {r.doc_id: r.text for r in queries.table(spark, SF, "documents").collect()}
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    lang = {r.doc_id: r for r in queries.op8_language_id(spark, SF).collect()}
    kept = {i: t for i, t in docs.items() if lang[i].lang_pred != "und" and lang[i].score > corpus_pipeline.LEAST_SCORE}
    last = {}
    for i in sorted(kept):
        last[kept[i]] = i
    kept = {i: t for t, i in last.items()}
    classes = linked([brute_fingerprint(kept[i]) for i in sorted(kept)], sorted(kept))
    kept = {i: t for i, t in kept.items() if classes[i] == i}
    bench = [(r.item_id, r.text) for r in queries.table(spark, SF, "benchmark").collect()]
    bad = brute_contamination(list(kept.items()), bench)
    kept = {i: t for i, t in kept.items() if not (bad[i][1] > 0 and 20 * bad[i][1] >= bad[i][0])}
    assert set(got) == set(kept)
    assert all(r.decoded_sha256 == hashlib.sha256(kept[i].encode()).hexdigest() for i, r in got.items())


def test_pipeline_stages_awkward(spark):
    import corpus_pipeline

    odd = frame(spark, [(i, t, "en", "s", 1) for i, t in enumerate(AWKWARD * 2)], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        for docs in (odd, odd.limit(0)):
            if name != "benchmark_decontamination" or os.path.isdir(SF):
                out = stage(spark, docs, SF)
                assert out.count() <= docs.count()
                assert name == "sentencepiece" or out.columns == docs.columns


def test_null_and_shared_ids(spark):
    import corpus_pipeline

    kept = lambda out: sorted((str(r.doc_id), r.text) for r in out.collect())
    schema = "doc_id long, text string, lang string"
    good = "the house and the dog in the garden"
    rows = [(i, good, "en") for i in range(10, 20)] + [(20, "das haus und der hund im garten", "de"), (None, "123", "en"), (None, good, "en"), (5, "!!", "en"), (5, good, "en")]
    out = corpus_pipeline.language_stage(spark, frame(spark, rows, schema), SF)
    assert kept(out) == sorted((str(i), t) for i, t, _ in rows if t not in ("123", "!!"))
    a, b, c = ("a1 a2 a3 a4 a5 " * 3).strip(), ("b1 b2 b3 b4 b5 " * 3).strip(), "c1 c2 c3"
    docs = frame(spark, [(1, a), (1, b), (2, a), (None, a), (None, c), (None, c), (3, "d"), (3, "d"), (None, None), (None, "")])
    rest = [("None", ""), ("None", None), ("None", c), ("None", c), ("3", "d"), ("3", "d")]
    by = lambda x: sorted(x, key=str)
    got = lambda out: by((str(r.doc_id), r.text) for r in out.collect())
    assert got(exact_dedup.drop_exact_duplicates(docs)) == by([*rest, ("1", b), ("2", a)])
    assert got(simhash.drop_near_duplicates(docs)) == by([*rest, ("1", a), ("1", b)])
    bench = frame(spark, [(0, a)], "item_id long, text string")
    assert got(decontaminate.decontaminate(docs, bench)) == by([*rest, ("1", b)])
