"""The corpus operators against brute force, on awkward rows and on the smallest test data."""

import collections
import hashlib
import math
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from tidelog.llm import components as graph
from tidelog.llm import decontamination, license_scan, ngram_join, queries, sentencepiece, substring_dedup, suffix_tree, toxicity, wordhash

DATA = "/root/testdata/sf0.001"
LOW = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
SCHEMA = "doc_id bigint, text string, id string, body int, kept string, cls int, n double"
EXTRA = ("x", 1, "k", 2, 0.5)


def frame(spark, rows):
    """Documents with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, *EXTRA) for i, t in rows], SCHEMA)


def awkward():
    rng = random.Random(5)
    words = ["the", "of", "And", "x", "yy", "zzz", "Ünder", "日本", "a-b", "q,"]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared, base = line(40), line(60)
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one two"), (6, "ONE two"), (7, base), (8, base), (9, base + " tail"), (10, line(30) + " " + shared), (11, shared + "\n" + line(9)), (12, shared)]
    rows += [(13, line(20_000)), (14, "w " * 300), (15, "w " * 300), (16, base.replace("zzz", "zz", 1)), (17, "\u00a0nbsp\u00a0stays one\x0bword\x0ctoo"), (18, line(13)), (19, "  lead and trail  "), (20, "▁mark ▁ <s> é\x00z")]
    return rows


def documents():
    return duckdb.sql(f"SELECT doc_id, text FROM '{DATA}/documents.parquet' ORDER BY doc_id").fetchall()


@pytest.fixture(scope="module", params=["awkward", "data"])
def rows(request):
    return awkward() if request.param == "awkward" else documents()


def words(text):
    return (text or "").encode().split()


def test_words_by_arrays(rows):
    import pyarrow as pa

    for lower in (False, True):
        column = pa.array([t.encode() if t is not None else None for _, t in rows], pa.binary())
        found = collections.defaultdict(list)
        for w in wordhash.hashed(column, lower):
            for k, (at, n) in enumerate(zip(w.base, w.count)):
                found[w.first + k] = w.hashes[at : at + n].tolist()
        seen = {}
        for k, (_, t) in enumerate(rows):
            own = words(t.translate(LOW) if t and lower else t)
            assert len(own) == len(found[k])
            for w, h in zip(own, found[k]):
                assert seen.setdefault(w, h) == h
        assert len(set(seen.values())) == len(seen)


# ---- 1


def test_substring_dedup(spark, rows):
    got = {r.doc_id: r for r in substring_dedup.dedup_substrings(frame(spark, rows)).collect()}
    first = {}
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k : k + 13]), i)
    for i, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] < i:
                gone[k : k + 13] = [True] * 13
        text = b" ".join(x for x, g in zip(w, gone) if not g)
        r = got[i]
        assert (r.n_words, r.n_removed, r.kept_sha256) == (len(w), sum(gone), hashlib.sha256(text).hexdigest())
        assert sum(e - s for s, e in zip(r.starts, r.ends)) == r.n_removed
        assert r.kept == (text.decode() if r.n_removed else t)


def test_substring_dedup_edges(spark):
    passage = " ".join(f"w{i}" for i in range(30))
    assert substring_dedup.dedup_substrings(frame(spark, [])).count() == 0
    out = substring_dedup.dedup_substrings(frame(spark, [(5, passage), (5, passage), (9, passage), (None, passage)]), carry=("body", "n")).collect()
    assert sorted((r.doc_id is None, r.doc_id, r.n_removed, r.carried.body) for r in out) == [(False, 5, 0, 1), (False, 5, 0, 1), (False, 9, 30, 1), (True, None, 0, 1)]


def test_substring_sources_across_batches():
    """First places are carried over batch borders, for any way of cutting the sorted pieces."""
    import pyarrow as pa

    rng = random.Random(2)
    pieces = sorted((rng.randrange(3), d, rng.randrange(50), bytes(rng.choice(b"ab") for _ in range(5))) for d in range(60))
    expected, seen = set(), {}
    for k, d, at, e in pieces:
        if seen.setdefault((k, e), d) < d:
            expected.add((d, at))
    for step in (1, 7, 60):
        batches = [pa.RecordBatch.from_arrays([pa.array([p[c] for p in pieces[i : i + step]], kind) for c, kind in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.binary()))], ["key", "id", "at", "edges"]) for i in range(0, len(pieces), step)]
        got = {(d, a) for b in substring_dedup._sources(iter(batches)) for d, a in zip(b.column(0).to_pylist(), b.column(1).to_pylist())}
        assert got == expected


# ---- 2


def test_suffix_tree_base(spark, rows):
    got = {r.doc_id: r for r in suffix_tree.suffix_tree_scores(frame(spark, rows)).collect()}
    tokens = {i: words((t or "").translate(LOW)) + [None] for i, t in rows}
    counts = collections.Counter()
    for i, w in tokens.items():
        if zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update(w)
    n, v = sum(counts.values()), len(counts)
    for i, w in tokens.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (zlib.crc32(str(i).encode()) % 7 == 2, len(w), sum(counts[x] > 0 for x in w), n)
        assert math.isclose(r.base_score, sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w), rel_tol=1e-9)
    learned = [r for r in got.values() if not r.held_out]
    assert sum(r.score for r in learned) >= sum(r.base_score for r in learned)


def test_suffix_tree_is_a_distribution(spark):
    """The probabilities of all next tokens after a kept context sum to one, and it predicts what followed it."""
    rows = [(i, "alpha beta gamma " * 30 + f"u{i}") for i in range(60)]
    got = suffix_tree.suffix_tree_scores(frame(spark, rows))
    learned, held = got.where("NOT held_out").agg(F.sum("base_score"), F.sum("score")).first(), got.where("held_out").agg(F.sum("base_score"), F.sum("score")).first()
    assert learned[1] > learned[0] * 0.2 and held[1] > held[0] * 0.4
    # Score texts that differ in the token after "alpha" only; the differences give the conditional distribution.
    assert suffix_tree.suffix_tree_scores(frame(spark, [])).count() == 0
    none = suffix_tree.suffix_tree_scores(frame(spark, [(None, "a b"), (None, None)])).collect()
    assert [(r.held_out, r.train_tokens, r.n_known) for r in none] == [(None, 0, 0)] * 2


def test_suffix_tree_contexts_are_tested_against_their_parents(spark):
    """Scores as by the definition; a context of two words must diverge from that of its last word, not only from the root."""
    rng = random.Random(12)
    # "z" has next words of its own and "y z" the same ones, so "y z" is no state; "p q" has others than "q".
    rows = [(i, " ".join(rng.choice([f"y z {rng.choice('abcd')}", f"x z {rng.choice('abcd')}", f"p q {rng.choice('ef')}", f"r q {rng.choice('gh')}", f"u{rng.randrange(60)}"]) for _ in range(12))) for i in range(200)]
    tokens = {i: words(t) + [None] for i, t in rows}
    one, two, three = collections.Counter(), collections.Counter(), collections.Counter()
    for i, w in tokens.items():
        if zlib.crc32(str(i).encode()) % 7 != 2:
            one.update(w)
            two.update(zip(w, w[1:]))
            three.update(zip(w, w[1:], w[2:]))
    n, v = sum(one.values()), len(one)
    eighth = lambda p: 2 ** (-min(255, round(-8 * math.log2(p))) / 8)
    share = lambda x: one[x] / n if one[x] else 1 / suffix_tree.SHARE

    def nodes(grams, mu, parent):
        below, kept = collections.defaultdict(dict), {}
        for g, c in grams.items():
            below[g[:-1]][g] = c
        for context, items in below.items():
            total = sum(items.values())
            if total > 1 and sum(c * math.log(((c - 1) / eighth(parent(g)) + mu) / (total - 1 + mu)) for g, c in items.items()) > suffix_tree.MARGIN:
                kept[context] = total
        return kept

    short = nodes(two, 4, lambda g: share(g[1]))
    below_q = {g: c for g, c in three.items() if g[1:2] in short}
    after_one = lambda g, p: (two[g] + 4 * p) / (short[g[:1]] + 4)
    long = nodes(below_q, 2, lambda g: after_one(g[1:], share(g[2])))
    assert (b"z",) in short and (b"p", b"q") in long and (b"y", b"z") not in long
    got = {r.doc_id: r for r in suffix_tree.suffix_tree_scores(frame(spark, rows)).collect()}
    for i, w in tokens.items():
        score = 0.0
        for k, x in enumerate(w):
            p = (one[x] + 1) / (n + v + 1)
            if k and (w[k - 1],) in short:
                p = after_one((w[k - 1], x), p)
                if k > 1 and (total := long.get((w[k - 2], w[k - 1]))):
                    p = (three[w[k - 2], w[k - 1], x] + 2 * p) / (total + 2)
            score += math.log10(p)
        assert math.isclose(got[i].score, score, rel_tol=1e-9)


@pytest.mark.parametrize("size", [100 << 20, 3 << 30])
def test_suffix_tree_scores_do_not_depend_on_the_input_size(spark, monkeypatch, size):
    """Contexts that would overfill a counting task pass the same test as others, so a larger estimate changes no score."""
    rng = random.Random(9)
    common = lambda: " ".join(rng.choice("the of and in to a".split()) for _ in range(8))
    rows = documents() + [(10_000 + i, f"{common()} r{rng.randrange(400)} {common()}") for i in range(300)]
    scores = lambda: {r.doc_id: r.score for r in suffix_tree.suffix_tree_scores(frame(spark, rows)).collect()}
    small = scores()
    monkeypatch.setattr(suffix_tree, "input_bytes", lambda df: size)
    large = scores()
    assert small.keys() == large.keys() and all(math.isclose(small[i], large[i], rel_tol=1e-9) for i in small)


# ---- 4


def brute_components(rows, n, percent):
    up = {}

    def root(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    sets = {}
    for i, t in rows:
        w = words((t or "").translate(LOW))
        sets[i] = frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])
    ids = sorted(sets)
    for x in range(len(ids)):
        for y in range(x):
            a, b = sets[ids[x]], sets[ids[y]]
            both = len(a & b)
            if both and 100 * both >= percent * (len(a) + len(b) - both):
                p, q = root(ids[x]), root(ids[y])
                if p != q:
                    up[max(p, q)] = min(p, q)
    return {i: (len(s), root(i)) for i, s in sets.items()}


@pytest.mark.parametrize("n,percent", [(3, 90), (5, 80)])
def test_ngram_join(spark, rows, n, percent):
    got = ngram_join.jaccard_components(frame(spark, rows), shingle=n, percent=percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows, n, percent)


def test_ngram_join_of_a_near_copy_family(spark):
    """Several hundred variants of one text, some linked through others only, and unlinked ones that share rare passages."""
    rng = random.Random(11)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(260):
        w = list(base)
        for _ in range(rng.randrange(0, 6)):
            w[rng.randrange(len(w))] = f"r{rng.randrange(12)}"
        rows.append((i, " ".join(w)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(frame(spark, rows)).collect()}
    assert got == brute_components(rows, 3, 90)


def test_ngram_join_edges(spark):
    assert ngram_join.jaccard_components(frame(spark, [])).count() == 0
    assert ngram_join.jaccard_components(frame(spark, [(1, None), (2, "")])).count() == 2
    out = ngram_join.jaccard_components(frame(spark, [(3, "a b c d"), (3, "a b c d"), (7, "a b c d"), (None, "a b c d")])).collect()
    assert sorted((r.doc_id or -1, r.component_id) for r in out) == [(-1, None), (3, 3), (3, 3), (7, 3)]


def test_crowded_groups_across_batches():
    import pyarrow as pa

    rng = random.Random(4)
    rows = sorted((rng.randrange(12), rng.randrange(3), rng.randrange(5, 8), rng.randrange(6)) for _ in range(60))
    classes = collections.defaultdict(set)
    for t, _, _, c in rows:
        classes[t].add(c)
    wanted = {r for r in rows if len(classes[r[0]]) > 1}
    for step in (1, 3, 60):
        batches = [pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows[i : i + step]], kind) for c, kind in enumerate((pa.int64(), pa.int32(), pa.int32(), pa.int64()))], ["token", "pos", "n", "cls"]) for i in range(0, len(rows), step)]
        got = [tuple(r.values()) for b in ngram_join._crowded(iter(batches)) for r in b.to_pylist()]
        assert {(t, c) for t, _, _, c in got} == {(t, c) for t, _, _, c in wanted}


@pytest.mark.parametrize("limit", [400_000, 40])
def test_components(spark, monkeypatch, limit):
    monkeypatch.setattr(graph, "TASK_EDGES", limit)
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(1000, 1100)] + [(5, 5), (None, 2)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    forest = graph.Forest()
    for a, b in edges:
        if a is not None and a != b:
            forest.join(a, b)
    for x in {x for e in edges for x in e if x is not None}:
        assert got.get(x, x) == forest.root(x)


# ---- 5


def test_license_scan(spark):
    known = license_scan.templates()
    mit = next(t for n, t in known if n == "MIT" and len(t) > 500)
    changed = mit.replace("free of charge", "at no cost").replace("sublicense", "relicense")
    rows = [(1, None), (2, ""), (3, "no licence here, of the and"), (4, f"some words {mit} more words"), (5, changed), (6, "x\nLicensed under CC BY-NC 4.0.\ny\nReleased under the MIT License."), (7, mit[:200]), (8, "Licensed under CC BY-SA 4.0.")]
    got = {r.doc_id: r for r in license_scan.license_matches(frame(spark, rows)).collect()}
    assert [got[i].license for i in range(1, 9)] == [None, None, None, "MIT", "MIT", "CC-BY-NC-4.0", None, "CC-BY-SA-4.0"]
    assert got[4].dice == 1.0 and 0.8 <= got[5].dice < 1 and got[6].n_passages == 2
    assert license_scan.license_matches(frame(spark, [])).count() == 0


def test_license_scan_finds_what_brute_force_finds():
    """No passage reaches the threshold where none was found; a found one's coefficient is right."""
    rng = random.Random(8)
    template = [f"t{i}" for i in range(9)]
    scan = license_scan.DiceScanner([("T", " ".join(template))])
    target = set(zip(template, template[1:]))
    for _ in range(150):
        w = [rng.choice([*template, "x", "y"]) if rng.random() < 0.4 else template[i % 9] for i in range(rng.randrange(2, 20))]
        best = 0.0
        for a in range(len(w)):
            for b in range(a + 2, len(w) + 1):
                own = set(zip(w[a:b], w[a + 1 : b]))
                best = max(best, 2 * len(own & target) / (len(own) + len(target)))
        found = scan.passages(" ".join(w).encode())
        assert (max((f[1] for f in found), default=0.0) if best >= 0.8 else bool(found)) == pytest.approx(best if best >= 0.8 else 0)


# ---- 6


def test_sentencepiece(spark, rows):
    import sentencepiece as library

    model = library.SentencePieceProcessor(model_file=sentencepiece.model_path())
    got = {r.doc_id: r for r in sentencepiece.piece_tokens(frame(spark, rows)).collect()}
    for i, t in rows:
        ids = model.encode(t or "")
        back = model.decode(ids)
        r = got[i]
        assert (r.n_tokens, list(r.ids), r.decoded) == (len(ids), ids, back)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(back.encode()).hexdigest()
    assert sentencepiece.piece_tokens(frame(spark, [])).count() == 0


def test_sentencepiece_random():
    import sentencepiece as library

    model = library.SentencePieceProcessor(model_file=sentencepiece.model_path())
    codec = sentencepiece.codec(sentencepiece.model_path())
    rng = random.Random(1)
    for _ in range(1500):
        t = "".join(rng.choice(" \n▁abehtÀé日0123,.$%<\r\t𝔘") for _ in range(rng.randrange(40)))
        assert codec.encode(t) == model.encode(t)
        assert codec.decode(model.encode(t)) == model.decode(model.encode(t))
    for t in ("a" * 3000, " " * 37 + "x" + " " * 21, "ab" * 900):
        assert codec.encode(t) == model.encode(t)


def test_sentencepiece_pieces_over_a_punctuation_tail():
    """Pieces that hold a character beyond ASCII and then a mark: ``”.``, ``»,``, ``…]`` and the like."""
    import sentencepiece as library

    model = library.SentencePieceProcessor(model_file=sentencepiece.model_path())
    codec = sentencepiece.codec(sentencepiece.model_path())
    over = sorted(p for p in codec.ids if re.search(r"[^\x00-\x7f▁][!-/:-@\[-`{-~\n]", p))
    assert "”." in over and "»," in over
    texts = ["he said “yes”."] + [f"{a}{p}{b}" for p in over for a in ("", "yes", "été", "日") for b in ("", ".", " x", "?!")]
    rng = random.Random(7)
    texts += ["".join(rng.choice(["a", "be", "é", " ", "日", "“", "”", ".", ",", "\n", *over]) for _ in range(rng.randrange(30))) for _ in range(1500)]
    for t in texts:
        assert codec.encode(t) == model.encode(t), t


# ---- 9


def test_toxicity(spark):
    rng = random.Random(6)
    bad = ["blargh", "vileword", "stinko"]
    rows, labels = [], []
    for i in range(900):
        toxic = i % 4 == 0
        w = [f"n{rng.randrange(300)}" for _ in range(30)]
        if toxic and rng.random() < 0.7:
            w += rng.sample(bad, 2)
        if rng.random() < (0.9 if toxic else 0.2):
            w.append("muslim")  # a biased sample: the group is mentioned mostly in toxic texts
        rng.shuffle(w)
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    docs, marks = frame(spark, rows), spark.createDataFrame(labels, "doc_id bigint, toxic int")
    out = toxicity.train_and_score(docs, marks).join(marks, "doc_id").collect()
    held = [r for r in out if r.held_out]
    assert len(held) > 100 and sum(r.predicted == r.toxic for r in held) > 0.85 * len(held)
    fitted, plain = toxicity.fit_toxicity(docs, marks), toxicity.fit_toxicity(docs, marks, pull=0)
    own = lambda m: m.logit({b"muslim"}) - m.bias
    assert own(plain) > 0.5 and own(fitted) < 0.5 * own(plain)


def test_toxicity_edges(spark):
    one = spark.createDataFrame([(1, 0), (2, None), (77, 1)], "doc_id bigint, toxic int")
    out = toxicity.train_and_score(frame(spark, [(1, None), (2, ""), (None, "x")]), one).collect()
    assert len(out) == 3 and all(0 < r.score < 1 for r in out)
    assert toxicity.train_and_score(frame(spark, []), one).count() == 0


# ---- 10

SPLIT = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@pytest.mark.parametrize("limit", [16 << 20, 2000])
def test_decontamination(spark, rows, limit):
    items = duckdb.sql(f"SELECT item_id, text FROM '{DATA}/benchmark.parquet'").fetchall()
    items += [(9001, "one two"), (9002, None), (9003, ""), (9004, "ONE, two!"), (9005, "w"), (9006, rows[6][1]), (9007, " ".join((rows[10][1] or "").split()[:14]))]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {r.doc_id: r for r in decontamination.contamination(frame(spark, rows), bench, block_limit=limit, carry=("body",)).collect()}
    patterns = collections.defaultdict(set)
    for i, t in items:
        w = SPLIT.findall((t or "").translate(LOW))
        for k in range(max(1, len(w) - 12) if w else 0):
            patterns[tuple(w[k : k + 13])].add(i)
    sizes = {len(p) for p in patterns}
    for i, t in rows:
        w = SPLIT.findall((t or "").translate(LOW))
        hit, found = set(), set()
        for m in sizes:
            for k in range(len(w) - m + 1):
                if (p := tuple(w[k : k + m])) in patterns:
                    hit |= set(range(k, k + m))
                    found |= patterns[p]
        r = got[i]
        digest = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated, r.carried.body) == (len(w), len(hit), len(found), digest, len(hit) > 0 and 20 * len(hit) >= len(w), 1)


def test_decontamination_edges(spark):
    bench = spark.createDataFrame([], "item_id bigint, text string")
    out = decontamination.contamination(frame(spark, [(1, "a b"), (1, None)]), bench).collect()
    assert [r.contaminated for r in out] == [False, False]
    assert decontamination.contamination(frame(spark, []), bench).count() == 0


@pytest.mark.parametrize("carry", [(), ("body", "text")])
def test_decontamination_by_blocks_keeps_rows_apart(spark, carry):
    """Rows without id, and rows that share id and number of words, have their own hits, however large the benchmark."""
    bench = spark.createDataFrame([(k, f"a{k} b{k} c{k}") for k in range(9)], "item_id bigint, text string")
    rows = [(None, "a1 b1 c1 x"), (None, "x y z w"), (5, "a2 b2 c2 x"), (5, "a3 b3 c3 x"), (5, "x y z w"), (5, "a2 b2 c2 x")]
    one, many = (sorted(map(repr, decontamination.contamination(frame(spark, rows), bench, block_limit=limit, carry=carry).collect())) for limit in (16 << 20, 300))
    assert one == many


# ---- registration and pipeline


def test_names():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.queries()) == list(range(1, 11))


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    before = {r.doc_id: r.text for r in docs.collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, DATA).cache()
        rows = out.collect()
        if k < 4:
            assert out.columns == columns
        after = {r.doc_id: r.text for r in rows} if k < 4 else None
        if name == "toxicity":
            model = toxicity.fit_toxicity(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
            assert set(after) == {r.doc_id for r in toxicity.score_toxicity(docs, model).where("predicted = 0").collect()}
        elif name == "ngram_jaccard_join":
            groups = brute_components(list(before.items()), 5, 80)
            assert set(after) == {i for i, (_, c) in groups.items() if i == c}
        elif name == "substring_dedup":
            assert set(after) == set(before) and any(after[i] != before[i] for i in after)
            assert all(r.n_chars == len(r.text) for r in rows)
        elif name == "benchmark_decontamination":
            bad = {r.doc_id for r in decontamination.contamination(docs, spark.read.parquet(f"{DATA}/benchmark.parquet")).where("contaminated").collect()}
            assert set(after) == set(before) - bad
        else:
            assert {r.doc_id for r in rows} == set(before)
        before, docs = after, out
    assert corpus_pipeline.run(spark, DATA).count() == docs.count()


def test_pipeline_takes_nulls(spark):
    import corpus_pipeline

    docs = spark.createDataFrame([(1, None, "en", "s", 0), (2, "", None, None, None), (None, "a b c", "en", "s", 5)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DATA).cache()
        assert docs.count() == 3, name


def test_cleanup(spark):
    from tidelog.llm.common import cleanup, stored

    df = stored(frame(spark, [(1, "a")]))
    assert df.count() == 1
    cleanup(spark)
    with pytest.raises(Exception, match="(?i)not.*exist"):
        df.count()


def test_pipeline_decontaminates_long_documents(spark):
    """A planted benchmark passage is caught in a document of any length, and by whichever document holds it after the stages before; clean ones stay."""
    import corpus_pipeline

    rng = random.Random(21)
    item = duckdb.sql(f"SELECT text FROM '{DATA}/benchmark.parquet' ORDER BY length(text) DESC LIMIT 1").fetchall()[0][0]
    passage = " ".join(item.split()[:20])
    own = lambda n: " ".join(f"w{rng.randrange(10**9)}" for _ in range(n))
    rows = [(i, f"{own(n)} {passage} {own(n)}" if hit else own(2 * n)) for i, (n, hit) in enumerate([(5, 1), (100, 1), (3000, 1), (3000, 0), (5, 0), (400, 1)])] + [(9, None), (10, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    alone = corpus_pipeline.decontamination(spark, docs, DATA).collect()
    assert sorted(r.doc_id for r in alone) == [3, 4, 9, 10] and all(r.text == dict(rows)[r.doc_id] for r in alone)
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, DATA).cache()
    left = docs.collect()
    assert {3, 4, 9, 10} <= {r.doc_id for r in left} and not any(passage in (r.text or "") for r in left)


def test_pipeline_takes_ties_repeats_and_clashing_columns(spark):
    import corpus_pipeline

    text = " ".join(f"t{i}" for i in range(40))
    rows = [(3, text, "en", "s", 1), (3, text, "en", "s", 1), (5, text, "de", None, 1), (8, "x " * 20_000, "en", "s", 1), (8, "x " * 20_000, "en", "s", 1)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, body int, carried int, component_id string, kept string"
    for given, expected in ((rows, [3, 3, 8, 8]), ([], [])):
        docs = spark.createDataFrame([(*r, "i", 1, 2, "c", "k") for r in given], schema)
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            docs = stage(spark, docs, DATA).cache()
            assert sorted(r.doc_id for r in docs.collect()) == (sorted(r[0] for r in given) if k == 0 else expected), name
            if k < 4:
                assert docs.columns == list(corpus_pipeline.COLUMNS)


def test_ngram_join_splits_crowded_tokens(spark, monkeypatch):
    """However the sets of a token are dealt to tasks and blocks, the components stay the same."""
    rng = random.Random(23)
    rows = []
    for k in range(5):
        base = [f"f{k}b{i}" for i in range(60)] + [f"all{i}" for i in range(60)]
        for i in range(50):
            w = list(base)
            for _ in range(rng.randrange(0, 4)):
                w[rng.randrange(len(w))] = f"r{rng.randrange(12)}"
            rows.append((1000 * k + i, " ".join(w)))
    expected = brute_components(rows, 3, 90)
    monkeypatch.setattr(ngram_join, "NEAR", 1)  # few star pairs, so that many pairs are left to the crosses
    for sets in (4096, 7):
        monkeypatch.setattr(ngram_join, "CROSS_SETS", sets)
        monkeypatch.setattr(ngram_join, "GROUP_BYTES", 400)
        monkeypatch.setattr(ngram_join, "HOT", 10 if sets == 7 else 1 << 16)
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(frame(spark, rows)).collect()} == expected


def test_ngram_join_ids_with_several_texts_are_one_document(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(40)) for x in "ab")
    out = ngram_join.jaccard_components(frame(spark, [(5, a), (5, b), (3, a), (9, b), (11, "c d e f")])).collect()
    assert {(r.doc_id, r.component_id) for r in out} == {(3, 3), (5, 3), (9, 3), (11, 11)}


def test_ngram_join_sketches_rule_out_no_link():
    import numpy as np

    rng = np.random.default_rng(5)
    for n in (1, 5, 300, 6000):
        s = rng.integers(0, 2**63, n).astype(np.uint64)
        t = np.concatenate([s[: n - n // 20], rng.integers(0, 2**63, n // 30).astype(np.uint64)])
        x, y = (np.frombuffer(ngram_join.sketch(v), np.uint64) for v in (s, t))
        common = len(np.intersect1d(s, t))
        alone = lambda p, q: int(np.bitwise_count(p & ~q).sum())
        assert min(len(s) - alone(x, y), len(t) - alone(y, x)) >= common


def test_word_hashes_of_interchanged_letters_differ():
    """Words whose letters follow the Thue-Morse sequence and its complement, which polynomial hashes modulo a power of two confuse."""
    import pyarrow as pa

    word = "a"
    for _ in range(11):
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    found = [w.hashes for w in wordhash.hashed(pa.array([word.encode(), other.encode(), b"abcdefgh", b"abcdefgh\0", b"", b"abcdefghi"], pa.binary()))]
    assert len({int(h) for f in found for h in f}) == 5


def test_license_scan_of_long_and_repetitive_texts():
    import time

    known = license_scan.templates()
    scan = license_scan.DiceScanner(known)
    notice = "Released under the MIT License. "
    began = time.perf_counter()
    assert len(scan.passages((notice + "x y ") .encode() * 4000)) == 4000
    assert scan.passages(b"w " * 200_000) == []
    assert time.perf_counter() - began < 20
    # A passage that repeats its own bigrams is longer than any bound on words, and is found whole.
    template = [f"t{i}" for i in range(10)]
    stretched = license_scan.DiceScanner([("T", " ".join(template))])
    body = " ".join([*template[:5], *(["t3 t4"] * 40), *template[4:]])
    (name, dice, start, end), = stretched.passages(body.encode())
    assert (name, start, end) == ("T", 0, len(body.split())) and dice == pytest.approx(2 * 9 / (11 + 9))  # nine of the template, (t4, t3) and (t4, t4)


def test_toxicity_neutral_mentions(spark):
    """False positives on neutral mentions of a group, on held-out texts: fewer with the counterfactual penalty than without, at the same recall."""
    rng = random.Random(16)
    bad, groups = ["blargh", "vileword", "stinko"], ["muslim", "gay", "immigrant"]
    rows, labels = [], []
    for i in range(1500):
        toxic = i % 3 == 0
        w = [f"n{rng.randrange(200)}" for _ in range(25)] + (rng.sample(bad, 1) if toxic and rng.random() < 0.6 else [])
        if rng.random() < (0.85 if toxic else 0.1):
            w.append(rng.choice(groups))
        rng.shuffle(w)
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    docs, marks = frame(spark, rows), spark.createDataFrame(labels, "doc_id bigint, toxic int")
    neutral = frame(spark, [(i, " ".join([f"n{rng.randrange(200)}" for _ in range(25)] + [rng.choice(groups)])) for i in range(300)])
    hurtful = frame(spark, [(i, " ".join([f"n{rng.randrange(200)}" for _ in range(25)] + [rng.choice(bad)])) for i in range(300)])
    rate = lambda model, docs: sum(r.predicted for r in toxicity.score_toxicity(docs, model).collect()) / 300
    fitted, plain = toxicity.fit_toxicity(docs, marks), toxicity.fit_toxicity(docs, marks, pull=0)
    assert rate(plain, neutral) > 0.5 and rate(fitted, neutral) < 0.5 * rate(plain, neutral)
    assert rate(fitted, hurtful) > 0.9


def test_toxicity_counterfactuals_take_one_term_at_a_time():
    assert toxicity.counterfactuals([b"man", b"sees", b"woman", b"man"]) == [[b"woman", b"sees", b"woman", b"woman"], [b"man", b"sees", b"man", b"man"]]
    assert toxicity.counterfactuals([b"no", b"term"]) == []


def test_toxicity_ids_with_two_labels_count_once(spark):
    docs = frame(spark, [(i, f"w{i % 2} x") for i in range(40)])
    once = [(i, i % 2) for i in range(40)]
    one, both = (toxicity.fit_toxicity(docs, spark.createDataFrame(r, "doc_id bigint, toxic int")) for r in (once, once + [(i, 0) for i in range(40)]))
    assert one.bias == both.bias and (one.weights == both.weights).all()


def test_very_long_texts(spark):
    """Megabytes of text in one row: whole texts are read, in reasonable time."""
    import sentencepiece as library
    from tidelog.llm import url_filter

    rng = random.Random(30)
    vocabulary = [f"w{i}" for i in range(3000)] + ["stinko"]
    long = " ".join(rng.choice(vocabulary) for _ in range(200_000)) + " the very end"
    unbroken = "ab" * 200_000
    rows = [(1, long), (2, unbroken), (3, "short")]
    model = library.SentencePieceProcessor(model_file=sentencepiece.model_path())
    for r in sentencepiece.piece_tokens(frame(spark, rows)).collect():
        assert list(r.ids) == model.encode(dict(rows)[r.doc_id])
    scored = {r.doc_id: r for r in suffix_tree.suffix_tree_scores(frame(spark, rows), depth=3).collect()}
    assert scored[1].n_tokens == 200_004 and scored[2].n_tokens == 2 and all(r.score < 0 for r in scored.values())
    marks = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id bigint, toxic int")
    fitted = toxicity.fit_toxicity(frame(spark, [(i, f"w{i} stinko" if i % 2 else f"w{i} calm") for i in range(40)]), marks, screen=2.0)
    got = {r.doc_id: r.predicted for r in toxicity.score_toxicity(frame(spark, [(1, "calm " * 300_000 + "x"), (2, long.replace("stinko", "w1") + " stinko" * 3)]), fitted).collect()}
    assert got[1] == 0
    urls = spark.createDataFrame([(1, "http://x.org/" + "a/" * 200_000 + "porn/x"), (2, "http://x.org/" + "porn" * 100_000)], "page_id bigint, url string")
    assert {r.page_id: r.verdict for r in url_filter.url_verdicts(urls).collect()} == {1: "block", 2: "allow"}
    kept = {r.doc_id: r for r in substring_dedup.dedup_substrings(frame(spark, [(1, long), (2, "lead " + long)])).collect()}
    assert (kept[1].n_removed, kept[2].n_removed, kept[2].kept) == (0, 200_003, "lead")


@pytest.mark.parametrize("depth", [1, 3, 4])
def test_suffix_tree_of_other_depths(spark, depth):
    """Scores as by the definition for any depth, and the probabilities of all tokens after a context sum to one."""
    rng = random.Random(depth)
    phrases = ["a b c d e f", "g b c d h i", "k c d l", "m n", "a b x", "c d e"]
    rows = [(i, " ".join(rng.choice([*phrases, f"u{rng.randrange(40)}"]) for _ in range(10))) for i in range(150)]
    tokens = {i: words(t) + [None] for i, t in rows}
    counts = [collections.Counter() for _ in range(depth + 1)]
    for i, w in tokens.items():
        if zlib.crc32(str(i).encode()) % 7 != 2:
            for k in range(depth + 1):
                counts[k].update(tuple(w[j : j + k + 1]) for j in range(len(w) - k))
    n, v = sum(counts[0].values()), len(counts[0])
    eighth = lambda p: 2 ** (-min(255, round(-8 * math.log2(p))) / 8)
    share = lambda x: counts[0][x,] / n if counts[0][x,] else 1 / suffix_tree.SHARE
    kept: list[dict] = [{}]  # for each order the kept contexts and their totals

    def below(g, root, upto):
        """The probability of the last token of ``g`` by the longest kept suffix of what is before it, of ``upto`` words at most."""
        p = root(g[-1])
        for k in range(1, upto + 1):
            total = kept[k].get(g[-k - 1 : -1])
            if total is None:
                break
            p = (counts[k][g[-k - 1 :]] + suffix_tree.WEIGHT[k] * p) / (total + suffix_tree.WEIGHT[k])
        return p

    for k in range(1, depth + 1):
        inner, own = collections.defaultdict(dict), {}
        for g, c in counts[k].items():
            if k == 1 or g[1:-1] in kept[k - 1]:
                inner[g[:-1]][g] = c
        mu = suffix_tree.WEIGHT[k]
        for context, items in inner.items():
            total = sum(items.values())
            if total > 1 and sum(c * math.log(((c - 1) / eighth(below(g, share, k - 1)) + mu) / (total - 1 + mu)) for g, c in items.items()) > suffix_tree.MARGIN:
                own[context] = total
        kept.append(own)
    assert kept[depth]
    base = lambda x: (counts[0][x,] + 1) / (n + v + 1)
    got = {r.doc_id: r for r in suffix_tree.suffix_tree_scores(frame(spark, rows), depth=depth).collect()}
    for i, w in tokens.items():
        score = sum(math.log10(below(tuple(w[max(0, j - depth) : j + 1]), base, min(j, depth))) for j in range(len(w)))
        assert math.isclose(got[i].score, score, rel_tol=1e-9), i
    for context in [c for own in kept[1:] for c in own][:40]:
        everything = sum(below((*context, *x), base, len(context)) for x in [*counts[0], ("an unknown word",)])
        assert math.isclose(everything, 1, rel_tol=1e-9)
