"""Each operator against brute force on small tables: nulls, empty and long texts, ties, repeated rows, clashing names, no rows."""

import base64
import hashlib
import random
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from weftline.llm import blocks, components, contexts, copies, decontaminate, exact, html, packing, simhash, suffixes, tokenfile, toxicity, warc
from weftline.llm.tokens import Encoder, default_path

EMPTY = ([], "doc_id long, text string")


def prose(rng, n):
    return " ".join(rng.choice(["alpha", "beta,", "gamma", "Delta.", "épsilon", "zeta", "eta", "theta"]) + (str(rng.randint(0, 9)) if rng.random() < 0.4 else "") for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    """Copies, edited copies, shared passages within and across texts, repeated lines, nulls, empties, a long text, equal rows."""
    rng = random.Random(11)
    passage, line = prose(rng, 70), prose(rng, 6)
    texts = [prose(rng, rng.randint(1, 300)) for _ in range(30)]
    texts += [texts[3], texts[3], texts[5] + " ", texts[3].replace("alpha", "ALPHA", 1)]
    for k in (7, 8, 9, 12):
        at = rng.randint(0, 40)
        words = texts[k].split(" ")
        texts.append(" ".join([*words[:at], passage, *words[at:]]))
    for k in range(6):
        words = prose(rng, 0) or texts[0].split(" ")
        words = texts[0].split(" ")
        words[rng.randrange(len(words))] = f"edit{k}"
        texts.append(" ".join(words))
    texts += [passage + "\n" + passage, "\n".join([line] * 40), "x" * 450, "ab" * 300, "tab\tand\x0bmore  spaces here", "", "", None, " \n\t", prose(rng, 9000), "one", "z" * 199, "y" * 200]
    rows = [(k * 3 % 101 + 200, t) for k, t in enumerate(texts)]
    rows += [rows[4], rows[4], (rows[6][0], "another text under one id"), (None, texts[3]), (None, "alone without id " + prose(rng, 80))]
    return rows


def same(got, want):
    """As multisets."""
    assert Counter(map(repr, map(tuple, got))) == Counter(map(repr, map(tuple, want)))


def test_exact(table, corpus):
    got = exact.decisions(table(corpus)).collect()
    groups = defaultdict(list)
    for i, t in corpus:
        groups[t or ""].append(i)
    top = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    same([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], [(i, top[t or ""], len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in corpus])
    kept = [r for r in got if r.kept]
    assert len(kept) == len(groups) and all(r.doc_id == r.keep_id for r in kept) and len({r.text_sha256 for r in kept}) == len(groups)
    df = table(corpus)
    out = exact.drop(df)
    assert out.columns == df.columns
    assert sorted(r.text or "" for r in out.collect()) == sorted(groups)
    assert {(r.doc_id, r.text or "") for r in out.collect()} == {(top[t], t) for t in groups}
    lowered = exact.decisions(table([(1, "A b"), (2, "a B")]), normalise=F.lower).collect()
    assert {(r.doc_id, r.keep_id) for r in lowered} == {(1, 2), (2, 2)}
    assert exact.decisions(table(*EMPTY)).count() == 0 and exact.drop(table(*EMPTY)).count() == 0


def slow_fingerprint(text, n):
    ws = (text or "").encode().lower().split()
    if not ws:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(ws[k : k + n]), 42) for k in range(max(1, len(ws) - n + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(fps, threshold):
    label = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= threshold:
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    return label


@pytest.mark.parametrize("tile", [8192, 4])
def test_simhash(table, corpus, monkeypatch, tile):
    monkeypatch.setattr(simhash, "TILE", tile)
    fps = [slow_fingerprint(t, 4) for _, t in corpus]
    label = slow_components(fps, 4)
    least = {}
    for (i, _), k in zip(corpus, label):
        least[k] = min((x for x in (least.get(k), i) if x is not None), default=None)
    got = simhash.near_duplicates(table(corpus)).collect()
    same(got, [(i, f"{f:016x}", least[k]) for (i, _), f, k in zip(corpus, fps, label)])
    assert len(set(label)) < len({t for _, t in corpus})


@pytest.mark.parametrize("one_task", [500_000, 0])
def test_components(spark, monkeypatch, one_task):
    monkeypatch.setattr(components, "ONE_TASK", one_task)
    rng = random.Random(14)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(220)] + [(1000 + k, 1001 + k) for k in range(40)] + [(2000, 2000 + k) for k in range(1, 1500)] + [(5, 5), (7, 7)]
    label = {x: x for ab in links for x in ab if ab[0] != ab[1]}
    for _ in range(60):
        for a, b in links:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    got = components.components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r.node: r.root for r in got} == label and len(got) == len(label)


def test_simhash_keeps_one_of_each_group(table, corpus):
    rng = random.Random(5)
    base = prose(rng, 400).split(" ")
    near = [" ".join(base)]
    for k in range(8):
        ws = list(base)
        for _ in range(6):
            ws[rng.randrange(len(ws))] = f"edit{k}{rng.random()}"
        near.append(" ".join(ws))
    clean = [prose(rng, 300) for _ in range(20)]
    rows = [(50 - k, t) for k, t in enumerate(near)] + [(100 + k, t) for k, t in enumerate(clean)] + [(7, ""), (8, None), (None, "a few words without id")]
    df = table(rows)
    out = simhash.one_of_each(df)
    assert out.columns == df.columns
    got = {r.doc_id for r in out.collect()}
    assert got == {42, 7, 8, None} | {100 + k for k in range(20)}
    assert simhash.near_duplicates(table(*EMPTY)).count() == 0 and simhash.one_of_each(table(*EMPTY)).count() == 0


def test_pairs_link_from_the_similarity_on_and_only_then(table):
    """Of pairs in each band of similarity from 0.8 at least 0.9 are in one group, and none below it; each text has one near copy."""
    rng = random.Random(16)
    fresh = lambda n: [f"{rng.choice('bcdfghklmn')}{rng.randint(0, 9000)}" for _ in range(n)]
    rows, pairs = [], []
    for k in range(600):
        base = fresh(rng.randint(60, 400))
        edited, share = list(base), rng.uniform(0.0, 0.26)
        # A word that changes takes up to five runs of each text with it.
        for at in rng.sample(range(len(base)), int(share * len(base) / 10) + 1):
            edited[at] = fresh(1)[0]
        a, b = " ".join(base), " ".join(edited)
        rows += [(2 * k, a), (2 * k + 1, b)]
        pairs.append((2 * k, simhash.similar(simhash.shingles(a.encode(), 5), simhash.shingles(b.encode(), 5))))
    group = {r.doc_id: r.component_id for r in simhash.alike(table(rows)).collect()}
    linked = lambda low, high: [group[k + 1] == k for k, s in pairs if low <= s < high]
    for low in (0.8, 0.85, 0.9, 0.95):
        some = linked(low, low + 0.05)
        assert len(some) > 20 and sum(some) >= 0.9 * len(some), (low, sum(some), len(some))
    assert len(linked(0.6, 0.8)) > 20 and not any(linked(0, 0.8)) and all(group[2 * k] == 2 * k for k in range(600))


@pytest.mark.parametrize(("tile", "few"), [(16_384, 64), (16, 4)])
def test_full_anchors_lose_no_link(table, monkeypatch, tile, few):
    """Hundreds of near copies of two texts that are near each other share every anchor: one group, however it is dealt out."""
    monkeypatch.setattr(simhash, "WIDE_TILE", tile)
    monkeypatch.setattr(simhash, "FEW", few)
    rng = random.Random(17)
    base = [f"{rng.choice('bcdfghklmn')}{rng.randint(0, 9000)}" for _ in range(300)]
    other = [f"other{k}" if k in (50, 100, 150) else w for k, w in enumerate(base)]
    rows = []
    for k in range(240):
        ws = list(base if k % 2 else other)
        ws[rng.randrange(len(ws))] = f"edit{k}"
        rows.append((k, " ".join(ws)))
    rows.append((1000, " ".join(f"{w}x" for w in base)))
    assert {(r.doc_id, r.component_id) for r in simhash.alike(table(rows)).collect()} == {(k, 0) for k in range(240)} | {(1000, 1000)}


@pytest.mark.parametrize(("tried", "spread"), [(8, 2000), (1, 7)])
def test_groups_about_the_similarity_are_those_of_all_pairs(table, monkeypatch, tried, spread):
    """Edited copies of one text without that text itself: some pairs reach the similarity, most don't, and chains decide."""
    monkeypatch.setattr(simhash, "TRIED", tried)
    monkeypatch.setattr(simhash, "SPREAD", spread)
    rng = random.Random(19)
    rows = []
    for group in range(3):
        base = [f"{rng.choice('bcdfghklmn')}{rng.randint(0, 9000)}" for _ in range(300)]
        for k in range(60):
            ws = list(base)
            for at in rng.sample(range(300), rng.randint(2, 11)):
                ws[at] = f"edit{rng.random()}"
            rows.append((group * 100 + k, " ".join(ws)))
    sets = [simhash.shingles(t.encode(), 5) for _, t in rows]
    label = list(range(len(rows)))
    sure, total = [], 0
    for i in range(len(rows)):
        for j in range(i):
            s = simhash.similar(sets[i], sets[j])
            total += 0.6 < s < 0.8
            if s >= 0.8:
                sure.append((i, j))
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    assert total > 1000 and len(sure) > 300
    got = {r.doc_id: r.component_id for r in simhash.alike(table(rows)).collect()}
    want = {i: rows[label[k]][0] for k, (i, _) in enumerate(rows)}
    # No merge beyond all pairs' components; of the links at most one in ten is lost, by the anchors.
    assert all(want[got[i]] == want[i] for i in got)
    assert sum(got[rows[i][0]] == got[rows[j][0]] for i, j in sure) >= 0.97 * len(sure)


def test_only_similar_texts_go(table):
    """Runs that repeat fill most of a fingerprint: it is equal, or nearly so, for texts that share little else."""
    rng = random.Random(6)
    rows = [(k, "to be or not to be " * 40 + prose(rng, 60)) for k in range(6)]
    base = prose(rng, 300).split(" ")
    ws = list(base)
    ws[100] = ws[200] = "edited"
    rows += [(20, " ".join(base)), (21, " ".join(ws))]
    assert sorted(r.doc_id for r in simhash.one_of_each(table(rows)).collect()) == [*range(6), 20]


def test_a_family_near_the_similarity_makes_no_row_for_each_pair(spark, monkeypatch):
    """Candidates come as nodes, not as pairs, and every link among them is found, in one part or in many."""
    n = 300
    rows = [np.full(n, 7), np.zeros(n, np.int64), np.ones(n, bool), np.arange(n), np.arange(n), *np.zeros((simhash.WIDTH, n), np.int64)]
    out = list(simhash._across(rows, np.array([0]), simhash.APART))
    assert sum(x.num_rows for x in out) == n and {x for b in out for x in b.column(2).to_pylist()} == {0}
    rng = random.Random(37)
    base = [f"w{rng.randint(0, 9999)}" for _ in range(200)]
    texts = []
    for _ in range(60):
        ws = list(base)
        for k in rng.sample(range(200), rng.randint(1, 4)):
            ws[k] = f"x{rng.randint(0, 10**9)}"
        texts.append(" ".join(ws))
    sets = [{tuple(t.split()[k : k + 5]) for k in range(196)} for t in texts]
    monkeypatch.setattr(simhash, "TRIED", 2)
    fps = np.array([simhash.wide(t.encode()) for t in texts])
    label = list(range(60))
    for i in range(60):
        for j in range(i):
            if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8 and np.bitwise_count(fps[i] ^ fps[j]).sum() <= simhash.APART:
                label = [min(label[i], label[j]) if x in (label[i], label[j]) else x for x in label]
    met = spark.createDataFrame([(k, k, 0) for k in range(60)], "node long, label long, met long")
    nodes = spark.createDataFrame([(k, *map(int, fps[k].view(np.int64))) for k in range(60)], ", ".join(["node long", *(f"fp{j} long" for j in range(simhash.WIDTH))]))
    texts_of = spark.createDataFrame([(k, t.encode()) for k, t in enumerate(texts)], "node long, text binary")
    dealt = simhash._families(met, nodes, texts_of)
    assert dealt.select("tile").distinct().count() == 10
    links = dealt.mapInArrow(simhash._kin(5, 0.8, simhash.APART), "a long, b long")
    got = {r.node: r.root for r in components.components(links).collect()}
    assert [got.get(k, k) for k in range(60)] == label and 1 < len(set(label)) < 60


@pytest.mark.parametrize("limit", [20_000, 2])
def test_blocks(table, corpus, limit, monkeypatch):
    monkeypatch.setattr(contexts, "SORTED", 3000)
    monkeypatch.setattr(contexts, "HELD", 3000)
    monkeypatch.setattr(contexts, "LIMIT", limit)
    rank = lambda i: -1 if i is None else i
    first = {}
    for i, t in corpus:
        ws = (t or "").encode().split()
        for k in range(len(ws) - 49):
            w = tuple(ws[k : k + 50])
            first[w] = min(first.get(w, 1 << 60), rank(i))
    want = []
    for i, t in corpus:
        ws = (t or "").encode().split()
        gone = [False] * len(ws)
        for k in range(len(ws) - 49):
            if first[tuple(ws[k : k + 50])] < rank(i):
                gone[k : k + 50] = [True] * 50
        want.append((i, len(ws), sum(gone), b" ".join(w for w, g in zip(ws, gone) if not g)))
    got = blocks.repeats(table(corpus)).withColumn("r", copies.removed()).collect()
    same([(r.doc_id, r.n, r.r, bytes(r.kept)) for r in got], want)
    assert sum(w[2] for w in want) > 300 and blocks.repeats(table(*EMPTY)).count() == 0


def test_words_of_equal_polynomial_hashes_do_not_repeat(table):
    """A Thue-Morse word of 1,024 letters and its complement share every polynomial hash modulo 2**64; only the same word repeats."""
    letters = "".join("ab"[k.bit_count() & 1] for k in range(1024))
    other = letters.translate(str.maketrans("ab", "ba"))
    rows = [(3, " ".join([letters] * 60)), (4, " ".join([other] * 60)), (5, "x " + " ".join([other] * 55)), (6, "y " + " ".join([letters] * 50))]
    got = {r.doc_id: (r.n, r.r) for r in blocks.repeats(table(rows)).withColumn("r", copies.removed()).collect()}
    assert got == {3: (60, 0), 4: (60, 0), 5: (56, 55), 6: (51, 50)}


def test_a_line_in_hundreds_of_contexts(table, monkeypatch):
    """Anchors of more classes than one task takes are halved; what repeats beyond the line is found, in bytes and in words."""
    monkeypatch.setattr(contexts, "LIMIT", 150)
    rng = random.Random(23)
    word = lambda: "".join(rng.choices("abcdefghij", k=7))
    line = " ".join(word() for _ in range(30))
    rows = [(k, f"{' '.join(word() for _ in range(25))} {line} {' '.join(word() for _ in range(25))}") for k in range(600)]
    rows += [(10_000 + k, rows[k][1].replace(" ", "  ", 1)) for k in range(3)]
    rows.append((20_000, rows[9][1][:230] + " end"))
    seen = Counter(hash(t[k : k + 200]) for _, t in rows for k in range(len(t) - 199))
    got = {r.doc_id: list(r.spans) for r in suffixes.repeats(table(rows)).collect()}
    for i, t in rows:
        gone = bytearray(len(t))
        for k in range(len(t) - 199):
            if seen[hash(t[k : k + 200])] > 1:
                gone[k : k + 200] = b"\1" * 200
        assert got[i] == [k for k in range(len(t) + 1) if (gone[k] if k < len(t) else 0) != (gone[k - 1] if k else 0)]
    assert len(line) > 200 and all(got.values())
    found = {r.doc_id: r.r for r in blocks.repeats(table(rows)).withColumn("r", copies.removed()).collect()}
    assert all(found[k] == 0 for k in range(600)) and all(found[10_000 + k] == 80 for k in range(3)) and found[20_000] == 0


def test_a_round_of_halving_reads_the_last_one_only(table, monkeypatch):
    """Classes that are not halved pass one join, however many rounds follow: rows don't double with each."""
    monkeypatch.setattr(contexts, "LIMIT", 2)
    plans, cut = [], contexts.cut
    monkeypatch.setattr(contexts, "cut", lambda df: plans.append(df._jdf.queryExecution().analyzed().toString()) or cut(df))
    rng = random.Random(31)
    line = "".join(rng.choices("abcdefghij", k=230))
    rows = [(k, "".join(rng.choices("abcdefghij", k=150)) + line + "".join(rng.choices("abcdefghij", k=150))) for k in range(40)]
    seen = Counter(t[k : k + 200] for _, t in rows for k in range(len(t) - 199))
    for r in suffixes.repeats(table(rows)).collect():
        at = [k for k in range(len(rows[0][1]) - 199) if seen[rows[r.doc_id][1][k : k + 200]] > 1]
        assert list(r.spans) == [at[0], at[-1] + 200]
    rounds = sum(" of#" in p and "LeftSemi" in p for p in plans)
    assert rounds >= 5 and max(p.count("LeftAnti") for p in plans) <= rounds


def local(a, b):
    """The best local alignment: two for a match, one off for another word or a gap."""
    best, above = 0, [0] * (len(b) + 1)
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(max(0, above[j] + (2 if x == y else -1), above[j + 1] - 1, row[j] - 1))
        best, above = max(best, *row), row
    return best


@pytest.mark.parametrize("sent", [4_000_000, 0])
def test_leaks_are_those_of_all_alignments(spark, table, monkeypatch, sent):
    """Every document against every item, by whole alignment; an item counts where three words of it stand together."""
    monkeypatch.setattr(decontaminate, "SENT", sent)
    rng = random.Random(29)
    word = lambda: f"{rng.choice('bcdfg')}{rng.randint(0, 300)}"
    items = [(k, [word() for _ in range(rng.randint(3, 40))]) for k in range(12)]
    rows = []
    for k in range(90):
        ws = [word() for _ in range(rng.randint(0, 120))]
        for _ in range(rng.randint(0, 2)):
            rate, copy = rng.uniform(0, 0.5), []
            for w in rng.choice(items)[1]:
                x = rng.random()
                copy += [w] if x > rate else [] if x < rate / 3 else [word()] if x < rate * 2 / 3 else [w, word()]
            at = rng.randint(0, len(ws))
            ws[at:at] = copy
        rows.append((k, ws))
    want = {}
    for i, d in rows:
        runs = {tuple(d[k : k + 3]) for k in range(len(d) - 2)}
        for j, q in items:
            if any(tuple(q[k : k + 3]) in runs for k in range(len(q) - 2)) and local(q, d) >= len(q):
                want[i, j] = local(q, d) / (2 * len(q))
    got = decontaminate.leaks(table([(i, " ".join(d)) for i, d in rows]), spark.createDataFrame([(j, " ".join(q)) for j, q in items], "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id): r.score for r in got} == want and len(want) > 20


def test_documents_are_searched_in_one_pass(table, spark):
    """With few items no text moves, and its words are hashed once: seeds, passages and alignments are one step."""
    items = spark.createDataFrame([(1, "one two three four five six"), (2, "red green blue"), (3, "a b")], "item_id long, text string")
    rows = [(1, "x one two three four five six y"), (2, "one two three x five six. red Green, blue"), (3, "one two x three four y five six"), (4, None), (None, "red green blue"), (4, "red green blue " * 3), (5, "a b")]
    found = decontaminate.leaks(table(rows), items)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    assert {(r.doc_id, r.item_id, r.score, r.first_word, r.last_word) for r in found.collect()} == {(1, 1, 1.0, 1, 7), (2, 1, 0.75, 0, 6), (2, 2, 1.0, 6, 9), (None, 2, 1.0, 0, 3), (4, 2, 1.0, 0, 3)}


def test_a_long_item_takes_memory_as_its_words(spark, table):
    rng = random.Random(31)
    item = [f"w{rng.randint(0, 5000)}" for _ in range(20_000)]
    edited = [w if rng.random() > 0.05 else "other" for w in item]
    rows = [(k, " ".join(f"v{rng.randint(0, 5000)}" for _ in range(50))) for k in range(20)] + [(50, "before " + " ".join(edited[:12_000]) + " behind")]
    tracemalloc.start()
    words = next(decontaminate._words(iter([pa.RecordBatch.from_pydict({"item": [1], "text": [" ".join(item).encode()]})])))
    batch = pa.RecordBatch.from_arrays([words.column(0), pa.array([5]), words.column(1)], names=["item", "key", "words"])
    assert sum(b.nbytes for b in decontaminate._grams(3)(iter([batch]))) < 2_000_000 and tracemalloc.get_traced_memory()[1] < 50_000_000
    tracemalloc.stop()
    got = decontaminate.leaks(table(rows), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).collect()
    assert [(r.doc_id, r.item_id) for r in got] == [(50, 1)] and 0.5 < got[0].score < 0.6


@pytest.mark.parametrize(("length", "limit"), [(200, 20_000), (64, 20_000), (200, 2)])
def test_suffixes(table, corpus, length, limit, monkeypatch):
    monkeypatch.setattr(contexts, "SORTED", 3000)
    monkeypatch.setattr(contexts, "HELD", 3000)
    monkeypatch.setattr(contexts, "LIMIT", limit)
    monkeypatch.setattr(suffixes, "AT_ONCE", 2048)
    texts = [(i, (t or "").encode()) for i, t in corpus]
    count = Counter(t[k : k + length] for _, t in texts for k in range(len(t) - length + 1))
    want = []
    for i, t in texts:
        gone = bytearray(len(t))
        for k in range(len(t) - length + 1):
            if count[t[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        edges = [k for k in range(len(t) + 1) if (gone[k] if k < len(t) else 0) != (gone[k - 1] if k else 0)]
        want.append((i, len(t), edges, bytes(c for c, g in zip(t, gone) if not g)))
    got = suffixes.repeats(table(corpus), length).collect()
    same([(r.doc_id, r.n, list(r.spans), bytes(r.kept)) for r in got], want)
    assert suffixes.repeats(table(*EMPTY)).count() == 0


@pytest.fixture(scope="module")
def encoder():
    return Encoder(default_path()).tokenizer


def test_packing(table, corpus, encoder):
    limits = packing.Limits(tokens=128, segments=6, loss=128, open=4)
    got = packing.pack(table(corpus), limits=limits).collect()
    ids = [np.array(encoder.encode(t or "", add_special_tokens=False).ids + [0], "<u4") for _, t in corpus]
    assert sum(r.length for r in got) == sum(map(len, ids))
    # Every piece's ids are those of its place in a text of that id and length.
    by = defaultdict(list)
    for (i, _), x in zip(corpus, ids):
        by[i, len(x)].append(x)
    for r in got:
        assert any(zlib.crc32(x[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for x in by[r.doc_id, r.doc_tokens])
    places = defaultdict(list)
    for r in got:
        places[r.doc_id, r.doc_tokens].append((r.start, r.length))
    for key, pieces in places.items():
        covered = Counter(x for s, n in pieces for x in range(s, s + n))
        assert covered == Counter({x: len(by[key]) for x in range(key[1])})
    seqs = defaultdict(list)
    for r in got:
        seqs[r.sequence_id].append((r.offset, r.length))
    padding = 0
    for pieces in seqs.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 128 and len(pieces) <= 6
        padding += 0 if at & (at - 1) == 0 else 128 - at
    assert padding < 0.05 * sum(map(len, ids))
    assert packing.pack(table(*EMPTY)).count() == 0


def test_packer_holds_all_limits():
    rng = random.Random(2)
    limits = packing.Limits(tokens=64, segments=5, loss=20, open=6)
    packer, out, sizes = packing.Packer(limits), [], {}
    for key in range(300):
        n = rng.randint(1, 150)
        mask = np.array([rng.random() < 0.3 for _ in range(n)])
        sizes[key] = mask
        out += packer.add(key, n, mask)
    out += packer.close()
    seen = Counter()
    for s in out:
        assert s.used <= 64 and len(s.pieces) <= 5 and s.bears <= 20 and s.used == sum(p.length for p in s.pieces)
        assert [p.offset for p in s.pieces] == list(np.cumsum([0, *(p.length for p in s.pieces)])[:-1])
        for p in s.pieces:
            assert p.bears == sizes[p.key][p.start : p.start + p.length].sum()
            seen.update((p.key, x) for x in range(p.start, p.start + p.length))
    assert seen == Counter((k, x) for k, m in sizes.items() for x in range(len(m)))


def test_conversations(spark, encoder):
    rows = [(1, 1, "user", "hello there"), (1, 2, "assistant", "good day"), (2, 1, None, None), (3, None, "assistant", "x " * 3000)]
    got = packing.pack_conversations(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")).collect()
    total = sum(len(encoder.encode(t or "", add_special_tokens=False).ids) + 1 for *_, t in rows)
    assert sum(r.length for r in got) == total and {r.doc_id for r in got} == {1, 2, 3}
    assert packing.pack_conversations(spark.createDataFrame([], "conv_id long, turn int, role string, text string")).count() == 0


def test_all_three_limits_of_documents_bind(table, encoder):
    """Many one-word texts meet the limit of pieces, a text of many sequences that of loss-bearing tokens; padding stays little."""
    rng = random.Random(9)
    rows = [(k, rng.choice(["a", "b", "c"])) for k in range(3000)] + [(5000, prose(rng, 8000))]
    got = packing.pack(table(rows).coalesce(1), limits=packing.Limits(tokens=64, segments=16, loss=63)).collect()
    seqs = defaultdict(list)
    for r in got:
        seqs[r.sequence_id].append(r)
    bears = {k: sum(r.length - (r.start == 0) for r in rs) for k, rs in seqs.items()}
    assert max(map(len, seqs.values())) == 16 and max(bears.values()) == 63 and all(sum(r.length for r in rs) <= 64 for rs in seqs.values())


def test_token_files(spark, table, corpus, encoder, monkeypatch, tmp_path):
    monkeypatch.setattr(tokenfile, "FILE_IDS", 2000)
    got = tokenfile.round_trip(table(corpus)).collect()
    rank = lambda x: (x[0] is not None, x[0] or 0, x[1] or "")
    at, want = 0, []
    for i, t in sorted(corpus, key=rank):
        ids = np.array(encoder.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    same(got, want)
    assert tokenfile.round_trip(table(*EMPTY)).count() == 0
    folder = f"file://{tmp_path}/t"
    tokenfile.write(table(corpus), folder)
    dictionary = bytes(spark.read.parquet(f"{folder}/dictionary").first()[0])
    content = bytes(spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{folder}/ids").filter("length > 0").first().content)
    reader = tokenfile.Reader(content, dictionary)
    k = len(reader.doc_ids) // 2
    assert len(reader.ids(k)) == reader.counts[k] and reader.ids(k)[-1] == 2
    with pytest.raises(ValueError, match="dictionary"):
        tokenfile.Reader(content, b"other")


@pytest.mark.parametrize("version", [1, 2])
def test_warc(table, version, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 2000)
    rows = [(5, "http://a/ x", "<p>é</p>"), (3, "http://b", "<p>é</p>"), (9, None, None), (2, "u", ""), (None, "n", ""), (None, "m", "solo\r\n\r\nWARC/1.1\r\n"), (7, "v", "x" * 9000), (3, "http://b", "<p>é</p>")]
    got = warc.round_trip(table(rows, "page_id long, url string, html string"), version=version).collect()
    least = {}
    for i, _, h in rows:
        least[h or ""] = min((x for x in (least.get(h or ""), i) if x is not None), default=None)
    want = []
    for i, _, h in rows:
        body, top = (h or "").encode(), least[h or ""]
        again = top is not None and i != top
        want.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if again else "response", top if again else None))
    same([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got], want)
    assert warc.round_trip(table([], "page_id long, url string, html string")).count() == 0


def test_small_payloads_are_all_responses(table):
    got = warc.round_trip(table([(1, "a", "hi"), (2, "b", "hi"), (3, "c", "long " * 9), (4, "d", "long " * 9)], "page_id long, url string, html string"), least=10).collect()
    assert {(r.page_id, r.record_type) for r in got} == {(1, "response"), (2, "response"), (3, "response"), (4, "revisit")}


def test_leaks(spark, table, corpus):
    rng = random.Random(8)
    item = lambda: " ".join(f"{rng.choice('bcdfg')}{rng.randint(0, 400)}" for _ in range(30))
    items = [(k, item()) for k in range(6)] + [(6, "too short"), (7, None), (None, item()), (0, None)]
    edited = items[1][1].split(" ")
    edited[10:12] = ["other", "words", "here"]
    edited[20] = "changed"
    rows = [(k, t) for k, t in enumerate(t for _, t in corpus)]
    rows += [(901, "before it " + items[0][1].upper() + " behind"), (902, " ".join(edited)), (903, prose(rng, 500) + "\n" + items[2][1].replace(" ", ",\n") + " " + items[0][1]), (904, items[8][1]), (None, items[3][1]), (905, items[4][1][: len(items[4][1]) // 4]), (901, "another row of this id")]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("item", F.lit(1)).withColumn("doc_id", F.lit(2))
    got = decontaminate.leaks(table(rows), bench).collect()
    found = {(r.doc_id, r.item_id): r for r in got}
    assert found.keys() == {(901, 0), (902, 1), (903, 2), (903, 0), (904, None), (None, 3)} and len(got) == len(found)
    assert found[901, 0].score == 1.0 and (found[901, 0].first_word, found[901, 0].last_word) == (2, 32) and 0.7 < found[902, 1].score < 1
    df = table(rows)
    kept = decontaminate.clean(df, bench)
    assert kept.columns == df.columns and Counter(r.doc_id for r in kept.collect()) == Counter(i for i, _ in rows if i not in (901, 902, 903, 904, None))
    assert decontaminate.leaks(table(*EMPTY), bench).count() == 0 and decontaminate.leaks(table(rows), bench.limit(0)).count() == 0
    assert decontaminate.clean(table(rows), bench.limit(0)).count() == len(rows)


def test_leaks_beside_exact_copies(spark, table):
    """Edited copies are found however often what they keep of an item occurs: counts don't choose the seeds."""
    rng = random.Random(18)
    items = [(k, " ".join(f"{rng.choice('bcdfg')}{rng.randint(0, 4000)}" for _ in range(30))) for k in range(4)]
    edited = {k: " ".join("edit" if j % 5 == 4 else w for j, w in enumerate(t.split(" "))) for k, t in items}
    rows = [(k, prose(rng, 20) + " " + t) for k, t in items] + [(10 + k, prose(rng, 20) + " " + t) for k, t in edited.items()]
    rows += [(1000 + k, f"text {k} holds {edited[0]} and ends") for k in range(2000)]
    got = decontaminate.leaks(table(rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(k + d, k) for k in range(4) for d in (0, 10)} | {(1000 + k, 0) for k in range(2000)}


def test_rare_words_mark_too_and_all_documents_give_segments(spark, table, monkeypatch):
    """A hundred offending words, each in a few toxic documents; the bound on segments leaves no feature without any."""
    monkeypatch.setattr(toxicity, "SEGMENTS", 20)
    rng = random.Random(33)
    bad = [f"{a}{b}vile{c}" for a in "bcdf" for b in "aeiou" for c in "klmnp"]
    rows, labels = [], []
    for k in range(2500):
        ws = [f"w{rng.randint(0, 150)}" for _ in range(rng.randint(5, 60))]
        if k % 5 == 0:
            ws[rng.randrange(len(ws))] = bad[k // 5 % len(bad)]
        rows.append((k, " ".join(ws)))
        labels.append((k, int(k % 5 == 0)))
    model = toxicity.fit(table(rows), spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = toxicity.score(table(rows), model).withColumn("held", toxicity.held_out()).filter("held").collect()
    hits = [r.predicted for r in got if r.doc_id % 5 == 0]
    assert sum(hits) >= 0.9 * len(hits) and not any(r.predicted for r in got if r.doc_id % 5)


def test_toxicity(spark, table):
    rng = random.Random(3)
    rows, labels = [], []
    for k in range(400):
        ws = [f"w{rng.randint(0, 200)}" for _ in range(rng.randint(1, 80))]
        if k % 7 == 0:
            ws[rng.randrange(len(ws))] = rng.choice(["Vile!", "vile", "FOUL,"])
        rows.append((k, " ".join(ws)))
        labels.append((k, int(k % 7 == 0)))
    rows += [(400, None), (401, ""), (None, "vile w1 w2"), (0, rows[0][1]), (402, "w1 " * 30000 + "foul")]
    labels += [(None, 1), (3, None), (5, 0)]
    about = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(table(rows), about)
    got = toxicity.score(table(rows), model).withColumn("held", toxicity.held_out()).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    bad = {k for k, t in rows if t and ("vile" in t.lower() or "foul" in t.lower())}
    assert {r.doc_id for r in got if r.predicted} == bad
    assert all(r.held == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 5 == 0) for r in got)
    texts = {}
    for k, t in rows:
        texts[k] = (t or "").encode()
    for r in got:
        words = [texts[r.doc_id][a:b].lower() for a, b in zip(r.spans[::2], r.spans[1::2])]
        assert all(b"vile" in w or b"foul" in w for w in words) and bool(words) == (r.doc_id in bad)
    df = table(rows)
    kept = toxicity.accepted(df, model)
    assert kept.columns == df.columns and Counter(r.doc_id for r in kept.collect()) == Counter(k for k, _ in rows if k not in bad)
    nothing = toxicity.fit(table(*EMPTY), about.limit(0))
    assert toxicity.score(table(rows), nothing).filter("predicted = 1").count() == 0 and toxicity.score(table(*EMPTY), model).count() == 0


def test_html(table):
    page = lambda body: f"<html><head><title>t</title></head><body><nav><ul><li><a href='/'>Home</a></li><li><a>More</a></li></ul></nav><div class='ad'>Buy this now.</div>{body}<footer>&copy; us</footer></body></html>"
    text = "Many words of an article stand here, one behind the other, until it ends."
    rows = [(1, "u", page(f"<article><h1>A  title</h1><p>{text}</p><p>{text} &amp; more<br>lines</article>")), (2, None, None), (3, "e", ""), (None, "n", page("")), (1, "u", page(f"<article><p>{text}</p></article>")), (4, "l", page("<article>" + f"<p>{text}</p>" * 800 + "</article>"))]
    got = {(r.page_id, r.url, len(r.text)): r.text for r in html.main_text(table(rows, "page_id long, url string, html string")).collect()}
    assert len(got) == 6
    texts = sorted(got.values())
    assert f"A title\n{text}\n{text} & more lines" in texts and text in texts and texts.count("") >= 2 and "\n".join([text] * 800) in texts
    assert html.main_text(table([], "page_id long, url string, html string")).count() == 0
