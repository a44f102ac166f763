"""Pieces without Spark: filters, hashes of runs, tokens, tries, sorting, alignment, fields."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftline.llm import bloom, copies, decontaminate, html, simhash, suffixes, toxicity, warc, words
from weftline.llm.components import labels
from weftline.llm.tokens import Encoder, default_path


@pytest.fixture(scope="module")
def encoder():
    return Encoder(default_path())


PIECES = ["a", "The", " ", "  ", "\n", "\t", "'s", "é", "12", "!?", "　", "x'll", "'", "\x1c", "\x85", "<|endoftext|>", "ñandú", "word.", "\0", "ǅ", "á", "|", "#", "日本"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=10))
def test_words_give_the_library_s_ids(encoder, parts):
    text = "".join(parts)
    assert encoder.ids([text])[0].tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize(("known", "waiting", "at_once"), [(9, 100, 1 << 20), (1000, 3, 37), (2, 1, 20)])
def test_tables_fill_and_texts_are_cut(monkeypatch, known, waiting, at_once):
    for name, value in (("KNOWN", known), ("WAITING", waiting), ("AT_ONCE", at_once)):
        monkeypatch.setattr(f"weftline.llm.tokens.{name}", value)
    fresh, rng = Encoder(default_path()), random.Random(known)
    for _ in range(60):
        texts = [" ".join(rng.choices(["one", "two,", "three\nfour", "é", "x" * 20, "y.", str(rng.random())], k=rng.randint(0, 40))) for _ in range(4)] + ["odd\ttext", "double  space"]
        assert [x.tolist() for x in fresh.ids(texts)] == [fresh.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_runs_are_equal_where_words_are():
    ws = [random.Random(1).choice([b"a", b"b", b"c"]) for _ in range(300)]
    h = words.runs(words.sums(words.hashed(b" ".join(ws))), 4)
    assert len(h) == 297
    by = {}
    for k, x in enumerate(h.tolist()):
        by.setdefault(x, set()).add(tuple(ws[k : k + 4]))
    assert all(len(v) == 1 for v in by.values()) and len(by) == len({tuple(ws[k : k + 4]) for k in range(297)})
    at = np.array([5, 0, 200])
    assert (words.runs(words.sums(words.hashed(b"\n\t".join(ws) + b" ")), 4, at) == h[at]).all()


@pytest.mark.parametrize("at_once", [1 << 20, 7])
def test_words_are_those_of_split(monkeypatch, at_once):
    monkeypatch.setattr(words, "AT_ONCE", at_once)
    rng = random.Random(6)
    known = {}
    for _ in range(300):
        text = bytes(rng.choice(b"ab \n\t\x0b\xc3\xa9") for _ in range(rng.randint(0, 40)))
        told, h = text.split(), words.hashed(text).tolist()
        assert len(told) == len(h) and all(known.setdefault(w, x) == x for w, x in zip(told, h))
    assert len(set(known.values())) == len(known)
    texts = [" ".join(rng.choices(["a", "bb", "a word that is long".replace(" ", "-"), "\n"], k=rng.randint(0, 9))).encode() for _ in range(40)]
    h, counts = words.together(texts)
    assert h.tolist() == [x for t in texts for x in words.hashed(t).tolist()] and counts.tolist() == [len(t.split()) for t in texts]


def thue_morse(n, a="a", b="b"):
    """A word and its complement share every polynomial hash modulo 2**64 from 1,024 letters on."""
    return "".join((a, b)[k.bit_count() & 1] for k in range(n))


@pytest.mark.parametrize("n", [16, 1024, 2048])
def test_words_with_equal_polynomial_hashes_stay_apart(n):
    fresh = Encoder(default_path())
    texts = ["x " + thue_morse(n), "x " + thue_morse(n, "b", "a"), thue_morse(n, "b", "a") + " y"]
    for some in (texts, texts[:1], texts[1:], texts[::-1]):
        assert [x.tolist() for x in fresh.ids(some)] == [fresh.tokenizer.encode(t, add_special_tokens=False).ids for t in some]
    assert len(set(words.hashed(" ".join(texts).encode()).tolist())) == 4


def test_words_that_share_a_hash_are_told_by_their_bytes(monkeypatch):
    monkeypatch.setattr("weftline.llm.tokens.spread", lambda low, high: low % np.uint64(3))
    fresh, rng = Encoder(default_path()), random.Random(4)
    for _ in range(40):
        texts = [" ".join(rng.choices(["one", "two,", "three\nfour", "é", "x" * 20, "a\0", "a", "a\0\0", "seventeen letters", str(rng.random())], k=rng.randint(0, 40))) for _ in range(4)]
        assert [x.tolist() for x in fresh.ids(texts)] == [fresh.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


@given(st.lists(st.binary(min_size=1, max_size=15).filter(lambda w: not set(w) & set(b" \t\n\x0b\x0c\r")), unique=True, max_size=30))
def test_short_words_are_two_numbers(ws):
    data = np.frombuffer(b" ".join(ws) + words.PAD, np.uint8)
    sizes = np.array([len(w) for w in ws], np.int64)
    low, high = words.short(data, np.cumsum(sizes + 1) - sizes - 1, sizes)
    assert len(set(zip(low.tolist(), high.tolist()))) == len(ws)


def test_labels_are_the_smallest_of_a_component():
    got = labels(6, np.array([0, 4, 2]), np.array([3, 3, 5]))
    assert got.tolist() == [0, 1, 2, 0, 0, 2]


@pytest.mark.parametrize("threshold", [1, 3, 4, 5])
def test_anchors_bring_every_near_pair_together(threshold):
    rng = random.Random(threshold)
    for _ in range(200):
        x = rng.getrandbits(64)
        y = x
        for bit in rng.sample(range(64), rng.randint(0, threshold)):
            y ^= 1 << bit
        fps = np.array([x, y], np.uint64)
        home, guest = [set(), set()], [set(), set()]
        for at, anchors, is_home in simhash.anchors(fps, threshold):
            for i, a in zip(at.tolist(), anchors.tolist()):
                guest[i].add(a)
                if is_home:
                    home[i].add(a)
        assert home[0] & guest[1] and home[1] & guest[0]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.binary(max_size=90).map(lambda b: b.translate(bytes(x % 2 + 97 for x in range(256)))), min_size=1, max_size=20), st.binary(max_size=3))
def test_deep_shallow_sorts_and_knows_common_prefixes(strings, tail):
    strings = [b"q" * 70 + s for s in strings] + strings + [s + tail for s in strings] + [b"", b"q" * 70, b"q\0"]
    order, lcp = suffixes.deep_shallow(strings)
    got = [strings[k] for k in order]
    assert got == sorted(strings)
    assert [suffixes.common(a, b) for a, b in zip(got, got[1:])] == lcp[1:].tolist()


def test_windows_have_one_anchor_each():
    rng = random.Random(3)
    text = bytes(rng.choice(b"abcd") for _ in range(900)) + b"x" * 400
    covered = []
    for _, offset, _, at, first, last in suffixes.anchors([text, b"short", text[100:400]], 200):
        assert (at >= first).all() and (at - last >= 0).all() and (at - first <= 168).all()
        covered.append(int((last - first + 1).sum()))
    assert covered == [1300 - 199, 300 - 199]


@given(st.lists(st.tuples(st.integers(0, 30), st.integers(1, 8)), min_size=1, max_size=12))
def test_union_of_spans(pairs):
    got = copies.union(np.array([a for a, _ in pairs]), np.array([a + n for a, n in pairs]), 35)
    marks = {x for a, n in pairs for x in range(a, min(35, a + n))}
    assert {x for a, b in got for x in range(a, b)} == marks and all(b < c for (_, b), (c, _) in zip(got, got[1:]))


def slow_alignment(item, passage):
    best, h = 0, [[0] * (len(passage) + 1) for _ in range(len(item) + 1)]
    for i in range(1, len(item) + 1):
        for j in range(1, len(passage) + 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if item[i - 1] == passage[j - 1] else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
            best = max(best, h[i][j])
    return best


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(1, 4), min_size=1, max_size=9), st.lists(st.integers(1, 4), max_size=14)), min_size=1, max_size=5))
def test_alignment_scores(pairs):
    got = decontaminate.scored([(np.array(a, np.uint64), np.array(b, np.uint64)) for a, b in pairs])
    for (a, b), (score, first, last) in zip(pairs, got):
        assert score == slow_alignment(a, b) / (2 * len(a)) and 0 <= first <= last <= len(b)


def test_filter_holds_what_it_was_given():
    f = bloom.Filter(np.zeros(bloom.BUCKETS * 8, np.uint8))
    assert not f.test(np.array([1, 2**63], np.uint64)).any()


def test_arc_versions_and_fields():
    for version in (1, 2):
        block = b"HTTP/1.1 200 OK\r\nX-Page-Id: 5\r\n\r\nbody\n\nfiledesc://x"
        content = warc.arc_version(version, "20010203040506") + warc.arc_record(version, "http://a b/", "20010203040506", block) + warc.arc_record(version, "dns:x", "2001", b"", kind="text/dns")
        a, b = warc.read_arc(content)
        assert a.fields["URL"] == "http://a%20b/" and a.parts()[1] == b"body\n\nfiledesc://x" and a.header("x-page-id") == "5" and a.version == version
        w = warc.to_warc(a)
        assert w.headers["WARC-Date"] == "2001-02-03T04:05:06Z" and w.headers["WARC-Type"] == "response"
        assert warc.to_warc(b).headers["WARC-Type"] == "resource" and b.block == b""
        assert [r.block for r in warc.read_warc(w.dump() + warc.to_warc(b).dump())] == [block, b""]
    with pytest.raises(ValueError, match="declared length"):
        list(warc.read_arc((warc.arc_version(1, "2001") + warc.arc_record(1, "x:", "2001", b"payload"))[:-5]))
    with pytest.raises(ValueError, match="header line"):
        list(warc.read_arc(b"what is this\n"))
    assert warc.warc_date("nonsense") == "1970-01-01T00:00:00Z"


def test_blocks_of_a_page():
    page = "<!doctype html><title>t</title><script>var x='<p>no</p>'</script><body><nav><ul><li><a href=x>Home<li><a>B</a></ul></nav><!-- <p>no</p> --><article class='post main'><p>One &amp; <b>two<br>three<p>Four</article><img alt='>'>tail"
    got = html.blocks(page)
    assert [b.text for b in got] == ["Home", "B", "One & two three", "Four", "tail"]
    assert got[2].path == ("body", "article post main", "p") and got[0].linked == 4 and got[3].path[-1] == "p"
    assert html.blocks("") == [] and html.blocks("<script>never closed") == [] and [b.text for b in html.blocks("plain  text")] == ["plain text"]


def test_labeller_learns_and_its_gradients_are_right():
    model = html.trained()
    rng = np.random.default_rng(99)
    right = total = 0
    for _ in range(100):
        page, truth = html.made_page(rng)
        p = html.labelled(model, [html.blocks(page)])[0]
        right += int(((p >= 0.5) == np.array(truth, bool)).sum())
        total += len(truth)
    assert right / total > 0.98
    small = html.Labeller(hidden=3)
    x, live = html.padded([rng.normal(size=(n, html.INPUT)).astype(np.float32) for n in (4, 2)])
    y = np.array([[1, 0, 1, 0], [0, 1, 0, 0]], np.float32)
    small.w = {k: v.astype(np.float64) for k, v in small.w.items()}
    _, grad = small.gradients(x, live, y)
    for name, at in (("wxf", (3, 2)), ("whb", (1, 5)), ("bf", (4,)), ("wo", (2,)), ("bo", (0,))):
        base = small.w[name][at]
        losses = []
        for step in (1e-3, -1e-3):
            small.w[name][at] = base + step
            losses.append(small.gradients(x, live, y)[0])
        small.w[name][at] = base
        assert abs((losses[0] - losses[1]) / 2e-3 - grad[name][at]) < 1e-3


def test_marginals_are_those_of_the_whole_chain():
    model = toxicity.Model({"=bad": 2.0, "ugly": 1.0}, -1.5, np.array([[1.0, -1.0], [-0.5, 0.7]]), np.zeros(4))
    scorer = model.prepare()
    for text in (b"a bad b c d ugly bad", b"bad", b"x " * 300 + b"bad y"):
        places, got, n = scorer.marginals(text)
        e = [np.exp([0, scorer.known[w] if not np.isnan(scorer.known[w]) else model.other]) for w in text.split()]
        step = np.exp(model.trans)
        # The chain begins from both states alike, through one step.
        f, back = [], [None] * len(e)
        a = np.ones(2)
        for x in e:
            a = (a @ step) * x
            a = a / a.sum()
            f.append(a)
        b = np.ones(2)
        for k in range(len(e) - 1, -1, -1):
            back[k] = b
            b = step @ (e[k] * b)
            b = b / b.sum()
        want = [(f[k] * back[k] / (f[k] @ back[k]))[1] for k in places]
        assert np.allclose(got, want, atol=1e-9) and n == len(e)


def test_training_finds_marks_beyond_words():
    rng = random.Random(4)
    plain = [f"w{rng.randint(0, 300)}" for _ in range(400)]
    texts, toxic = [], []
    for k in range(600):
        ws = [rng.choice(plain) for _ in range(rng.randint(5, 60))]
        if k % 8 == 0:
            for _ in range(rng.randint(1, 4)):
                ws[rng.randrange(len(ws))] = "zorg" + rng.choice(["a", "bel", "ix", "yy", "um"]) + str(rng.randint(0, 99))
        texts.append(" ".join(ws).encode())
        toxic.append(int(k % 8 == 0))
    model = toxicity.train(texts[:500], toxic[:500])
    scorer = model.prepare()
    assert all((scorer.score(x)[0] >= 0.5) == bool(y) for x, y in zip(texts[500:], toxic[500:]))
    assert toxicity.train([], []).prepare().score(b"x")[0] < 0.5 and 0 <= toxicity.train([b"a"], [1]).prepare().score(b"")[0] <= 1


@pytest.mark.parametrize(
    ("page", "texts"),
    [
        ("<p>A</p><svg width='1'/><article><p>B</p></article>", ["A", "B"]),
        ("<svg><svg><text>no</text></svg><text>no</text></svg><p>A</p>", ["A"]),
        ("<svg><title>no</title><p>A</p>", ["A"]),
        ("<object data=x><p>A</p>", ["A"]),
        ("<object><object><p>A</p></object><p>B</p></object>C", ["A", "B", "C"]),
        ("<noscript><p>no</p><noscript>no</noscript>no</noscript><p>A</p><noscript><p>B</p>", ["A", "B"]),
        ("<script>'<noscript>'</script><p>A</p><noscript>no</noscript><p>B</p>", ["A", "B"]),
        ("<textarea><p>no</p></textarea>A<iframe src=x>no</iframe>B", ["AB"]),
        ("<p>A</p><textarea>no<p>no</p>", ["A"]),
        ("<script>if (a<b && c==\"x\") f()</script><p class=\"y\">A</p>", ["A"]),
        ("<canvas>A</canvas><math/><p>B</p><template><p>no</p></template>", ["A", "B"]),
        ("<scripted>A</scripted><SVG>no</svg >B", ["AB"]),
    ],
)
def test_skipped_elements_end_where_they_end(page, texts):
    assert [b.text for b in html.blocks(page)] == texts


def test_all_names_of_an_element_count():
    assert html.blocks("<div class='w-full px-4 py-2 mt-8 flex grow text-sm border comments'>A</div>")[0].path[0].split(" ")[-1] == "comments"


P1 = "A long first paragraph tells what happened in the town that day, and why."
P2 = "The second one, shorter, closes the matter with a quote from the mayor."
#: Shapes of pages that made_page does not make, with the text that a reader takes from each.
PAGES = {
    "icons": (f'<html><body><header><svg width="1"/><a href=/>Site</a></header><main><svg width="1" height="2"/><h1>A headline</h1><p>{P1}</p><p>{P2}</p></main><footer><p>&copy; 2024</p></footer></body></html>', f"A headline\n{P1}\n{P2}"),
    "nested object": (f'<html><body><nav><a href=/>Home</a><a href=/b>News</a></nav><article><object data=a><object data=b><p>{P1}</p></object></object><p>{P2}</p></article></body></html>', f"{P1}\n{P2}"),
    "definition list": (f'<html><body><ul class="menu"><li><a href=/>Home</a><li><a href=/x>More</a></ul><article><h1>Words</h1><dl><dt>One</dt><dd>{P1}</dd><dt>Two</dt><dd>{P2}</dd></dl></article><aside><h3>Related</h3><ul><li><a href=1>Another story</a></li></ul></aside></body></html>', f"Words\nOne\n{P1}\nTwo\n{P2}"),
    "no wrapper": (f'<html><body><h1>A headline</h1><p>{P1}</p><noscript><p>Please enable scripts.</p></noscript><p>{P2}</p><div class="comments"><h3>Comments</h3><div class="comment"><p>I do not agree with this at all.</p></div></div></body></html>', f"A headline\n{P1}\n{P2}"),
    "utility classes": (f'<html><body><div class="w-full px-4 py-2 mt-8 flex grow text-sm border rounded navbar"><a href=/>Home</a> <a href=/b>News</a></div><main><h1>A headline</h1><p>{P1}</p><p>{P2}</p></main><section class="w-full px-4 py-2 mt-8 flex grow text-sm border rounded comments"><div class="p-2 m-1 flex comment"><p>First of all, I was there, too.</p></div></section></body></html>', f"A headline\n{P1}\n{P2}"),
    "unclosed": (f'<body><nav><ul><li><a href=/>Home<li><a href=/b>News</ul></nav><article><h1>A headline<p>{P1}<canvas id=c><p>{P2}<template></article><footer>&copy; 2024 The site</footer>', f"A headline\n{P1}\n{P2}"),
    "quoted script": (f'<html><head><script>if (a<b && c=="x") document.write("<p title=\'")</script></head><body><article class="story"><p>{P1}</p><p>{P2}</p></article></body></html>', f"{P1}\n{P2}"),
}


@pytest.mark.parametrize("shape", list(PAGES))
def test_text_of_pages_of_other_shapes(shape):
    page, want = PAGES[shape]
    found = html.blocks(page)
    assert "\n".join(b.text for b, q in zip(found, html.labelled(html.trained(), [found])[0]) if q >= 0.5) == want
