"""The llm operators against brute force, exact round trips and held-out lines, with awkward inputs."""

from collections import Counter, defaultdict

import numpy as np
import pytest

pytest.importorskip("linkframe.llm")
from pyspark.sql import functions as F  # noqa: E402

from linkframe.llm import duplicates, names  # noqa: E402
from linkframe.llm.crf import forward_backward  # noqa: E402
from linkframe.llm.encoding import VOCABULARY, Encoder, count_tokens, encode_corpus, read_ranks  # noqa: E402
from linkframe.llm.mixing import mix  # noqa: E402
from linkframe.llm.pii import Finder, default_model, find_items, redact  # noqa: E402
from linkframe.llm.pii_lexer import alike, line_classes, lines_classes, segments, token_spans, token_texts, tokens  # noqa: E402
from linkframe.llm.pii_training import LABELS, Grammar  # noqa: E402
from linkframe.operators.widen import canon_text  # noqa: E402
from linkframe.schema import table  # noqa: E402

SF = "/root/testdata/sf0.001"


# --- duplicates

LINKS = "rawid bigint, origin string, rel string, target string, _key string, n_copies int"


def key_of(r):
    rel = None if r.rel is None else canon_text(r.rel)
    if r.target is None:
        target = None
    elif rel and rel.endswith(("extent", "imprint")):
        import re

        target = tuple(sorted(filter(None, map(canon_text, re.split(r"[;,|&\n\r]+", r.target)))))
    else:
        target = canon_text(r.target)
    return (None if r.origin is None else canon_text(r.origin), rel, target)


@pytest.mark.parametrize("filter_bytes", [64 << 20, 8192])
def test_collapse_brute_force(spark, filter_bytes):
    links = table(spark, SF, "relationship")
    groups = defaultdict(list)
    for r in links.collect():
        groups[key_of(r)].append(r.rawid)
    want = {i: (min(g), len(g)) for g in groups.values() for i in g}
    got = duplicates.collapse(links, duplicates.link_key(), "rawid", filter_bytes=filter_bytes)
    assert {r.rawid: (r.first_id, r.n_copies) for r in got.collect()} == want
    assert got.columns[: len(links.columns)] == links.columns


def test_collapse_in_passes(spark, monkeypatch):
    """Several passes give what one gives, in a plan of the same size; each reads its own range of hashes, and its filter is
    destroyed before the next is made."""
    links = table(spark, "/root/testdata/sf0.01", "relationship").select("rawid", "origin", "rel", "target")
    alive, most, counts = set(), [], []
    make, real = type(spark.sparkContext).broadcast, duplicates.repeated_filter

    def broadcast(sc, value):
        b = make(sc, value)
        alive.add(id(b))
        most.append(len(alive))
        destroy = b.destroy
        b.destroy = lambda: (alive.discard(id(b)), destroy())
        return b

    def counted(hashes, pages, fan_in=128):
        counts.append(hashes.count())
        return real(hashes, pages, 3)

    monkeypatch.setattr(type(spark.sparkContext), "broadcast", broadcast)
    monkeypatch.setattr(duplicates, "repeated_filter", counted)
    plans, got = [], []
    for filter_bytes in (64 << 20, 8192):
        out = duplicates.collapse(links, duplicates.link_key(), "rawid", filter_bytes=filter_bytes)
        plans.append(out._jdf.queryExecution().optimizedPlan().toString().count("\n"))
        got.append(sorted(map(tuple, out.select("rawid", "first_id", "n_copies").collect())))
    assert got[0] == got[1] and len(got[0]) == 15_000 and plans[0] == plans[1]
    assert len(most) == 4 and set(most) == {1} and not alive
    assert counts[0] == sum(counts[1:]) == 15_000 and len(counts) == 4 and all(counts)


def test_collapse_awkward(spark):
    data = [(1, "a", "x", None), (2, "A!", "X", None), (3, "a", "x", ""), (4, None, None, None), (5, None, None, None), (6, "a", "extent", "p=1; q=2"), (7, "a", "EXTENT", "Q: 2 | P: 1"), (8, "a", "extent", "p=2; q=1"), (9, "z" * 100_000, "x", "y"), (9, "Z" * 100_000, "x", "y")]
    df = spark.createDataFrame([(*d, "k", 1) for d in data], LINKS).withColumns({"_hash": F.lit(1), "_ckey": F.lit(2), "_maybe": F.lit(3)})
    out = duplicates.collapse(df, duplicates.link_key(), "rawid")
    assert {(r["_key"], r["_hash"], r["_ckey"], r["_maybe"]) for r in out.collect()} == {("k", 1, 2, 3)}
    got = {(r.rawid, r.target): (r.first_id, r.n_copies) for r in out.collect()}
    assert got[1, None] == got[2, None] == (1, 2) and got[3, ""] == (3, 1) and got[4, None] == got[5, None] == (4, 2)
    assert got[6, "p=1; q=2"] == got[7, "Q: 2 | P: 1"] == (6, 2) and got[8, "p=2; q=1"] == (8, 1) and got[9, "y"] == (9, 2)
    assert duplicates.collapse(df.limit(0), duplicates.link_key(), "rawid").count() == 0


def test_bloom_filters_lose_nothing():
    rng = np.random.default_rng(1)
    h = rng.integers(-(2**63), 2**63 - 1, 5000)
    page, bits = duplicates.positions(h, 3)
    assert page.max() < 3 and bits.max() < duplicates.PAGE_BITS
    bitmap = np.zeros(3 * duplicates.PAGE_BYTES, np.uint8)
    duplicates.set_bits(bitmap, page, bits)
    assert duplicates.has_bits(bitmap, page, bits).all()
    other = rng.integers(-(2**63), 2**63 - 1, 5000)
    assert duplicates.has_bits(bitmap, *duplicates.positions(other, 3)).mean() < 0.02


# --- names


def slow_edits(a, b):
    d = {}
    for i in range(-1, len(a) + 1):
        d[i, -1] = i + 1
    for j in range(-1, len(b) + 1):
        d[-1, j] = j + 1
    for i in range(len(a)):
        for j in range(len(b)):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i] != b[j]))
            if i and j and a[i] == b[j - 1] and a[i - 1] == b[j]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a) - 1, len(b) - 1]


def misspell(rng, s):
    i = int(rng.integers(0, len(s)))
    k = rng.integers(0, 4)
    if k == 0:
        return s[:i] + s[i + 1 :]
    if k == 1:
        return s[:i] + "q" + s[i:]
    if k == 2:
        return s[:i] + "w" + s[i + 1 :]
    i = min(i, len(s) - 2)
    return s[:i] + s[i + 1] + s[i] + s[i + 2 :]


def test_segment_keys_are_complete():
    """Whatever is as many edits away as its length allows shares a key, whichever side is looked up, and no key is of one
    letter; banded edits equal the full table."""
    rng = np.random.default_rng(3)
    for _ in range(3000):
        s = "".join(rng.choice(list("abcdefgh"), int(rng.integers(3, 15))))
        t = misspell(rng, s) if rng.random() < 0.3 else misspell(rng, misspell(rng, s))
        want = slow_edits(s, t)
        assert names.edits(s, t, 2) == min(want, 3) and names.edits(s, t, 1) == min(want, 2)
        a, b = (s, t) if len(s) >= len(t) else (t, s)
        for most in (1, 2):
            if want <= min(most, names.allowed(len(s), len(t))):
                assert names.probe_keys(a, most) & names.index_keys(b, most), (s, t)
            assert len(b) < 2 or all(len(k.split(",", 2)[2]) > 1 for k in names.index_keys(b, most))


def test_near_texts_brute_force(spark):
    rng = np.random.default_rng(4)
    texts = ["".join(rng.choice(list("abcd"), int(rng.integers(2, 10)))) for _ in range(60)]
    texts = sorted({x for t in texts for x in (t, misspell(rng, t + "xy"), misspell(rng, misspell(rng, t)))})
    df = spark.createDataFrame([(t, "b" if i % 3 else "c") for i, t in enumerate(texts)], "text string, block string")
    block = {t: "b" if i % 3 else "c" for i, t in enumerate(texts)}
    near = lambda x, y, m: x != y and slow_edits(x, y) <= min(m, names.allowed(len(x), len(y)))
    for most in (1, 2):
        want = {frozenset((x, y)) for x in texts for y in texts if near(x, y, most)}
        got = [frozenset((r.a_text, r.b_text)) for r in names.near_texts(df, most, False).collect()]
        assert set(got) == want and len(want) > 20
        assert {frozenset((r.a_text, r.b_text)) for r in names.near_texts(df, most).collect()} == {p for p in want if len({block[x] for x in p}) == 1}


@pytest.mark.parametrize("name,want", [
    ("Robert M. Sormo", ("sormo", "robert", "m", True)), ("Sormo, Robert (ed.)", ("sormo", "robert", "", True)), ("SORMO, R.M.", ("sormo", "r", "m", True)), ("RM Sormo", ("sormo", "r", "m", True)), ("Sormo R", ("sormo", "r", "", True)),
    ("Dr. Søren van der Kex-Ruhl", ("van der kex-ruhl", "soren", "", True)), ("  ", None), ("", None), ("Anonymous", None), ("123", None), ("Sir Zoë  Kex", ("kex", "zoe", "", True)),
])
def test_read_author(name, want):
    assert names.read_author(name) == want


def test_link_names(spark):
    people = [["Robert M. Sormoplowick", "Sormoplowick, Bob", "R. Sormoplowick", "Robbert Sormoplowick", "SORMOPLOWICK, Robert", "Sir Robert Sormoplowikc", "Sormoplowick Robert"], ["Anna Sormoplowick"], ["Thomas Kelard", "Kelard, Tom"], ["Tavish Kelard"], ["X. Y. Zedekiah"]]
    houses = [["Quellstein University Press", "Quellstein U.P.", "Univ. Press of Quellstein", "Quelstein Universty Press"], ["Quellstein Books", "Books by Quellstein", "Quellstein Bks."], ["Arrow & Bolton Ltd.", "Bolton & Arrow", "Arrow, Bolton & Co. Ltd."], ["Verlag Ostrander", "Ostrander-Verlag", "Ostranderverlag", "Ostrander Verlag GmbH & Co. KG"]]
    rows = [(n, None) for p in people for n in p] + [(None, n) for h in houses for n in h] + [("", " "), (None, None), ("T. Kelard", None), ("Anonymous", "Ltd."), ("Thomas Kelard", None)]
    df = spark.createDataFrame(rows, "author string, publisher string").withColumn("name", F.lit("clash"))
    for kind, groups in (("author", people), ("publisher", houses)):
        linked = names.link_names(df, kind, kind)
        got = {(r.name_a, r.name_b) for r in names.same_entity_pairs(linked).collect()}
        assert got == {(a, b) for g in groups for a in g for b in g if a < b}
    # 'T. Kelard' may be either of two persons: it is an entity of its own
    assert {r.name for r in names.link_names(df, "author", "author").collect()} >= {"T. Kelard"}
    assert names.link_names(df.limit(0), "author", "author").count() == 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 101), (102, 101), (7, 7)]
    got = {r.node: r.root for r in names.components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()}
    assert all(got[i] == 0 for i in range(61)) and got[102] == got[101] == 100


# --- encoding

ODD = [None, "", " ", "\n\n  x", "a\x1cb\x85c", "x" * 40_000, "ab" * 3000, "日本語" * 700, "naïve ½ ²٣", "😀👨‍👩‍👧", "don't they'll", "�​　", "<|endoftext|>"]


def test_encoding_equals_public_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    import public_tokenizers

    t = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    docs = table(spark, SF, "documents").select("doc_id", "text").unionByName(spark.createDataFrame([(10**6 + i, x) for i, x in enumerate(ODD)], "doc_id bigint, text string"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r.ids for r in encode_corpus(docs.withColumn("ids", F.lit(1))).collect()}
    assert got == {i: t.encode(x or "", add_special_tokens=False).ids for i, x in texts.items()}
    n = {r.doc_id: r.n_tokens for r in count_tokens(docs, ["doc_id"]).collect()}
    assert n == {i: len(x) for i, x in got.items()}
    assert encode_corpus(docs.limit(0)).count() == 0


def test_segment_tree_against_plain_merging():
    e = Encoder(read_ranks(VOCABULARY))

    def plain(b):
        parts = e.byte_id[np.frombuffer(b, np.uint8)].tolist()
        while True:
            ranks = [(e.pairs.get(x * int(e.width) + y, 1 << 40), i) for i, (x, y) in enumerate(zip(parts, parts[1:]))]
            r, i = min(ranks, default=(1 << 40, 0))
            if r == 1 << 40:
                return parts
            parts[i : i + 2] = [r]

    rng = np.random.default_rng(2)
    words = [bytes(rng.choice(np.frombuffer(b"abcdeghilnorstu \xc3\xa9", np.uint8), int(rng.integers(2, 40)))) for _ in range(300)]
    for group in (words[:150], words[150:]):
        assert [x.tolist() for x in e.merge_many(group)] == [plain(w) for w in group]
    assert [e.merge_one(w).tolist() for w in words[:60]] == [plain(w) for w in words[:60]]


# --- mixing


def test_mix(spark):
    docs = [(i, "a", "word " * 10) for i in range(300)] + [(1000 + i, "b", "word " * (1 + i % 7)) for i in range(40)] + [(2000, "b", None), (2001, None, "x"), (2002, "unwished", "x"), (2003, "b", "")]
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.4, 5), ("none", 0.1, 3), (None, 0.0, 1)], "source string, weight double, max_repeats int")
    df = spark.createDataFrame(docs, "doc_id bigint, source string, text string").withColumn("n_tokens", F.lit("clash"))
    out, shares = mix(df, targets)
    rows = {r.doc_id: r for r in out.collect()}
    assert set(rows) == {d[0] for d in docs} - {2001, 2002} and rows[2000].n_copies == rows[2003].n_copies == 0
    got = {r.source: r for r in shares.collect()}
    assert abs(got["a"].share / got["b"].share - 1.25) < 0.02 and got["none"].share == 0 and got["b"].most_copies <= 5 and got["a"].most_copies == 1
    tokens = Counter()
    for r in rows.values():
        tokens[r.source] += r.n_tokens * r.n_copies
        assert r.n_copies in (int(r.rate), int(r.rate) + 1)
    assert tokens["a"] == got["a"].tokens and tokens["b"] == got["b"].tokens
    small = mix(df, targets, total_tokens=500)[1].collect()
    assert abs(sum(r.tokens for r in small) - 500) < 30
    assert mix(df.limit(0), targets)[0].count() == 0 and all(r.share == 0 for r in mix(df.limit(0), targets)[1].collect())
    with pytest.raises(ValueError):
        mix(df, targets.unionByName(targets))


# --- personal information


def test_forward_backward_against_enumeration():
    from itertools import product

    rng = np.random.default_rng(0)
    nodes, start, step = rng.normal(size=(1, 4, 3)), rng.normal(size=3), rng.normal(size=(3, 3))
    belief, _, log_z = forward_backward(nodes, np.array([4]), start, step)
    total, sums = 0.0, np.zeros((4, 3))
    for y in product(range(3), repeat=4):
        p = np.exp(start[y[0]] + sum(nodes[0, t, y[t]] for t in range(4)) + sum(step[a, b] for a, b in zip(y, y[1:])))
        total += p
        for t in range(4):
            sums[t, y[t]] += p
    assert np.allclose(belief[0], sums / total)


def test_model_on_held_out_lines():
    f, g = Finder(default_model()), Grammar(777)
    lines = [g.line() for _ in range(600)]
    found = f.find([t for t, _ in lines])
    right = sum(set(x) == set(items) for x, (_, items) in zip(found, lines))
    assert right / len(lines) > 0.95


def test_skip_edges_carry_labels():
    """A spelling that is unclear by itself takes the label it has where it is clear."""
    m = default_model()
    nodes = [np.zeros((1, len(m.labels))), np.zeros((1, len(m.labels)))]
    nodes[0][0, 4] = 6.0
    nodes[1][0, 0] = 0.5
    first = m.beliefs(nodes)
    same = np.where(np.eye(len(m.labels)) > 0, 3.0, 0.0)
    after = m.loopy(nodes, first, np.array([[0, 0, 1, 0]]), same)
    assert after[1][0, 4] > first[1][0, 4]


@pytest.mark.parametrize("text", ["( Qorvath Zelminor" + "\n; Qorvath Zelminor" * 3, "( Qorvath Zelminor" + " ; Qorvath Zelminor" * 3])
def test_a_clear_mention_mends_all_others(text):
    """After '(' a name is clear, after ';' it is rather none: in lines of their own, and in one line."""
    f = Finder(default_model())
    def nodes(classes):
        out = np.zeros((len(classes), 8))
        for i, c in enumerate(classes):
            if c in "(;":
                out[i, 0] = 9.0
            else:
                first = classes[i - 1] in "(;"
                clear = classes[i - 1 if first else i - 2] == "("
                out[i, 4 if first else 5] = 6.0 if clear else 0.0
                out[i, 0] = 0.0 if clear else 0.6
                out[i, [1, 2, 3, 6, 7, 5 if first else 4]] = -6.0
        return out

    f.nodes = nodes
    assert [text[s:e] for s, e, _ in sorted(f.find([text])[0])] == ["Qorvath Zelminor"] * 4


def test_names_are_found_again_without_an_anchor():
    """Neither given name nor surname is known, and the later lines have no word that points to a person."""
    text = "Inventor: Qorvath Zelminor\nThe valve 12 closes.\nQorvath Zelminor observed that the seal held.\nParts of the Zelminor GmbH were used.\nSteel Zelminorite."
    found = sorted(Finder(default_model()).find([text])[0])
    assert [(text[s:e], k) for s, e, k in found] == [("Qorvath Zelminor", "person")] * 2


#: A known limit: nothing announces the name, and no list has the given name. Found before only as such sentences were trained on.
UNANNOUNCED = pytest.mark.xfail(reason="an unlisted name that nothing announces", strict=False)


@pytest.mark.parametrize("text,name", [("A sketch made by Renske Tabraim is annexed.", "Renske Tabraim"), pytest.param("Mirel Nigenby observed that the seal held.", "Mirel Nigenby", marks=UNANNOUNCED), pytest.param("Ikaika Braforston hat die Proben gegossen.", "Ikaika Braforston", marks=UNANNOUNCED), pytest.param("Les essais ont été menés par Renske Sobrez à l'atelier.", "Renske Sobrez", marks=UNANNOUNCED)])
def test_every_line_is_decided(text, name):
    """Given names on no list, and no word that points to a person."""
    plain = "The valve 12 closes.\nHere \ufffd\ufffd = 0.39, where the constant follows from Table 2."
    doc = f"{plain}\n{text}\n{plain}"
    assert [(doc[s:e], k) for s, e, k in Finder(default_model()).find([doc])[0]] == [(name, "person")]


@pytest.mark.parametrize("text,item,kind", [("Data sheets can be had from kel ( at ) post.drih.example now.", "kel ( at ) post.drih.example", "email"), ("Write to drih.kel AT post DOT drih DOT example", "drih.kel AT post DOT drih DOT example", "email"), ("Mobile +61 30 2312500", "+61 30 2312500", "phone"), ("A1exander Tabraim observed that the seal held.", "A1exander Tabraim", "person")])
def test_writings_that_had_no_anchor(text, item, kind):
    """Whatever the lexer reads as a token is looked at; words as mended."""
    doc = f"The valve 12 closes.\n{text}"
    assert [(doc[s:e], k) for s, e, k in Finder(default_model()).find([doc])[0]] == [(item, kind)]


@pytest.mark.parametrize("line", ["Tel. +44 (0)1632 960187", "a@b = b@a", "_12345678A x12345678A R1 QX6 4ZQ", "AndrÃ© Ã\x80\x80 © °C µm", "ca1l l0 B1O A10BCDEFG _A10BCDEFG", "電話 03-0000-1234 アカ・タナ", "kel [at] drih.example, kel AT drih DOT org", "  a\tb  ", "l'eau d’Or x-1-y"])
def test_classes_of_a_line(line):
    spans, classes = tokens(line)
    assert line_classes(line) == classes and token_texts(line) == [line[s:e] for s, e in spans]


@pytest.mark.parametrize("unit", ["a.", "1.", "1 ", "A1", "x_", "+(1)", "é-", "市", "ア・", "Ax, ", "Inventor: ", "A. ", "@", "a@a.", "12 bis, rue "])
def test_long_odd_lines_take_linear_time(unit):
    import time

    f, took = Finder(default_model()), []
    for n in (20_000, 80_000):
        began = time.process_time()
        f.find(["Inventor: " + unit * (n // len(unit))])
        took.append(time.process_time() - began)
    assert took[1] < 8 * took[0] + 1


def test_a_line_is_looked_up_once_not_once_a_mention():
    """What a mention costs does not grow with the mentions of its line."""
    f, asked = Finder(default_model()), Counter()

    class Known(dict):
        def __getitem__(self, classes):
            asked[len(classes)] += 1
            return super().__getitem__(classes)

    f.known = Known()
    f.find(["Inventor: " + "Ax, " * 500])
    assert sum(asked.values()) < 20


ODD = [*"ABXabe0123579 .,-()+/@'é", "  ", "\n", " \n", "(57) ", "(72)5", "[at]", " AT ", " DOT ", "ア", "・", "阿", "斯", "省", "市", "号", "県", "丁目", "番", "５", "（", "Ã", "\x80", "©", "²", "\t", "\r", "\x85", "QX6 4ZQ", "AB-123-4567", "AB12345678", "the", "l'", "한", "🙂", "_"]


def test_what_is_kept_of_lines_is_what_tokens_are():
    """Lines looked up by parts and by texts alike, the texts and places of their tokens, and joined lines."""
    rng = np.random.default_rng(3)
    for _ in range(8000):
        text = "".join(rng.choice(ODD, rng.integers(1, 20)))
        want, at = [], 0
        for line in text.split("\n"):
            spans, classes = tokens(text, at, at + len(line))
            if classes:
                want.append((at, at + len(line), classes))
                assert token_spans(text, at, at + len(line), classes) == spans and token_texts(line, classes) == [text[s:e] for s, e in spans]
            at += len(line) + 1
        lines = alike(text).split("\n")
        assert segments(lines, {x: line_classes(x) or None for x in lines}) == want
        spans, classes = tokens(text)
        assert token_spans(text, 0, len(text), classes) == spans and token_texts(text, classes) == [text[s:e] for s, e in spans]
        for a, b in zip(want, want[1:]):
            if b[0] == a[1] + 1:
                assert lines_classes(text, a[0], b[1], [a[2], b[2]]) == tokens(text, a[0], b[1])[1]


def test_lines_alike_and_clear_lines_are_read_once(monkeypatch):
    """Lines that differ in digits above one are one line; the words of lines without a doubtful mention are not looked for."""
    from linkframe.llm import pii

    read = Counter()
    monkeypatch.setattr(pii, "token_texts", lambda line, *of: read.update([line]) or token_texts(line, *of))
    f = Finder(default_model())
    f.find(["\n".join(f"The valve {a}{b} of the Kelard GmbH closes at {b}.{a} mm." for a in range(2, 10) for b in range(2, 10)) + "\nInventor: Robert M. Tabraim"] * 3)
    assert len(f.lines) == 2 and all("Tabraim" in line for line in read)


def test_long_texts_are_worked_in_parts(monkeypatch):
    """Few long texts or many short ones at once; none lost, none twice."""
    import pyarrow as pa

    from linkframe.llm import pii

    def sizes(texts):
        parts = list(pii.parts_of(pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], ["id", "text"])))
        assert [t for p in parts for t in p.column(1).to_pylist()] == texts
        return [p.num_rows for p in parts]

    assert sizes([]) == [] and sizes(["x"] * 4001) == [2000, 2000, 1]
    monkeypatch.setattr(pii, "MOST_BYTES", 100)
    assert sizes(["é" * 30, None, "x" * 40, "y", "z" * 500, "", "w"]) == [3, 1, 1, 2]


def test_marginals_against_forward_backward():
    rng = np.random.default_rng(1)
    m = default_model()
    size = rng.integers(1, 30, 50)
    nodes = [rng.normal(size=(n, len(m.labels))) * 3 for n in size]
    for x, got in zip(nodes, m.beliefs(nodes)):
        assert np.allclose(forward_backward(x[None], np.array([len(x)]), m.start, m.step)[0][0], got, atol=1e-5)


TEXT = "Inventor: Robert M. Kelard\nTel. +44 (0)1632 960187\nresiding at Flat 4, 3 Drovappo Road\nDaikashaw\nQX6 4ZQ\nmail kel [at] post.drih.example today, SSN 901 50 8669 (to be struck out)\nTests 555-11-246 and 2032-09-304 by Kelard GmbH gave a@b = b@a + 5."


def test_find_and_redact(spark):
    docs = spark.createDataFrame([(1, TEXT), (2, None), (3, ""), (4, " \n\t"), (5, TEXT), (6, "z" * 300_000 + "\n" + TEXT), (7, "\x00￿🙂")], "doc_id bigint, text string").withColumn("kind", F.lit("clash"))
    got = defaultdict(set)
    for r in find_items(docs).collect():
        got[r.doc_id].add((r.kind, r.matched))
    want = {("person", "Robert M. Kelard"), ("phone", "+44 (0)1632 960187"), ("address", "Flat 4, 3 Drovappo Road\nDaikashaw\nQX6 4ZQ"), ("email", "kel [at] post.drih.example"), ("idnum", "901 50 8669")}
    assert got == {1: want, 5: want, 6: want}
    clean = {r.doc_id: r.text for r in redact(docs).collect()}
    assert clean[2] is None and clean[3] == "" and clean[4] == " \n\t" and clean[7] == "\x00￿🙂"
    assert clean[1] == "Inventor: [PERSON]\nTel. [PHONE]\nresiding at [ADDRESS]\nmail [EMAIL] today, SSN [IDNUM] (to be struck out)\nTests 555-11-246 and 2032-09-304 by Kelard GmbH gave a@b = b@a + 5."
    assert find_items(docs.limit(0)).count() == 0
