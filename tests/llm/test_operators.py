"""The dealt operators against brute force, on small tables with the awkward cases."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quireflow.llm import bpe, chat, decontaminate, languages, licences, neardup, quality, substrings, tokencounts, wrappers
from quireflow.llm.components import components
from quireflow.llm.vocab import rank_file, whole_pieces, word_start_pieces

tokenizers = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, tag string, row string, words string, kept string"
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def _prose(seed: int, n: int) -> str:
    draw = random.Random(seed)
    return " ".join("".join(draw.choices("abcdeéß", k=draw.randint(1, 7))) for _ in range(n))


TEXTS = [
    _prose(1, 120), _prose(1, 120), _prose(1, 118) + " x y", "Zz " + _prose(1, 120), _prose(2, 60) + "\n" + _prose(3, 40),
    _prose(3, 40) + " " + _prose(4, 50), None, "", " \t\n ", "one", "One two\x0bthree", "a b c d", _prose(5, 9) + " " + _prose(5, 9),
    "line one here\nline one here\n \n \nlast|#*", _prose(6, 6000), "the the " * 400, "word" * 3000, "　漢字 é x",
    _prose(7, 34), _prose(7, 35), _prose(7, 36),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", len(t or ""), "k", "t", "r", "w", "no") for i, t in enumerate(TEXTS)]
    rows += [rows[4], (4, "another text under a known id", *rows[4][2:]), (None, TEXTS[0], *rows[0][2:]), (None, None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def _same(got, expected):
    assert Counter(map(tuple, got)) == Counter(expected)


def _words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def _ascii_words(text: str | None) -> list[str]:
    lowered = (text or "").encode().translate(LOWER).decode()
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def vocabulary():
    return rank_file(tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def test_bpe_equals_the_public_library(docs, rows, vocabulary):
    tiktoken = pytest.importorskip("tiktoken")
    other = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks={p: i for i, p in enumerate(vocabulary)}, special_tokens={})
    expected = []
    for i, t in rows:
        ids = other.encode_ordinary(t or "")
        expected.append((i, len(ids), _sha(",".join(map(str, ids))), _sha(t or "")))
    got = bpe.encode(docs, vocabulary, tokenizers.PATTERN, with_ids=True)
    _same(got.select("row.doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect(), expected)
    back = bpe.decode(got.select("ids"), vocabulary).select(F.sha2("decoded", 256)).collect()
    _same(back, [(_sha(t or ""),) for _, t in rows])


def test_bpe_fold_with_higher_order_functions(spark, vocabulary):
    ranks = {p: i for i, p in enumerate(vocabulary)}
    words = sorted({w for t in TEXTS[:5] for w in (t or "").split()} | {" the", "é", "x"})[:80]
    got = bpe.encode_words(spark.createDataFrame([(w,) for w in words], "word string"), bpe.rank_map(vocabulary)).collect()
    _same([(r.word, tuple(r.ids)) for r in got], [(w, tuple(bpe.merge(w.encode(), ranks))) for w in words])


def _brute_contamination(rows, items, window=10):
    wins = {}
    for item, text in items:
        w = _ascii_words(text)
        for s in range(max(len(w) - window, 0) + 1) if w else ():
            wins.setdefault(tuple(w[s : s + window]), set()).add("" if item is None else str(item))
    out = []
    for i, text in rows:
        w, hit, named = _ascii_words(text), set(), set()
        for k in {len(x) for x in wins}:
            for s in range(len(w) - k + 1):
                if (found := wins.get(tuple(w[s : s + k]))) is not None:
                    hit.update(range(s, s + k))
                    named |= found
        out.append((i, len(w), len(hit), len(named), _sha(",".join(sorted(named))), bool(hit)))
    return out


def test_decontamination(spark, docs, rows):
    items = [(1, " ".join(_words(TEXTS[4])[5:20]).upper()), (10, "line ONE here"), (2, "absent words only"), (3, None), (4, "..."), (5, "the"), (5, "the"), (6, "last"), (None, _prose(5, 9))]
    table = spark.createDataFrame(items, "item_id long, text string")
    _same(decontaminate.contamination(docs, table).collect(), _brute_contamination(rows, items))
    clean = decontaminate.clean(docs, table)
    assert clean.columns == docs.columns
    _same([(r.doc_id,) for r in clean.collect()], [(x[0],) for x in _brute_contamination(rows, items) if not x[-1]])
    _same(decontaminate.contamination(docs.limit(0), table).collect(), [])
    _same(decontaminate.contamination(docs, table.limit(0)).collect(), _brute_contamination(rows, []))


def test_proximity_matches(spark):
    given = spark.createDataFrame([(1, "alpha beta gamma delta epsilon"), (2, "alpha beta new gamma delta epsilon"), (3, "epsilon alpha")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "alpha beta gamma delta epsilon")], "item_id long, text string")
    found = decontaminate.matches(decontaminate.keyed(given), items, slop=2).groupBy("key").agg(F.max("exact").alias("e")).collect()
    assert {(r.key, r.e) for r in found} == {(1, True), (2, False)}


def test_proximity_equals_brute_force(spark):
    draw = random.Random(8)
    item = "w0 w1 w2 w3 w4 w5 w6 w2 w8 w9 w10 w11".split()
    texts = ["w0 w1 w2 w3 other w5 w6 w2 w8 w9", "w3 w4 w5 w6 w2 w8 w9 w10", "w9 w8 w2 w6 w5 w4 w3 w2 w1 w0", " ".join(item)]
    for _ in range(120):
        w = [f"x{draw.randrange(5)}" for _ in range(draw.randrange(6))] + item[draw.randrange(3) :]
        for _ in range(draw.randrange(6)):
            k = draw.randrange(len(w) + 1)
            w[k : k + draw.randrange(2)] = draw.choice(([], [f"x{draw.randrange(5)}"], ["W5"], ["absent-not"]))
        texts.append(" ".join(w))
    items = [(1, " ".join(item)), (2, "w0 nowhere w2"), (3, "w3 w4 gone w5 w6 w8 gone2 w9 w10 w11")]
    slop, expected = 2, []
    for i, text in enumerate(texts):
        w, near, owners = _ascii_words(text), set(), set()
        for key, own in items:
            own = own.split()
            for s in range(max(len(own) - 10, 0) + 1):
                win = own[s : s + 10]
                need = 0.8 * len(set(win))
                at = [len({t for o, t in enumerate(win) if t in w[max(p + o - slop, 0) : max(p + o + slop + 1, 0)]}) for p in range(-14, len(w) + 4)]
                if max(at) >= need and not any(w[p : p + len(win)] == win for p in range(len(w))):
                    near.add(tuple(win))
                    owners.add(key)
        expected.append((i, len(near), len(owners)))
    assert expected[0][1:] == (1, 1) and sum(n > 0 for _, n, _ in expected) > 20
    tables = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    _same(decontaminate.proximity(*tables, slop=slop).collect(), expected)
    _same(decontaminate.proximity(tables[0].limit(0), tables[1]).collect(), [])


def _repeats(words: list[str], least: int) -> tuple[int, int]:
    covered, longest = set(), 0
    order = sorted(range(len(words)), key=lambda i: words[i:])
    for a, b in zip(order, order[1:], strict=False):
        k = 0
        while max(a, b) + k < len(words) and words[a + k] == words[b + k]:
            k += 1
        if k >= least:
            longest = max(longest, k)
            covered.update(range(a, a + k), range(b, b + k))
    return len(covered), longest


def test_quality_rules(docs, rows):
    expected = []
    for i, t in rows:
        w = _words(t)
        grams = Counter(zip(w, w[1:], w[2:], strict=False))
        twice = {k for s in range(len(w) - 2) if grams[tuple(w[s : s + 3])] > 1 for k in (s, s + 1, s + 2)}
        lines = [x for x in (t or "").split("\n") if _words(x)]
        failed = len(w) < 50 or 100 * len(twice) > 50 * len(w)
        covered, longest = _repeats(w, 8)
        kept = not failed and covered <= 0.3 * len(w) and longest <= 0.2 * len(w)
        symbols = len(re.findall(r"[#*$%&|<>]", t or ""))
        expected.append((i, len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(twice), covered, longest, failed, kept))
    got = quality.judge(docs)
    _same(got.select("row.doc_id", *got.columns[1:]).collect(), expected)
    assert quality.judge(docs.limit(0)).count() == 0


def test_substrings_in_memory_and_by_count(docs, rows):
    texts = [(i, _words(t)) for i, t in rows]
    seen = Counter(tuple(w[s : s + 35]) for _, w in texts for s in range(len(w) - 34))
    expected = []
    for i, w in texts:
        gone = {k for s in range(len(w) - 34) if seen[tuple(w[s : s + 35])] > 1 for k in range(s, s + 35)}
        expected.append((i, len(w), len(gone), _sha(" ".join(x for k, x in enumerate(w) if k not in gone))))
    for group_rows in (substrings.GROUP_ROWS, 2):
        got = substrings.remove_repeats(docs, group_rows=group_rows)
        _same(got.select("row.doc_id", "n_words", "n_removed", "kept_sha256").collect(), expected)
    assert substrings.remove_repeats(docs.limit(0)).count() == 0


def _sets(rows):
    for _, t in rows:
        w = [x.decode() for x in (t or "").encode().translate(LOWER).split()]
        yield frozenset(tuple(w[s : s + 5]) for s in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def test_near_duplicates(spark):
    base = _prose(11, 200).split()
    draw = random.Random(3)
    texts = []
    for i in range(60):  # copies of copies: many are near only some of the others
        w = list(base)
        for _ in range(draw.choice((1, 3, 5, 7, 9, 12))):
            w[draw.randrange(len(w))] = f"new{i}{draw.random()}"
        texts.append(" ".join(w))
    rows = list(enumerate(texts + texts[:5] + [_prose(20 + k, 80) for k in range(20)] + [None, "", "one", "ONE", "a b c d", "a b c"]))
    sets = list(_sets(rows))
    least = list(range(len(rows)))

    def root(x):
        while least[x] != x:
            x = least[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            k = len(sets[a] & sets[b])
            if k and 100 * k >= 75 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                least[max(x, y)] = min(x, y)
    expected = [(i, len(sets[i]), root(i), root(i) == i) for i, _ in rows]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    _same(neardup.near_duplicates(table).collect(), expected)
    assert neardup.near_duplicates(table.limit(0)).count() == 0


def test_near_duplicates_in_small_blocks(docs, monkeypatch):
    whole = neardup.near_duplicates(docs).collect()
    monkeypatch.setattr(neardup, "BLOCK", 2)
    _same(neardup.near_duplicates(docs).collect(), [tuple(r) for r in whole])
    assert {r.component_id for r in whole if r.doc_id in (0, 1)} == {0}


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, k) for k in range(101, 140)] + [(7, 7), (None, 3)]
    got = components(spark.createDataFrame(edges, "u long, v long")).collect()
    _same(got, [(i, 0) for i in range(31)] + [(k, 100) for k in range(100, 140)])


def test_chat_folds_logs(spark):
    log = [
        (1, 5, "delta", 1, "user", "Hi "), (1, 6, "delta", 1, "user", "<|im_end|>\\p\\"), (1, 7, "delta", 2, "assistant", "wrong"),
        (1, 8, "regenerate", 2, "assistant", "ignored"), (1, 9, "delta", 2, "assistant", "right"), (1, 10, "delta", 2, "assistant", None),
        (1, 11, "edit", 1, "user", "edited <|x"), (1, 12, "delta", 1, "user", " more"), (None, 1, "delta", 1, None, None), (2, 1, "regenerate", 1, "assistant", None),
    ]
    events = spark.createDataFrame(log, "conv_id long, seq long, kind string, message int, role string, text string")
    rendered = chat.render(chat.fold(events))
    told = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in rendered.select("conv_id", chat.parse(F.col("formatted")).alias("turns")).collect()}
    assert told == {1: [("user", "edited <|x more"), ("assistant", "right")], None: [("", "")], 2: [("assistant", "")]}
    learnt = {r.conv_id: r.loss_chars for r in chat.digest(rendered).collect()}
    assert learnt == {1: 5, None: 0, 2: 0}
    assert chat.render(chat.fold(events.limit(0))).count() == 0


def test_licences(docs, spark):
    texts = ["Under the MIT License, or the mit license.", "licensed under the Apache License, Version 2.0.", "GNU General Public License v3 text", "Licensed under CC BY-NC 4.0.", "cc by mit", None, ""]
    got = {r.doc_id: r for r in licences.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [(got[i].n_base, got[i].first_word, got[i].last_word, got[i].base_labels) for i in range(7)] == [
        (2, 2, 6, "mit"), (1, 3, 3, "apache"), (1, 1, 1, "gpl"), (0, None, None, ""), (0, None, None, ""), (0, None, None, ""), (0, None, None, "")
    ]
    assert "cc-by-nc" in got[3].labels and got[4].labels == "" and all(0 <= r.score <= 1 for r in got.values())
    assert licences.scan(docs).count() == docs.count() and licences.scan(docs.limit(0)).count() == 0


def test_licences_of_a_text_with_every_notice(spark):
    notices = {label: text for label, (text, _) in licences.TEMPLATES.items()}
    texts = [" . ".join(notices.values()), " . ".join(notices[k] for k in ("mit", "apache", "gpl", "bsd")), *notices.values()]
    got = {r.doc_id: r for r in licences.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got[0].labels.split(",") == sorted(notices)
    assert set(got[1].labels.split(",")) >= {"mit", "apache", "gpl", "bsd"}
    for i, label in enumerate(notices, 2):
        assert label in got[i].labels.split(",") and got[i].score == pytest.approx(1)
    assert got[0].score == got[1].score == pytest.approx(1)


def test_language_codes(spark, docs):
    texts = [("en", "the house of the and with that this"), ("de", "das haus und der die mit ein nicht"), ("fr", "la maison et le de un pour dans")]
    train = spark.createDataFrame([(i, f"{t} {_prose(i, 3)}", lang) for i in range(10) for lang, t in texts], "doc_id long, text string, lang string")
    model = languages.fit(train)
    ask = spark.createDataFrame([(1, "der hund und die katze mit nicht"), (2, None), (3, "12 ... !"), (4, "the cat and that dog")], "doc_id long, text string")
    got = {r.doc_id: r for r in languages.identify(ask, model).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3, 4)] == ["de", "und", "und", "en"] and got[2].score == 0
    assert languages.identify(docs, model).count() == docs.count()
    assert {r.lang_pred for r in languages.identify(ask, languages.fit(train.limit(0))).collect()} == {"und"}
    assert {r.lang_pred for r in languages.identify(ask, languages.fit(train.filter("lang = 'de'"))).collect()} == {"und", "de"}
    code = languages.codewords(12).astype(int)
    assert min((code[a] != code[b]).sum() for a in range(12) for b in range(a)) >= 8


def test_held_out_accuracy(spark):
    from quireflow.llm.queries import QUERIES

    folder = "/root/testdata/sf0.01"
    told = QUERIES["op8_language_id"](spark, folder).filter("held_out").join(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang"), "doc_id")
    assert told.filter("lang = lang_pred").count() >= 0.98 * told.count()


def test_token_counts_equal_greedy_matching(docs, rows):
    pieces = word_start_pieces(tokenizers.path("piece_bpe_32k.model"))
    head, rest = {p[1:] for p in pieces if p[0] == "▁" and len(p) > 1}, {p for p in pieces if p[0] != "▁"}

    def count(word):
        n = at = 0
        while at < len(word):
            end = next((e for e in range(min(len(word), at + 40), at, -1) if word[at:e] in (rest if at else head)), None)
            if end is None:
                return None
            at, n = end, n + 1
        return n

    expected = []
    for i, t in rows:
        found = [count(w) for w in (t or "").split()]
        expected.append((i, len(found), sum(1 if f is None else f for f in found), found.count(None)))
    _same(tokencounts.token_counts(docs, pieces).collect(), expected)


def _greedy(word, pieces, byte_pieces):
    text, n, at = "▁" + word, 0, 0
    while at < len(text):
        end = next((e for e in range(min(len(text), at + 40), at, -1) if text[at:e] in pieces), None)
        if end is None:
            own = text[at].encode()
            if not byte_pieces.issuperset(own):
                return None
            end, n = at + 1, n + len(own) - 1
        at, n = end, n + 1
    return n


def test_token_counts_by_the_whole_piece_list(spark, docs):
    pieces, byte_pieces = whole_pieces(tokenizers.path("piece_bpe_32k.model"))
    known = set(pieces)
    assert "▁" in known and len(byte_pieces) == 256 and max(map(len, pieces)) <= 40
    texts = ["ñandú être ß", "漢字かな交じり文", "x\U00013000y", "a▁b ▁ ▁▁", "naïve 🙂🙂 ǅ"]
    given = docs.select("doc_id", "text").unionByName(spark.createDataFrame(list(enumerate(texts, 100)), "doc_id long, text string"))
    expected = []
    for r in given.collect():
        found = [_greedy(w, known, byte_pieces) for w in (r.text or "").split()]
        expected.append((r.doc_id, len(found), sum(found), 0))
    _same(tokencounts.token_counts(given, pieces, byte_pieces=byte_pieces).collect(), expected)


def test_token_automaton_against_greedy_matching():
    draw = random.Random(9)
    for _ in range(300):
        pieces = sorted({draw.choice(("", "▁")) + "".join(draw.choices("abé", k=draw.randint(1, 4))) for _ in range(draw.randint(1, 9))} | set(draw.sample(["▁", "a", "é"], draw.randint(0, 3))))
        byte_pieces = draw.choice((frozenset(), frozenset(range(256)), frozenset(b"ab"), frozenset("▁".encode())))
        automaton = tokencounts.Automaton(pieces, byte_pieces=byte_pieces)
        for _ in range(40):
            word = "".join(draw.choices("abéc", k=draw.randint(1, 9)))
            assert automaton.count(word) == _greedy(word, set(pieces), byte_pieces), (pieces, byte_pieces, word)


def test_main_text(spark):
    page = (
        "<!DOCTYPE html><html><head><title>T</title><script>var a='<p>';</script></head><body><nav><ul><li><a>Menu</a></ul></nav>"
        "<div class='cookie-notice'>Notice</div><header>Head</header><article><h1>T&amp;itle</h1><p>One <b>bold</b>\n text<br>next<p>Two"
        "<div class=comments><p>Reader</p></div><form>Form</form></article><aside>Side</aside><footer>&copy; F</footer>"
    )
    plain = "<body><p>Same everywhere</p><div><p>Own text {0}</p><ul><li>a{0}<li>b</ul></div></body>"
    rows = [(1, "http://a.example/1", page), (2, "http://b.example:80/x", plain.format(1)), (3, "https://B.example/y", plain.format(2)), (4, None, None), (5, "c", ""), (6, "http://d.example", "<p>cut <a href='")]
    got = {r.page_id: (r.text, r.n_chars) for r in wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1][0] == "T&itle\n\nOne bold text next\n\nTwo"
    assert got[2][0].startswith("Own text 1\n\na1") and got[3][0].startswith("Own text 2")
    assert got[4] == got[5] == ("", 0) and got[6][0].startswith("cut")
    assert all(n == len(t) for t, n in got.values())


def test_head_without_an_end():
    for page in ("<head><title>T</title><body><p>One<p>Two", "<html><head><meta charset=x>\n<p>One</p><p>Two</p>", "<head><link rel=x>One<p>Two", "<head><style>p{}</style></head><body><p>One<head><p>Two"):
        found = list(wrappers.blocks(page))
        assert [text for labels, text in found if not wrappers._is_outside(labels)] == ["One", "Two"], page


def test_near_copies_keep_the_text_they_share(spark):
    parts = [f"<h2>Heading {k}</h2><p>{_prose(40 + k, 30)}</p>" for k in range(6)]
    near = ["<body>" + "".join(parts[:3]) + f"<p>changed {k}</p>" + "".join(parts[3:]) for k in range(4)]
    frame = "<body><p>Same on every page</p><div><h1>{0}</h1>{1}</div>"
    far = [frame.format(f"Title {k}", "".join(f"<p>{_prose(60 + 5 * k + j, 25)}</p>" for j in range(2)) + ("<section><p>Only here</p></section>" if k == 1 else "")) for k in range(3)]
    rows = [(k, "http://near.example/", p) for k, p in enumerate(near)] + [(10 + k, "http://far.example/", p) for k, p in enumerate(far)]
    got = {r.page_id: r.text for r in wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    for k in range(4):
        assert all(f"Heading {j}" in got[k] and _prose(40 + j, 30) in got[k] for j in range(6)) and f"changed {k}" in got[k]
    for k in range(3):
        assert got[10 + k].startswith(f"Title {k}\n\n") and ("Only here" in got[10 + k]) == (k == 1)


def test_wrappers_are_union_free():
    one = wrappers.page_wrapper(list(wrappers.blocks("<body><h1>A</h1><ul><li>x<li>y</ul></body>")))
    two = wrappers.page_wrapper(list(wrappers.blocks("<body><h1>B</h1><p>extra</p><ul><li>x</ul></body>")))
    body = wrappers.align(one, two)["c"][0]
    assert [(c["l"], c["o"]) for c in body["c"]] == [("h1", False), ("p", True), ("ul", False)]
    assert body["c"][0]["c"] == [{"t": None}] and body["c"][2]["c"][0]["r"]


def test_pipeline_on_awkward_rows(spark, tmp_path):
    import corpus_pipeline

    kept = _prose(31, 90)
    rows = [(1, kept), (2, kept), (3, kept + " z"), (4, _prose(32, 100) + " " + _prose(33, 20)), (5, None), (6, "short"), (7, "a b c " * 60), (8, _prose(34, 70)), (9, _prose(34, 40) + " " + _prose(35, 60))]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, _prose(33, 20))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert sorted(got) == [1, 8, 9]  # 2, 3 near copies; 4 benchmark; 5, 6, 7 rules
    assert got[1].decoded_sha256 == _sha(kept)
    assert got[9].n_chars == len(" ".join(rows[8][1].split()[40:]))
