"""Divergence of sources, fingerprints and periodic runs against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quireflow.llm import divergence, imatch, periods, queries
from quireflow.llm.neardup import near_duplicates  # noqa: F401 - the package must import as a whole

SCHEMA = "doc_id long, text string, lang string, source string, row string, place long, term string, runs string, rank int"


def _lower(text: str | None) -> str:
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _prose(seed: int, n: int, letters: str = "abéß", longest: int = 5) -> str:
    draw = random.Random(seed)
    return " ".join("".join(draw.choices(letters, k=draw.randint(1, longest))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    langs, sources = ["en", "fr", None, ""], ["s0", "s1", "s2", None]
    out = [(i, _prose(i, i * 3), langs[i % 4], sources[i // 4 % 4]) for i in range(60)]
    out += [(60 + i, "Shared " * 14 + _prose(900 + i, 30) + " longwordthatgoesonandon" * (1 + i % 2) + "x" * (i % 3), "en", f"s{i % 3}") for i in range(16)]
    out += [(76, None, "en", "s9"), (77, "", "de", "s0"), (78, "...", "de", "s1"), (79, "a b " * 4000, "en", "s0"), (None, "Null id", "en", "s0")]
    out += [(None, None, None, None), out[5], out[5], (5, "another text of a known id", "en", "s1"), (80, "only one source", "it", "s0")]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, "r", 1, "t", "n", 2) for r in rows], SCHEMA).repartition(4).cache()


def _same(got, expected):
    assert Counter(map(tuple, got)) == Counter(expected)


def _brute_divergence(rows, threshold, top):
    held, counts, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", _lower(text))
        held[lang].update(set(terms))
        counts[lang, source].update(terms)
    out = []
    for lang in {g[0] for g in groups}:
        kept = sorted(t for t, n in held[lang].items() if n >= threshold)
        sources = sorted(s for g, s in groups if g == lang)

        def shares(count, kept=kept):
            total = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 2) // (total + 2 * len(kept)) for t in kept}

        q = shares(sum((counts[lang, s] for s in sources), Counter()))
        p = {s: shares(counts[lang, s]) for s in sources}
        distance = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(-sum(distance(p[s][t], p[o][t]) for t in kept), o.encode()) for o in sources if o != s]
            terms = [(-distance(p[s][t], q[t]), t.encode()) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, items in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, s, part, item.decode(), -value, i + 1) for i, (value, item) in enumerate(items)]
    return out


@pytest.mark.parametrize(("width", "ship"), [(1, 0), (4, 16 << 20), (2, 200)])
def test_divergence(docs, rows, width, ship):
    got = divergence.divergence(docs, threshold=4, width=width, ship_bytes=ship).collect()
    expected = _brute_divergence(rows, 4, 10)
    assert any(part == "term" and "longword" in item for _, _, part, item, _, _ in expected)
    _same(got, expected)


def test_divergence_without_kept_terms(docs, rows):
    got = divergence.divergence(docs, threshold=1000).collect()
    assert {r.part for r in got} == {"pair"} and {r.value for r in got} == {0}
    _same(got, _brute_divergence(rows, 1000, 10))
    assert divergence.divergence(docs.filter("false")).count() == 0


def test_partial_counts_are_the_same_for_any_chunk(docs, rows, monkeypatch):
    from quireflow.llm import words

    batch = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")]).toArrow().to_batches()
    whole = list(divergence._level(4, 0, None)(batch))
    monkeypatch.setattr(divergence, "_CHUNK_BYTES", 50)
    cut = list(divergence._level(4, 0, None)(batch))
    assert len(cut) > len(whole) and words.CHUNK_BYTES > 50

    def summed(parts):
        total = Counter()
        for part in parts:
            for r in part.to_pylist():
                total[r["lang"], r["source"], r["prefix"], r["whole"], "docs"] += r["docs"]
                total[r["lang"], r["source"], r["prefix"], r["whole"], "often"] += r["often"]
        return total

    assert summed(whole) == summed(cut)


def _brute_fingerprints(rows, rarest, commonest):
    def words(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", _lower(text))

    held = Counter(t for r in rows for t in set(words(r[1])))
    lexicon = {t for t, n in held.items() if n * rarest >= len(rows) and n * commonest <= len(rows)}

    def drawn(term):
        digest = _sha(term)
        return int(digest[0], 16), int(digest[1:5], 16).bit_length(), term.encode()

    def printed(text):
        found = sorted(map(drawn, set(words(text)) & lexicon))
        if not found:
            return _sha(" ".join(words(text)))[:16]
        whole, parts = "", []
        for n in range(16):
            own = [(level, term.decode()) for part, level, term in found if part == n]
            whole += _sha(" ".join(t for _, t in own))[:16] if own else ""
            parts.append(_sha(" ".join(t for level, t in own if level == own[0][0]))[:6] if own else "")
        return "-".join([_sha(whole)[:16], *parts])

    def near(a, b):
        if a == b:
            return 1.0
        pairs = [(x, y) for x, y in list(zip(a.split("-"), b.split("-"), strict=False))[1:] if x or y]
        return sum(x == y for x, y in pairs) / max(len(pairs), 1)

    return printed, near


def test_fingerprints(spark, docs, rows):
    printed, near = _brute_fingerprints(rows, 1000, 2)
    tags = {t: docs.sparkSession.sql("SELECT xxhash64(:t) AS h", {"t": t}).first().h for t in {r[1] or "" for r in rows if r[0] in (5, None)}}
    keys = sorted({(r[0] is None, -(r[0] or 0), tags.get(r[1] or "", 0), r[1] or "") for r in rows})
    expected = {}
    for i, key in enumerate(keys):
        text, after = key[3], keys[(i + 1) % len(keys)][3]
        half = len(text) // 2
        changed = text[: len(text) - half] + after[:half]
        a, b, c = printed(text), printed(changed), printed(after)
        expected[key] = (None if key[0] else -key[1], len(text), _sha(changed), a, b, near(a, b), near(a, c))
    copies = Counter((r[0] is None, -(r[0] or 0), tags.get(r[1] or "", 0), r[1] or "") for r in rows)
    got = imatch.fingerprints(docs).collect()
    _same(got, [expected[k] for k, n in copies.items() for _ in range(n)])
    assert imatch.fingerprints(docs.filter("false")).count() == 0
    alone = imatch.fingerprints(docs.filter("doc_id = 79")).first()
    assert alone.near_next == 1.0 and alone.edited_sha256 == _sha("a b " * 4000)


def test_links_over_many_partitions(spark):
    ids = list(range(0, 3000, 3))
    table = spark.createDataFrame([(i, f"text {i}") for i in ids], "doc_id long, text string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = imatch.neighbours(imatch._keyed(table)).select("place", "after.place", "before.place").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert {(~a, ~b, ~c) for a, b, c in got} == {(i, ids[k - 1], ids[(k + 1) % len(ids)]) for k, i in enumerate(ids)}


def test_fingerprints_run_no_python(docs):
    plan = imatch.fingerprints(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_half_a_text_in_common_is_nearer_than_a_neighbour(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("length(text) > 600")
    got = imatch.fingerprints(table).select(F.avg("near_edited").alias("e"), F.avg("near_next").alias("n")).first()
    assert got.e > 0.2 and got.e > 3 * got.n


def _brute_runs(words, least=12):
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = q
        while i < len(words):
            first = i
            while i < len(words) and words[i] == words[i - q]:
                i += 1
            if i - first + q >= max(least, 2 * q):
                found.setdefault((first - q, i - first + q), q)
            i += i == first
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


@st.composite
def _sequences(draw):
    words = draw(st.lists(st.integers(0, draw(st.sampled_from([0, 1, 2, 30]))), max_size=150))
    for _ in range(draw(st.integers(0, 3))):
        at, size, times = draw(st.integers(0, len(words))), draw(st.integers(1, 60)), draw(st.integers(1, 4))
        words[at:at] = words[at : at + size] * times
    return words[:700]


@settings(max_examples=150, deadline=None)
@given(st.lists(_sequences(), max_size=4), st.sampled_from([1, 5, 64, 1 << 20]))
def test_runs_equal_brute_force(texts, slice_rows):
    counts = np.array([len(t) for t in texts], dtype=np.int64)
    bounds = np.append(0, np.cumsum(counts))
    got = periods.runs_of(np.array([w for t in texts for w in t], dtype=np.int64), counts, slice_rows=slice_rows)
    assert list(map(tuple, got.tolist())) == [(int(s + bounds[i]), n, q) for i, t in enumerate(texts) for s, n, q in _brute_runs(t)]


def test_runs_in_linear_time():
    for ids in (np.zeros(150_000, np.int64), np.tile(np.arange(10), 15_000), np.tile(np.append(np.zeros(499, np.int64), 1), 300)):
        got = periods.runs_of(ids, np.array([len(ids)]))
        assert (got[:, 1].max() == len(ids)) and len(got) <= 301


def _expected_op13(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = _brute_runs(words)
    gone = {i for s, k, q in runs for i in range(s + q, s + k)}
    best = min(((-k, s, q) for s, k, q in runs), default=None)
    s, k, q = (best[1], -best[0], best[2]) if best else (None, None, None)
    return (
        doc_id, len(runs), s, k, q, best and 1000 * k // q, _sha("".join(f"{s},{k},{q}\n" for s, k, q in runs)),
        _sha(" ".join(w for i, w in enumerate(words) if i not in gone)),
    )


def test_periodic_runs(spark, tmp_path):
    texts = [_prose(i, 20 + i, "ab", 1 + i % 2) for i in range(120)] + [None, "", " \n", "one", "x " * 700, ("one two three\x0b" * 40) + "tail"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (3, "a b " * 10), (None, "c d " * 30), (None, None)]
    table = spark.createDataFrame([(*r, "r", "x", 1) for r in rows], "doc_id long, text string, row string, runs string, n_words int")
    table.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op13_periodic_runs"](spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    expected = [_expected_op13(*r) for r in rows]
    assert sum(e[1] > 0 for e in expected) > 20
    _same(got.collect(), expected)
    whole = periods.periodic_runs(table, ("doc_id", "runs")).select("row.doc_id", "collapsed", "n_words").filter("doc_id = 124").first()
    assert (whole.collapsed, whole.n_words) == ("x", 700)
    assert periods.periodic_runs(table.filter("false")).count() == 0


def _seconds(make):
    import time

    start = time.perf_counter()
    make()
    return time.perf_counter() - start


def test_copies_of_a_row_cost_no_more_than_rows(spark):
    """Ten times the copies without an id: no row of spans, postings or text for each pair of copies."""
    from quireflow.llm import decontaminate, substrings

    text = _prose(77, 400, "abcdefgh", 7)
    items = spark.createDataFrame([(1, " ".join(text.split()[50:70]))], "item_id long, text string")

    def table(n):
        return spark.range(n).select(F.lit(None).cast("long").alias("doc_id"), F.lit(text).alias("text")).repartition(8)

    def removed(n):
        got = substrings.remove_repeats(table(n)).groupBy("n_removed").count().collect()
        assert [tuple(r) for r in got] == [(400, n)]

    def hit(n):
        got = decontaminate.contamination(table(n), items).groupBy("n_hit", "n_items").count().collect()
        assert [tuple(r) for r in got] == [(20, 1, n)]

    for run in (removed, hit):
        run(10)
        few = _seconds(lambda: run(1000))
        assert _seconds(lambda: run(10_000)) < 2 * few + 3


def test_windows_of_a_copied_text_repeat_in_others(spark):
    from quireflow.llm import substrings

    shared, own = _prose(78, 50, "abcdefgh", 7), _prose(79, 60, "ijklmnop", 7)
    rows = [(1, shared), (1, shared), (None, shared), (2, own + " " + shared), (3, own[:40]), (4, "short"), (4, "short")]
    got = substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).select("row.doc_id", "n_words", "n_removed").collect()
    _same(got, [(1, 50, 50), (1, 50, 50), (None, 50, 50), (2, 110, 50), (3, len(own[:40].split()), 0), (4, 1, 0), (4, 1, 0)])


def test_licence_needs_all_its_phrases(spark):
    from quireflow.llm import licences

    whole = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
    texts = [whole, "the associated documentation files are listed below", "Permission is hereby granted, free of charge, to whoever asks.", whole.replace("copy", "piece"), "plain text"]
    rows = [(i, t) for i, t in enumerate(texts)]
    got = {r.doc_id: r.labels for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: "mit", 1: "", 2: "", 3: "mit", 4: ""}
    # words that the corpus lacks leave the index to those it has
    cut = "this library is licensed under the gnu lesser general public license version 3".replace("library", "code")
    found = licences.scan(spark.createDataFrame([(1, cut)], "doc_id long, text string")).first()
    assert "lgpl" in found.labels.split(",")


def test_long_words_that_a_polynomial_confuses():
    import pyarrow as pa

    from quireflow.llm import words

    one = "a"
    while len(one) < 1024:
        one += "".join("b" if c == "a" else "a" for c in one)
    other = "".join("b" if c == "a" else "a" for c in one)
    batch = pa.RecordBatch.from_arrays([pa.array([f"{one} {other} {one}"])], ["text"])
    value = next(words.chunks(batch)).words().value
    assert value[0] == value[2] != value[1]


def _brute_licences(rows):
    from math import log

    from quireflow.llm.licences import BASE, RARE, TEMPLATES

    texts = {i: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", _lower(t)) for i, t in rows}
    counts = Counter(w for words in texts.values() for w in words)
    out = {}
    for i, words in texts.items():
        base = {label for label, p in BASE.items() for s in range(len(words)) if words[s : s + len(p.split())] == p.split()}
        own, best = set(), 0.5 if base else 0.0
        match = []
        for label, (text, keys) in TEMPLATES.items():
            template = text.split()
            entered = sorted({w for w in template if counts[w]}, key=lambda w: (counts[w], w.encode()))[:RARE]
            weight = {w: 1 / log(2.718281828 + counts[w]) for w in entered}
            for shift in range(-len(template), len(words)):
                agree = {w for p, w in enumerate(template) if w in weight and 0 <= shift + p < len(words) and words[shift + p] == w}
                stands = []
                for key in keys:
                    at = shift + len(text[: text.index(key)].split())
                    stands.append(at >= 0 and words[at : at + len(key.split())] == key.split())
                if agree and all(stands) and len(agree) >= min(len(entered), 2):
                    own.add(label)
                    match.append(min(sum(weight[w] for w in agree) / sum(weight.values()), 1.0))
        out[i] = (",".join(sorted(base)), ",".join(sorted(base | own)), max(match) if match else best)
    return out


def test_licences_equal_brute_force(spark):
    from quireflow.llm import licences

    draw = random.Random(4)
    rows = []
    for i in range(150):
        parts = []
        for _ in range(draw.randint(0, 3)):
            words = draw.choice([t for t, _ in licences.TEMPLATES.values()] + list(licences.BASE.values())).split()
            for _ in range(draw.choice([0, 0, 1, 1, 3])):
                k = draw.randrange(max(len(words), 1))
                words[k : k + 1] = draw.choice(([], ["other"], [w.upper() for w in words[k : k + 1]], [*words[k : k + 1], "more"]))
            parts.append(draw.choice([" ", ", ", "\n"]).join(words))
        parts.insert(draw.randint(0, len(parts)), _prose(i, draw.randint(0, 20)))
        rows.append((i, " ".join(parts)))
    expected = _brute_licences(rows)
    got = {r.doc_id: r for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(bool(labels) for _, labels, _ in expected.values()) > 60
    for i, (base, labels, score) in expected.items():
        assert (got[i].base_labels, got[i].labels) == (base, labels), rows[i]
        assert got[i].score == pytest.approx(score, abs=1e-9)


def test_licence_postings_without_their_phrases_stay_in_their_task(spark, monkeypatch):
    """Where the corpus has only common words of a template, these are indexed; none of their places is stored."""
    from quireflow.llm import licences

    stored, cut = [], licences.cut_lineage
    monkeypatch.setattr(licences, "cut_lineage", lambda df: stored.append(cut(df)) or stored[-1])
    rows = [(i, "to the person of this and any work is free in the " * 50) for i in range(20)]
    rows.append((20, "This work is licensed under the GNU General Public License version 3"))
    got = {r.doc_id: r.labels for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert stored[0].filter("word in ('the', 'is', 'work')").count() > 0
    assert {r.key for r in stored[1].select("key").distinct().collect()} == {20}
    assert got[20] == "gpl" and not any(got[i] for i in range(20))
