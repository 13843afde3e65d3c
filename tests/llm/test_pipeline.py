"""The whole pipeline against a plain version of its five stages, on generated documents."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import pytest

tokenizers = pytest.importorskip("public_tokenizers")
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def _sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def _words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def _item_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().translate(LOWER).decode())


def _prose(draw, n, letters="abcdeéß"):
    return " ".join("".join(draw.choices(letters, k=draw.randint(1, 7))) for _ in range(n))


def _rules_keep(text):
    w = _words(text)
    if len(w) < 50:
        return False
    grams = Counter(zip(w, w[1:], w[2:], strict=False))
    twice = {k for s in range(len(w) - 2) if grams[tuple(w[s : s + 3])] > 1 for k in (s, s + 1, s + 2)}
    if 100 * len(twice) > 50 * len(w):
        return False
    covered, longest = set(), 0
    order = sorted(range(len(w)), key=lambda i: w[i:])
    for a, b in zip(order, order[1:], strict=False):
        k = 0
        while max(a, b) + k < len(w) and w[a + k] == w[b + k]:
            k += 1
        if k >= 8:
            longest = max(longest, k)
            covered.update(range(a, a + k), range(b, b + k))
    return len(covered) <= 0.3 * len(w) and longest <= 0.2 * len(w)


def _without_near_copies(docs):
    sets = []
    for _, text in docs:
        w = [x.decode() for x in text.encode().translate(LOWER).split()]
        sets.append({tuple(w[s : s + 5]) for s in range(max(len(w) - 4, 1))})
    group = list(range(len(docs)))
    for a in range(len(docs)):
        for b in range(a):
            k = len(sets[a] & sets[b])
            if 100 * k >= 75 * len(sets[a] | sets[b]):
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    least = {}
    for (doc_id, _), g in zip(docs, group, strict=True):
        least[g] = min(least.get(g, doc_id), doc_id)
    return [d for d, g in zip(docs, group, strict=True) if d[0] == least[g]]


def _without_repeats(docs):
    seen = Counter(tuple(w[s : s + 35]) for _, t in docs for w in [_words(t)] for s in range(len(w) - 34))
    out = []
    for doc_id, text in docs:
        w = _words(text)
        gone = {k for s in range(len(w) - 34) if seen[tuple(w[s : s + 35])] > 1 for k in range(s, s + 35)}
        out.append((doc_id, " ".join(x for k, x in enumerate(w) if k not in gone) if gone else text))
    return out


def _without_items(docs, items):
    windows = {tuple(w[s : s + 10]) for t in items for w in [_item_words(t)] if w for s in range(max(len(w) - 9, 1))}
    sizes = {len(x) for x in windows}
    return [d for d in docs if not any(tuple(w[s : s + k]) in windows for w in [_item_words(d[1])] for k in sizes for s in range(len(w) - k + 1))]


def _documents(draw):
    shared = [_prose(draw, 60) for _ in range(3)]
    items = [_prose(draw, n, "abcdefg") for n in (15, 30, 6)]
    texts = [None, "", "too short"]
    for _ in range(60):
        text = _prose(draw, draw.randint(40, 160))
        kind = draw.random()
        if kind < 0.15:
            text += " " + draw.choice(shared)
        elif kind < 0.3:
            text += "\n" + draw.choice(items).upper()
        elif kind < 0.4:
            text = " ".join([*text.split()[:12], *(text.split()[:20] * 6)])
        elif kind < 0.7 and len(texts) > 10:
            w = (draw.choice(texts[5:]) or text).split()
            for _ in range(draw.choice([0, 1, 2, 9])):
                w[draw.randrange(len(w))] = _prose(draw, 1)
            text = " ".join(w)
        texts.append(text)
    order = list(range(len(texts)))
    draw.shuffle(order)
    return list(zip(order, texts, strict=True)), [*items, None, "..."]


@pytest.mark.parametrize("seed", [1, 2])
def test_pipeline_equals_its_stages_in_plain_code(spark, tmp_path, seed):
    import corpus_pipeline

    tiktoken = pytest.importorskip("tiktoken")
    docs, items = _documents(random.Random(seed))
    rows = [(i, t, "en", "s", len(t or ""), "x") for i, t in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    counts = [len(docs)]
    left = [d for d in docs if _rules_keep(d[1])]
    for stage in (_without_near_copies, _without_repeats, lambda d: _without_items(d, items)):
        counts.append(len(left))
        left = stage(left)
    counts.append(len(left))
    assert counts[0] > counts[1] > counts[2] == counts[3] > counts[4] > 5

    with open(tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as lines:
        import base64

        ranks = {base64.b64decode(p): int(n) for p, n in map(bytes.split, lines)}
    encoder = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    expected = []
    for doc_id, text in left:
        ids = encoder.encode_ordinary(text)
        expected.append((doc_id, "en", "s", len(text), len(ids), _sha(",".join(map(str, ids))), _sha(text), tuple(ids)))
    got = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "lang", "source", "n_chars", "n_tokens", "ids_sha256", "decoded_sha256", "ids").collect()
    assert sorted((*r[:-1], tuple(r.ids)) for r in got) == sorted(expected)
