"""Coverage against brute force, with tiny blocks so that every boundary is crossed."""

import random

from quireflow.plans import coverage


def test_missing_lines_equal_brute_force(spark):
    rng = random.Random(7)
    words = ["a", "to", "the", "alpha", "beta", "é", "gamma", "deltadelta", "naïve", "x" * 12]
    chapters = [
        ("s", f"{n:02d}.xhtml", " ".join(rng.choice(words) for _ in range(rng.randint(1, 30)))) for n in range(12)
    ]
    book = " ".join(text for _, _, text in sorted(chapters, key=lambda c: c[1]))
    lines = []
    for _ in range(150):
        start = rng.randrange(len(book) - 2)
        lines.append(book[start : start + rng.randint(1, 60)].strip())
        lines.append(" ".join(rng.choice(words) for _ in range(rng.randint(1, 6))))
    lines = [line for line in lines if line]
    frame = spark.createDataFrame([("s", n, line) for n, line in enumerate(lines)], "site string, n int, line string")
    text = spark.createDataFrame(chapters, "site string, file string, text string")
    # pieces longer than all lines, pieces that cut words, and pieces of a few characters
    for block, piece in ((16, 64), (32, 16), (16, 5), (1 << 14, 256)):
        missing = coverage.missing_lines(frame, text, block=block, piece=piece)
        assert {row.n for row in missing.collect()} == {n for n, line in enumerate(lines) if line not in book}, (block, piece)


def test_a_long_line_must_stand_in_one_piece(spark):
    """Pieces that occur, but not one after the other, are no occurrence; equal pieces at many places are."""
    unit = "alpha beta gamma delta "
    book = unit * 40 + "END " + "x " * 300 + "the tail"
    text = spark.createDataFrame([("s", "a", book[:700]), ("s", "b", book[701:]), ("t", "a", unit * 3)], "site string, file string, text string")
    lines = [
        (unit * 30).strip(), (unit * 41).strip(), (unit * 40).strip() + " END x x", "x " * 299 + "x the tail", "x " * 301 + "the tail",
        unit * 2 + "gamma", (unit * 40).strip() + " END " + "x " * 300 + "the tail",
    ]
    frame = spark.createDataFrame([(s, n, line) for s in "st" for n, line in enumerate(lines)], "site string, n int, line string")
    for block, piece in ((64, 32), (16, 7), (1 << 14, 256)):
        got = {(r.site, r.n) for r in coverage.missing_lines(frame, text, block, piece).collect()}
        expected = {("s", n) for n, line in enumerate(lines) if line not in book} | {("t", n) for n, line in enumerate(lines) if line not in unit * 3}
        assert got == expected and ("s", 1) in got and ("s", 0) not in got


def test_block_width_does_not_follow_the_longest_line(spark, monkeypatch):
    seen = []
    original = coverage.text_blocks
    monkeypatch.setattr(coverage, "text_blocks", lambda chapters, block, overlap: seen.append((block, overlap)) or original(chapters, block, overlap))
    text = spark.createDataFrame([("s", "a", "word " * 20000)], "site string, file string, text string")
    lines = spark.createDataFrame([("s", "word " * 19999 + "word"), ("s", "word " * 20001)], "site string, line string")
    assert coverage.covered_lines(lines, text).count() == 1
    assert seen == [(coverage.BLOCK_CHARS, coverage.LINE_PIECE_CHARS)]


def test_covered_source_reads_as_complete(spark):
    lines = spark.createDataFrame(
        [
            (1, "# Heading of the page which is long enough to count otherwise"),
            (2, "- The `List<T>` of a [guide](http://x/y) is <b>bold</b> and long"),
            (3, "```"),
            (4, "code that would never be found in any of the chapters, ever"),
            (5, "```"),
            (6, "short line"),
        ],
        "line_no int, line string",
    ).selectExpr("'s' AS site", "*")
    source = coverage.source_lines(lines, "site")
    assert [row.line for row in source.collect()] == ["the list<t> of a guide is bold and long"]
    chapters = spark.createDataFrame(
        [("s", "a", "x the list<t> of a guide"), ("s", "b", "is bold and longer")], "site string, file string, text string"
    )
    missing = coverage.missing_lines(source, chapters)
    assert coverage.coverage_ratio(source, missing).first()["coverage"] == 1.0


def test_places_of_other_anchors_stay_in_their_task(spark):
    """The bitmap keeps every key in use and little else, so the shuffle does not follow the words of the book."""
    keys = spark.range(5000).selectExpr("xxhash64(id) AS key")
    places = spark.range(200000).selectExpr("xxhash64(id) AS key", "id AS start")
    kept = {row.start for row in coverage.in_bitmap(places, coverage.key_bitmap(keys)).collect()}
    assert set(range(5000)) <= kept and len(kept) < 5200


def test_lines_of_one_word_alone(spark):
    text = spark.createDataFrame([("s", "a", "one antelope two é" + "y" * 40), ("t", "a", "x")], "site string, file string, text string")
    words = ["elope", "antelopes", "n", "éy", "y" * 40, "y" * 41, "two"]
    lines = spark.createDataFrame([(s, w) for s in "st" for w in words], "site string, line string")
    for block, piece in ((16, 8), (1 << 14, 256)):
        assert {tuple(row) for row in coverage.covered_lines(lines, text, block, piece).collect()} == {
            ("s", w) for w in ("elope", "n", "éy", "y" * 40, "two")
        }


def test_tabular_shape_of_a_long_text_costs_its_length(spark, tmp_path):
    """Cut into rows of five words, the text was split again for every row."""
    import time

    from quireflow.catalog import load

    spark.createDataFrame([(3, " ".join(["word"] * 400_000))], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    started = time.monotonic()
    assert [tuple(row) for row in load()[0]["a07_tabular_shape"](spark, str(tmp_path)).collect()] == [(3, 5)]
    assert time.monotonic() - started < 60


def test_lines_that_begin_alike_cost_blocks_not_places(spark):
    """Lines of one repeated word begin at each of its places, and all their pieces were looked for from each."""
    import time

    text = spark.createDataFrame([("s", n, "the " * 30_000 + n) for n in "abcd"], "site string, file string, text string")
    sizes = range(500, 30_500, 500)
    lines = spark.createDataFrame([("s", "the " * size + end) for size in sizes for end in ("the", "a", "z")], "site string, line string")
    started = time.monotonic()
    expected = {("s", "the " * size + end) for size in sizes for end in ("the", "a") if size < 30_000 or size == 30_000 and end == "a"}
    assert {tuple(row) for row in coverage.covered_lines(lines, text).collect()} == expected
    assert time.monotonic() - started < 60


def test_chapters_that_share_a_name_stand_once(spark):
    """Each of them stood at the place of both, and long lines behind them read as missing."""
    tail = " ".join(f"word{n}" for n in range(40))
    chapters = [("s", "a", "one antelope two"), ("s", "a", "three lions four"), ("s", "b", tail)]
    text = spark.createDataFrame(chapters, "site string, file string, text string")
    lines = spark.createDataFrame([("s", line) for line in ("antelope two", "lions four", tail, tail[9:], "two one antelope", "four three lions")], "site string, line string")
    for block, piece in ((1 << 14, 16), (64, 16), (1 << 14, 256)):
        got = {row.line for row in coverage.covered_lines(lines, text, block, piece).collect()}
        assert got == {"antelope two", "lions four", tail, tail[9:]}, (block, piece)


def test_few_windows_pass_the_bitmap_by_chance(spark):
    """By one bit of a key, 3,000 of these windows pass, as many again for each kind of window in use."""
    from pyspark.sql import functions as F

    from quireflow.operators.occurrences import SHIFTS, text_keys, window_key

    words = [f"word{n}" for n in range(400_000)]
    text = spark.createDataFrame([(" ".join(words),)], "text string")
    wanted = spark.createDataFrame([(f"{word} word"[:16].ljust(16, "1").encode(),) for word in words[100_000:100_050]], "window binary").select(window_key("window").alias("key"))
    others = spark.range(1_000_000).select(F.xxhash64("id").alias("key"))
    marks = wanted.unionByName(others).select(F.explode(F.array(*(F.shiftrightunsigned("key", shift) for shift in SHIFTS))).alias("key"))
    bitmap = spark.sparkContext.broadcast(coverage._collected(coverage.key_bitmap(marks)))
    passed = {row.key for row in text.select(F.explode(text_keys([(True, 16)], bitmap)("text")).alias("key")).collect()}
    assert {row.key for row in wanted.collect()} <= passed and len(passed) < 300
