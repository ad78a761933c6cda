"""Nulls, empty and long texts, ties, repeated rows, empty tables, and columns with clashing names."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from wavelattice.llm import chat, decontam, fm_dedup, lm_score, ngram_join, quality, sentencepiece_codec, suffix_dedup, toxicity, warc

LONG = "the quick brown fox jumps over lazy dogs " * 20000
ROWS = [
    (1, None), (2, ""), (3, " \n\t "), (None, None), (None, "some words stand here without an id at all, twelve or so"),
    (4, "one two three four five six seven eight nine ten eleven twelve " * 9), (4, "one two three four five six seven eight nine ten eleven twelve " * 9),
    (5, "one two three four five six seven eight nine ten eleven twelve " * 9), (6, LONG), (7, "x" * 250), (8, "x" * 250), (9, "日本語 " * 60), (4, "another text of the same id"),
]
CLASH = ("id", "n", "key", "node", "r1", "row", "token", "slice", "rid", "block", "spans", "kept", "copies", "payload", "role_", "part", "target", "y", "h", "items", "n_words", "first_id", "text_")


@pytest.fixture(scope="module")
def docs(spark):
    table = spark.createDataFrame(ROWS, "doc_id long, text string")
    return table.withColumns({c: F.lit("clash") for c in CLASH}).repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def labels(spark, n=40):
    return spark.createDataFrame([(k, k % 2, k % 2) for k in range(n)] + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")


def bench(spark):
    return spark.createDataFrame([(1, "two three FOUR"), (1, "two three FOUR"), (2, None), (3, ""), (None, "jumps over lazy dogs the quick brown fox jumps over"), (4, "nowhere at all")], "item_id long, text string")


OPERATORS = {
    "quality": lambda spark, d: quality.quality_rules(d),
    "suffix": lambda spark, d: suffix_dedup.remove_repeated_substrings(d),
    "fm": lambda spark, d: fm_dedup.remove_repeated_passages(d),
    "decontam": lambda spark, d: decontam.decontaminate(d, bench(spark)),
    "join": lambda spark, d: ngram_join.near_duplicates(d),
    "codec": lambda spark, d: sentencepiece_codec.codec_digest(d),
    "lm": lambda spark, d: lm_score.cross_entropy_difference(d, labels(spark).where("quality = 1").select("doc_id")),
    "toxicity": lambda spark, d: toxicity.toxicity_scores(d, labels(spark)),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_every_row_gives_one_row(spark, docs, none, name):
    got = OPERATORS[name](spark, docs).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted((k is None, k or 0) for k, _ in ROWS)
    empty = OPERATORS[name](spark, none)
    assert empty.collect() == []
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    if name == "suffix":
        assert by[1][0].n_bytes == 0 and by[7][0].n_removed == 250 == by[8][0].n_removed and by[6][0].n_removed == len(LONG)
        assert sorted(r.n_removed for r in by[4])[1:] == [len(ROWS[5][1])] * 2
    elif name == "fm":
        # rows that repeat are alike; the first round of each text stays
        first = sorted(r.n_removed for r in by[4])
        assert first[0] == 0 and first[1] == first[2] == 108 - 12 and by[5][0].n_removed == 108
        assert by[6][0].n_removed == 160000 - 8 and by[1][0].n_words == 0
    elif name == "join":
        assert by[1][0].component_id == 1 and by[1][0].n_shingles == 0 and by[5][0].component_id == 4 and by[7][0].n_shingles == 1 and by[8][0].component_id == 7
    elif name == "decontam":
        hits = {k: rs[0].n_items for k, rs in by.items() if k in (5, 6, 7)}
        assert hits == {5: 1, 6: 1, 7: 0} and by[1][0].n_words == 0
    elif name == "quality":
        assert by[1][0].base_failed and not by[6][0].kept and by[3][0].n_words == 0
    elif name == "codec":
        assert all(r.round_trip and r.parity for r in got) and by[2][0].n_tokens == 0


def test_no_benchmark_no_hits(spark, docs):
    rows = decontam.decontaminate(docs, bench(spark).limit(0)).collect()
    assert len(rows) == len(ROWS) and not any(r.contaminated for r in rows)


def test_a_large_benchmark_is_searched_in_blocks(spark, docs):
    key = lambda d: sorted(map(str, d.select("doc_id", "n_words", "spans", "items").collect()))
    assert key(decontam.benchmark_matches(docs, bench(spark), max_bytes=30)) == key(decontam.benchmark_matches(docs, bench(spark)))


def test_proximity_matches_take_any_order(spark):
    docs = spark.createDataFrame([(1, "zebra apple common mango"), (2, "zebra " + "common " * 40 + "apple mango")], "doc_id long, text string")
    item = spark.createDataFrame([(7, "apple common zebra common mango")], "item_id long, text string")
    got = {r.doc_id: (r.n_items, r.n_near_items) for r in decontam.decontaminate(docs, item).collect()}
    assert got == {1: (0, 1), 2: (0, 0)}


def test_toxicity_without_one_class_says_nothing(spark, docs):
    rows = toxicity.toxicity_scores(docs, labels(spark).where("toxic = 0")).collect()
    assert all(r.score == 0.5 for r in rows)


def test_conversations(spark):
    turns = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi <|im_end|>"), (1, 2, "bob", None), (1, 2, "bob", None), (1, 300, "ann", "late"), (2, 0, "system", "alone"), (None, None, None, "x")]
    table = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumns({c: F.lit(1) for c in ("conv", "part", "of", "perspective", "turns", "k", "row", "range", "start", "p")})
    rows = {(r.conv_id, r.part, r.perspective): r for r in chat.rotate_perspectives(table).collect()}
    assert set(rows) == {(1, 0, "ann"), (1, 0, "bob"), (None, 0, "unknown")}
    r = rows[1, 0, "ann"]
    assert r.n_turns == 5 and r.n_target_turns == 2 and r.start == 0 and "user name=bob" in r.text and r.text.startswith("<|im_start|>system\nbe kind")
    assert [r.text[s.start : s.end] for s in r.spans] == ["hi < |im_end|>", "late"]
    assert rows[1, 0, "bob"].n_target_turns == 2 and rows[1, 0, "bob"].n_target_chars == 0
    assert chat.rotate_perspectives(table.limit(0)).collect() == []


def test_long_dialogues_are_whole(spark):
    # one conversation of repeated turn numbers, repeated rows and null turns; parts of three turns
    turns = [(1, k // 4 or None, ("ann", "bob", "system", "é")[k % 4], f"line {k % 9} é") for k in range(40)] + [(1, 5, "ann", "again")] * 7 + [(2, 0, "bob", "short")]
    table = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(5)
    whole = {(r.conv_id, r.perspective): r for r in chat.rotate_perspectives(table).collect()}
    assert set(whole) == {(1, "ann"), (1, "bob"), (1, "é"), (2, "bob")} and all(r.part == 0 for r in whole.values())
    parts = {}
    for r in sorted(chat.rotate_perspectives(table, part_turns=3).collect(), key=lambda r: r.part):
        text, spans, turns = parts.get((r.conv_id, r.perspective), ("", [], 0))
        assert r.start == len(text) and r.n_turns <= 3
        parts[r.conv_id, r.perspective] = (text + r.text, spans + r.spans, turns + r.n_turns)
    assert parts == {k: (r.text, r.spans, r.n_turns) for k, r in whole.items()}


def test_pages(spark):
    rows = [(1, "u", "y" * 100), (1, "u", "y" * 100), (2, "u", "y" * 100), (3, None, None), (4, "u", ""), (None, "u", "y" * 100), (5, "u", "y" * 99), (6, "u", "y" * 99)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("c") for c in ("id", "payload", "record_type", "chunks", "n", "uuid", "first_id", "value")})
    got = sorted((r.page_id or 0, r.payload_bytes, r.record_type, r.refers_to) for r in warc.archive_round_trip(table).collect())
    assert got == [(0, 100, "revisit", 1), (1, 100, "response", None), (1, 100, "response", None), (2, 100, "revisit", 1), (3, 0, "response", None), (4, 0, "response", None), (5, 99, "response", None), (6, 99, "response", None)]
    assert warc.archive_round_trip(table.limit(0)).collect() == []


def test_pipeline_stages_take_odd_rows(spark, docs, tmp_path):
    bench(spark).write.parquet(f"{tmp_path}/benchmark.parquet")
    table = docs.withColumns({"lang": F.lit("en"), "source": F.lit(None).cast("string"), "n_chars": F.length("text").cast("long")})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, table, str(tmp_path))
        assert out.columns == table.columns and out.count() <= len(ROWS)
        assert stage(spark, table.limit(0), str(tmp_path)).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, table, str(tmp_path)).count() == len(ROWS)
