"""What SQL cannot express, against brute force, the library, or held-out labels."""

import hashlib
import math
import os
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from wavelattice.llm import _text as X
from wavelattice.llm import fm_dedup, lm_score, ngram_join, queries, suffix_dedup, toxicity, warc
from wavelattice.llm import sentencepiece_codec as codec

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
ALNUM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def documents(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}


def words_of(text):
    return ALNUM.findall(text.encode().translate(LOWER).decode())


def test_suffix_order_is_that_of_sorting():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 3, 4, 5, 7, 20, 61):
        for k in (1, 2, 30):
            t = rng.integers(1, k + 1, n)
            want = sorted(range(n), key=lambda i, t=t: t[i:].tolist())
            assert suffix_dedup.suffix_order(t).tolist() == want
            got = [t[i : i + 5].tolist() for i in suffix_dedup.suffix_order(t, 5)]
            assert got == sorted(got)


def test_fm_index_counts_occurrences():
    rng = np.random.default_rng(1)
    t = rng.integers(1, 6, 300)
    index = fm_dedup.FMIndex(t)
    for size in (1, 2, 3, 4):
        for at in range(0, 290, 7):
            p = t[at : at + size]
            lo, hi = np.array([index.first[p[-1]]]), np.array([index.first[p[-1] + 1]])
            for c in p[-2::-1]:
                lo, hi = index.extend(np.array([c]), lo, hi)
            assert hi[0] - lo[0] == sum(np.array_equal(t[i : i + size], p) for i in range(301 - size))


def test_toxicity_is_found_in_held_out_rows(spark):
    big = DATA.replace("0.001", "0.1")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{big}/labels.parquet").collect()}
    rows = [r for r in queries.op3_toxicity(spark, big).collect() if r.held_out and r.doc_id in labels]
    assert len(rows) > 500 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    y, s = np.array([labels[r.doc_id] for r in rows]), np.array([r.score for r in rows])
    assert ((s >= 0.5) == y).mean() > 0.9
    # half of these labels have nothing in the text that tells
    assert ((s >= 0.5) & (y == 0)).sum() <= 15 and ((s >= 0.5) & (y == 1)).sum() >= 35


def test_toxicity_models_are_those_of_plain_counts():
    """Every probability by dictionaries: discounted continuation counts over a backoff that both classes share."""
    rng = random.Random(9)
    texts = [" ".join(rng.choice("abcdefgh" if k % 2 else "efghijkl") for _ in range(rng.randrange(0, 60))) for k in range(120)]
    y = np.array([k % 2 for k in range(120)])
    model = toxicity.fit_counts(texts, y)
    after, pairs = ([defaultdict(set), defaultdict(set)] for _ in range(2))
    for t, c in zip(texts, y, strict=True):
        w = t.split()
        for i, x in enumerate(w):
            after[c][x].add(w[i - 1] if i else None)
            if i:
                pairs[c][w[i - 1], x].add(w[i - 2] if i > 1 else None)
    words = sorted(set(after[0]) | set(after[1]))
    cut = lambda n: min(n, toxicity.DISCOUNT)
    one = [{x: len(after[c][x]) for x in words} for c in (0, 1)]
    two = [{p: len(v) for p, v in pairs[c].items()} for c in (0, 1)]
    pool = {x: cut(one[0][x]) + cut(one[1][x]) for x in words}
    shared = {x: (n + 1) / (sum(pool.values()) + len(words) + 1) for x, n in pool.items()}

    def p_word(x, c):
        total = sum(one[c].values())
        return (one[c][x] - cut(one[c][x])) / total + (sum(map(cut, one[c].values())) + 1) / total * shared[x]

    def p_pair(h, x, c):
        total = sum(n for p, n in two[c].items() if p[0] == h)
        left = sum(cut(n) for p, n in two[c].items() if p[0] == h) / total if total else 1.0
        n = two[c].get((h, x), 0)
        return (n - cut(n)) / max(total, 1) + left * p_word(x, c)

    block = next(X.blocks(pa.array(texts, pa.string())))
    mean, _, n = toxicity.gains(model, block)
    for k, t in enumerate(texts):
        w = t.split()
        gain = [math.log(p_word(w[0], 1) / p_word(w[0], 0))] if w else []
        gain += [math.log(p_pair(a, b, 1) / p_pair(a, b, 0)) for a, b in zip(w, w[1:], strict=False)]
        assert n[k] == len(w) and np.isclose(mean[k], np.mean(np.clip(gain, -toxicity.CLIP, toxicity.CLIP)) if w else 0, atol=1e-5)


def test_lm_scores_are_those_of_plain_counts(spark):
    texts = {k: words_of(t) for k, t in documents(spark).items()}
    good = {r.doc_id for r in spark.read.parquet(f"{DATA}/labels.parquet").where("quality = 1").collect()} & set(texts)
    n, t = Counter(w for ws in texts.values() for w in ws), Counter(w for k in good for w in texts[k])
    total, target = sum(n.values()), sum(t.values())
    size = len(n) + 2
    p_n = {w: (c + 1) / (total + size) for w, c in n.items()}
    p_t = {w: (t[w] + lm_score.MASS_1 * p_n[w]) / (target + lm_score.MASS_1) for w in n}
    n[None], t[None] = sum(1 for ws in texts.values() if ws), sum(1 for k in good if texts[k])
    own = {k: Counter(zip([None, *ws], ws, strict=False)) for k, ws in texts.items()}
    all_n, all_t = Counter(), Counter()
    for k, c in own.items():
        all_n.update(c)
        all_t.update(c if k in good else {})
    mass = lm_score.MASS_2 * total / target
    for r in queries.op4_lm_score(spark, DATA).collect():
        a = b = 0.0
        for (h, w), q in own[r.doc_id].items():
            a -= q * math.log(min(1, (all_t[h, w] - q * (r.doc_id in good) + lm_score.MASS_2 * p_t[w]) / (t[h] + lm_score.MASS_2)))
            b -= q * math.log(min(1, (all_n[h, w] - q + mass * p_n[w]) / (n[h] + mass)))
        size = max(1, len(texts[r.doc_id]))
        assert r.n_tokens == len(texts[r.doc_id])
        assert np.allclose([r.ce_target, r.ce_background, r.score], [a / size, b / size, (a - b) / size])


ODD_TEXTS = ["", " ", "  a", "a  b ", "\n\n \t a", "日本語 テスト 😀", "a\0b", "<s> </s> <unk> <0x41>", "é" * 50, "a", " a", "a "]


def model_file():
    with open(codec.MODEL, "rb") as f:
        return f.read()


def test_token_ids_are_the_librarys(spark):
    import sentencepiece

    raw = model_file()
    library = sentencepiece.SentencePieceProcessor(model_proto=raw)
    texts = [*documents(spark).values(), *ODD_TEXTS]
    own = codec.Codec(raw)
    assert own.by_part
    ids = own.encode(texts)
    assert ids == library.encode(texts) == [e.ids for e in own.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert own.decode(ids) == texts == library.decode(ids) == own.tokenizer.decode_batch(ids, skip_special_tokens=False)
    # the marker itself is a space to both; any ids decode
    marked = ["a▁b ▁ c▁", "▁", "x ▁▁y"]
    assert own.encode(marked) == library.encode(marked) and own.decode(own.encode(marked)) == library.decode(library.encode(marked))
    wild = [[5, 300, 31999, 0, 1, 2, 260, 261], [], [200], [1, 1], ids[0][3:40]]
    got, want = own.decode(wild), library.decode(wild)
    assert [g.strip(" ") for g in got] == [w.strip(" ") for w in want]


def test_codec_digests_are_those_of_the_library(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_proto=model_file())
    sha = lambda b: hashlib.sha256(b).hexdigest()
    texts = documents(spark)
    rows = {r.doc_id: r for r in queries.op8_sentencepiece(spark, DATA).collect()}
    assert set(rows) == set(texts)
    for k, t in texts.items():
        ids, r = library.encode(t), rows[k]
        assert (r.n_bytes, r.n_tokens, r.ids_sha256) == (len(t.encode()), len(ids), sha(np.array(ids, "<i4").tobytes()))
        assert (r.decoded_sha256, r.round_trip, r.parity) == (sha(library.decode(ids).encode()), library.decode(ids) == t, True)


def garbage(model, texts):
    """Of each text and each way to encode it: ids when our backend answers one number for everything, and the parity told."""
    own = codec.Codec(model)
    blocks = list(X.blocks(pa.array(texts, pa.string())))

    class Wrong:
        ids = [7]

        def encode_batch_fast(self, parts, **_):
            return [self] * len(parts)

        def decode_batch(self, parts, **_):
            return ["?"] * len(parts)

    real = own.plain, own.tokenizer
    own.plain = own.tokenizer = Wrong()
    ids, offs, _, _, parity = own.round_trip(blocks[0])
    own.plain, own.tokenizer = real
    return [x.tolist() for x in np.split(ids, offs[1:-1])], parity


def varied(dummy, squeeze):
    """The model file with other normaliser flags."""
    raw, out = model_file(), []
    for number, value in codec._fields(raw):
        if number == 3:
            value = b"".join(varint(n * 8 + 2) + varint(len(v)) + v if isinstance(v, bytes) else varint(n * 8) + varint({3: dummy, 4: squeeze}.get(n, v)) for n, v in {3: dummy, 4: squeeze, **dict(codec._fields(value))}.items())
        out.append(varint(number * 8 + 2) + varint(len(value)) + value)
    return b"".join(out)


@pytest.mark.parametrize(("dummy", "squeeze"), [(1, 0), (0, 0), (1, 1), (0, 1)])
def test_every_model_is_held_against_the_library(dummy, squeeze):
    import sentencepiece

    raw = varied(dummy, squeeze)
    library = sentencepiece.SentencePieceProcessor(model_proto=raw)
    own = codec.Codec(raw)
    assert own.by_part == (dummy == 1 and squeeze == 0)
    texts = [*ODD_TEXTS, "  spaces   between words ", "a▁b"]
    (block,) = X.blocks(pa.array(texts, pa.string()))
    ids, offs, text, cuts, parity = own.round_trip(block)
    assert [x.tolist() for x in np.split(ids, offs[1:-1])] == library.encode(texts)
    assert [x.tobytes().decode() for x, p in zip(np.split(text, cuts[1:-1]), parity, strict=True) if p] == [t for t, p in zip(library.decode(library.encode(texts)), parity, strict=True) if p]
    assert parity.count(True) > len(texts) / 2
    ids, parity = garbage(raw, ["some words", "a ", "x"])
    assert ids == library.encode(["some words", "a ", "x"]) and parity == [False] * 3
    assert codec.Codec(raw, parity=False).round_trip(block)[4] == [None] * len(texts)


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def test_unigram_models_are_rebuilt():
    import struct

    import sentencepiece

    field = lambda n, raw: varint(n * 8 + 2) + varint(len(raw)) + raw
    number = lambda n, v: varint(n * 8) + varint(v)
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *((f"<0x{b:02X}>", 0.0, 6) for b in range(256)), ("▁", -2.0, 1), ("▁ab", -3.0, 1), ("a", -4.0, 1), ("b", -4.5, 1), ("c", -5.0, 1), ("bc", -5.5, 1), ("▁abc", -8.5, 1)]
    raw = b"".join(field(1, field(1, p.encode()) + varint(2 * 8 + 5) + struct.pack("<f", s) + number(3, k)) for p, s, k in pieces)
    raw += field(2, number(3, 1) + number(35, 1)) + field(3, field(1, b"identity") + number(3, 1) + number(4, 0))
    library = sentencepiece.SentencePieceProcessor(model_proto=raw)
    texts = ["abc", "ab c", "bcbc a", "", "x é", "a  b"]
    own = codec.Codec(raw)
    assert own.encode(texts) == library.encode(texts) and own.decode(own.encode(texts)) == texts


def brute_components(texts):
    sets = {}
    for k, t in texts.items():
        w = t.encode().translate(LOWER).split()
        sets[k] = frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    root = {k: k for k in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders, shared = defaultdict(list), Counter()
    for k in sorted(sets):
        for g in sets[k]:
            shared.update((o, k) for o in holders[g])
            holders[g].append(k)
    for (a, b), n in shared.items():
        if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {k: (len(sets[k]), find(k)) for k in texts}


def edited_copies(seed=0):
    """Chains and stars of near copies, short texts and a passage that unlike texts share."""
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(3000)]
    texts, passage = {}, [rng.choice(vocab) for _ in range(25)]
    for g in range(12):
        base = [rng.choice(vocab) for _ in range(rng.choice((8, 30, 120)))]
        for c in range(rng.choice((1, 4, 12))):
            base = list(base) if g % 3 else base
            w = list(base)
            for _ in range(rng.randrange(0, 1 + len(w) // 40 + (c % 2))):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            if g % 3:
                base = w  # each is a copy of the one before: a chain
            texts[len(texts)] = " ".join(w)
    for _ in range(10):
        texts[len(texts)] = " ".join([rng.choice(vocab) for _ in range(rng.randrange(3, 40))] + passage)
    texts |= {len(texts) + k: t for k, t in enumerate(["", "a b", "A  b", "a b c", "a b c d e", "a b c d e"])}
    return texts


@pytest.mark.parametrize("seed", range(2))
def test_near_duplicates_are_those_of_brute_force(spark, seed):
    texts = edited_copies(seed)
    want = brute_components(texts)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(docs).collect()} == want


def test_matching_statistics_are_those_of_brute_force():
    rng = np.random.default_rng(2)
    for t in (rng.integers(1, 4, 200), np.repeat(rng.integers(1, 4, 12), 20), np.tile([1, 2, 3, 1], 60)):
        index = fm_dedup.FMIndex(t)
        ends = np.arange(len(t))
        length, _ = fm_dedup.matching_statistics(index, t, ends[9:], 9)
        raw = t.astype("u1").tobytes()
        for e, n in zip(ends[9:].tolist(), length.tolist(), strict=True):
            twice = lambda k, e=e: k <= 9 and any(raw[i : i + k] == raw[e + 1 - k : e + 1] for i in range(len(raw) - k + 1) if i != e + 1 - k)
            assert n == next(k for k in range(10) if not twice(k + 1))


@pytest.mark.parametrize("n_bits", [1, 63, 64, 5000])
def test_bits_are_ranked_in_either_form(n_bits):
    rng = np.random.default_rng(n_bits)
    for bits in (rng.random(n_bits) < 0.5, np.arange(n_bits) // max(1, n_bits // 3) % 2 == 0, np.zeros(n_bits, bool)):
        at = np.arange(n_bits + 1)
        want = np.concatenate(([0], np.cumsum(bits)))
        starts = np.flatnonzero(np.concatenate(([True], bits[1:] != bits[:-1])))
        assert all(np.array_equal(form.rank(at), want) for form in (fm_dedup._Packed(bits), fm_dedup._Runs(bits, starts), fm_dedup.compressed(bits)))


def test_hot_anchors_are_taken_apart_by_window(spark, monkeypatch):
    from wavelattice.llm import _repeats

    rng = random.Random(4)
    passage = " ".join(rng.choice("abcdefg") * 3 for _ in range(80))
    text = lambda k: "".join(rng.choice("hijkl ") for _ in range(60)) + passage + "".join(rng.choice("mnop ") for _ in range(60 + k))
    texts = [(k, text(k)) for k in range(12)]
    docs = spark.createDataFrame([*texts, *texts[:2], (50, texts[3][1]), (None, texts[4][1])], "doc_id long, text string")
    for operator in (suffix_dedup.remove_repeated_substrings, fm_dedup.remove_repeated_passages):
        get = lambda f=operator: sorted(str((r.doc_id, r.n_removed, r.kept_sha256)) for r in f(docs).collect())
        usual = get()
        with monkeypatch.context() as m:
            m.setattr(_repeats, "HOT_BODIES", 2)
            assert get() == usual and len(usual) == 16


def test_archives_reassemble_segments(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "x" * 70000), (2, "u", "x" * 70000), (3, "v\r\nEvil: 1", "é" * 9000), (4, None, None), (5, "w", "small")], "page_id long, url string, html string")
    path = f"file://{tmp_path}/a"
    warc.write_archives(warc.mark_revisits(pages), path)
    back = {int(r.page_id): r for r in warc.read_archives(spark, path).collect()}
    assert bytes(back[1].payload) == b"x" * 70000 and bytes(back[3].payload).decode() == "é" * 9000 and bytes(back[4].payload) == b""
    assert (back[2].record_type, back[2].refers_to, back[2].payload_bytes) == ("revisit", "1", 70000)
    assert back[2].payload_digest == hashlib.sha256(b"x" * 70000).hexdigest() and all(r.complete for r in back.values())
    assert warc.unchunk(b"3\r\nabc\r\n0\r\n\r\n") == b"abc" and warc.unchunk(b"3\r\nabcX") is None and warc.unchunk(b"zz\r\nabc\r\n") is None
    import glob
    import gzip

    for name in glob.glob(f"{tmp_path}/a/*.gz"):
        with open(name, "rb") as f:
            records = list(warc.parse_records(gzip.decompress(f.read())))
        last = [r for r in records if "warc-segment-total-length" in r[0]]
        if last:
            raw = gzip.decompress(open(name, "rb").read()).replace(b"WARC-Segment-Number: 2", b"WARC-Segment-Number: 9")
            os.remove(os.path.join(os.path.dirname(name), f".{os.path.basename(name)}.crc"))
            with open(name, "wb") as f:
                f.write(gzip.compress(raw))
    broken = [r for r in warc.read_archives(spark, path).collect() if not r.complete]
    assert broken and all(r.payload is None for r in broken)


def test_damaged_archives_do_not_end_the_job(spark, tmp_path):
    import gzip

    body = lambda b: b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n" + b
    good = body(b"3\r\nabc\r\n0\r\n\r\n")
    digest = hashlib.sha256(b"abc").hexdigest().encode()

    def record(page, block, length=None, more=b""):
        return b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Page-ID: %s\r\nWARC-Payload-Digest: sha256:%s\r\n%sContent-Length: %s\r\n\r\n%s\r\n\r\n" % (page, digest, more, str(len(block)).encode() if length is None else length, block)

    bad = [body(b"zz\r\nabc\r\n0\r\n\r\n"), body(b"-3\r\nabc\r\n0\r\n\r\n"), body(b"0x3\r\nabc\r\n0\r\n\r\n"), body(b"3\r\nabcd\r\n0\r\n\r\n"), b"", b"HTTP/1.1 200 OK\r\nContent-Length: many\r\n\r\nabcd"]
    data = b"".join(record(b"%d" % k, b) for k, b in enumerate(bad)) + record(b"10", good) + record(b"11", good, b"x9") + record(b"12", good, b"99999") + b"junk\r\n\r\n" + record(b"13", good)
    data += record(b"14", good, None, b"WARC-Segment-Number: one\r\n") + record(b"15", good, b"?", b"WARC-Segment-Number: 1\r\n") + record(b"16", good)
    (tmp_path / "a.warc").write_bytes(data)
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(record(b"20", good)) + gzip.compress(record(b"21", good) * 3000)[:-20])
    (tmp_path / "c.warc").write_bytes(b"no archive at all")
    (tmp_path / "d.warc").write_bytes(b"")
    rows = warc.read_archives(spark, f"file://{tmp_path}").collect()
    whole = sorted(r.page_id for r in rows if r.complete)
    assert whole[:4] == ["10", "13", "16", "20"] and set(whole[4:]) == {"21"} and all(bytes(r.payload) == b"abc" for r in rows if r.complete)
    assert {str(k) for k in range(len(bad))} | {"11", "12", "14", "15"} <= {r.page_id for r in rows if not r.complete} and all(r.payload is None for r in rows if not r.complete)


def test_pipeline_stages_are_those_of_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = corpus_pipeline.quality_stage(spark, docs, DATA)
    good = {r.doc_id for r in queries.op9_quality(spark, DATA).where("kept").collect()}
    texts = {r.doc_id: r.text for r in kept.collect()}
    assert set(texts) == good and kept.columns == docs.columns

    kept = corpus_pipeline.near_duplicate_stage(spark, kept, DATA)
    roots = {c for _, c in brute_components(texts).values()}
    texts = {r.doc_id: r.text for r in kept.collect()}
    assert set(texts) == roots and kept.columns == docs.columns

    kept = corpus_pipeline.passage_stage(spark, kept, DATA)
    seen, left = set(), {}
    for k in sorted(texts):
        w = texts[k].encode().split()
        gone = set()
        for i in range(len(w) - 19):
            g = tuple(w[i : i + 20])
            gone |= set(range(i, i + 20)) if g in seen else set()
            seen.add(g)
        if not gone:
            left[k] = texts[k]
        elif len(gone) < len(w):
            left[k] = b" ".join(x for i, x in enumerate(w) if i not in gone).decode()
    rows = kept.collect()
    assert {r.doc_id: r.text for r in rows} == left and all(r.n_chars == len(r.text) for r in rows)

    kept = corpus_pipeline.decontamination_stage(spark, kept, DATA)
    items = set()
    for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect():
        w = words_of(r.text)
        items |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9)) if w}
    sizes = {len(i) for i in items}
    clean = {k for k, t in left.items() if not any(tuple(w[i : i + n]) in items for w in [words_of(t)] for n in sizes for i in range(len(w) - n + 1))}
    assert {r.doc_id for r in kept.collect()} == clean

    last = corpus_pipeline.encoding_stage(spark, kept, DATA).collect()
    assert {r.doc_id for r in last} == clean and all(r.round_trip and r.parity and r.n_tokens == len(r.token_ids) for r in last)


def test_blocks_cut_between_documents():
    column = pa.array(["ab", None, "", "é" * 10, "x"])
    got = [bytes(b.data[b.offs[i] : b.offs[i + 1]]) for b in X.blocks(column, 3) for i in range(b.hi - b.lo)]
    assert got == [b"ab", b"", b"", ("é" * 10).encode(), b"x"]
