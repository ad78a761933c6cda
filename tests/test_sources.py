import gzip
import io
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavelattice.sources import files, maps, matrices, waveset


def records(spark):
    rows = [("a", rid, row, 0, 0, 1.0, 2.0, 3.0, 2, 4, [float(rid + row + k) for k in range(4)]) for rid in (5, 3) for row in range(2)]
    return spark.createDataFrame(rows, "path string, rid long, row long, li long, gi long, px double, py double, pz double, ws long, wl long, data array<double>")


def rows_of(table):
    return sorted((r.rid, r.row, r.ws, r.wl, r.data, r.im) for r in table.collect())


def test_waveform_sets_survive_a_round_trip(spark, tmp_path):
    assert waveset.write_sets(records(spark), str(tmp_path), nsamp=10, f2c=7, tgc=[1.0, 2.0]) == 1
    back = waveset.read_records(spark, str(tmp_path / "a"))
    assert rows_of(back) == rows_of(records(spark).withColumn("im", F.lit(None)))
    head = waveset.read_sets(spark, str(tmp_path / "a")).first()
    assert (head.nsamp, head.f2c, head.nrx, head.ntx, head.tgc) == (10, 7, 2, 2, [1.0, 2.0])
    assert [r.rid for r in waveset.channel_list(waveset.read_records(spark, str(tmp_path / "a"), headers_only=True)).orderBy("rid").collect()] == [3, 5]
    assert waveset.gain_curves(waveset.read_sets(spark, str(tmp_path / "a"))).count() == 2
    with pytest.raises(Exception, match="does not fit"):
        waveset.write_sets(records(spark).where("rid = 3 or row = 0"), str(tmp_path))


@pytest.mark.parametrize("code", ["C4", "C8"])
def test_complex_samples_survive(spark, tmp_path, code):
    held = records(spark).withColumn("im", F.transform("data", lambda v: -2 * v))
    waveset.write_sets(held, str(tmp_path), typecode=code, compression="gzip" if code == "C4" else None)
    assert rows_of(waveset.read_records(spark, str(tmp_path / "a"))) == rows_of(held)
    (tmp_path / "m").mkdir()
    waves = spark.createDataFrame([(0, 1, 8, 2, [1.0, 3.0], [2.0, 4.0]), (1, 1, 8, 0, [5.0], [6.0])], "t long, r long, nsamp long, dstart long, data array<double>, im array<double>")
    assert files.write_files(maps.map_files(waves.coalesce(1), "<c8" if code == "C4" else "<c16"), str(tmp_path / "m")) == 1
    back = maps.last_of_each(maps.read_maps(spark, str(tmp_path / "m")))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, waves.collect()))


def test_sets_take_more_channels(spark, tmp_path):
    waveset.write_sets(records(spark).where("rid = 5"), str(tmp_path), open_ended=True)
    waveset.write_sets(records(spark).where("rid = 3"), str(tmp_path), append=True)
    assert rows_of(waveset.read_records(spark, str(tmp_path / "a"))) == rows_of(records(spark).withColumn("im", F.lit(None)))
    with pytest.raises(Exception, match="takes no such channels"):
        waveset.write_sets(records(spark).where("row = 0"), str(tmp_path), append=True)
    with pytest.raises(ValueError):
        waveset.write_sets(records(spark), str(tmp_path), append=True, compression="gzip")


class Counted(io.BytesIO):
    n = 0

    def read(self, size=-1):
        out = super().read(size)
        self.n += len(out)
        return out


def test_headers_are_read_without_the_samples():
    raw = waveset.file_header("F8", 0, 5000, 4, 10) + b"".join(struct.pack("<3I3f2I", k, 0, 0, 1, 2, 3, 0, 5000) + bytes(8 * 50000) for k in range(4))
    file = Counted(raw)
    head, cursor = waveset.parse_header(file)
    assert [r[0] for r in waveset.parse_records(head, cursor, headers_only=True)] == [0, 1, 2, 3] and file.n < len(raw) / 100
    with pytest.raises(waveset.FormatError):
        list(waveset.parse_records(*waveset.parse_header(raw[:-1]), headers_only=True))
    data = maps.encode_map([(k, 0, 9000, 0, np.arange(9000.0)) for k in range(20)], "<f8")
    file = Counted(data)
    assert [t for t, *_ in maps.parse_map(file, keys_only=True)] == list(range(20)) and file.n < len(data) / 10


def old_file(minor, rid=1):
    raw = struct.pack("<4s2I", b"WAVE", 1, minor)
    if minor > 4:
        raw += struct.pack("<2f", 20, 21)
    raw += struct.pack("<2s4I", b"I2", 0, 3, 1, 2)
    if minor > 1:
        raw += struct.pack("<2H", 0, 0)
        if minor >= 4:
            raw += struct.pack("<I", 0)
        raw += np.zeros(256, "<f4").tobytes() if minor < 6 else struct.pack("<I", 0)
    elif minor == 0:
        raw += struct.pack("<2I", 2, 1)
    if minor != 2:
        raw += struct.pack("<I", rid)
    if minor > 1:
        raw += struct.pack("<2I", 0, 0)
    raw += struct.pack("<3f2I", 1, 2, 3, 0, 3) + np.arange(6, dtype="<i2").tobytes()
    return raw


@pytest.mark.parametrize("minor", range(7))
def test_all_versions_are_read(minor):
    head, cursor = waveset.parse_header(old_file(minor))
    ((rid, _, _, pos, ws, wl, block),) = waveset.parse_records(head, cursor)
    assert rid == (0 if minor <= 2 else 1) and pos == (1, 2, 3) and (ws, wl) == (0, 3)
    assert block.tolist() == [[0, 1, 2], [3, 4, 5]]
    assert (head["txlist"] == [1, 0]) == (minor == 0)


def test_malformed_sets_are_refused():
    with pytest.raises(waveset.FormatError):
        waveset.parse_header(b"NOPE" + bytes(20))
    with pytest.raises(waveset.FormatError):
        waveset.parse_header(struct.pack("<4s2I", b"WAVE", 1, 7))
    head, cursor = waveset.parse_header(old_file(6)[:-2])
    with pytest.raises(waveset.FormatError):
        list(waveset.parse_records(head, cursor))
    assert files.opened(gzip.compress(b"x")) == b"x"


def test_maps_survive_and_append(spark, tmp_path):
    first = maps.encode_map([(0, 1, 8, 2, [1.0, 2.0]), (1, 0, 8, 0, [3.0])], "<f8")
    both = maps.encode_map([(0, 1, 9, 0, [9.0])], "<f8", "deflate", before=first)
    (tmp_path / "m.zip").write_bytes(both)
    rows = maps.read_maps(spark, str(tmp_path / "m.zip"))
    assert rows.count() == 3 and maps.read_maps(spark, str(tmp_path / "m.zip"), keys_only=True).where("data is null").count() == 3
    kept = {(r.t, r.r): (r.nsamp, r.dstart, r.data) for r in maps.last_of_each(rows).collect()}
    assert kept == {(0, 1): (9, 0, [9.0]), (1, 0): (8, 0, [3.0])}
    with pytest.raises(ValueError):
        maps.single_wave(rows)


def test_key_maps_survive_and_are_checked(spark, tmp_path):
    rows = [((1, 2), [1.5]), ((0, 7), [2.5])]
    (tmp_path / "k.npz").write_bytes(matrices.encode_keymat(rows, comment="c"))
    (tmp_path / "k.txt").write_text("1 2 4.0\n")
    got = [(r["keys"], r["values"]) for r in matrices.merged_keymats(matrices.read_keymats(spark, str(tmp_path), nkeys=2)).collect()]
    assert got == [([0, 7], [2.5]), ([1, 2], [4.0])]
    ragged = matrices.parse_keymat(matrices.encode_keymat([((3,), [1, 2]), ((4,), [5])]))
    assert ragged == [([3], [1, 2]), ([4], [5])]
    with pytest.raises(TypeError):
        matrices.encode_keymat([((1,), [1]), ((1, 2), [1])])


def test_captures_matrices_and_spectral_groups(spark, tmp_path):
    (tmp_path / "f0.csv").write_text("h\n" * 4 + "".join(f"{c},{r},1,2,3\n" for c in range(2) for r in range(3)))
    captures = matrices.read_captures(spark, str(tmp_path / "f0.csv"))
    assert [(r.channels, r.reps) for r in matrices.capture_counts(captures).collect()] == [(2, 3)]
    assert matrices.fire_sequence(captures, ["f0.csv"]).where("fire = 0").count() == 6
    with pytest.raises(Exception, match="rectangular"):
        matrices.capture_counts(captures.where("not (channel = 1 and rep = 2)")).collect()
    m = np.arange(6.0).reshape(2, 3)
    assert np.array_equal(matrices.decode_matrix(matrices.encode_matrix(m), 2, "<f8"), m)
    groups = [np.array([(1 + 2j, 4), (3, 5)], matrices.SPECTRAL), np.zeros(0, matrices.SPECTRAL)]
    assert [len(g) for g in matrices.spectral_groups(matrices.encode_spectral(groups))] == [2, 0]
    with pytest.raises(ValueError):
        matrices.spectral_groups(matrices.encode_spectral(groups)[:-32])
    (tmp_path / "s.bin").write_bytes(matrices.encode_spectral(groups))
    rows = matrices.read_spectral(spark, str(tmp_path / "s.bin")).orderBy("pos").collect()
    assert [(r.grp, r.pos, r.re, r.im, r.idx) for r in rows] == [(0, 0, 1.0, 2.0, 4), (0, 1, 3.0, 0.0, 5)]
    assert sorted((r.grp, r.n) for r in matrices.read_spectral(spark, str(tmp_path / "s.bin"), counts_only=True).collect()) == [(0, 2), (1, 0)]


def test_names(spark, tmp_path):
    for name in ("g.1-2.x", "g.10-3.x", "h.x"):
        (tmp_path / name).write_text("1")
    found = files.match_files(spark, [f"{tmp_path}/g*", f"{tmp_path}/h.x"])
    assert [f.rpartition("/")[2] for f in found] == ["g.1-2.x", "g.10-3.x", "h.x"] and files.match_files(spark, [f"{tmp_path}/none*"], must=False) == []
    with pytest.raises(FileNotFoundError):
        files.match_files(spark, [f"{tmp_path}/none*"])
    assert [r.numbers for r in files.numbered_files(files.listed(spark, str(tmp_path)), "g.", r"\.x", 2).collect()] == [[1, 2], [10, 3]]
    assert files.output_name("/a/b.x.gz", "/c", label="l") == "/c/b.l.x.gz"
    assert files.output_name("/a/b.x", None, "npz") == "/a/b.npz"


def test_channels_may_lack_transmissions(spark, tmp_path):
    rng = np.random.default_rng(0)
    kept = {0: [0, 1, 2, 3, 4], 1: [1, 3], 2: [0], 3: [4]}
    rows = [("b" if rid == 3 else "a", rid, row, 0, 0, 1.0, 2.0, 3.0, 4, 8, rng.normal(size=8).astype("f4").astype(float).tolist()) for rid, own in kept.items() for row in own]
    table = spark.createDataFrame(rows, "path string, rid long, row long, li long, gi long, px double, py double, pz double, ws long, wl long, data array<double>")
    for code in ("F4", "F8", "C4", "C8"):
        folder = str(tmp_path / code)
        assert waveset.write_sets(table, folder, typecode=code, ntx=5) == 2
        got = {(r.rid, r.row): r["data"] for r in waveset.read_records(spark, folder).collect()}
        assert got == {(r[1], r[2]): r[-1] for r in rows}
        assert {(r.ntx, r.nrx) for r in waveset.read_sets(spark, folder).collect()} == {(5, 3), (5, 1)}
        assert waveset.channel_list(waveset.read_records(spark, folder, headers_only=True)).count() == 4
    for bad in ({"typecode": "I4", "ntx": 5}, {"ntx": 4}, {}):
        with pytest.raises(Exception, match="does not fit|beyond"):
            waveset.write_sets(table, str(tmp_path / "bad"), **bad)
    with pytest.raises(Exception, match="twice"):
        waveset.write_sets(table.unionByName(table.where("rid = 2")), str(tmp_path / "bad"), ntx=5)


def test_file_queries_hold_for_channels_that_are_not_whole(spark, tmp_path):
    import duckdb

    from wavelattice.plans import catalog

    for n in (42, 33):  # the last channel alone in its file, and beside others
        folder = tmp_path / str(n)
        spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").where(f"vec_id < {n} or (vec_id >= 80 and vec_id < {49 + n})").write.parquet(str(folder / "embeddings.parquet"))
        con = duckdb.connect()
        con.sql(f"create view embeddings as select * from '{folder}/embeddings.parquet/*.parquet'")
        for name in ("set_round_trip", "set_headers", "channel_list", "decoded_set", "hadamard_decode"):
            df = catalog.QUERIES[name](spark, str(folder))
            want = con.sql(f"select {', '.join(df.columns)} from ({catalog.SQL[name]})").fetchall()
            assert sorted(map(tuple, df.collect())) == sorted(want), name


def test_a_set_is_written_by_one_task(spark, tmp_path):
    rows = spark.range(400).repartition(8).select(
        F.concat(F.lit("set"), F.floor(F.col("id") / 80)).alias("path"), F.floor(F.col("id") / 20).alias("rid"), (F.col("id") % 20).alias("row"), *(F.lit(0).cast("long").alias(c) for c in ("li", "gi")),
        *(F.lit(0.0).alias(c) for c in ("px", "py", "pz")), F.lit(0).cast("long").alias("ws"), F.lit(2).cast("long").alias("wl"), F.array(F.col("id").cast("double"), F.lit(1.0)).alias("data"),
    )
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    # the join is planned by sorting, and becomes a broadcast when the few sums are seen
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "2000")
    try:
        waveset.write_sets(rows, str(tmp_path / "s"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sorted((r.rid, r.row, r["data"][0]) for r in waveset.read_records(spark, str(tmp_path / "s")).collect()) == [(k // 20, k % 20, float(k)) for k in range(400)]
