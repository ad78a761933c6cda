"""Queries on signals: windows, arithmetic, transforms, rolling measures, decoding."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import kernels as K
from ..functions import spectral as S
from ..operators import arrivals, decode, images, rolling
from . import bindings as B

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def long_form(waves, data="data", start="dstart"):
    """t, r, s, v with six decimals."""
    rows = rolling.to_samples(waves, data=data, start=start)
    return rows.select("t", "r", "s", F.round("v", 6).alias("v"))


@query("dense_window", B.sql("also grid as (select t, r, unnest(range(-5, 40))::bigint as s from waves) select g.t, g.r, g.s, round(coalesce(x.v, 0), 6) as v from grid g left join samples x using (t, r, s)", "waves", "samples"))
def dense_window(spark, sf_dir):
    w = A.replace(B.waves(spark, sf_dir), data=A.dense(F.col("data"), F.col("dstart"), -5, 45), dstart=F.lit(-5).cast("long"))
    return long_form(w)


@query("hann_window", B.sql("select t, r, s, round(v * case when s - 8 < 6 then 0.5 - 0.5 * cos(2 * pi() * (s - 8) / 11) else 1 end * case when s - 8 >= 34 then 0.5 - 0.5 * cos(2 * pi() * (39 - (s - 8)) / 11) else 1 end, 6) as v from samples where s >= 8 and s < 48", "samples"))
def hann_window(spark, sf_dir):
    start, data = A.window(F.col("data"), F.col("dstart"), 8, 40, tail=6)
    return long_form(A.replace(B.waves(spark, sf_dir), dstart=start, data=data))


@query("relative_window", B.sql("select t, r, s, round(v, 6) as v from samples where s >= 3 and s < 54", "samples"))
def relative_window(spark, sf_dir):
    start, data = A.trim(F.col("data"), F.col("dstart"), 3, -10)
    return long_form(A.replace(B.waves(spark, sf_dir), dstart=start, data=data))


@query("debias", B.sql("select t, r, s, round(v - avg(v) over (partition by t, r), 6) as v from samples", "samples"))
def debias(spark, sf_dir):
    return long_form(B.waves(spark, sf_dir).withColumn("data", A.debias(F.col("data"))))


@query("signsquare", B.sql("select t, r, s, round(v * abs(v), 6) as v from samples", "samples"))
def signsquare(spark, sf_dir):
    return long_form(B.waves(spark, sf_dir).withColumn("data", A.sign_square(F.col("data"))))


@query("scale_add", B.sql("also a as (select t, r, s, v from samples), b as (select t, r, s + 10 as s, v from samples) select coalesce(a.t, b.t) as t, coalesce(a.r, b.r) as r, coalesce(a.s, b.s)::bigint as s, round(2.5 * coalesce(a.v, 0) - coalesce(b.v, 0), 6) as v from a full join b on a.t = b.t and a.r = b.r and a.s = b.s", "samples"))
def scale_add(spark, sf_dir):
    w = B.waves(spark, sf_dir)
    start, data = A.add(A.scale(F.col("data"), 2.5), F.col("dstart"), F.col("data"), F.col("dstart") + 10, -1)
    return long_form(A.replace(w, dstart=start, data=data))


@query("scalar_division", B.sql("select t, r, s, round(-v / 4, 6) as quotient, floor(v / 0.25)::double as floored, round(abs(v), 6) as magnitude from samples", "samples"))
def scalar_division(spark, sf_dir):
    parts = F.arrays_zip(A.divide(A.negate(F.col("data")), 4.0).alias("a"), A.floor_divide(F.col("data"), 0.25).alias("b"), A.magnitude(F.col("data")).alias("c"))
    rows = B.waves(spark, sf_dir).select("t", "r", F.posexplode(parts).alias("s", "p"))
    return rows.select("t", "r", F.col("s").cast("long").alias("s"), F.round("p.a", 6).alias("quotient"), F.col("p.b").alias("floored"), F.round("p.c", 6).alias("magnitude"))


@query("cyclic_shift", B.sql("select t, r, ((s + 5) % 64)::bigint as s, round(v, 6) as v from samples", "samples"))
def cyclic_shift(spark, sf_dir):
    start, data = A.shift(F.col("data"), F.col("dstart"), 5, F.col("nsamp"), cyclic=True)
    return long_form(A.replace(B.waves(spark, sf_dir), dstart=start, data=data))


@query("clipped_shift", B.sql("select t, r, s - 7 as s, round(v, 6) as v from samples where s >= 7", "samples"))
def clipped_shift(spark, sf_dir):
    start, data = A.shift(F.col("data"), F.col("dstart"), -7, F.col("nsamp"))
    return long_form(A.replace(B.waves(spark, sf_dir), dstart=start, data=data))


@query("group_roll", B.sql("select t, r, (case when r // 8 = 1 then (s + 64 - 9) % 64 else s end)::bigint as s, round(v, 6) as v from samples", "samples"))
def group_roll(spark, sf_dir):
    return long_form(decode.shift_group(B.waves(spark, sf_dir), 1, 9, size=8))


@query("dft_magnitude", B.sql("also bins as (select unnest(range(0, 33))::bigint as k) select t, r, k, round(sqrt(pow(sum(v * cos(2 * pi() * k * s / 64)), 2) + pow(sum(v * sin(2 * pi() * k * s / 64)), 2)), 5) as mag from samples, bins group by t, r, k", "samples"))
def dft_magnitude(spark, sf_dir):
    rows = S.transform(B.waves(spark, sf_dir)).select("t", "r", F.posexplode(F.zip_with("re", "im", lambda a, b: F.sqrt(a * a + b * b))).alias("k", "m"))
    return rows.select("t", "r", F.col("k").cast("long").alias("k"), F.round("m", 5).alias("mag"))


_BINS = "bins as (select t, r, k, sum(v * cos(2 * pi() * k * s / 64)) as re, sum(v * sin(2 * pi() * k * s / 64)) as im from samples, (select unnest(range(4, 20)) as k) group by t, r, k)"


@query("bandpass_energy", B.sql(f"also {_BINS} select t, r, round(sum(2 * (re * re + im * im) / 64), 5) as energy from bins group by t, r", "samples"))
def bandpass_energy(spark, sf_dir):
    rows = S.bandpass(B.waves(spark, sf_dir), 4, 20)
    return rows.select("t", "r", F.round(F.aggregate("data", F.lit(0.0), lambda a, v: a + v * v), 5).alias("energy"))


_LAGS = """also lags as (select a.r as r, a.t as t, (a.s - b.s)::bigint as lag, sum(a.v * b.v) as c from samples a join samples b on a.r = b.r and b.t = 0 and a.t > 0 group by 1, 2, 3)"""


@query("xcorr_lag", B.sql(_LAGS + " select t, r, lag, round(c, 5) as c from lags", "samples"))
def xcorr_lag(spark, sf_dir):
    w = B.waves(spark, sf_dir)
    pairs = w.where("t > 0").join(w.where("t = 0").select("r", F.col("data").alias("ref"), F.col("dstart").alias("ref_start")), "r")

    def kernel(d, x, s, y):
        lags, c = K.correlate(x, d, y, s)
        return lags, c

    rows = S.apply(pairs, ["dstart", "data", "ref_start", "ref"], {"lags": "array<double>", "c": "array<double>"}, kernel)
    rows = rows.select("t", "r", F.explode(F.arrays_zip("lags", "c")).alias("p"))
    return rows.select("t", "r", F.col("p.lags").cast("long").alias("lag"), F.round("p.c", 5).alias("c"))


@query("xcorr_delay", B.sql(_LAGS + ", best as (select t, r, max(round(c, 9)) as c from lags group by t, r) select l.t, l.r, min(l.lag)::double as delay from lags l join best b on l.t = b.t and l.r = b.r and round(l.c, 9) = b.c group by 1, 2", "samples"))
def xcorr_delay(spark, sf_dir):
    w = B.waves(spark, sf_dir)
    pairs = w.where("t > 0").join(w.where("t = 0").select("r", F.col("data").alias("ref"), F.col("dstart").alias("ref_start")), "r")
    return S.delay(pairs).select("t", "r", "delay")


#: Channels of 20 transmissions each, coded in groups of four.
_CODED = "also coded as (select vec_id // 20 as rid, vec_id % 20 as row, unnest(range(0, 64))::bigint as s, unnest(embedding)::double as v from embeddings)"


def _coded(spark, sf_dir):
    rows = B.table(spark, sf_dir, "embeddings")
    return rows.select(F.floor(F.col("vec_id") / 20).alias("rid"), (F.col("vec_id") % 20).alias("row"), F.lit(0).cast("long").alias("ws"), F.col("embedding").cast("array<double>").alias("data"))


@query("hadamard_decode", "with " + _CODED.removeprefix("also ") + " select rid, (row // 4)::bigint as g, l, s, round(sum(v * (1 - 2 * (bit_count((row % 4)::bigint & l) % 2))) / 4, 6) as v from coded, (select unnest(range(0, 4))::bigint as l) group by 1, 2, 3, 4")
def hadamard_decode(spark, sf_dir):
    out = decode.hadamard_decode(_coded(spark, sf_dir), 4, B.NSAMP, whole=False)
    return out.select("rid", "g", "l", F.posexplode("re").alias("s", "v")).select("rid", "g", "l", F.col("s").cast("long").alias("s"), F.round("v", 6).alias("v"))


@query("hadamard_join", SQL["hadamard_decode"])
def hadamard_join(spark, sf_dir):
    rows = _coded(spark, sf_dir).select("rid", F.floor(F.col("row") / 4).alias("g"), (F.col("row") % 4).alias("row"), F.posexplode("data").alias("s", "v"))
    return decode.hadamard_join(rows, 4).select("rid", "g", F.col("l").cast("long").alias("l"), F.col("s").cast("long").alias("s"), F.round("v", 6).alias("v"))


@query("tgc_gain", B.sql("select t, r, s, round(v * pow(10, -(s // 16) / 20.0), 6) as v from samples", "samples"))
def tgc_gain(spark, sf_dir):
    gain = A.gain_curve(F.array(*(F.lit(float(k)) for k in range(4))), 16)
    return long_form(B.waves(spark, sf_dir).withColumn("data", F.zip_with("data", gain, lambda v, g: v * g)))


_PAD = """also power as (select t, r, s, v, v * v as pw from samples),
pads as (select t, r, unnest(list_concat(range(-6, 0), range(64, 67)))::bigint as s, null::double as v, avg(pw) as pw from power group by t, r),
rows as (select * from power union all select * from pads),
ratios as (select t, r, s, v,
  avg(pw) over (partition by t, r order by s rows between current row and 3 following) / avg(pw) over (partition by t, r order by s rows between 4 preceding and 1 preceding) as ner,
  avg(pw) over (partition by t, r order by s rows between current row and 3 following) / avg(pw) over (partition by t, r order by s rows between 6 preceding and 5 preceding) as fer from rows)"""
_MER = _PAD + ", mer as (select t, r, s, v, ner, fer, pow(ner, 3) * pow(abs(v), 3) as nmer, pow(fer, 3) * pow(abs(v), 3) as fmer from ratios where v is not null)"


def _ratios(spark, sf_dir):
    return rolling.energy_ratio(B.samples(spark, sf_dir), 4, 4, 2)


@query("energy_ratio", B.sql(_PAD + " select t, r, s, round(ner, 5) as ner, round(fer, 5) as fer from ratios where v is not null", "samples"))
def energy_ratio(spark, sf_dir):
    return _ratios(spark, sf_dir).select("t", "r", "s", F.round("ner", 5).alias("ner"), F.round("fer", 5).alias("fer"))


@query("mer", B.sql(_MER + " select t, r, s, round(nmer, 5) as nmer, round(fmer, 4) as fmer from mer", "samples"))
def mer(spark, sf_dir):
    return rolling.modified_ratio(_ratios(spark, sf_dir)).select("t", "r", "s", F.round("nmer", 5).alias("nmer"), F.round("fmer", 4).alias("fmer"))


_IMER = _MER + """, smooth as (select t, r, s, avg(nmer) over w as nm, avg(fmer) over w as fm from mer window w as (partition by t, r order by s rows between 2 preceding and 2 following)),
ends as (select t, r, nm, fm from smooth where s = 61),
imer as (select a.t, a.r, a.s, case when a.s > 61 then e.fm - e.nm else a.fm - a.nm end as imer from smooth a join ends e using (t, r))"""


@query("imer", B.sql(_IMER + " select t, r, s, round(imer, 4) as imer from imer", "samples"))
def imer(spark, sf_dir):
    rows = rolling.imer(rolling.modified_ratio(_ratios(spark, sf_dir)), 5)
    return rows.select("t", "r", "s", F.round("imer", 4).alias("imer"))


@query("first_crossing", B.sql(_MER + ", means as (select t, r, avg(nmer) as m from mer group by t, r) select t, r, min(s) as s from mer join means using (t, r) where nmer >= m group by t, r", "samples"))
def first_crossing(spark, sf_dir):
    return rolling.first_crossing(rolling.modified_ratio(_ratios(spark, sf_dir)), "nmer")


@query("breakaway_crossing", B.sql(_MER + """, means as (select t, r, avg(nmer) as m from mer group by t, r), first as (select t, r, min(s) as dl from mer join means using (t, r) where nmer >= m group by t, r),
base as (select t, r, s, nmer, avg(nmer) over w + 0.5 * stddev_pop(nmer) over w as b from mer window w as (partition by t, r order by s rows between 7 preceding and current row)),
back as (select f.t, f.r, f.dl, max(case when nmer < b then s end) as b from first f left join base on base.t = f.t and base.r = f.r and base.s < f.dl group by 1, 2, 3)
select t, r, (case when b + 1 < dl then b + 1 else dl end)::bigint as s from back""", "samples"))
def breakaway_crossing(spark, sf_dir):
    rows = rolling.modified_ratio(_ratios(spark, sf_dir))
    return rolling.breakaway(rows, "nmer", rolling.first_crossing(rows, "nmer"), 8, 0.5)


@query("energy_leak", B.sql("select t, r, round(sum(case when s < 20 then v * v else 0 end) / sum(v * v), 6) as leak from samples group by t, r", "samples"))
def energy_leak(spark, sf_dir):
    at = B.waves(spark, sf_dir).select("t", "r", F.lit(20.4).alias("at"))
    return rolling.energy_leak(B.samples(spark, sf_dir), at).select("t", "r", F.round("leak", 6).alias("leak"))


@query("running_energy", B.sql("select ch, s, round(sum(v * v) over (partition by ch order by s rows unbounded preceding), 0) as energy from series", "series"))
def running_energy(spark, sf_dir):
    return rolling.running_energy(B.series(spark, sf_dir), ("ch",)).select("ch", "s", F.round("energy", 0).alias("energy"))


@query("noise_floor", B.sql("also sd as (select ch, stddev_pop(v) over w as sd, count(*) over w as n from series window w as (partition by ch order by s rows between 4 preceding and current row)) select ch, round(20 * log10(greatest(min(sd), 2.220446049250313e-16)), 5) as floor from sd where n = 5 group by ch", "series"))
def noise_floor(spark, sf_dir):
    return rolling.noise_floor(B.series(spark, sf_dir), 5, ("ch",)).select("ch", F.round("floor", 5).alias("floor"))


@query("snr_rolling", B.sql("""also raw as (select ch, s, v, case when count(*) over w = 6 then sqrt(avg(v * v) over w) end as rms from series window w as (partition by ch order by s rows between 6 preceding and 1 preceding)),
firsts as (select ch, arg_min(rms, s) filter (where rms is not null) as f from raw group by ch)
select ch, s, round(20 * log10(abs(v) / coalesce(rms, f)), 5) as snr from raw join firsts using (ch)""", "series"))
def snr_rolling(spark, sf_dir):
    # a level just below the noise is -0.0, as SQL rounds
    near = F.round("snr", 5)
    return rolling.rolling_snr(B.series(spark, sf_dir), 6, ("ch",)).select("ch", "s", F.when((near == 0) & (F.col("snr") < 0), F.lit(-0.0)).otherwise(near).alias("snr"))


@query("peak_snr", B.sql("also sd as (select t, r, stddev_pop(v) over w as sd, count(*) over w as n from samples window w as (partition by t, r order by s rows between 7 preceding and current row)), f as (select t, r, min(sd) as sd from sd where n = 8 group by t, r) select t, r, round(20 * log10(max(abs(v))) - 20 * log10(min(sd)), 5) as snr from samples join f using (t, r) group by t, r", "samples"))
def peak_snr(spark, sf_dir):
    return rolling.peak_snr(B.samples(spark, sf_dir), 8).select("t", "r", F.round("snr", 5).alias("snr"))


@query("extremum", B.sql("select t, r, round(max(v), 6) as value, arg_max(s, [v, -s]) as s, round(min(v), 6) as least, arg_min(s, [v, s]) as at from samples group by t, r", "samples"))
def extremum(spark, sf_dir):
    rows = B.samples(spark, sf_dir)
    low = rolling.extremum(rows, largest=False).select("t", "r", F.round("value", 6).alias("least"), F.col("s").alias("at"))
    return rolling.extremum(rows).select("t", "r", F.round("value", 6).alias("value"), "s").join(low, ["t", "r"])


_HANN8 = "(0.5 - 0.5 * cos(2 * pi() * i / 7))"


@query("stft_power", B.sql(f"""also frames as (select x.t, x.r, x.s as frame, i, y.v * {_HANN8} as v from samples x, (select unnest(range(0, 8)) as i), samples y where y.t = x.t and y.r = x.r and y.s = x.s + i - 4)
select t, r, frame as s, k, round(pow(sum(v * cos(2 * pi() * k * i / 8)), 2) + pow(sum(v * sin(2 * pi() * k * i / 8)), 2), 5) as power from frames, (select unnest(range(0, 3))::bigint as k) group by t, r, frame, k""", "samples"))
def stft_power(spark, sf_dir):
    def kernel(n, d, x):
        y = K.stft(x, K.hann(8), 8)[:, :3]
        return ((y.real**2 + y.imag**2).ravel(),)

    rows = S.apply(B.waves(spark, sf_dir), S.WAVE, {"power": "array<double>"}, kernel).select("t", "r", F.posexplode("power").alias("i", "p"))
    return rows.select("t", "r", F.floor(F.col("i") / 3).alias("s"), (F.col("i") % 3).cast("long").alias("k"), F.round("p", 5).alias("power"))


@query("fft_round_trip", B.sql("select t, r, s, round(v, 6) as v from samples", "samples"))
def fft_round_trip(spark, sf_dir):
    return long_form(S.inverse(S.transform(B.waves(spark, sf_dir)), B.NSAMP).withColumn("dstart", F.lit(0)))


@query("spectrum_index", "with n as (select n_nationkey + 2 as n from nation), i as (select n, unnest(range(0, n))::bigint as i from n) select n::bigint as n, i, (case when i < (n + 1) // 2 then i else i - n end)::bigint as full_index, (case when i <= n // 2 then i end)::bigint as real_index from i")
def spectrum_index(spark, sf_dir):
    n = B.table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 2).cast("long").alias("n"))
    rows = n.select("n", F.posexplode(A.spectrum_index(F.col("n"), False)).alias("i", "full_index"))
    real = n.select("n", F.posexplode(A.spectrum_index(F.col("n"), True)).alias("i", "real_index"))
    return rows.join(real, ["n", "i"], "left").select("n", *(F.col(c).cast("long").alias(c) for c in ("i", "full_index", "real_index")))


#: The transform of 64 samples: re and im by bin.
_DFT = "also dft as (select t, r, k, sum(v * cos(2 * pi() * k * s / 64)) as re, -sum(v * sin(2 * pi() * k * s / 64)) as im from samples, (select unnest(range(0, 33)) as k) group by t, r, k)"


@query("fft_envelope", B.sql(_DFT + ", back as (select t, r, s, sum(case when k in (0, 32) then 1 else 2 end * (re * cos(2 * pi() * k * s / 64) - im * sin(2 * pi() * k * s / 64))) / 64 as a, sum(case when k in (0, 32) then 1 else 2 end * (re * sin(2 * pi() * k * s / 64) + im * cos(2 * pi() * k * s / 64))) / 64 as b from dft, (select unnest(range(0, 64))::bigint as s) group by t, r, s) select t, r, s, round(sqrt(a * a + b * b), 6) as v from back", "samples"))
def fft_envelope(spark, sf_dir):
    return long_form(S.envelope(B.waves(spark, sf_dir)))


@query("denoise")
def denoise(spark, sf_dir):
    return long_form(S.denoise(B.waves(spark, sf_dir), band=(0.05, 0.45), noisewin=(0, 16), pfa=0.01, sigma=3.0))


@query("peak_isolation")
def peak_isolation(spark, sf_dir):
    rows = S.isolate_peak(B.waves(spark, sf_dir), window="tight")
    return rows.select("t", "r", "peak", F.round("prominence", 6).alias("prominence"), "width", "dstart", F.size("data").alias("n"), "status")


@query("oversampled_delay", B.sql("""also dft as (select t, r, k, sum(v * cos(2 * pi() * k * s / 128)) as re, -sum(v * sin(2 * pi() * k * s / 128)) as im from samples, (select unnest(range(0, 65)) as k) group by t, r, k),
part as (select a.t, a.r, a.k, a.re * b.re + a.im * b.im as re, a.im * b.re - a.re * b.im as im from dft a join dft b on b.t = 0 and a.t > 0 and a.r = b.r and a.k = b.k),
lags as (select t, r, m, sum(case when k in (0, 64) then 1 else 2 end * (re * cos(2 * pi() * k * m / 512) - im * sin(2 * pi() * k * m / 512))) as c from part, (select unnest(range(-252, 253)) as m) group by t, r, m)
select t, r, arg_max(m, abs(c))::double / 4 as delay, arg_max(case when c < 0 then -1 else 1 end, abs(c))::integer as sign from lags group by t, r""", "samples"))
def oversampled_delay(spark, sf_dir):
    w = B.waves(spark, sf_dir)
    pairs = w.where("t > 0").join(w.where("t = 0").select("r", F.col("data").alias("ref"), F.col("dstart").alias("ref_start")), "r")
    return S.delay(pairs, osamp=4, negative=True).select("t", "r", "delay", "sign")


@query("oversample", B.sql("select t, r, s, round(v, 6) as v from samples", "samples"))
def oversample(spark, sf_dir):
    """Every third of the samples between which two were put."""
    rows = long_form(S.oversample(B.waves(spark, sf_dir), 3)).where("s % 3 = 0")
    return rows.withColumn("s", (F.col("s") / 3).cast("long"))


@query("fractional_shift", B.sql(_DFT + " select t, r, s, round(sum(case when k = 0 then re when k = 32 then re * cos(pi() * 2.25) * cos(pi() * s) else 2 * (re * cos(2 * pi() * k * (s - 2.25) / 64) - im * sin(2 * pi() * k * (s - 2.25) / 64)) end) / 64, 6) as v from dft, (select unnest(range(0, 64))::bigint as s) group by t, r, s", "samples"))
def fractional_shift(spark, sf_dir):
    return long_form(S.shift(B.waves(spark, sf_dir).withColumn("d", F.lit(2.25)), "d", cyclic=True))


#: The improved ratio with an average of three: far less near, the last one repeated.
_IMER3 = _MER + """, smooth as (select t, r, s, v, avg(fmer) over w - avg(nmer) over w as c from mer window w as (partition by t, r order by s rows between 1 preceding and 1 following)),
curve as (select t, r, s, v, case when s = 63 then lag(c) over (partition by t, r order by s) else c end as c from smooth),
crossed as (select t, r, min(s) as s from (select *, avg(c) over (partition by t, r) as m from curve) where c >= m group by t, r)"""
_ARRIVAL = {"prewin": 4, "postwin": 4, "vpwin": 2, "avgwin": 3}


@query("arrival_samples", B.sql(_IMER3 + " select t, r, s::double as at, 'ok' as status from crossed", "samples"))
def arrival_samples(spark, sf_dir):
    return S.arrivals(B.waves(spark, sf_dir), **_ARRIVAL).select("t", "r", F.round("at", 6).alias("at"), "status")


_LEAKS = _IMER3 + """, leaks as (select c.t, c.r, c.s, sum(case when x.s <= c.s - 1 then x.v * x.v else 0 end) / sum(x.v * x.v) as share from crossed c join samples x on x.t = c.t and x.r = c.r group by 1, 2, 3),
told as (select t, r, s, case when s < 1 then 'out-of-bounds' when share >= 0.3 then 'leaky' else 'valid' end as status from leaks)"""


@query("arrival_times", B.sql(_LEAKS + ", sides as (select t, r, s, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2)) as d from told join senders a on a.e = t join senders b on b.e = r where status = 'valid' and t <> r), slow as (select t, r, s, s / d as w from sides), q as (select quantile_cont(w, 0.25) as lo, quantile_cont(w, 0.75) as hi from slow) select t, r, round(s * 0.05::double + 3, 6) as time from slow, q where w between lo - 1.5 * (hi - lo) and hi + 1.5 * (hi - lo)", "samples", "senders"))
def arrival_times(spark, sf_dir):
    """The whole job: crossings, leaks, outliers of slowness, times."""
    rows, _ = arrivals.arrival_times(B.waves(spark, sf_dir), 0.05, 3.0, B.senders(spark, sf_dir), reach=1.5, imer=dict(_ARRIVAL), leak=0.3)
    return rows.select("t", "r", F.round("time", 6).alias("time"))


@query("arrival_statuses", B.sql(_LEAKS + " select case when t % 4 = 0 then 'cached' else status end as status, count(*)::bigint as n from told group by 1", "samples"))
def arrival_statuses(spark, sf_dir):
    waves = B.waves(spark, sf_dir)
    cache = waves.where("t % 4 = 0").select("t", "r", F.lit(9.0).alias("delay"))
    return arrivals.arrival_times(waves, 0.05, 3.0, cache=cache, imer=dict(_ARRIVAL), leak=0.3)[1]


@query("correlated_times", B.sql(_LAGS + ", best as (select t, r, max(round(c, 9)) as c from lags group by t, r), early as (select l.t, l.r, min(l.lag) as lag from lags l join best b on l.t = b.t and l.r = b.r and round(l.c, 9) = b.c group by 1, 2) select t, r, round(lag * 0.5::double + 40, 6) as time from early", "samples"))
def correlated_times(spark, sf_dir):
    """Delays against a reference signal of each receiver, one after the other: those of its first transmission."""
    waves = B.waves(spark, sf_dir)
    pairs = waves.where("t > 0").join(waves.where("t = 0").select("r", F.col("data").alias("ref"), F.col("dstart").alias("ref_start")), "r")
    return S.delay(pairs).select("t", "r", F.round(F.col("delay") * 0.5 + 40, 6).alias("time"))


@query("neighbourhood_average", B.sql("select x.t, x.r, y.s, round(avg(y.v), 6) as v from waves x join samples y on abs(y.t - x.t) <= 1 and abs(y.r - x.r) <= 1 group by 1, 2, 3", "waves", "samples"))
def neighbourhood_average(spark, sf_dir):
    waves = B.waves(spark, sf_dir)
    ends = waves.select(F.col("t").alias("e")).unionByName(waves.select(F.col("r").alias("e"))).distinct()
    near = ends.select("e", F.explode(F.array(F.col("e") - 1, F.col("e") + 1)).alias("n"))
    return long_form(arrivals.neighbourhood_average(waves, near))


@query("prony", "select c_custkey as t, round(-(0.05 + c_custkey % 37 / 40.0), 5) as decay, round((1 + c_custkey % 11)::double, 4) as amplitude from customer")
def prony(spark, sf_dir):
    k = F.col("c_custkey")
    decay, size = 0.05 + k % 37 / 40, (1 + k % 11).cast("double")
    data = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda s: size * F.exp(-decay * s))
    waves = B.table(spark, sf_dir, "customer").select(k.alias("t"), F.lit(0).cast("long").alias("r"), F.lit(16).cast("long").alias("nsamp"), F.lit(0).cast("long").alias("dstart"), data.alias("data"))
    return S.exponents(waves, 1).select("t", F.round(F.get("decay", F.lit(0)), 5).alias("decay"), F.round(F.get("amplitude", F.lit(0)), 4).alias("amplitude"))


def _pulses(spark, sf_dir):
    """A smooth pulse a customer, delayed by its own number of samples."""
    k = F.col("c_custkey")
    data = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda s: F.exp(-((s - k % 20) ** 2) / 8))
    return B.table(spark, sf_dir, "customer").select(k.alias("t"), F.lit(0).cast("long").alias("r"), F.lit(64).cast("long").alias("nsamp"), F.lit(0).cast("long").alias("dstart"), data.alias("data"))


@query("zero_time", "select c_custkey as t, true as close from customer where c_custkey % 20 >= 6")
def zero_time(spark, sf_dir):
    """The slope of the phase gives the delay of a whole pulse."""
    rows = S.apply(_pulses(spark, sf_dir).where("t % 20 >= 6"), S.WAVE, {"delay": "double"}, lambda n, d, x: (K.zero_time(x, d, n, 1, 12),))
    return rows.select("t", (F.abs(F.col("delay") - F.col("t") % 20) < 0.01).alias("close"))


@query("directivity", B.sql(_DFT + " select t, r, k::bigint as k, round(exp(-(k / 16.0) * sin(0.5)) * sqrt(re * re + im * im), 5) as mag from dft", "samples"))
def directivity(spark, sf_dir):
    def kernel(re, im):
        a, b = K.directivity(re, im, np.arange(33) / 16, 0.5)
        return (np.hypot(a, b),)

    rows = S.apply(S.transform(B.waves(spark, sf_dir)), ["re", "im"], {"mag": "array<double>"}, kernel).select("t", "r", F.posexplode("mag").alias("k", "m"))
    return rows.select("t", "r", F.col("k").cast("long").alias("k"), F.round("m", 5).alias("mag"))


@query("spectral_ratio", B.sql(_DFT + ", big as (select t, r, max(sqrt(re * re + im * im)) as m from dft group by t, r) select t, r, k::bigint as k, case when sqrt(re * re + im * im) > 0.25 * m then 2.5 else 0 end::double as ratio from dft join big using (t, r)", "samples"))
def spectral_ratio(spark, sf_dir):
    """Of a signal and 2.5 times it, where the signal has something to tell."""
    rows = S.apply(B.waves(spark, sf_dir), ["data"], {"ratio": "array<double>"}, lambda x: (K.spectral_ratio(2.5 * x, x, 0.25).real,)).select("t", "r", F.posexplode("ratio").alias("k", "v"))
    return rows.select("t", "r", F.col("k").cast("long").alias("k"), F.round("v", 6).alias("ratio"))


@query("spectral_scale", B.sql(_DFT + " select t, r, s, round(sum(1.0 / (1 + k) * case when k in (0, 32) then 1 else 2 end * (re * cos(2 * pi() * k * s / 64) - im * sin(2 * pi() * k * s / 64))) / 64, 6) as v from dft, (select unnest(range(0, 64))::bigint as s) group by t, r, s", "samples"))
def spectral_scale(spark, sf_dir):
    gain = 1 / (1 + np.arange(33))
    rows = S.apply(B.waves(spark, sf_dir), ["data"], {"data2": "array<double>"}, lambda x: (K.spectral_scale(x, gain),))
    return long_form(rows.select("t", "r", F.col("data2").alias("data"), F.lit(0).alias("dstart")))


@query("stft_round_trip", B.sql("select t, r, s, round(v, 6) as v from samples", "samples"))
def stft_round_trip(spark, sf_dir):
    """Frames under a Gaussian window, put together again."""
    win = K.gabor_window(2.0)
    rows = S.apply(B.waves(spark, sf_dir), S.WAVE, {"data2": "array<double>"}, lambda n, d, x: (K.istft(K.stft(x, win), win),))
    return long_form(rows.select("t", "r", F.col("data2").alias("data"), F.lit(0).alias("dstart")))


@query("image_table", B.sql("select row_number() over (order by t, r) - 1 as row, s::bigint as s, round(greatest(20 * log10(abs(v) / max(abs(v)) over ()), -40), 4) as v from (select t, r, s, v from samples where s between 8 and 39)".replace("row_number() over (order by t, r) - 1 as row", "(dense_rank() over (order by t, r) - 1)::bigint as row").replace("s::bigint as s", "(s - 8)::bigint as s"), "samples"))
def image_table(spark, sf_dir):
    rows = images.image_table(B.waves(spark, sf_dir), 8, 32, scale="log", floor_db=-40.0)
    return rows.select(F.col("row").cast("long").alias("row"), "s", F.round("v", 4).alias("v"))


@query("frame_table", B.sql("also p as (select t, r, max(abs(v)) as p from samples where s between 8 and 39 group by t, r), g as (select t, max(p) as top from p group by t), l as (select t, avg(p / top) + 1.5 * stddev_pop(p / top) as lim from p join g using (t) group by t) select t, r as member, (s - 8)::bigint as s, round(v / top, 6) as v, round(lim, 6) as lim from samples join g using (t) join l using (t) where s between 8 and 39", "samples"))
def frame_table(spark, sf_dir):
    groups = B.waves(spark, sf_dir).select("t", F.col("r").alias("member"), "dstart", "data")
    rows = images.frame_table(groups, 8, 32, keys=("t",), deviations=1.5).select("t", "member", F.posexplode("data").alias("s", "v"), "limit")
    return rows.select("t", "member", F.col("s").cast("long").alias("s"), F.round("v", 6).alias("v"), F.round("limit", 6).alias("lim"))
