"""Canonical tables.  Keys are (t, r) pairs, element indices or voxel numbers; values are scalars or arrays."""

from __future__ import annotations

from pyspark.sql import types as T

_long, _double = T.LongType(), T.DoubleType()
_array = T.ArrayType(_double)


def _of(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


#: One signal a row: samples dstart .. dstart + size(data) of nsamp; zero elsewhere.
WAVES = _of(t=_long, r=_long, nsamp=_long, dstart=_long, data=_array)
SAMPLES = _of(t=_long, r=_long, s=_long, v=_double)
ARRIVALS = _of(t=_long, r=_long, time=_double)
ELEMENTS = _of(e=_long, x=_double, y=_double, z=_double)
VOXELS = _of(i=_long, j=_long, k=_long, v=_double)
#: Length of a path (t, r) in a voxel.
PATHS = _of(t=_long, r=_long, vid=_long, len=_double)
BASIS = _of(vid=_long, pid=_long, w=_double)
#: Records of an acquisition: one row a receive channel and transmission.
RECORDS = _of(rid=_long, row=_long, li=_long, gi=_long, px=_double, py=_double, pz=_double, ws=_long, wl=_long, data=_array)
SETS = _of(path=T.StringType(), version=T.StringType(), temps=_array, typecode=T.StringType(), f2c=_long, nsamp=_long, nrx=_long, ntx=_long, gcount=_long, gsize=_long, txstart=_long, tgc=_array)
KEYMAT = _of(keys=T.ArrayType(_long), values=_array)
CAPTURES = _of(fire=_long, channel=_long, rep=_long, data=_array)
SPECREPS = _of(path=T.StringType(), grp=_long, pos=_long, re=T.FloatType(), im=T.FloatType(), idx=_long)
TRIANGLES = _of(tri=_long, ax=_double, ay=_double, az=_double, bx=_double, by=_double, bz=_double, cx=_double, cy=_double, cz=_double)
