"""64-bit and 32-bit mixers: bijections (or folds) of integers, by NumPy in Arrow
batches, since ANSI multiplication of longs does not wrap around.

column(name) is a mixer as a column function.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

U = np.uint64

#: Multipliers and constants of published mixers.
EVENSEN_A, EVENSEN_B = 0x9FB21C651E98DF25, 0xA24BAED4963EE407
NASAM_A, NASAM_B, ROOT_TWO = 0x9E6C63D0676A9A99, 0x9E6D62D06F6A9A9B, 0x6A09E667F3BCC909
PELICAN_X, PELICAN_A, PELICAN_B = 0xD1B54A32D192ED03, 0xAEF17502108EF2D9, 0xDB4F0B9175AE2165
STAFFORD_13A, STAFFORD_13B = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
STAFFORD_4A, STAFFORD_4B = 0x62A9D9ED799705F5, 0xCB24D0A5C88C35B3
LEA_64, LEA_32 = 0xDABA0B6EB09322E3, 0xD36D884B
APPLEBY_A, APPLEBY_B = 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53


def ror(v: np.ndarray, k: int) -> np.ndarray:
    return (v >> U(k)) | (v << U(64 - k))


def _shift_multiply(v: np.ndarray, *steps: tuple[int, int], last: int) -> np.ndarray:
    for shift, factor in steps:
        v = (v ^ (v >> U(shift))) * U(factor)
    return v ^ (v >> U(last))


def rrmxmx(v):
    v = (v ^ ror(v, 49) ^ ror(v, 24)) * U(EVENSEN_A)
    return _shift_multiply(v, (28, EVENSEN_A), last=28)


def rrxmrrxmsx(v):
    v = (v ^ ror(v, 25) ^ ror(v, 50)) * U(EVENSEN_B)
    v = (v ^ ror(v, 24) ^ ror(v, 49)) * U(EVENSEN_A)
    return v ^ (v >> U(28))


def xnasam(v, c: int = ROOT_TWO):
    v = v ^ U(c)
    v = (v ^ ror(v, 25) ^ ror(v, 47)) * U(NASAM_A)
    v = (v ^ (v >> U(23)) ^ (v >> U(51))) * U(NASAM_B)
    return v ^ (v >> U(23)) ^ (v >> U(51))


def pelican(v):
    v = (v ^ ror(v, 23) ^ ror(v, 47) ^ U(PELICAN_X)) * U(PELICAN_A)
    v = (v ^ (v >> U(43)) ^ (v >> U(31)) ^ (v >> U(23))) * U(PELICAN_B)
    return v ^ (v >> U(28))


def stafford_mix13(v):
    return _shift_multiply(v, (30, STAFFORD_13A), (27, STAFFORD_13B), last=31)


def lea_mix64(v):
    return _shift_multiply(v, (32, LEA_64), (32, LEA_64), last=32)


def appleby_mix64(v):
    return _shift_multiply(v, (33, APPLEBY_A), (33, APPLEBY_B), last=33)


def stafford_mix04(v):
    """64 bits to 32."""
    v = (v ^ (v >> U(33))) * U(STAFFORD_4A)
    return (((v ^ (v >> U(28))) * U(STAFFORD_4B)) >> U(32)).astype(np.uint32)


def lea_mix32(v):
    v = v.astype(np.uint32)
    for _ in range(2):
        v = (v ^ (v >> np.uint32(16))) * np.uint32(LEA_32)
    return v ^ (v >> np.uint32(16))


MIXERS = {f.__name__: f for f in (rrmxmx, rrxmrrxmsx, xnasam, pelican, stafford_mix13, lea_mix64, appleby_mix64)}
FOLDS = {f.__name__: f for f in (stafford_mix04, lea_mix32)}


def column(name: str):
    """A mixer from a bigint column to a bigint (or, for the folds, an int) column."""
    f, kind, out = (MIXERS[name], "long", np.int64) if name in MIXERS else (FOLDS[name], "int", np.int32)

    @F.pandas_udf(kind)
    def run(x: pd.Series) -> pd.Series:
        return pd.Series(f(x.to_numpy(dtype=np.int64).view(U)).view(out))

    return lambda x: run(x.cast("long"))


def double_of(bits: Column) -> Column:
    """[0, 1) from the 53 upper bits."""
    return F.shiftrightunsigned(bits, 11) * F.lit(2.0**-53)
