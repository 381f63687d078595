"""Integer mixers on 32 and 64 bits, vectorised."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import LongType


def mix64(x: np.ndarray, rounds: int = 2) -> np.ndarray:
    """Shift and multiply rounds with odd constants, a bijection on 64 bits."""
    x = x.astype(np.uint64)
    for c in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)[:rounds]:
        x = (x ^ (x >> np.uint64(33))) * np.uint64(c)
    return x ^ (x >> np.uint64(33))


@pandas_udf(LongType())
def hash64(x: pd.Series) -> pd.Series:
    return pd.Series(mix64(x.to_numpy(np.int64).view(np.uint64)).view(np.int64))


@pandas_udf(LongType())
def hash32(x: pd.Series) -> pd.Series:
    return pd.Series((mix64(x.to_numpy(np.int64).view(np.uint64)) >> np.uint64(32)).astype(np.int64))
