"""df.canonframe.to_canonical(), .to_canonical_str() and .sha256() on pandas frames and series; import to register."""

from __future__ import annotations

import hashlib

import pandas as pd

from canonframe.operators.typed import from_pandas


class _Accessor:
    def __init__(self, obj) -> None:
        self._obj = obj

    def to_canonical(self, **options) -> bytes:
        return from_pandas(self._obj, **options)

    def to_canonical_str(self, **options) -> str:
        return self.to_canonical(**options).decode("utf-8")

    def sha256(self, **options) -> str:
        return hashlib.sha256(self.to_canonical(**options)).hexdigest()


pd.api.extensions.register_dataframe_accessor("canonframe")(_Accessor)
pd.api.extensions.register_series_accessor("canonframe")(_Accessor)
