"""JData N-dimensional arrays to nested arrays."""

from __future__ import annotations

import math

from canonframe.kernel.numbers import canonical
from canonframe.kernel.values import JsonError, Num


def _dimension(v) -> int:
    plain = canonical(v) if type(v) is Num else "."
    if not plain.isdigit():
        raise JsonError("JData: _ArraySize_ must be a number or array of numbers")
    return int(plain)


def expand(v):
    if type(v) is list:
        return [expand(x) for x in v]
    if type(v) is not dict:
        return v
    if "_ArrayZipData_" in v:
        raise JsonError("JData: compressed arrays (_ArrayZipData_) are not supported")
    if not {"_ArrayType_", "_ArraySize_", "_ArrayData_"} <= v.keys():
        return {k: expand(x) for k, x in v.items()}
    size, data = v["_ArraySize_"], v["_ArrayData_"]
    dims = [_dimension(x) for x in (size if type(size) is list else [size])]
    if type(data) is not list:
        raise JsonError("JData: _ArrayData_ must be an array")
    if not dims or math.prod(dims) != len(data):
        raise JsonError("JData: _ArrayData_ length does not match _ArraySize_")
    out = [expand(x) for x in data]
    for d in reversed(dims[1:]):  # innermost dimension first
        out = [out[i : i + d] for i in range(0, len(out), d)] if d else [[]] * dims[0]
    return out
