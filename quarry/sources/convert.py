"""One-off conversion of array files and pickled dictionaries to tables, on the driver, before any job runs.

Arrays are mapped, not loaded, and written piece by piece. Pickles are read without any code of theirs: only plain
containers, numbers and strings are let through.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

PIECE = 1_000_000


def array(path: str) -> np.ndarray:
    """An array of a .npy file, or of a .pt file where that library is installed."""
    if path.endswith(".npy"):
        return np.load(path, mmap_mode="r", allow_pickle=False)
    try:
        import torch
    except ImportError as e:
        raise ValueError(f"{path}: only .npy files can be read here") from e
    return torch.load(path, weights_only=True, map_location="cpu").numpy()


class _Plain(pickle.Unpickler):
    def find_class(self, module: str, name: str):
        raise pickle.UnpicklingError(f"{module}.{name} isn't plain data")


def dictionary(spark: SparkSession, path: str, schema: str = "key long, value string") -> DataFrame:
    """A pickled dictionary, or a list by position, as key and value."""
    with open(path, "rb") as file:
        found = _Plain(file).load()
    pairs = found.items() if isinstance(found, dict) else enumerate(found)
    return spark.createDataFrame([(k, None if v is None else str(v)) for k, v in pairs], schema)


def graph(spark: SparkSession, edge_index: np.ndarray, edge_types: np.ndarray, node_types: np.ndarray, folder: str) -> tuple[DataFrame, DataFrame]:
    """edges (edge_id, src, dst, type_id) and nodes (node_id, type_id), written to the folder; ids are places in the arrays."""
    if edge_index.shape[0] != 2 or edge_index.shape[1] != len(edge_types):
        raise ValueError("edge_index must be of two rows, with a column for each edge type")
    tables = {"edges": (len(edge_types), lambda a, b: {"edge_id": np.arange(a, b), "src": edge_index[0, a:b], "dst": edge_index[1, a:b], "type_id": edge_types[a:b]}), "nodes": (len(node_types), lambda a, b: {"node_id": np.arange(a, b), "type_id": node_types[a:b]})}
    out = []
    for name, (size, piece) in tables.items():
        for a in range(0, max(size, 1), PIECE):
            part = pd.DataFrame({k: np.asarray(v, np.int64) for k, v in piece(a, min(a + PIECE, size)).items()})
            columns = ", ".join(f"{c} long" for c in part.columns)
            spark.createDataFrame(part, columns).write.mode("append" if a else "overwrite").parquet(f"{folder}/{name}")
        out.append(spark.read.parquet(f"{folder}/{name}"))
    return out[0], out[1]
