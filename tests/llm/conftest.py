from __future__ import annotations

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from planted import awkward_rows

SCHEMAS = {
    "documents": pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())]),
    "benchmark": pa.schema([("item_id", pa.int64()), ("text", pa.string())]),
    "labels": pa.schema([("doc_id", pa.int64()), ("quality", pa.int32()), ("toxic", pa.int32())]),
    "embeddings": pa.schema([("vec_id", pa.int64()), ("embedding", pa.list_(pa.float32())), ("label", pa.int32())]),
    "conversations": pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())]),
}


@pytest.fixture
def tables(tmp_path):
    """Write small tables: tables(documents=[(id, text), ...], ...) -> folder. Missing tables are empty."""
    def write(extra: dict | None = None, **rows):
        for name, schema in SCHEMAS.items():
            data = [tuple(r) + (None,) * (len(schema) - len(r)) for r in rows.get(name, [])]
            table = pa.table([pa.array([r[i] for r in data], f.type) for i, f in enumerate(schema)], schema=schema)
            for column, value in (extra or {}).items():
                if column not in table.column_names:
                    table = table.append_column(column, pa.array([value] * len(data), pa.string()))
            pq.write_table(table, tmp_path / f"{name}.parquet")
        return str(tmp_path)
    return write


@pytest.fixture
def awkward():
    return awkward_rows()
