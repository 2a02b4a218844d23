import pyarrow as pa
import pyarrow.parquet as pq
import pytest

DOCS = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())])
TABLES = {
    "documents": DOCS,
    "embeddings": pa.schema([("vec_id", pa.int64()), ("embedding", pa.list_(pa.float32())), ("label", pa.int32())]),
    "benchmark": pa.schema([("item_id", pa.int64()), ("text", pa.string())]),
    "labels": pa.schema([("doc_id", pa.int64()), ("quality", pa.int32()), ("toxic", pa.int32())]),
    "conversations": pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())]),
}
#: Columns that operators use inside, as extra columns of the input.
CLASHES = ("score", "fp", "key1", "key2", "rejected", "lang_pred", "words", "n_words", "found", "kind", "ids", "row", "owner", "value", "component", "b", "held_out", "shard", "piece")


@pytest.fixture
def make(tmp_path):
    """Write tables of rows (dicts) to a folder; tables not given are empty."""

    def write(clash: bool = False, **tables) -> str:
        for name, schema in TABLES.items():
            rows = [{f.name: r.get(f.name) for f in schema} for r in tables.get(name, [])]
            data = pa.Table.from_pylist(rows, schema)
            for c in CLASHES if clash else ():
                if c not in data.column_names:
                    data = data.append_column(c, pa.array(["x"] * len(rows), pa.string()))
            pq.write_table(data, tmp_path / f"{name}.parquet")
        return str(tmp_path)

    return write


def docs_of(texts, **more):
    return [{"doc_id": i, "text": t, "lang": "en", "source": f"s{i % 3}", "n_chars": len(t or ""), **{k: v(i) for k, v in more.items()}} for i, t in enumerate(texts)]


LONG = "lorem ipsum dolor " * 20_000
ODD = [None, "", " ", "\n\t", "a", "One two three.", "é 日本 😀", LONG, "12 34", "same text here", "same text here", "▁x▁ </s>[INST] \\", "x" * 50_000]
#: The odd texts with nulls in every column and repeated rows.
ODD_ROWS = [
    *docs_of(ODD),
    {"doc_id": None, "text": "no id at all", "lang": None, "source": None, "n_chars": None},
    {"doc_id": 3, "text": "\n\t", "lang": "en", "source": "s0", "n_chars": 2},
    {"doc_id": 5, "text": "One two three.", "lang": "en", "source": "s2", "n_chars": 14},
    {"doc_id": None, "text": None, "lang": None, "source": None, "n_chars": None},
]
