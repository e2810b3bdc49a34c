"""Every registered query of the subpackage on the smallest tables, against its SQL where it has one."""

import duckdb
import pytest

from docketlake.llm import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, name):
    df = registry.QUERIES[name](spark, SF)
    names, got = sorted(df.columns), df.collect()  # rows, as pandas has no long that may be null
    assert len(got) > 0
    if name in registry.ORACLES:
        con = duckdb.connect()
        for t in ("documents", "embeddings", "labels", "pages", "benchmark"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        want = con.sql(f"SELECT {', '.join(names)} FROM ({registry.ORACLES[name]})").fetchall()
        assert sorted(repr(tuple(r[c] for c in names)) for r in got) == sorted(map(repr, want))


def test_contracts(spark):
    kinds = lambda name: {f.name: f.dataType.simpleString() for f in registry.QUERIES[name](spark, SF).schema}
    assert {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"}.items() <= kinds("op2_mix").items()
    assert {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"}.items() <= kinds("op3_bpe_roundtrip").items()
    assert {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"}.items() <= kinds("op6_nearest").items()
    assert kinds("op11_near_vectors") == {"vec_id": "bigint", "n_links": "bigint", "component_id": "bigint", "kept": "boolean"}
    assert kinds("op12_impact_search") == {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"}
    assert kinds("op13_spelling") == {"word": "string", "form": "string", "root": "string", "n": "bigint", "n_near": "bigint", "form_n": "bigint"}
    assert {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}.items() <= kinds("op8_quality").items()
