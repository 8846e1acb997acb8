"""Queries whose rows the test tables hardly have, on tables of their own; and every core query on tables without rows."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from corpusmill.plans import catalog, gates


def put(folder, name, **columns):
    pq.write_table(pa.table(columns), f"{folder}/{name}.parquet")


def both(spark, folder, name, key):
    """Rows of a query and of its SQL over the same small tables, ordered."""
    con = duckdb.connect()
    for f in folder.glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}'")
    df = catalog.queries()[name](spark, str(folder))
    cols = sorted(df.columns)
    got = sorted((tuple(r) for r in df.select(*cols).collect()), key=str)
    rel = con.execute(catalog.oracle_sql()[name])
    names = [c[0] for c in rel.description]
    want = sorted((tuple(r[names.index(c)] for c in cols) for r in rel.fetchall()), key=str)
    assert got == want
    return {r[cols.index(key)]: dict(zip(cols, r, strict=True)) for r in got}


def test_self_labels_and_contexts(spark, tmp_path):
    bodies = ["Title\n Genre : satire", "This essay explores rivers. It is in the field of water.", "LCSH (x): rivers", "In law, it is so.", "He won, in law, a case.", None, ""]
    put(tmp_path, "shelf_features", rec_no=list(range(len(bodies))), body=bodies)
    got = both(spark, tmp_path, "gate_self_label", "rec_no")
    assert {k: v["names"] for k, v in got.items()} == {0: "heading", 1: "field_of,this_text_explores", 3: "in_law"}
    texts = ["(Road maps): old", "Genre: Road maps", "road maps - a list", "the road maps of it", None]
    put(tmp_path, "documents", doc_id=list(range(5)), text=texts, lcgft_form=["Road maps"] * 4 + [None])
    assert set(both(spark, tmp_path, "labels_in_labelling_context", "doc_id")) == {0, 1, 2}


def test_gates_on_edge_texts(spark, tmp_path):
    rows = [("t", "the body of it and so on", [3, 9]), (None, "x", None), (" ", None, [0, 0]), ("t", "I cannot help with that. The end of it.", [100, 130]), ("None", "Zażółć gęślą jaźń", [1, 2])]
    put(tmp_path, "shelf_features", rec_no=list(range(5)), title=[r[0] for r in rows], body=[r[1] for r in rows], target_word_range=pa.array([r[2] for r in rows], pa.list_(pa.int32())), topics=pa.array([["Body parts"], None, [], ["Help"], [None]], pa.list_(pa.string())), model=["m", None, "", "m", "n"], spec_id=["a"] * 5)
    got = both(spark, tmp_path, "qc_flat", "rec_no")
    assert [got[i]["failed"] for i in range(5)] == ["", "parse,language", "parse,language,refusal", "length,refusal", "language"] and got[0]["qc_topic_coverage"] == 0.0
    both(spark, tmp_path, "qc_by_source", "generator")
    assert set(both(spark, tmp_path, "gate_parse", "rec_no")) == set(range(5))


def test_sanitized_descriptions(spark, tmp_path):
    put(tmp_path, "documents", doc_id=[1, 2, 3], text=["A book of Road maps, (Essays) and more.", "nothing", None])
    put(tmp_path, "label_space", facet=["lcgft_form", "lcgft_form", "lcc_code"], term=["Road maps", "Essays", "Q"], broader=["x", "y", "Science"])
    got = {r.doc_id: r.text for r in gates.sanitized_descriptions(spark, str(tmp_path)).collect()}
    assert got == {1: "A book of, and more."}


FIXED = {"label_space": [("lcc_code", "Q", "Science"), ("lcc_code", "H", "Social"), ("lcgft_form", "Essays", "Discursive"), ("model", "alpha-1b", "house"), ("register", "formal", "official")], "place_regions": [("Quillby", "Reach")]}


@pytest.fixture(scope="module")
def no_rows(tmp_path_factory):
    """The tables of the queries with their columns and no rows; label space and places are there."""
    s, i, big, d, ts, ss, ii = pa.string(), pa.int32(), pa.int64(), pa.float64(), pa.timestamp("us"), pa.list_(pa.string()), pa.list_(pa.int32())
    shelf = {"rec_no": big, **dict.fromkeys(["id", "split", "text", "title", "body"], s), "word_count": i, **dict.fromkeys(["lcc_code", "lcc_name", "lcc_uri", "lcgft_category", "lcgft_form"], s), "topics": ss, "geographic": ss}
    shelf |= {**dict.fromkeys(["audience", "register", "register_description", "target_length"], s), "target_word_range": ii, "temperature": pa.float32(), "top_p": pa.float32(), **dict.fromkeys(["model", "provider_served", "model_resolved"], s), "reasoning_tokens": i}
    shelf |= {"git_commit": s, "code_version": s, "thinking_budget": i, "token_multiplier": pa.float32(), **dict.fromkeys(["spec_id", "block_id", "prompt_variant_id", "source_type"], s)}
    tables = {
        "shelf_features": shelf, "class_predictions": {"run_name": s, "id": s, "prediction": s, "confidence": d}, "retrieval_runs": {"query_id": s, "ranked_doc_ids": ss, "scores": pa.list_(d)},
        "documents": {"doc_id": big, "text": s, "lang": s, "source": s, "n_chars": big, "lcc_code": s, "lcgft_form": s, "added_at": ts}, "events": {"event_id": big, "ts": ts, "user_id": big, "event_type": s, "value": d, "props": s},
        "cost_ledger": {"request_id": s, "logged_at": s, "received_at": ts, "run_id": s, "model": s, "input_tokens": i, "output_tokens": i, "reasoning_tokens": i, "cost_usd": d, "provider_served": s, "spec_id": s, "doc_ref": s, "status": s, "extra": s},
        "embeddings": {"vec_id": big, "embedding": pa.list_(pa.float32()), "label": i}, "label_space": {"facet": s, "term": s, "broader": s}, "place_regions": {"place": s, "region_name": s},
        "lineitem": {"l_orderkey": big, "l_extendedprice": d, "l_discount": d}, "orders": {"o_orderkey": big, "o_custkey": big}, "customer": {"c_custkey": big, "c_nationkey": big}, "nation": {"n_nationkey": big, "n_name": s},
    }
    folder = tmp_path_factory.mktemp("empty")
    for name, columns in tables.items():
        schema = pa.schema(list(columns.items()))
        rows = [dict(zip(columns, r, strict=True)) for r in FIXED.get(name, [])]
        pq.write_table(pa.Table.from_pylist(rows, schema), f"{folder}/{name}.parquet")
    return str(folder)


#: Too few rows are an error by definition.
REFUSE = {"ranked_form_pool", "filtered_rows"}


def test_every_query_on_tables_without_rows(spark, no_rows):
    for name, q in catalog.queries().items():
        if name in REFUSE:
            with pytest.raises(ValueError):
                q(spark, no_rows).collect()
        else:
            q(spark, no_rows).collect()


def test_topic_overlap_of_few_and_many_topics(spark, tmp_path):
    names = [f"t{i:02d}" for i in range(14)]
    topics = [[names[(i * k + i) % 14] for k in range(i % 12)] for i in range(80)] + [names, None, [None, " T01 ", "t01"]]
    none = [None] * len(topics)
    text = dict.fromkeys(["split", "lcc_code", "lcgft_form", "lcgft_category", "audience", "register", "model", "spec_id", "block_id", "body"], pa.array(none, pa.string()))
    put(tmp_path, "shelf_features", rec_no=list(range(len(topics))), id=[f"d{i}" for i in range(len(topics))], topics=pa.array(topics, pa.list_(pa.string())), **text)
    assert max(both(spark, tmp_path, "topic_overlap_join", "overlap")) > 8
