"""Queries with a DuckDB statement, on tables with planted copies, nulls-free as SQL sees them."""

import hashlib
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from alertweave.llm.queries import QUERIES
from alertweave.llm.sql import SQL

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_statement(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "benchmark", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    got = QUERIES[name](spark, SF)
    want = con.sql(SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    rows = sorted(tuple(r[c] for c in columns) for r in got.collect())
    place = [want.columns.index(c) for c in columns]
    assert rows == sorted(tuple(r[i] for i in place) for r in want.fetchall())


CONTRACTS = {
    "op1_quality_rules": ("documents", "doc_id:bigint n_words:bigint word_chars:bigint n_symbols:bigint n_dup_lines:bigint n_repeat_words:bigint base_failed:boolean kept:boolean"),
    "op2_toxicity": ("documents", "doc_id:bigint held_out:boolean score:double predicted:int"),
    "op5_sharding": ("documents", "doc_id:bigint size:bigint text_crc32:bigint law:string shard:int slot:bigint grown_shard:int"),
    "op6_html_text": ("pages", "page_id:bigint url:string text:string n_chars:bigint"),
    "op7_packing": (None, "doc_id:bigint start:bigint length:bigint ids_crc32:bigint doc_tokens:bigint sequence_id:bigint offset:bigint"),
    "op10_suffix_dedup": ("documents", "doc_id:bigint n_bytes:bigint n_removed:bigint n_spans:bigint kept_sha256:string"),
    "op12_nearest_graphs": (None, "query_id:bigint rank:int vec_id:bigint score:double"),
}


@pytest.mark.parametrize("name", sorted(CONTRACTS))
def test_registered_query_keeps_its_contract(spark, name):
    """Columns, types, a row for each row of the table, and digests worked out again from the table."""
    source, columns = CONTRACTS[name]
    got = QUERIES[name](spark, SF)
    assert dict(got.dtypes) == dict(c.split(":") for c in columns.split())
    rows = got.collect()
    con = duckdb.connect()
    docs = dict(con.sql(f"SELECT doc_id, coalesce(text, '') FROM '{SF}/documents.parquet'").fetchall())
    if source:
        assert len(rows) == con.sql(f"SELECT count(*) FROM '{SF}/{source}.parquet'").fetchall()[0][0]
    if name == "op5_sharding":
        for r in rows:
            data = docs[r["doc_id"]].encode()
            assert (r["size"], r["text_crc32"], r["grown_shard"]) == (len(data) + 1, zlib.crc32(data), None)
        for shard in range(8):
            slots = sorted(r["slot"] for r in rows if r["shard"] == shard)
            assert slots == list(range(len(slots)))
    if name == "op6_html_text":
        assert all(r["n_chars"] == len(r["text"]) for r in rows)
    if name == "op2_toxicity":
        assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    if name == "op10_suffix_dedup":
        assert all(r["n_bytes"] == len(docs[r["doc_id"]].encode()) for r in rows)
        assert all(r["kept_sha256"] == hashlib.sha256(docs[r["doc_id"]].encode()).hexdigest() for r in rows if not r["n_removed"])
    if name == "op7_packing":
        ids = public_tokenizers.path("byte_bpe_50k.json")
        tokenizer = Tokenizer.from_file(str(ids))
        pieces = {}
        for r in rows:
            pieces.setdefault(r["doc_id"], []).append(r)
        assert set(pieces) == set(docs)
        for doc_id, own in pieces.items():
            want = [*tokenizer.encode(docs[doc_id], add_special_tokens=False).ids, 0]
            at = 0
            for r in sorted(own, key=lambda r: r["start"]):
                part = want[r["start"] : r["start"] + r["length"]]
                assert r["start"] == at and r["doc_tokens"] == len(want) and r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
                at += r["length"]
            assert at == len(want)
    if name == "op12_nearest_graphs":
        table = con.sql(f"SELECT vec_id, embedding FROM '{SF}/embeddings.parquet'").fetchall()
        ids, points = np.array([i for i, _ in table]), np.array([v for _, v in table], float)
        hit = 0
        for at in np.flatnonzero(ids % 20 == 0):
            score = points @ points[at]
            best = [int(ids[i]) for i in np.lexsort((ids, -score)) if i != at][:20]
            own = sorted((r["rank"], r["vec_id"], r["score"]) for r in rows if r["query_id"] == ids[at])
            assert [k for k, _, _ in own] == list(range(1, 21))
            hit += len(set(best) & {v for _, v, _ in own})
        assert hit >= 0.9 * 20 * (ids % 20 == 0).sum()
