"""Token store, packing and token counts against the tokenizers library itself."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from condensa.llm import bpe_count, packing, queries, token_store
from condensa.llm.token_cache import CachedEncoder

ODD = [None, "", " ", "\n", "  a  b ", "\n\nx\n y z\n", "a <|endoftext|> b<|startoftext|>  ", "tab\there\x85nb\xa0sp", "Ünï ΑΣ Σ é ́x", "don't WE'LL 123abc...  ", "x" * 300, "a\r\nb\r\n\r\n c", " lead", "trail ", "中文 字 🙂", "word " * 5000]


def library(name):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    return lambda s: t.encode(s or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def odd_docs(spark):
    rows = [(i, t, "x") for i, t in enumerate(ODD)] + [(None, "no id", "x"), (3, "\n", "x"), (3, "\n", "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string")


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_cached_encoder(name):
    ids, n = CachedEncoder(public_tokenizers.path(name), most=200).encode(pa.array(ODD))
    ends = np.cumsum(n)
    for text, a, b in zip(ODD, ends - n, ends, strict=True):
        assert ids[a:b].tolist() == library(name)(text), text


def test_counts(spark, sf):
    lib = library("byte_bpe_50k.json")
    docs = odd_docs(spark)
    got = bpe_count.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json")).collect()
    texts = dict(enumerate(ODD)) | {None: "no id"}
    assert len(got) == docs.count()
    assert all((r.n_tokens, r.n_bytes) == (len(lib(texts[r.doc_id])), len((texts[r.doc_id] or "").encode())) for r in got)
    texts = {r.doc_id: r.text for r in queries.table(spark, sf, "documents").collect()}
    for r in queries.op5_token_counts(spark, sf).collect():
        n = len(lib(texts[r.doc_id]))
        assert (r.n_tokens, r.over_limit) == (n, n > 1024)


def test_elias_fano():
    for values in ([], [5], [0, 0, 3, 3, 900, 901], list(np.cumsum(np.random.default_rng(1).integers(0, 900, 777)))):
        ef = token_store.EliasFano.of(np.array(values, np.int64))
        assert ef.all().tolist() == list(values)
        assert [ef.select(i) for i in range(len(values))] == list(values)
        if len(values) > 700:
            assert len(ef.low) + len(ef.high) < len(values) * (2 + np.log2(values[-1] / len(values)) + 1) / 8 + 16


def check_store(got, rows):
    """rows: (doc_id, text) in ascending doc_id order."""
    lib, start = library("byte_bpe_50k.json"), 0
    got = sorted(got, key=lambda r: r.start)
    assert len(got) == len(rows)
    for r, (d, text) in zip(got, rows, strict=True):
        ids = [*lib(text), 2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (d, start, len(ids), crc(ids))
        start += len(ids)


def test_store(spark, sf, tmp_path):
    docs = queries.table(spark, sf, "documents")
    check_store(queries.op1_token_store(spark, sf).collect(), sorted((r.doc_id, r.text) for r in docs.collect()))
    path = token_store.write_token_store(odd_docs(spark), public_tokenizers.path("byte_bpe_50k.json"), segment_ids=32)
    got = token_store.read_token_store(spark, path).selectExpr("*", "crc32(ids) ids_crc32").collect()
    assert spark.read.parquet(path).count() > 1
    rows = [(None, "no id")] + sorted(((i, t) for i, t in enumerate(ODD)), key=lambda x: x[0])
    check_store(got, rows[:5] + [(3, "\n"), (3, "\n")] + rows[5:])
    some = token_store.fetch_documents(spark, path, [3, 12, 99, 3]).collect()
    lib = library("byte_bpe_50k.json")
    assert sorted((r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in some) == sorted((d, [*lib(t), 2]) for d, t in rows[:5] + [(3, "\n"), (3, "\n")] + rows[5:] if d in (3, 12))
    empty = token_store.write_token_store(odd_docs(spark).limit(0), public_tokenizers.path("byte_bpe_50k.json"))
    assert token_store.read_token_store(spark, empty).count() == 0


def check_packed(got, texts, capacity=4096):
    lib = library("word_bpe_49k.json")
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for d, text in texts.items():
        ids, at = [*lib(text), 2], 0
        for r in sorted(by_doc[d], key=lambda r: r.start):
            assert (r.start, r.ids_crc32, r.doc_tokens) == (at, crc(ids[at : at + r.length]), len(ids))
            at += r.length
        assert at == len(ids)
    for rows in by_seq.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return len(by_seq)


def test_packing(spark, sf):
    texts = {r.doc_id: r.text for r in queries.table(spark, sf, "documents").collect()}
    got = queries.op2_packing(spark, sf).collect()
    n = check_packed(got, texts)
    assert n * 4096 < 1.05 * sum(r.length for r in got) + 4096
    tok = public_tokenizers.path("word_bpe_49k.json")
    got = packing.pack(odd_docs(spark), tok, group_bytes=1000).selectExpr("*", "crc32(ids) ids_crc32").collect()
    assert sum(r.length for r in got if r.doc_id == 3) == 3
    assert packing.pack(odd_docs(spark).limit(0), tok).count() == 0


def test_first_fit_decreasing():
    rng = np.random.default_rng(0)
    for n in (1, 2, 7, 300):
        lens = rng.integers(1, 100, n)
        seq, off = packing.first_fit_decreasing(lens, 100)
        room: list[int] = []
        for i in np.argsort(-lens, kind="stable"):
            k = next((k for k, r in enumerate(room) if r >= lens[i]), len(room))
            if k == len(room):
                room.append(100)
            assert (seq[i], off[i]) == (k, 100 - room[k])
            room[k] -= lens[i]
