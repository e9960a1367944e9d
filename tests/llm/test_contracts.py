"""The registered queries without SQL, run as they are registered on the smallest given tables, against the
tokenizer libraries and brute force."""
import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest

from tabforge.llm import queries, simhash

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts():
    t = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    return dict(zip(t["doc_id"], t["text"]))


@pytest.fixture(scope="module")
def word_ids(texts):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return {i: tok.encode(t or "", add_special_tokens=False).ids for i, t in texts.items()}


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_op3_token_counts(spark, texts):
    import sentencepiece
    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in queries.op3_token_counts(spark, SF).collect()}
    want = {i: (len((t or "").encode()), len(lib.encode(t or "")), len(lib.encode(t or "")) > 4096) for i, t in texts.items()}
    assert got == want


def test_op5_url_filters(spark):
    pages = pq.read_table(f"{SF}/pages.parquet", columns=["page_id", "url"]).to_pydict()
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in queries.op5_url_filters(spark, SF).collect()}
    assert set(got) == set(pages["page_id"])
    for i, url in zip(pages["page_id"], pages["url"]):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
        host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
        fits = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
        best = max(fits, key=lambda r: len(r[0] + r[1]), default=None)
        assert got[i][:3] == (host, path, best[0] + best[1] if best else None)
        assert got[i][3] == best[2] if best else got[i][3] in ("allow", "block")


def test_op7_packing(spark, word_ids):
    rows = queries.op7_packing(spark, SF).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(word_ids)
    for i, pieces in by_doc.items():
        ids, at = word_ids[i] + [1], 0
        for p in sorted(pieces, key=lambda p: p.start):
            assert p.start == at and p.ids_crc32 == crc(ids[at:at + p.length]) and p.doc_tokens == len(ids)
            at += p.length
        assert at == len(ids)
    room = tokens = 0
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 2048
        tokens, room = tokens + at, room + (at if at & (at - 1) == 0 else 2048)
    assert tokens / room > 0.95


def test_op8_simhash_near_dedup(spark, texts):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op8_simhash_near_dedup(spark, SF).collect()}
    ids = sorted(texts)
    prints = [simhash.fingerprint(texts[i]) for i in ids]
    root = list(range(len(ids)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(ids)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                ra, rb = find(a), find(b)
                root[max(ra, rb)] = min(ra, rb)
    assert got == {i: (f"{p:016x}", ids[find(k)]) for k, (i, p) in enumerate(zip(ids, prints))}


def test_op9_toxicity(spark, texts):
    rows = queries.op9_toxicity(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    labels = pq.read_table(f"{SF}/labels.parquet").to_pydict()
    toxic = dict(zip(labels["doc_id"], labels["toxic"]))
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    known = [(r.predicted, toxic[r.doc_id]) for r in rows if toxic.get(r.doc_id) in (0, 1)]
    assert np.mean([p == y for p, y in known]) >= 0.9


def test_op10_token_files(spark, word_ids):
    rows = sorted(queries.op10_token_files(spark, SF).collect(), key=lambda r: r.doc_id)
    at = 0
    for r, i in zip(rows, sorted(word_ids), strict=True):
        ids = word_ids[i] + [2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, at, len(ids), crc(ids))
        at += len(ids)


def test_op12_suffix_dedup_digest(spark, texts):
    got = {r.doc_id: r for r in queries.op12_suffix_dedup(spark, SF).collect()}
    seen = set()
    for i in sorted(texts):
        t = (texts[i] or "").encode()
        gone = np.zeros(len(t) + 1, bool)
        for s in range(len(t) - 99):
            if t[s:s + 100] in seen:
                gone[s:s + 100] = True
            seen.add(t[s:s + 100])
        kept = bytes(np.frombuffer(t, np.uint8)[~gone[:-1]])
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == (len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
