"""Each operator against a brute-force version, on small tables with nulls, empty and long texts,
repeated rows and extra columns whose names clash with the operators' own."""
import random
import re
import struct
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tabforge.llm import (chat, components, decontaminate, linededup, packing, quality, queries, simhash, tokencount, tokenfile, toxicity,
                          urlfilter, wordcache)

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, n_words long, score double, words string, fp long, h string, line string"
RND = random.Random(3)
VOCAB = [f"w{i}" for i in range(400)] + ["Don't", "naïve", "日本", "x.", "##", "A|B"]


def prose(n, rnd=RND):
    return " ".join(rnd.choice(VOCAB) + ("\n" if rnd.random() < 0.06 else "") for _ in range(n))


LONG = prose(4000)
BASE = prose(120)
NEAR = BASE.replace(BASE.split()[50], "changed", 1)
TEXTS = [(1, None), (2, ""), (3, " \n\t "), (4, BASE), (5, BASE), (6, NEAR), (7, LONG), (8, LONG + " end"), (9, prose(60)), (9, prose(60)), (10, "one"),
         (10, "one"), (None, prose(40)), (11, "a b\n\na b\nc d e f g h i j\nc d e f g h i j"), (12, "x " * 300), (13, "  two  spaces\r\nand\x0btabs\t "),
         (14, "<|endoftext|> special <|STARTOFTEXT|>"), (15, "\u2581 mark \u2581\u2581x")]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", 7, 0.5, "w", 3, "h", "l") for i, t in TEXTS]
    return spark.createDataFrame(rows, SCHEMA).repartition(3, "lang", "text")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df, *cols):
    return sorted(([tuple(r) for r in df.select(*cols).collect()]), key=lambda r: [(x is not None, str(x)) for x in r])


def sort_rows(rows):
    return sorted(rows, key=lambda r: [(x is not None, str(x)) for x in r])


def test_quality_measures(docs, none):
    got = rows_of(quality.judge(docs), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    want = []
    for i, t in TEXTS:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        seen, hit = {}, set()
        for k in range(len(w) - 7):
            seen.setdefault(tuple(w[k:k + 8]), []).append(k)
        for at in seen.values():
            if len(at) > 1:
                hit.update(k + o for k in at for o in range(8))
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        n = len(w)
        want.append((i, n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit), n < 20 or 100 * len(hit) > 30 * n))
    assert got == sort_rows(want)
    assert quality.judge(none).count() == 0


def test_rule_order_changes_no_verdict(docs):
    rules = quality.default_rules()
    ordered, report = quality.order_rules(docs, rules)
    assert {r.name for r in ordered} == {r.name for r in rules} == {x["rule"] for x in report}
    m = quality.measure(docs)
    a, b = (rows_of(m.select("doc_id", "text", quality.first_rejection(x).isNull().alias("k")), "doc_id", "text", "k") for x in (rules, rules[::-1]))
    assert a == b


@pytest.mark.parametrize("block_chars", [16_000_000, 40])
def test_decontamination(spark, docs, none, block_chars):
    items = [(1, " ".join(BASE.split()[5:40])), (2, "One"), (None, "a b C d"), (3, None), (4, ""), (4, "!!"), (5, "x x x x x x x x x x"), (2, "One")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    norm = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    want = []
    for i, t in TEXTS:
        w, hit, found = norm(t), set(), set()
        for item, bt in items:
            b = norm(bt)
            n = min(10, len(b))
            wins = {tuple(b[k:k + n]) for k in range(len(b) - n + 1)} if n else set()
            for k in range(len(w) - n + 1):
                if tuple(w[k:k + n]) in wins:
                    hit.update(range(k, k + n))
                    found.add("" if item is None else str(item))
        want.append((i, len(w), len(hit), ",".join(sorted(found))))
    out = decontaminate.scan(docs, bench, block_chars=block_chars)
    assert rows_of(out.withColumn("i", F.concat_ws(",", "items")), "doc_id", "n_words", "n_hit", "i") == sort_rows(want)
    texts = {t for _, t in TEXTS if t}
    for r in out.filter("n_hit > 0 and doc_id = 4").collect():
        (a, b), = [(x.start, x.end) for x in r.char_spans]
        assert BASE in texts and norm(BASE[a:b]) == norm(" ".join(BASE.split()[5:40]))
    assert decontaminate.scan(none, bench).count() == 0
    assert decontaminate.scan(docs, bench.limit(0)).filter("n_hit > 0").count() == 0
    clean = decontaminate.keep_clean(docs, bench)
    assert clean.columns == docs.columns and clean.count() == sum(r[2] == 0 for r in want)


def test_token_counts_at_every_prefix(docs, none):
    model = public_tokenizers.path("piece_bpe_32k.model")
    lib = tokencount.bpe(model).library
    out = tokencount.token_counts(docs, model).collect()
    assert sorted((r.n_bytes, r.n_tokens) for r in out) == sorted((len((t or "").encode()), len(lib.encode(t or ""))) for _, t in TEXTS)
    solver, rnd = tokencount.bpe(model), random.Random(5)
    odd = [t[:250] for _, t in TEXTS if t] + ["".join(rnd.choice(" ab\u2581eth\nin.é日☃") for _ in range(50)) for _ in range(60)] + [" " * 41 + "word", "ab" * 90]
    for t in odd:
        want = [len(x) for x in lib.encode([t[:i] for i in range(1, len(t) + 1)])]
        blob = tokencount.pack_counts(solver.prefix_counts(t))
        assert tokencount.unpack_counts(blob).tolist() == want
        for budget in (0, 3, 10):
            assert tokencount.cut_at(blob, budget) == max((i for i in range(1, len(want) + 1) if want[i - 1] <= budget), default=0)
    assert tokencount.token_counts(none, model).count() == 0


def test_chat_round_trip(spark):
    hard = ["\\### Assistant: </turn> ok", "<turn>", "</turn>", "<\\turn>", "<\\\\/turn>\n", "", None, "a\\", "<", "</tur", "<turn>assistant\nx</turn>\n", "é日"]
    roles = ["user", "assistant", None, "sys\ntem", "a\\nb", "</turn>", "assistant"]
    rnd = random.Random(1)
    data = [(c, t, rnd.choice(roles), rnd.choice(hard), "x") for c in list(range(30)) + [None] for t in [0, 1, 1, 2, None]]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string, formatted string")
    made = chat.format_conversations(df)
    got = {r.conv_id: r for r in chat.read_back(made).collect()}
    for c in got:
        turns = sorted(((t is not None, t or 0, r or "", x or "") for k, t, r, x, _ in data if k == c))
        assert [(t.role, t.text) for t in got[c].turns] == [(r, x) for *_, r, x in turns]
        assert got[c].loss_text == "".join(x for *_, r, x in turns if r == "assistant")
    for r in made.collect():
        assert sum(x.length for x in r.loss_runs) == len(r.formatted)
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_url_rules(spark):
    urls = [None, "", "nohost", "http://a.net/x", "http://example.net/en/1", "https://Sub.Example.COM/de/2?a=b", "http://x.org/fr/3#t", "http://notnet/", "http://b.net",
            "x://c.net?/en/", "http://spam-win.example.org/en/5", "http://example.net.evil.org/en/", "http://u@example.net/en/"]
    urls += [f"http://casino-{i % 3}.bad.info/go/{i}.html" for i in range(40)] + [f"http://good{i % 3}.info/go/{i}.html" for i in range(40)]
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    labelled = df.filter("url like '%.info%'").select("url", F.col("url").contains("casino").alias("block"))
    rules = urlfilter.mine(labelled, min_support=0.05, min_confidence=0.9)
    assert rules.count() > 0
    got = {r.page_id: r for r in urlfilter.judge(df, rules, queries.SITE_RULES).collect()}
    assert len(got) == len(urls)
    mined = [(set(r.rule)) for r in rules.collect()]
    toks = {r.page_id: set(r.t) for r in df.select("page_id", urlfilter.tokens(F.col("url")).alias("t")).collect()}
    for i, u in enumerate(urls):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        fit = [(len(r.name), r) for r in queries.SITE_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fit, key=lambda x: x[0])[1] if fit else None
        verdict = best.verdict if best else "block" if any(s <= toks[i] for s in mined) else "allow"
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, best.name if best else None, verdict)
        assert not (u or "").startswith("http://good") or verdict == "allow"
    assert urlfilter.mine(labelled.limit(0)).count() == 0


def line_tokens(line):
    w = line.lower().replace("\t", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ")
    w = [x for x in w if x]
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_lines(texts):
    """Text after dedup for rows in the order of their ids (ids distinct)."""
    earlier, out = [], {}
    for i, t in texts:
        keep = []
        for line in (t or "").split("\n"):
            s = line_tokens(line)
            if s and any(5 * len(s & e) >= 4 * len(s | e) for e in earlier):
                earlier.append(s)
                continue
            if s:
                earlier.append(s)
            keep.append(line)
        out[i] = "\n".join(keep)
    return out


def test_line_dedup(spark, none):
    rnd, base = random.Random(9), prose(60).replace("\n", " ")
    texts = []
    for i in range(60):
        lines = []
        for _ in range(rnd.randint(0, 5)):
            w = base.split() if rnd.random() < 0.5 else prose(rnd.randint(1, 30), rnd).split()
            for _ in range(rnd.randint(0, 2)):
                w[rnd.randrange(len(w))] = rnd.choice(VOCAB)
            lines.append(" ".join(w))
        texts.append((i, "\n".join(lines + rnd.choice([[], ["boiler plate line"], ["", " "]]))))
    texts += [(100, None), (101, "")]
    df = spark.createDataFrame([(i, t, "en", 1, 0.1, "w", 2, "h", "l") for i, t in texts], SCHEMA).repartition(4)
    out = linededup.dedup(df)
    want = brute_lines(texts)
    got = {r.doc_id: r.text for r in out.collect()}
    assert {i: t or "" for i, t in got.items()} == want and got[100] is None
    assert out.drop("_ld_lines", "_ld_gone").columns == df.columns
    assert linededup.dedup(none).count() == 0
    long = " ".join(f"v{i}" for i in range(60))
    near = spark.createDataFrame([(None, long), (3, long + " end"), (4, "other\n" + long + " two ends"), (4, "x")], "doc_id long, text string")
    assert sorted((str(r.doc_id), r.text) for r in linededup.dedup(near).collect()) == [("3", ""), ("4", "other"), ("4", "x"), ("None", long)]
    twice = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "a b c d e f")], "doc_id long, text string")
    assert sorted((str(r.doc_id), r.text) for r in linededup.dedup(twice).collect()) == [("1", ""), ("1", ""), ("2", ""), ("None", "a b c d e f")]


def test_packing(docs, none):
    path = public_tokenizers.path("word_bpe_49k.json")
    tok = wordcache.word_cache(path).tok
    limits = packing.Limits(tokens=128, segments=4, loss=100)
    pieces = packing.pack_documents(docs, path, 1, limits, pool=16).collect()
    whole = sorted(tuple(tok.encode(t or "", add_special_tokens=False).ids) + (1,) for _, t in TEXTS)
    by_seq, by_doc = {}, {}
    for p in pieces:
        by_seq.setdefault(p.sequence_id, []).append(p)
        by_doc.setdefault((p.doc_id, p.doc_tokens, p.start), []).append(np.frombuffer(p.ids, "<u4"))
    for s in by_seq.values():
        at = 0
        for p in sorted(s, key=lambda p: p.offset):
            assert p.offset == at and p.length == len(p.ids) // 4
            at += p.length
        assert at <= 128 and len(s) <= 4 and sum(p.loss_tokens for p in s) <= 100
    unique = [(i, t) for i, t in TEXTS if [x for x, _ in TEXTS].count(i) == 1]
    for i, t in unique:
        mine = sorted((k[2], v[0]) for k, v in by_doc.items() if k[0] == i)
        ids = tuple(np.concatenate([v for _, v in mine]).tolist())
        assert ids == tuple(tok.encode(t or "", add_special_tokens=False).ids) + (1,)
    assert sum(p.length for p in pieces) == sum(map(len, whole))
    assert packing.pack_documents(none, path, 1).count() == 0


def test_packing_masks():
    rnd = np.random.default_rng(2)
    ex = [packing.Example(i, 0, np.arange(n, dtype="<u4"), n, rnd.integers(0, 2, n).astype(np.uint8)) for i, n in enumerate(rnd.integers(1, 300, 80).tolist())]
    out = list(packing.pack(iter(ex), packing.Limits(100, 3, 40), pool=8))
    assert all(sum(len(x.ids) for x in s) <= 100 and len(s) <= 3 and sum(x.loss for x in s) <= 40 for s in out)
    for e in ex:
        parts = sorted((x.start, x.ids.tolist()) for s in out for x in s if x.doc == e.doc)
        assert sum((p for _, p in parts), []) == e.ids.tolist()


def brute_fingerprint(text):
    import xxhash
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    parts = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    hs = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


@pytest.mark.parametrize("bucket_rows", [100_000, 3])
def test_simhash_groups(docs, none, bucket_rows):
    out = simhash.dedup_groups(docs, bucket_rows=bucket_rows).collect()
    fps = [(i, brute_fingerprint(t)) for i, t in TEXTS]
    assert sort_rows((r.doc_id, r.fp % (1 << 64)) for r in out) == sort_rows(fps)
    group = list(range(len(fps)))
    for _ in fps:
        for a in range(len(fps)):
            for b in range(len(fps)):
                if bin(fps[a][1] ^ fps[b][1]).count("1") <= 3:
                    group[a] = group[b] = min(group[a], group[b])
    least = {g: min((fps[k][0] for k in range(len(fps)) if group[k] == g and fps[k][0] is not None), default=None) for g in set(group)}
    assert sort_rows((r.doc_id, r.component_id) for r in out) == sort_rows((fps[k][0], least[group[k]]) for k in range(len(fps)))
    assert simhash.dedup_groups(none).count() == 0


def test_gray_index_finds_what_brute_force_finds():
    rng = np.random.default_rng(4)
    centres = rng.integers(0, 1 << 63, 8, dtype=np.uint64)
    v = np.unique(np.array([int(c) ^ sum(1 << int(b) for b in set(rng.integers(0, 64, rng.integers(0, 5)))) for c in centres for _ in range(60)], dtype=np.uint64))
    member, root = simhash.forest(v, np.zeros(len(v), np.int64), 3)
    label = {int(x): int(x) for x in v} | {int(a): int(b) for a, b in zip(member, root)}
    near = np.bitwise_count(v[:, None] ^ v[None, :]) <= 3
    reach = near.copy()
    while True:
        more = (reach.astype(int) @ near.astype(int)) > 0
        if (more == reach).all():
            break
        reach = more
    assert all((label[int(v[a])] == label[int(v[b])]) == reach[a, b] for a in range(0, len(v), 7) for b in range(len(v)))


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (7, 7), (200, 201), (201, 200)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 90: 90, 95: 90, 100: 90, 200: 200, 201: 200}


def toxic_corpus(n=120):
    rnd = random.Random(8)
    bad, out = ["grobnik", "skarvel", "plunterous"], []
    for i in range(n):
        w = [rnd.choice(VOCAB[:400]) for _ in range(60)]
        toxic = i % 3 == 0
        if toxic:
            for _ in range(3):
                w.insert(rnd.randrange(len(w)), rnd.choice(bad))
        out.append((i, " ".join(w), int(toxic)))
    return out


def test_toxicity(spark, docs, none):
    data = toxic_corpus()
    d = spark.createDataFrame([(i, t) for i, t, _ in data], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in data] + [(None, 1), (3, None), (9999, 1)], "doc_id long, toxic int")
    model = toxicity.fit_on(d, labels)
    got = {r.doc_id: r.score for r in toxicity.score(d, model).collect()}
    held = [(got[i], y) for i, _, y in data if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(s >= 0.5) == bool(y) for s, y in held]) >= 0.95
    assert all(0 <= r.score <= 1 for r in toxicity.score(docs, model).collect())
    assert toxicity.score(none, model).count() == 0
    assert {r.score for r in toxicity.score(docs, toxicity.fit_on(d, labels.limit(0))).collect()} == {0.0}


def test_token_files(spark, docs, none):
    path = public_tokenizers.path("word_bpe_49k.json")
    tok = wordcache.word_cache(path).tok
    store = tokenfile.write_tokens(docs, path, 2)
    out = sorted(tokenfile.read_tokens(store).collect(), key=lambda r: r.start)
    ids = [r.doc_id for r in out]
    assert ids == sorted(ids, key=lambda x: (x is not None, x or 0))
    at = 0
    for r in out:
        assert r.start == at and r.n_tokens == len(r.ids) // 4 and r.ids_crc32 == zlib.crc32(r.ids)
        at += r.n_tokens
    want = sorted((str(i), struct.pack(f"<{n}I", *x)) for i, x, n in ((i, x, len(x)) for i, x in (
        (i, tok.encode(t or "", add_special_tokens=False).ids + [2]) for i, t in TEXTS)))
    assert sorted((str(r.doc_id), bytes(r.ids)) for r in out) == want
    found = []
    for f in store.manifest.collect():
        file = tokenfile.TokenFile(f.path)
        found += file.read(7)
        file.close()
    assert [x.tolist() for x in found] == [tok.encode(LONG, add_special_tokens=False).ids + [2]]
    file = store.manifest.orderBy(F.desc("n_ids")).first().path
    raw = bytearray(open(file.removeprefix("file:"), "rb").read())
    raw[20] ^= 255
    with open(file.removeprefix("file:") + ".bad", "wb") as o:
        o.write(raw)
    with pytest.raises(Exception):
        tokenfile.TokenFile(file.removeprefix("file:") + ".bad").ids(0)
    assert tokenfile.read_tokens(tokenfile.write_tokens(none, path, 2)).count() == 0


def test_word_cache_is_exact():
    cache = wordcache.WordCache(public_tokenizers.path("word_bpe_49k.json"), limit_bytes=2000)
    texts = [t or "" for _, t in TEXTS] + ["it's I'M we've", "straße Σ. Ωμέγα, e\u0301. naïve?! word*** don't't ²x _a a_", "\u0130stanbul \x1c \xa0 a"]
    want = [np.array(e.ids, "<u4").tobytes() for e in cache.tok.encode_batch(texts, add_special_tokens=False)]
    assert [cache.encode([t])[0] for t in texts] == want == cache.encode(texts)
    ids, at = cache.encode_all(texts, 7)
    assert [ids[a:b].tobytes() for a, b in zip(at, at[1:])] == [w + np.array([7], "<u4").tobytes() for w in want]
    unspaced = ["語" * 3000 + str(i) for i in range(40)]  # never kept
    assert cache.encode(unspaced) == [np.array(e.ids, "<u4").tobytes() for e in cache.tok.encode_batch(unspaced, add_special_tokens=False)]
    assert cache.bytes < 2000 and not cache.numbers


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got = queries.QUERIES[name](spark, SF)
    rel = con.sql(queries.ORACLES[name])
    assert sorted(got.columns) == sorted(rel.columns)
    order = sorted(got.columns)
    assert sort_rows(tuple(r) for r in got.select(order).collect()) == sort_rows(rel.select(*order).fetchall())


def test_pipeline_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    toxic = corpus_pipeline.STAGES[0][1](spark, docs, SF)
    assert toxic.columns == docs.columns
    lines = corpus_pipeline.STAGES[1][1](spark, docs, SF)
    source = sorted((r.doc_id, r.text) for r in docs.collect())
    want = brute_lines(source)
    words = lambda t: re.search(r"[^\x20\x09-\x0D]", t or "")
    want = {i: want[i] for i, t in source if words(want[i]) or not words(t)}
    assert {r.doc_id: r.text or "" for r in lines.collect()} == want
    near = corpus_pipeline.STAGES[2][1](spark, docs, SF)
    groups = simhash.dedup_groups(docs).filter("doc_id = component_id")
    assert sorted(r.doc_id for r in near.collect()) == sorted(r.doc_id for r in groups.collect())
    clean = corpus_pipeline.STAGES[3][1](spark, docs, SF)
    hit = {r.doc_id for r in queries.op2_decontamination(spark, SF).filter("contaminated").collect()}
    assert {r.doc_id for r in clean.collect()} == {i for i, _ in source} - hit
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and out.count() > 0
    twice = docs.union(docs).withColumn("_x", F.lit(1))
    assert corpus_pipeline.STAGES[2][1](spark, twice, SF).count() == near.count()
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_near_dedup_keeps_one_row_of_each_group(spark):
    rnd = random.Random(21)
    alone = [prose(80, rnd) for _ in range(12)]
    copied, unique, both = prose(80, rnd), prose(80, rnd), prose(80, rnd)
    rows = [(None, t, "a") for t in alone] + [(None, alone[0], "b")]  # texts without an id, one of them twice
    rows += [(3, copied, "a"), (5, copied, "a"), (5, unique, "a")]  # a repeated id: a copy of 3 and a text of its own
    rows += [(7, both, "a"), (7, both, "b"), (None, both, "a"), (8, None, "a"), (9, "", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = rows_of(corpus_pipeline.near_dedup_stage(spark, df, SF), "doc_id", "text", "lang")
    want = [(None, t, "a") for t in alone] + [(3, copied, "a"), (5, unique, "a"), (7, both, "a"), (8, None, "a")]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_url_rules_are_the_same_in_small_and_large_tables(spark):
    bad = [(f"http://bad.info/go/{i}.html", True) for i in range(12)]
    for n in (100, 9000):
        df = spark.createDataFrame(bad + [(f"http://good{i % 40}.org/go/{i}.html", False) for i in range(n)], "url string, block boolean")
        rules = urlfilter.mine(df)
        assert ["host=bad.info"] in [r.rule for r in rules.collect()]
        pages = df.withColumn("page_id", F.monotonically_increasing_id())
        got = urlfilter.judge(pages, rules, []).filter("verdict = 'block'").select("host").collect()
        assert [r.host for r in got] == ["bad.info"] * 12
    often = spark.createDataFrame([(f"http://h{i % 5}.org/{i}", i % 10 < 7) for i in range(300)], "url string, block boolean")
    assert not any(r.rule == ["scheme=http"] for r in urlfilter.mine(often).collect())  # as often as all pages


def test_toxicity_sample_passes_over_texts_that_do_not_fit(spark, monkeypatch):
    data = [(i, t, y) for i, t, y in toxic_corpus() if zlib.crc32(str(i).encode()) % 5]
    d = spark.createDataFrame([(i, t) for i, t, _ in data], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in data], "doc_id long, toxic int")
    first = labels.filter("toxic = 1").orderBy(F.xxhash64(F.col("doc_id").cast("string"))).first().doc_id
    long = d.withColumn("text", F.when(F.col("doc_id") == first, F.repeat("text", 300)).otherwise(F.col("text")))
    taken = []
    monkeypatch.setattr(toxicity, "fit", lambda toxic, ordinary, **_: taken.append((toxic, ordinary)))
    toxicity.fit_on(long, labels, sample_chars=60_000)
    assert sorted(taken[0][0]) == sorted(t for i, t, y in data if y and i != first)
    assert sorted(taken[0][1]) == sorted(t for _, t, y in data if not y)
    toxicity.fit_on(d, labels, sample_chars=50)
    assert [len(x) for side in taken[1] for x in side] == [50, 50]
    toxicity.fit_on(d.union(d), labels)  # repeated rows count each
    assert sorted(taken[2][0]) == sorted(2 * [t for _, t, y in data if y])


def test_toxicity_threshold_comes_from_all_ordinary_windows():
    data = toxic_corpus()
    toxic, ordinary = ([t for _, t, y in data if y == k] for k in (1, 0))
    ordinary = [" ".join(random.Random(i).choice(ordinary) for _ in range(60)) for i in range(110)]  # over 20,000 windows
    model = toxicity.fit(toxic, ordinary, dictionary_windows=2000)
    saved = np.concatenate([model.savings(t) for t in ordinary])
    assert len(saved) > 20_000 and model.threshold == max(1, int(np.quantile(saved, 0.999)) + 1)


def test_line_dedup_keeps_lines_whose_tokens_agree_in_48_bits(spark):
    lines = ["w7912721", "w19374590", "W7912721 "]
    hashes = [r.x for r in spark.createDataFrame([(i, [t]) for i, t in enumerate(lines[:2])], "i int, t array<string>").orderBy("i").select(F.xxhash64("t").alias("x")).collect()]
    assert hashes[0] != hashes[1] and (hashes[0] ^ hashes[1]) % (1 << 48) == 0
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    assert {r.doc_id: r.text for r in linededup.dedup(docs).collect()} == {0: lines[0], 1: lines[1], 2: ""}


def test_line_dedup_does_not_search_texts_by_pattern_or_read_a_line_for_each_word(spark):
    turn = "a b c d e f g "
    texts = [turn * 3, turn * 5, turn * 4 + "h", "\t\x0b\x0c\r \n \nx\r\n\u00a0\n" + turn, "", None, "A  B c d\te f g", "x"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = linededup.dedup(docs)
    got = {r.doc_id: (r._ld_lines, list(r._ld_gone)) for r in out.collect()}
    # lines of other words with the same shingles are as similar as lines of the same words
    assert got == {0: (1, []), 1: (1, [0]), 2: (1, [0]), 3: (3, []), 4: (0, []), 5: (0, []), 6: (1, [0]), 7: (1, [0])}
    assert "regexp" not in out._jdf.queryExecution().analyzed().toString().lower()
    sets = docs.select(F.split("text", " ").alias("words")).select(linededup._tokens(F.col("words")).alias("h"))
    assert "get(words#" not in sets._jdf.queryExecution().analyzed().toString()


def test_few_words_do_not_depend_on_length(spark):
    vocabulary = [f"w{i}" for i in range(45_000)]
    rnd = random.Random(2)
    rich = " ".join(rnd.choice(vocabulary) for _ in range(200_000))  # distinct words are a falling share of all
    poor = " ".join(rnd.choice(vocabulary[:12]) + str(rnd.randint(0, 3)) for _ in range(3000))
    df = spark.createDataFrame([(1, rich), (2, poor), (3, "")], "doc_id long, text string")
    blocks = {r.doc_id: r.n for r in quality.with_words(df).select("doc_id", quality.distinct_in_blocks(F.col("words")).alias("n")).collect()}
    assert blocks[1] == sum(len(set(rich.split()[i:i + 1000])) for i in range(0, 200_000, 1000)) and blocks[3] == 0
    got = {r.doc_id: r.rejected_by for r in quality.judge(df).collect()}
    assert got[1] is None and got[2] == "few_words"


def test_url_mining_is_bounded_and_decides(spark):
    keys = "&".join(f"k{i}=1" for i in range(25))
    rows = [(f"http://a{i}.com/x?{keys}&z{i}=2", True) for i in range(12)] + [(f"http://a{i}.com/x?{keys}", False) for i in range(1)]
    rows += [(f"http://b{i % 40}.org/page/x?id={i}", False) for i in range(400)]
    # neither a folder nor a key decides, both together do
    rows += [(f"http://c{i}.com/go/x?ref={i}", True) for i in range(40)] + [(f"http://d{i}.com/go/x", False) for i in range(60)]
    rows += [(f"http://e{i}.com/buy/x?ref={i}", False) for i in range(60)] + [(None, True), ("nohost", None)]
    df = spark.createDataFrame(rows, "url string, block boolean").repartition(4)
    rules = {tuple(r.rule): r for r in urlfilter.mine(df).collect()}
    assert ("folder=go", "key=ref") in rules and rules["folder=go", "key=ref"].confidence == 1.0
    assert any(len(r) == 1 and r[0].startswith("key=k") for r in rules)
    for rule, r in rules.items():
        have = [b for u, b in rows if u and "://" in u and all(_has(u, t) for t in rule)]
        assert sum(map(bool, have)) >= urlfilter.MIN_COUNT and sum(map(bool, have)) / len(have) == pytest.approx(r.confidence)
    pages = spark.createDataFrame([(1, "http://new.com/go/y?ref=9"), (2, "http://new.com/go/y"), (3, None)], "page_id long, url string")
    got = {r.page_id: r.verdict for r in urlfilter.judge(pages, urlfilter.mine(df), []).collect()}
    assert got == {1: "block", 2: "allow", 3: "allow"}
    assert urlfilter.judge(pages.limit(0), urlfilter.mine(df), []).collect() == []


def _has(url, token):
    kind, value = token.split("=", 1)
    host, _, rest = url.split("://")[1].partition("/")
    path = rest.split("?")[0]
    if kind == "host":
        return host == value or host.endswith("." + value)
    return {"folder": value in path.split("/"), "key": re.search(rf"[?&]{re.escape(value)}=", url) is not None, "scheme": url.startswith(value)}[kind]


def test_keep_clean_over_several_blocks(spark):
    items = [(i, " ".join(f"w{i}x{k}" for k in range(12))) for i in range(30)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [(i, "before " + t + " after", {"a": 1}) for i, t in items[:20]] + [(100 + i, prose(50), {"b": 2}) for i in range(20)] + [(200, None, None), (201, "", {})]
    docs = spark.createDataFrame(rows, "doc_id long, text string, extra map<string,int>").repartition(4)
    for chars in (1 << 20, 700):
        out = decontaminate.keep_clean(docs, bench, block_chars=chars)
        assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == sorted([*range(100, 120), 200, 201])
    assert decontaminate.keep_clean(docs.limit(0), bench).count() == 0 and decontaminate.keep_clean(docs, bench.limit(0)).count() == 42


def test_stages_with_clashing_names_and_maps(spark):
    rows = [(1, "a b c d e f g", "x", 1, {"k": 1}), (1, "a b c d e f g", "y", 2, {"k": 2}), (2, "a b c d e f g\nq r s t u v w", "z", 3, None), (None, "one two three four five six", "n", 4, {})]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _ld_gone string, _cp_score int, name map<string,int>")
    out = corpus_pipeline.line_dedup_stage(spark, docs, SF)
    assert out.columns == docs.columns and sorted((str(r.doc_id), r.text) for r in out.collect()) == [
        ("1", "a b c d e f g"), ("1", "a b c d e f g"), ("2", "q r s t u v w"), ("None", "one two three four five six")]
    assert "_ld_gone_" in linededup.dedup(docs).columns
    near = corpus_pipeline.near_dedup_stage(spark, docs, SF)
    assert near.columns == docs.columns and sorted(str(r.doc_id) for r in near.collect()) == ["1", "2", "None"]
    assert corpus_pipeline.toxicity_stage(spark, docs, SF).columns == docs.columns
