"""The ten operators and the pipeline against brute force, on small rows."""

import base64
import collections
import gzip
import hashlib
import math
import pickle
import re
import time
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from verdictlake.llm import common, jaccard, lm, mixing, packing, quality, queries, sharding, textvec, token_files, topk, toxicity, warc

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, extra string"


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows,
    an extra column."""
    long = " ".join(f"w{k % 977}x{k % 31}" for k in range(30_000)) + "."
    base = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty twentyone twentytwo twentythree twentyfour"
    rows = [(1, base, "en", "a", 1, "x"), (2, base, "en", "b", 1, None), (3, base.upper(), None, "a", 1, "x"), (4, base + " last", "fr", None, None, "x"), (5, None, "en", "a", None, "x"), (6, "", "en", "a", 0, "x"), (7, " \n\t ", "de", "a", 3, "x"), (8, long, "en", "a", 9, "x"), (9, "short text", "en", "c", 2, "x"), (9, "short text", "en", "c", 2, "x"), (None, "no id here at all", "en", "c", 2, "x"), (10, "Ünïcödé wörds <|endoftext|> \x1c ümläut wide. it's I'm\r\n  two  spaces", "de", "c", 2, "x")]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(k, k % 2, 0) for k in range(1, 10)] + [(None, 1, 1)], "doc_id long, quality int, toxic int")


def words(text):
    return (text or "").encode().lower().split()


def test_words_and_windows():
    texts = [b"", b" The cat ", b"the  CAT sat\non the mat", b"\n", "é è é".encode()]
    w = textvec.words_of(pa.array([b"skip", *texts], pa.binary()).slice(1))
    flat = [x for t in texts for x in t.lower().split()]
    same = {(a, b): flat[a] == flat[b] for a in range(len(flat)) for b in range(len(flat))}
    assert all((w.hash[a] == w.hash[b]) == v for (a, b), v in same.items())
    assert np.diff(w.first).tolist() == [len(t.split()) for t in texts]
    h, doc = textvec.windows(w, 3, short=True)
    assert doc.tolist() == [1, 2, 2, 2, 2, 4]


@pytest.mark.parametrize("name,keep", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_coder_is_the_tokenizer(docs, name, keep):
    c = common.WordCoder(common.vocabulary(name), keep, most=300)  # a cache that overflows
    texts = [r.text or "" for r in docs.collect()] + ["a  ", "\n\nb", "don't. 'x 9th, a_b É́. İx ΑΣ Σ ẞ", "a\xa0 ?\x85b"]
    parts = [*" \t\n\r\x0b\x0c" * 3, *"ab'ABstdHé.,!1_-ΣΑς=", "\x1c", "\x85", "\xa0", "\u2003", "\u3000", "\u200b", "\u0301", "\u0331", "\u0338", "İ", "ẞ", "中", "😀", "'ll", "don't", " the", "\ufeff", "\x00", "ǅ", "Ⅷ", "²"]
    rng = np.random.default_rng(8)
    for most in (len(parts), 30):
        texts += ["".join(parts[k] for k in rng.integers(0, most, rng.integers(0, 25))) for _ in range(4000)]
    plain = Tokenizer.from_file(common.vocabulary(name))
    plain.encode_special_tokens = True
    want = [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]
    for _ in range(2):
        assert [x.tolist() for x in c.encode(pa.array([t.encode() for t in ["cut off", *texts]], pa.binary()).slice(1))] == want
    assert c.encode(pa.array([b"\xff a"], pa.binary()))[0].tolist() == plain.encode("\ufffd a", add_special_tokens=False).ids
    assert c.encode(pa.array([], pa.binary())) == []


def ids_of(name, text, end):
    """By the tokenizers library alone, in one piece."""
    if name not in _PLAIN:
        _PLAIN[name] = Tokenizer.from_file(common.vocabulary(name))
        _PLAIN[name].encode_special_tokens = True
    return np.array([*_PLAIN[name].encode(text or "", add_special_tokens=False).ids, end], dtype="<u4")


_PLAIN = {}


def test_packing_loses_nothing(spark, docs, empty):
    rows = packing.pack(docs, capacity=64, open_windows=3, fan_in=2).toPandas()
    want = collections.Counter()
    for r in docs.collect():
        ids = ids_of("word_bpe_49k.json", r.text, 1)
        want[(r.doc_id, len(ids))] += len(ids)
    got = collections.Counter()
    for r in rows.itertuples():
        got[(None if math.isnan(r.doc_id) else int(r.doc_id), r.doc_tokens)] += r.length
    assert got == want
    size = rows.groupby("sequence_id").length.sum()
    assert all(n == 64 or n & (n - 1) == 0 for n in size) and (size != 64).sum() <= 6
    rows = rows.sort_values(["sequence_id", "offset"])
    assert (rows.groupby("sequence_id").length.cumsum() - rows.length == rows.offset).all()
    assert packing.pack(empty).count() == 0


def test_packing_pieces_are_the_ids(spark):
    d = common.table(spark, DATA, "documents")
    texts = {r.doc_id: r.text or "" for r in d.collect()}
    ids = {k: ids_of("word_bpe_49k.json", t, 1) for k, t in texts.items()}
    for r in packing.pack(d).collect():
        assert zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32


def test_token_files(spark, docs, empty):
    folder = common.work_path(spark, "t")
    index = token_files.write_tokens(docs, folder, length=32)
    rows = token_files.read_tokens(spark, folder, index).orderBy("start").collect()
    at = 0
    for got, want in zip(rows, docs.orderBy(F.col("doc_id").asc_nulls_first(), "text").collect(), strict=True):
        ids = ids_of("byte_bpe_50k.json", want.text, 0)
        assert (got.doc_id, got.start, got.n_tokens, got.ids_crc32) == (want.doc_id, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    for f in index.collect():
        t = token_files.TokenFile(f"{folder}/{f.file}.arrow")
        ids, mask = t.sequence(0)
        assert len(ids) == 32 and len(mask) == 32 and t.n_real() == f.n_ids
        assert not ids.flags.owndata
    assert token_files.read_tokens(spark, folder + "e", token_files.write_tokens(empty, folder + "e")).count() == 0


def same_as_sql(spark, df, sql, d=DATA):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{d}/{t}.parquet')")
    want, got = con.execute(sql).df(), df.toPandas()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    key = lambda p: sorted(map(repr, p[columns].astype(object).where(p[columns].notna(), None).values.tolist()))
    assert key(got) == key(want)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, name):
    same_as_sql(spark, queries.QUERIES[name](spark, DATA), queries.ORACLE_SQL[name])


@pytest.mark.parametrize("share,epochs", [((1, 7), 1), ((3, 2), 4), ((1, 1), 1)])
def test_mix_budgets(spark, share, epochs):
    m = mixing.Mix(share=share, max_epochs=epochs)
    same_as_sql(spark, mixing.mix_documents(common.table(spark, DATA, "documents"), m), mixing.oracle(m))


def test_mix_fills_siblings_first(spark):
    rows = [(k, "w " * 10, "en", s, 1) for k, s in enumerate(["src0"] * 40 + ["a"] * 2 + ["b"] * 20 + ["c"] * 20)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    m = mixing.Mix(weights={"domain": {"crawl": 1, "curated": 1}}, share=(1, 2), max_epochs=1)
    got = {r.origin: r.t for r in mixing.mix_documents(d, m).groupBy("origin").agg(F.sum("take_tokens").alias("t")).collect()}
    assert got == {"src0": 205, "a": 20, "b": 92, "c": 93}


def test_mix_meets_budgets_with_repeated_and_null_ids(spark):
    """Each leaf takes its budget to the token, whatever rows share an id."""
    rows = [(None, "w " * 11, "en", "a", 1)] * 40 + [(7, "x y z", "en", "b", 1)] * 30 + [(7, "x y", "en", "b", 1)] * 5 + [(k, "q " * k, "de", None, 1) for k in range(9)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    for share, epochs in (((1, 2), 1), ((3, 2), 2), ((1, 3), 3)):
        m = mixing.Mix(share=share, max_epochs=epochs)
        got = mixing.mix_documents(d, m)
        budget = {tuple(r)[:3]: r.budget for r in mixing.plan(mixing.sizes_of(d, m), m).collect()}
        took = {tuple(r)[:3]: r.t for r in got.groupBy("domain", "language", "origin").agg(F.sum("take_tokens").alias("t")).collect()}
        assert took == {k: v for k, v in budget.items() if v}
        assert sum(took.values()) == sum(len((r[1] or "").split()) for r in rows) * share[0] // share[1]
        assert got.where("take_tokens < tokens").groupBy("domain", "language", "origin").count().where("count > 1").count() == 0


def test_mix_cuts_texts(spark):
    d = spark.createDataFrame([(k, f" a{k}  b{k}\nc{k} d", "en", "s", 1) for k in range(10)], "doc_id long, text string, lang string, source string, n_chars long")
    m = mixing.Mix(share=(11, 40), max_epochs=1)
    kept = {r.doc_id: r.text for r in mixing.keep_mixed(d, m).collect()}
    takes = {r.doc_id: r.take_tokens for r in mixing.mix_documents(d, m).collect()}
    assert sum(takes.values()) == 11 and sorted(takes.values()) == [3, 4, 4]
    assert {k: len(t.split()) for k, t in kept.items()} == takes
    assert all(f" a{k}  b{k}\nc{k} d".startswith(t) for k, t in kept.items())


#: Every name that an operator gives to a column of its own.
INTERNAL = ["rest", "whole_epochs", "mix_tokens", "mix_domain", "epoch", "take_tokens", "domain", "language", "origin", "key", "tokens", "digest", "keep_id", "keep_digest", "__digest", "own", "keep", "mix", "plan", "number", "part", "class_key", "bands", "grams", "bucket", "blocks", "block", "__text", "held_out", "toxic", "quality", "score", "kept", "n_words", "text_bytes", "ids", "open", "word", "row", "c", "count", "Rest", "MIX_0"]


def test_other_columns_keep_their_values(spark, docs, labels):
    """Columns named as those that the operators use themselves."""
    names = list({n.lower(): n for n in INTERNAL}.values())
    odd = docs.select("*", *[F.lit(k).alias(n) for k, n in enumerate(names)])
    stages = [("keep_good", lambda d: quality.keep_good(d, labels)), ("keep_clean", lambda d: toxicity.keep_clean(d, labels)), ("keep_one", jaccard.keep_one), ("keep_mixed", lambda d: mixing.keep_mixed(d, mixing.Mix(share=(3, 4), max_epochs=1)))]
    for name, stage in stages:
        out, plain = stage(odd).collect(), stage(docs).collect()
        assert out and sorted(map(repr, ([r[c] for c in docs.columns] for r in out))) == sorted(map(repr, ([r[c] for c in docs.columns] for r in plain))), name
        assert all(tuple(r)[len(docs.columns) :] == tuple(range(len(names))) for r in out), name
    for run in (lambda d: quality.quality(d, labels), lambda d: toxicity.toxicity(d, labels), mixing.mix_documents, jaccard.near_duplicates, lm.score, packing.pack):
        assert run(odd).count() == run(docs).count()


def test_shared_folder_of_the_session(spark, tmp_path, monkeypatch):
    """A checkpoint folder that the caller has set is used and stays."""
    before = spark.sparkContext.getCheckpointDir()
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    try:
        there = spark.sparkContext.getCheckpointDir()
        if not spark.sparkContext.getConf().get("spark.checkpoint.dir"):
            assert common.shared_folder(spark) == there
        assert spark.sparkContext.getCheckpointDir() == there
    finally:
        if before:
            spark.sparkContext.setCheckpointDir(before)


def test_mix_odd_rows(docs, empty):
    got = mixing.mix_documents(docs).toPandas()
    assert not got.doc_id.isin([5, 6, 7]).any() and got.take_tokens.sum() >= 1
    assert mixing.mix_documents(empty).count() == 0


def brute_links(texts, n=5, t=Fraction(4, 5)):
    sets = []
    for x in texts:
        w = words(x)
        sets.append(frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))) if w else frozenset())
    links = [[b for b in range(len(sets)) if a != b and (sets[a] == sets[b] or len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b]))] for a in range(len(sets))]
    root = list(range(len(sets)))
    for _ in sets:
        root = [min([root[a], *(root[b] for b in links[a])]) for a in range(len(sets))]
    return links, root


@pytest.mark.parametrize("block", [768, 2])
def test_jaccard(spark, block):
    rng = np.random.default_rng(5)
    base = [[f"v{k}" for k in rng.integers(0, 500, 120)] for _ in range(12)]
    texts = []
    for b in base:
        for _ in range(6):
            w = list(b)
            for k in rng.integers(0, 120, rng.integers(0, 4)):
                w[k] = f"z{rng.integers(0, 10**6)}"
            texts.append(" ".join(w))
    texts += ["a b", "a b", "A  B", "", " ", "a c"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in jaccard.near_duplicates(d, jaccard.Settings(block_sets=block)).collect()}
    links, root = brute_links(texts)
    assert all(got[k].n_links == len(links[k]) and got[k].class_id == root[k] for k in range(len(texts)))
    assert sorted(r.doc_id for r in jaccard.keep_one(d).collect()) == sorted(set(root))


def test_jaccard_odd_rows(docs, empty):
    got = jaccard.near_duplicates(docs).toPandas()
    of = {int(r.doc_id): r for r in got.dropna(subset=["doc_id"]).itertuples()}
    assert of[1].class_id == of[2].class_id == of[3].class_id == of[4].class_id == 1
    assert of[5].class_id == of[6].class_id == of[7].class_id == 5
    assert of[8].n_links == 0 and of[9].n_links == 1 and len(got) == 12
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == 6
    assert jaccard.near_duplicates(empty).count() == 0 and jaccard.keep_one(empty).count() == 0


def test_components_are_whole_or_an_error(spark):
    """A long chain is one component, and none is given in parts."""
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)], "a long, b long")
    assert {r.node: r.root for r in jaccard.connected(edges).collect()} == {k: 0 for k in range(1, 41)}
    with pytest.raises(RuntimeError, match="not settled"):
        jaccard.connected(edges, most_rounds=2)


@pytest.mark.parametrize("recall", [0.9, 0.99, 0.9999])
def test_bands_reach_the_recall(recall):
    n, rows = jaccard.Settings(recall=recall).bands()
    assert 1 - (1 - 0.8**rows) ** n >= recall and n * rows <= 128


PAGES = "page_id long, url string, html string"


def test_warc(spark):
    rows = [(1, "http://x/a b\n", "<p>é</p>"), (2, "u", "<p>é</p>"), (3, None, None), (4, "v", ""), (5, "w", "x" * 300_000), (None, "n", "only"), (6, "WARC/1.1\r\n\r\n", "WARC/1.1\r\nWARC-Type: response\r\n\r\n")]
    path = common.work_path(spark, "warc")
    got = {r.page_id: r for r in warc.archive(spark.createDataFrame(rows, PAGES).repartition(3), path).collect()}
    for page_id, _, html in rows:
        data = (html or "").encode()
        assert (got[page_id].payload_bytes, got[page_id].payload_digest) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
    assert {k: (r.record_type, r.refers_to) for k, r in got.items()} == {1: ("revisit", 2), 2: ("response", None), 3: ("revisit", 4), 4: ("response", None), 5: ("response", None), None: ("response", None), 6: ("response", None)}
    back = warc.read_warc(spark, path).where("type = 'response' and target_uri in ('w', 'v')").collect()
    assert sorted((r.target_uri, len(r.payload)) for r in back) == [("v", 0), ("w", 300_000)]
    assert warc.read_warc(spark, path).where("target_uri like 'http://x/%'").first().type == "revisit"
    assert warc.archive(spark.createDataFrame([], PAGES), path + "e").count() == 0


def test_warc_many_groups(spark, monkeypatch):
    """Beyond the bound of the broadcast the same rows come by salted joins."""
    d = common.table(spark, DATA, "pages")
    key = lambda df: sorted(map(repr, df.collect()))
    want = key(warc.archive(d, common.work_path(spark, "warc")))
    monkeypatch.setattr(warc, "BROADCAST_GROUPS", -1)
    assert key(warc.archive(d, common.work_path(spark, "warc"))) == want


def test_warc_least_bytes(spark):
    d = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")], PAGES)
    got = {r.page_id: r.record_type for r in warc.archive(d, common.work_path(spark, "warc"), least_bytes=3).collect()}
    assert got == {1: "response", 2: "response", 3: "revisit", 4: "response"}


def test_warc_of_others(spark, tmp_path):
    """Archives without manifest and lengths, whole and by member."""
    one = warc.record("urn:a", "response", "http://a", "2024-01-01T00:00:00Z", None, b"\0" * 20, 5, b"hello")
    two = warc.record("urn:b", "response", "http://b", "2024-01-01T00:00:00Z", None, b"\1" * 20, 3, b"bye")
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(one) + gzip.compress(two))
    (tmp_path / "b.warc").write_bytes(two + one)
    long = warc.record("urn:c", "response", "http://c", "2024-01-01T00:00:00Z", None, b"\2" * 20, 300_000, b"z" * 300_000)
    (tmp_path / "c.warc.gz").write_bytes(gzip.compress(one + long + two) + gzip.compress(two))
    (tmp_path / "d.warc.gz").write_bytes(warc.member(two + one, 1) + warc.member(one, 1))
    want = {"urn:a": 2 + 1 + 2, "urn:b": 2 + 2 + 1, "urn:c": 1}
    sizes = {"urn:a": b"hello", "urn:b": b"bye", "urn:c": b"z" * 300_000}
    got = warc.read_warc(spark, str(tmp_path)).select("record_id", "payload").collect()
    assert collections.Counter(r.record_id for r in got) == want and all(bytes(r.payload) == sizes[r.record_id] for r in got)
    got = warc.read_warc(spark, str(tmp_path), payload="false").where("record_id <> 'urn:c'").collect()
    assert collections.Counter(r.record_id for r in got) == {"urn:a": 5, "urn:b": 5} and all(r.payload_bytes == len(sizes[r.record_id]) for r in got)
    (tmp_path / "e.warc.gz").write_bytes(gzip.compress(one + two)[:-40])
    with pytest.raises(Exception, match="cut off"):
        warc.read_warc(spark, str(tmp_path)).collect()


def test_warc_lengths_of_others(spark, tmp_path):
    """Payload lengths where no HTTP header tells them, and predicates on them."""
    noise = np.random.default_rng(1).bytes(60_000).hex().encode()
    http = b"HTTP/1.1 200 OK\r\nX-Long: " + b"y" * 9_000 + b"\r\n\r\n" + noise
    blocks = [("resource", noise), ("response", http), ("metadata", b"a: b"), ("resource", b"")]
    records = [f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:{k}>\r\nContent-Length: {len(x)}\r\n\r\n".encode() + x + b"\r\n\r\n" for k, (kind, x) in enumerate(blocks)]
    for name, data in (("plain", b"".join(records)), ("members", b"".join(map(gzip.compress, records))), ("lengths", b"".join(warc.member(r, 1) for r in records))):
        (tmp_path / name).mkdir()
        (tmp_path / name / ("a.warc" if name == "plain" else "a.warc.gz")).write_bytes(data)
        for payload in ("true", "false"):
            read = warc.read_warc(spark, str(tmp_path / name), payload=payload)
            assert [r.payload_bytes for r in read.orderBy("record_id").collect()] == [120_000, 120_000, 4, 0]
            assert read.where("payload_bytes = 120000").count() == 2
            if payload == "true":
                assert {len(r.payload) for r in read.where("payload_bytes = 120000").collect()} == {120_000}


def test_shards(spark, docs, empty):
    store = sharding.shard(docs, common.work_path(spark, "shards"), arrivals=8, fan_in=3)
    key = lambda df: sorted(map(repr, df.collect()))
    assert key(store.read()) == key(docs)
    runs = store.manifest()["runs"]
    tiers = collections.Counter(store.tier(r) for r in runs if not store.done(r))
    assert max(tiers.values()) < 3
    with pytest.raises(sharding.CommitConflict):
        store.commit({"version": store.manifest()["version"] - 1}, runs, "")
    before = store.manifest()["version"]
    store.append(docs.limit(2))
    assert store.manifest()["version"] == before + 1 and store.read().count() == 14
    e = sharding.shard(empty, common.work_path(spark, "shards"))
    assert e.read().count() == 0 and e.read().columns == docs.columns


def test_shard_claims(spark, docs, monkeypatch):
    """A void claim is followed by a later one; its holder then gives up."""
    store = sharding.ShardStore(spark, common.work_path(spark, "shards"), claim_seconds=0.2, tries=1)
    first = store.append(docs)
    assert store._create(store._claim(2, 1), "")  # a writer that died
    with pytest.raises(sharding.CommitConflict):
        store.commit(first, first["runs"], first["schema"])
    time.sleep(0.3)
    create = store._create

    def overtaken(path, text):
        done = create(path, text)
        if text and store._claims(2) == 2:  # this writer slept; another one claims
            create(store._claim(2, 3), "")
        return done

    monkeypatch.setattr(store, "_create", overtaken)
    with pytest.raises(sharding.CommitConflict, match="published"):
        store.commit(first, first["runs"], first["schema"])
    monkeypatch.setattr(store, "_create", create)
    assert store.manifest()["version"] == 1
    time.sleep(0.3)
    assert store.append(docs)["version"] == 2 and store.read().count() == 24


def test_shard_conflicts_are_tried_again(spark, docs, monkeypatch):
    store = sharding.ShardStore(spark, common.work_path(spark, "shards"))
    store.append(docs)
    commit, met = store.commit, []

    def other_first(base, runs, schema):
        if not met:
            met.append(1)
            commit(base, base["runs"], schema)
        return commit(base, runs, schema)

    monkeypatch.setattr(store, "commit", other_first)
    assert store.append(docs)["version"] == 3 and store.read().count() == 24


def test_shard_readers_keep_their_version(spark, docs):
    """A version that was begun stays readable; orphans and old files go later."""
    path = common.work_path(spark, "shards")
    store = sharding.ShardStore(spark, path, fan_in=2)
    store.append(docs)
    begun = store.read()
    for _ in range(5):
        store.append(docs)
        store.compact()
    assert begun.count() == 12 and store.read().count() == 72
    docs.write.parquet(f"{path}/runs/orphan")
    late = sharding.ShardStore(spark, path, fan_in=2, keep_versions=1, keep_seconds=0, claim_seconds=0)
    late.vacuum()
    assert len(late.versions()) == 1 and late.read().count() == 72
    named = {r["folder"].split("/")[1] for r in late.manifest()["runs"]}
    assert {s.getPath().getName() for s in late.fs.listStatus(late._p("runs"))} == named
    assert not [s for s in late.fs.listStatus(late._p("_manifest")) if int(s.getPath().getName().split(".")[0]) < late.versions()[0]]


@pytest.mark.parametrize("k,block", [(5, 8192), (3, 4)])
def test_topk_brute(spark, k, block):
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(400, 8)).astype(np.float32)
    vectors[7], vectors[9] = vectors[50], vectors[50]  # ties
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    odd = [(1000, None), (1001, [1.0, None] + [0.0] * 6), (1050, [float("nan")] * 8), (1051, [float("inf")] + [0.0] * 7)]
    d = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").withColumn("label", F.lit(1))
    x = np.floor(256 * vectors.astype(np.float64)).astype(np.int64)
    want = set()
    for q in range(0, 400, 50):
        order = sorted((-int(x[q] @ x[c]), c) for c in range(400) if c != q)[:k]
        want |= {(q, r + 1, c, -s) for r, (s, c) in enumerate(order)}
    got = topk.top_k(d, k=k, query_block=block, slab_rows=block * 8)
    assert {tuple(r) for r in got.collect()} == want
    assert topk.top_k(d.limit(0)).count() == 0


def share_evaluated(x, n_queries, n_pivots=48):
    """By the operator's search, the sample's scores as a start, in two slabs."""
    space = topk.PivotSpace.of(topk.choose_pivots(x[:1000], n_pivots))
    d = topk.distances(x, topk.choose_pivots(x[:1000], n_pivots))
    q, ids, half = x[:n_queries], np.arange(len(x)), len(x) // 2
    least = np.sort(np.where(ids[None, :1000] == ids[:n_queries, None], -np.inf, q @ x[:1000].T), axis=1)[:, -5]
    best, n = topk.Best.of(least, 5), 0
    for part in (slice(0, half), slice(half, None)):
        n += topk.search_slab(ids[part], x[part], space.places(x[part], d[part]), ids[:n_queries], q, space.places(q, d[:n_queries]), best)
    want = np.where(ids[None] == ids[:n_queries, None], -np.inf, q @ x.T)
    assert all(sorted(best.scores[k], reverse=True) == sorted(want[k], reverse=True)[:5] for k in range(n_queries))
    return n / n_queries / len(x)


def test_pivots_save_work():
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(20, 6)) * 2000
    assert share_evaluated(np.floor(centres[rng.integers(0, 20, 4000)] + rng.normal(size=(4000, 6)) * 20), 40) < 0.02


def test_pivots_save_work_on_the_table(spark):
    """The rows of embeddings are spread evenly over 64 dimensions."""
    t = topk.usable(common.table(spark, "/root/testdata/sf0.1", "embeddings")).orderBy("vec_id").toArrow()
    assert share_evaluated(topk.matrix(t["embedding"].combine_chunks(), 64), 100) < 0.25


def test_topk_odd_rows(spark):
    """Repeated ids, unequal lengths, values whose multiple is not finite."""
    rows = [(0, [1.0, 2.0]), (0, [1.0, 1.0]), (1, [3.0]), (1, [3.0]), (2, [1.0, 1.0, 5.0]), (3, [1e306, 0.0]), (4, []), (50, [-1.0]), (None, [9.0])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit(1) for c in ("x", "d", "least", "rank", "score", "query_id")})
    got = sorted(map(tuple, topk.top_k(d, k=3).collect()))
    one = 256 * 256
    assert got == [(0, 1, 1, 3 * one), (0, 2, 1, 3 * one), (0, 3, 2, 2 * one), (50, 1, 4, 0), (50, 2, 0, -one), (50, 3, 0, -one)]
    assert topk.top_k(spark.createDataFrame([(0, []), (1, []), (2, None)], "vec_id long, embedding array<double>")).collect()[0][1:] == (1, 1, 0)
    big = spark.createDataFrame([(k, [1e300 * (k - 2), 1.0]) for k in range(4)], "vec_id long, embedding array<double>")
    assert [(r.vec_id, r.score) for r in topk.top_k(big, k=2).orderBy("rank").collect()] == [(1, 2**63 - 1), (2, one)]


def test_lm(spark, docs, empty):
    got = lm.score(docs).toPandas()
    rows = docs.collect()
    counts = collections.Counter(w for r in rows if r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 10 for w in [*words(r.text), None])
    n, v = sum(counts.values()), len(counts)
    for r in rows:
        tokens = [*words(r.text), None]
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens)
        x = (got[got.doc_id == r.doc_id] if r.doc_id is not None else got[got.doc_id.isna()]).iloc[0]
        assert (x.n_tokens, x.n_known, x.train_tokens) == (len(tokens), sum(counts[w] > 0 for w in tokens), n)
        assert x.base_score == pytest.approx(base) and x.score <= 0
    assert lm.score(empty).count() == 0


def test_lm_rare_words_are_joined(spark):
    d = common.table(spark, DATA, "documents")
    a = lm.score(d).toPandas().sort_values("doc_id")
    b = lm.score(d, lm.Settings(common_words=500, block_rows=20_000)).toPandas().sort_values("doc_id")
    assert np.allclose(a.base_score, b.base_score) and (a.n_known.values == b.n_known.values).all()
    held = a[a.held_out]
    assert held.score.sum() > held.base_score.sum()


def test_lm_filter_has_no_size_of_its_own(spark):
    """Nothing of the filter is sent to tasks, and unseen n-grams stay unseen,
    however many n-grams there are."""
    settings, sizes = lm.Settings(common_words=100), []
    for n in (5_000, 40_000):
        rows = [(1, False, " ".join(f"a{k}" for k in range(n)).encode()), (2, True, " ".join(f"b{k}" for k in range(2_000)).encode())]
        chunks = lm.chunks_of(spark.createDataFrame(rows, "doc_id long, held_out boolean, text binary"))
        model, _, levels = lm.train(chunks, 3, settings)
        sizes.append(len(pickle.dumps(model)))
        for kind in (lm.WORD, lm.PAIR, lm.FOLLOW):
            told = np.concatenate([np.frombuffer(r.counts, dtype=np.uint8) for r in levels.where(F.col("kind") == lm.SEEN + kind).collect()])
            assert n <= (told > 0).sum() < n + 400 and len(told) > n + 1_900
    assert abs(sizes[1] - sizes[0]) < 100


def test_lm_chunks_stay_out_of_the_jvm(spark):
    """However many chunks a task has, rows of Spark's tables hold none of them,
    and a reader gets each one alone."""
    texts = [f"a{k} b c".encode() for k in range(20_000)]
    source = spark.createDataFrame([(k, k % 10 == 0, t) for k, t in enumerate(texts)], "doc_id long, held_out boolean, text binary")
    rows = lm.chunks_of(source.coalesce(1), chunk_tokens=5_000).collect()
    assert len(rows) >= 5 and max(len(pickle.dumps(tuple(r))) for r in rows) < 1_000
    assert [r.chunk for r in rows] == list(range(len(rows))) and len({r.path for r in rows}) == 1
    assert pq.ParquetFile(rows[0].path.removeprefix("file://")).num_row_groups == len(rows)
    got = [lm.Chunk.of(r.chunk, r.path, r.place) for r in rows]
    assert [i for c in got for i in c.ids.to_pylist()] == list(range(20_000))
    assert [len(c.at) for c in got] == [4 * len(c.held) for c in got]
    assert sum(r.learned for r in rows) == 4 * 18_000


def test_files_of_failed_attempts_are_not_read(spark):
    schema = pa.schema([("n", pa.int64())])
    double = lambda batches: (pa.RecordBatch.from_arrays([pa.array(b.column(0).to_numpy() * 2)], schema=schema) for b in batches)
    folder, files = common.written(spark.range(100, numPartitions=3), double, schema, "written", told="n", rows_per_batch=20)
    at = folder.removeprefix("file://")
    pq.write_table(pa.table({"n": [1, 3]}), f"{at}/_tries/part-000000-99.parquet")
    assert sorted(r.n for r in spark.read.parquet(folder).collect()) == list(range(0, 200, 2))
    assert len(files) == 3 and all(pq.ParquetFile(f"{at}/{name}").num_row_groups == len(told) == 2 for name, told in files)


def test_bloom_counts():
    rng = np.random.default_rng(3)
    h = rng.integers(0, 2**63, 20_000, dtype=np.uint64)
    c = rng.geometric(0.3, 20_000)
    s = lm.Settings()
    bloom = lm.LogFrequencyBloom.of(lm.build_block(h ^ lm._SALT[0], c, s), s)
    want = lm.count_of(lm.level_of(c, s.base), s.base)
    got = bloom.counts(h, lm._SALT[0])
    assert (got >= want).all() and (got == want).mean() > 0.9  # never too low
    assert (bloom.counts(rng.integers(0, 2**63, 20_000, dtype=np.uint64), lm._SALT[0]) > 0).mean() < 0.1


def test_full_bloom_ends():
    """Levels end with the highest one stored, even where every bit is set."""
    s = lm.Settings()
    bloom = lm.LogFrequencyBloom(np.full(8, 255, dtype=np.uint8), 64, 7, s)
    assert (bloom.levels(np.arange(5, dtype=np.uint64), lm._SALT[0]) == 7).all()


def brute_lm(rows, s):
    """Scores from dictionaries of quantised counts, by the formulas."""
    one, two = collections.Counter(), collections.Counter()
    for r in rows:
        if r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 10:
            t = [*words(r.text), None]
            one.update(t)
            two.update(zip([None, *t], t))
    follow = collections.Counter(h for h, _ in two)
    q = lambda c: float(lm.count_of(lm.level_of(np.array([c]), s.base), s.base)[0]) if c else 0.0
    n, unknown = sum(one.values()), max(1, sum(c == 1 for c in one.values())) / sum(one.values())

    def p(h, w):
        single = max(q(one[w]) - unknown, 0.05) / n * (1 - unknown) if one[w] else unknown
        given = max(q(one[h]), q(two[h, w]), q(follow[h]))
        if not given:
            return single
        return min(1.0, max(q(two[h, w]) - s.discount, 0) / given + min(1.0, s.discount * max(q(follow[h]), 1) / given) * single)

    return [sum(math.log10(p(h, w)) for h, w in zip([None, *words(r.text)], [*words(r.text), None])) for r in rows], p, one


def test_lm_scores_brute(spark, docs):
    """With so many bits that nothing unseen is found, scores are the formulas'."""
    s = lm.Settings(bits_per_entry=400.0, probes=8, block_rows=3_000)
    for d in (docs, common.table(spark, DATA, "documents")):
        rows = d.collect()
        want = collections.defaultdict(list)
        for r, v in zip(rows, brute_lm(rows, s)[0]):
            want[r.doc_id].append(v)
        got = collections.defaultdict(list)
        for r in lm.score(d, s).collect():
            got[r.doc_id].append(r.score)
        assert got.keys() == want.keys()
        assert all(sorted(got[k]) == pytest.approx(sorted(want[k])) for k in want)


def test_lm_probabilities_sum_to_about_one(spark):
    """Counts are quantised, so sums over the vocabulary and the unknown word
    are near 1: within the width of a level; finer levels are nearer."""
    for base, low, high in ((1.5, 0.7, 1.15), (1.2, 0.83, 1.1)):
        _, p, one = brute_lm(common.table(spark, DATA, "documents").collect(), lm.Settings(base=base))
        for h, _ in [*one.most_common(6), *one.most_common(500)[-6:]]:
            assert low < sum(p(h, w) for w in [*one, b"\0never"]) < high


def brute_quality(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    runs = collections.Counter(tuple(ws[k : k + 8]) for k in range(len(ws) - 7))
    covered = {j for k in range(len(ws) - 7) if runs[tuple(ws[k : k + 8])] > 1 for j in range(k, k + 8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return [len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)]


def test_quality(spark, docs, labels, empty):
    for d, marks in ((common.table(spark, DATA, "documents"), common.table(spark, DATA, "labels")), (docs, labels)):
        texts = collections.defaultdict(list)
        for r in d.collect():
            texts[r.doc_id].append(r.text)
        rows = quality.quality(d, marks).collect()
        for r in rows:
            b = brute_quality(texts[r.doc_id][0])
            assert [r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words] == b
            assert r.base_failed == (b[0] < 20 or 100 * b[4] > 30 * b[0]) and not (r.base_failed and r.kept)
        kept = collections.Counter(r.doc_id for r in rows if r.kept)
        out = quality.keep_good(d, marks)
        assert out.columns == d.columns and collections.Counter(r.doc_id for r in out.collect()) == kept
    assert quality.quality(empty, labels).count() == 0


def test_quality_on_labels(spark):
    d = "/root/testdata/sf0.01"
    r = quality.quality(common.table(spark, d, "documents"), common.table(spark, d, "labels")).join(common.table(spark, d, "labels"), "doc_id").where("not base_failed")
    good, bad = (r.where(f"quality = {q}").agg(F.avg(F.col("kept").cast("double"))).first()[0] for q in (1, 0))
    assert good > 0.98 and bad < 0.4


def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.1"
    labels = common.table(spark, d, "labels")
    r = toxicity.toxicity(common.table(spark, d, "documents"), labels).join(labels, "doc_id").where("held_out").toPandas()
    assert ((r.toxic == 1) & (r.predicted == 1)).sum() / (r.toxic == 1).sum() > 0.8
    assert ((r.toxic == 0) & (r.predicted == 1)).sum() / (r.toxic == 0).sum() < 0.02


def test_toxic_sentences(spark):
    clean = "the sun is up. birds sing in the trees. all is well today"
    rows = [(k, clean + f". number {k}" + (". you grumbly zorgling person" if k % 3 == 0 else "."), k % 3 == 0) for k in range(120)]
    d = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1, int(t)) for k, _, t in rows], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(d, labels).collect()}
    assert all(got[k].predicted == int(t) for k, _, t in rows)
    text = rows[0][1]
    assert [text[s.start : s.end] for s in got[0].offending] == ["you grumbly zorgling person"]
    assert sorted(r.doc_id for r in toxicity.keep_clean(d, labels).collect()) == [k for k, _, t in rows if not t]


def test_toxicity_odd_rows(docs, labels, empty):
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == 12 and all(0 <= r.score <= 1 and r.predicted == 0 for r in got)
    assert toxicity.toxicity(empty, labels).count() == 0


def naive_anomaly(forest, row):
    """Path lengths by walking each tree alone."""
    total = 0.0
    for feature, place, child, length in forest.trees:
        at = 0
        while child[at][0] != at:
            at = int(child[at][1] if row[feature[at]] >= place[at] else child[at][0])
        total += length[at]
    return 2 ** (-total / len(forest.trees) / float(forest.expected(forest.sample)))


def naive_kept(spark, d, marks):
    """{doc_id: kept} of the quality rules, verdicts and threshold by brute force."""
    measured = quality.measure(d)
    forest, threshold = quality.fit(measured, marks)
    rows = [(r, naive_anomaly(forest, [r[x] for x in quality.RATES])) for r in measured.collect()]
    good = {r.doc_id for r in marks.groupBy("doc_id").agg(F.min("quality").alias("q")).where("q = 1 and doc_id is not null").collect()}
    passed = [(r, v) for r, v in rows if not (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)]
    known = sorted(v for r, v in passed if r.doc_id in good)
    if known:
        lost = lambda t: sum(v >= t for v in known) <= 0.003 * len(known)
        assert lost(threshold) and not lost(threshold - 1 / 2000)
    return {r.doc_id: any(r is x and v < threshold for x, v in passed) for r, _ in rows}, {r.doc_id: v for r, v in rows}


def test_quality_verdicts_brute(spark):
    d, marks = common.table(spark, DATA, "documents"), common.table(spark, DATA, "labels")
    kept, anomaly = naive_kept(spark, d, marks)
    got = quality.quality(d, marks).collect()
    assert {r.doc_id: r.kept for r in got} == kept and 0 < sum(kept.values()) < len(kept)
    assert all(r.anomaly == pytest.approx(anomaly[r.doc_id]) for r in got)


def naive_toxicity(model, text):
    """Noisy-or over sentences, word by word."""
    clean = 1.0
    weight = dict(zip(model.words.tolist(), model.weights.tolist()))
    for sentence in re.split(rb"[.!?\n]", (text or "").encode()):
        found = re.findall(rb"[0-9A-Za-z\x80-\xff]+", sentence)
        if found:
            z = model.bias
            for w in found:
                one = textvec.words_of(pa.array([w], pa.binary()), space=toxicity._BETWEEN)
                z += weight.get(int(one.hash[0]), 0.0)
                for n in toxicity.STEMS:
                    if len(w) > n:
                        part = textvec.words_of(pa.array([w[:n]], pa.binary()), space=toxicity._BETWEEN)
                        z += weight.get(int(textvec.mix(part.hash + np.uint64(n))[0]), 0.0)
            clean *= 1 - 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))
    return 1 - clean


def test_toxicity_brute(spark):
    d, marks = common.table(spark, DATA, "documents").where("length(text) < 2000"), common.table(spark, DATA, "labels")
    model = toxicity.fit(d, marks, least_docs=1, most_each=400)
    assert len(model.words) and (model.weights > 0).all()
    texts = {r.doc_id: r.text for r in d.collect()}
    got = toxicity.toxicity(d, marks, least_docs=1, most_each=400).collect()
    assert any(r.predicted for r in got)
    for r in got:
        assert r.score == pytest.approx(naive_toxicity(model, texts[r.doc_id]), abs=1e-9) and r.predicted == (r.score >= 0.5)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_toxicity_learns_from_no_held_out_label(spark):
    """Labels of held-out rows may say what they like."""
    d, marks = common.table(spark, DATA, "documents"), common.table(spark, DATA, "labels")
    other = marks.withColumn("toxic", F.expr("if(crc32(cast(doc_id as string)) % 5 = 0, 1 - toxic, toxic)"))
    a, b = (sorted((r.doc_id, r.score) for r in toxicity.toxicity(d, m).collect()) for m in (marks, other))
    assert a == b


def test_pipeline(spark):
    """Each stage against brute force on all that its predecessor kept."""
    import duckdb
    import corpus_pipeline as p

    docs = common.table(spark, DATA, "documents")
    marks = common.table(spark, DATA, "labels")
    assert [n for n, _ in p.STAGES] == ["quality", "toxicity", "near_duplicates", "mix", "pack"]
    for name, stage in p.STAGES[:-1]:
        rows = {r.doc_id: r for r in docs.collect()}
        if name == "quality":
            want = {k for k, v in naive_kept(spark, docs, marks)[0].items() if v}
        elif name == "toxicity":
            model = toxicity.fit(docs, marks)
            want = {k for k, r in rows.items() if naive_toxicity(model, r.text) < 0.5}
        elif name == "near_duplicates":
            ids = sorted(rows)
            want = {ids[k] for k in brute_links([rows[k].text for k in ids])[1]}
        else:
            con = duckdb.connect()
            con.register("documents", docs.toArrow())
            takes = {r[0]: r[1] for r in con.execute(f"SELECT doc_id, take_tokens FROM ({mixing.oracle(p.MIX)})").fetchall()}
            want = set(takes)
        out = common.materialize(stage(spark, docs, DATA), "stage")
        assert out.columns == docs.columns
        got = {r.doc_id: r for r in out.collect()}
        assert got.keys() == want and out.count() == len(want), name
        for k, r in got.items():
            if name == "mix" and takes[k] < len(words(rows[k].text)):
                assert rows[k].text.startswith(r.text) and len(words(r.text)) == takes[k] and r.n_chars == len(r.text)
            else:
                assert r == rows[k]
        docs = out
    assert len(want) < 200
    ids = {k: ids_of("word_bpe_49k.json", r.text, 1) for k, r in got.items()}
    places = collections.defaultdict(list)
    for r in p.STAGES[-1][1](spark, docs, DATA).collect():
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert len(part) == r.length and zlib.crc32(part.tobytes()) == r.ids_crc32
        places[r.doc_id].append((r.start, r.length))
    for k, v in ids.items():
        at = 0
        for start, n in sorted(places[k]):
            assert start == at
            at += n
        assert at == len(v)


def test_pipeline_odd_tables(spark, docs, empty, tmp_path):
    """Nulls, empty and long texts, repeated rows, no rows, other columns."""
    import corpus_pipeline as p

    marks = spark.createDataFrame([(k, 1, 0) for k in range(1, 12)], "doc_id long, quality int, toxic int")
    for name, d in (("odd", docs.withColumn("epoch", F.lit(7))), ("none", empty)):
        d.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        marks.write.parquet(f"{tmp_path}/{name}/labels.parquet")
        out = p.run(spark, f"{tmp_path}/{name}")
        assert (out.count() > 0) == (name == "odd")
        for stage, fn in p.STAGES[:-1]:
            assert fn(spark, d, f"{tmp_path}/{name}").columns == d.columns, stage


@pytest.mark.parametrize("before, inside", [("10000", "2048"), ("0", "2048"), ("100", "100")])
def test_batches_of_texts_are_small(spark, before, inside):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    default = spark.conf.get(name)
    spark.conf.set(name, before)
    try:
        with pytest.raises(ZeroDivisionError), common.small_batches(spark):
            assert spark.conf.get(name) == inside
            raise ZeroDivisionError
        assert spark.conf.get(name) == before
    finally:
        spark.conf.set(name, default)
