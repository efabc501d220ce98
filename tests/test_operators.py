import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quern.config import ERRORS, ConfigError, GenerationConfig, HybridConfig, IndexConfig, MemoryConfig, MemoryError_, ModelConfig, ModelError, RetrievalError, TEXT_PRESETS, VectorConfig, changed
from quern.functions import prompts as P
from quern.functions import security as X
from quern.functions import vectors as V
from quern.operators import access as A
from quern.operators import chains as C
from quern.operators import hybrid as H
from quern.operators import knn as K
from quern.operators import memory as M
from quern.operators import metrics as N
from quern.operators import store as D
from quern.sources.collections import Collections


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def test_knn_edges(spark):
    v = vectors(spark, [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [-1.0, 0.0]), (4, [0.0, 0.0]), (5, [1.0, 1.0]), (6, None), (7, [1.0])])
    q = vectors(spark, [(9, [2.0, 0.0]), (8, None)]).withColumnRenamed("vec_id", "query_id")
    got = [(r["rank"], r.vec_id, round(r.score, 6)) for r in K.knn(v, q, VectorConfig(dimension=2)).orderBy("rank").collect()]
    assert got == [(1, 1, 1.0), (2, 2, 1.0), (3, 5, 0.707107), (4, 4, 0.0)]  # negative, null and other sizes are left out
    assert K.knn(v, q.limit(0), VectorConfig(dimension=2)).count() == 0
    assert K.knn(v.limit(0), q, VectorConfig(dimension=2)).count() == 0
    one = K.nearest(v.filter("vec_id < 6"), [2.0, 0.0], VectorConfig(dimension=2)).collect()
    assert [r.vec_id for r in one] == [1, 2, 5, 4]


def test_knn_matches_brute_force(spark):
    import random

    r = random.Random(3)
    rows = [(i, [r.gauss(0, 1) for _ in range(8)]) for i in range(400)]
    for metric in ("cosine", "dot", "euclidean"):
        c = VectorConfig(dimension=8, k=7, metric=metric, normalize=metric != "dot")
        got = {}
        for x in K.knn(vectors(spark, rows).repartition(5), vectors(spark, rows[:6]).withColumnRenamed("vec_id", "query_id"), c).collect():
            got.setdefault(x.query_id, []).append((x["rank"], x.vec_id))
        import numpy as np

        m = np.array([v for _, v in rows], np.float32).astype(float)
        u = m / np.linalg.norm(m, axis=1, keepdims=True)
        s = {"cosine": u @ u.T, "dot": m @ m.T, "euclidean": 1 / (1 + np.linalg.norm(u[:, None] - u[None], axis=2))}[metric]
        for q in range(6):
            want = sorted(((-round(x, 9), i) for i, x in enumerate(s[q]) if x >= 0))[:7]
            assert [i for _, i in sorted(got[q])] == [i for _, i in want]


def test_vector_functions(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<double>, b array<double>")
    r = df.select(V.cosine(F.col("a"), F.col("b")).alias("c"), V.euclidean(F.col("a"), F.col("b")).alias("e"), V.unit(F.col("a")).alias("u"), V.unit(F.col("b")).alias("z")).first()
    assert (r.c, r.e, r.u, r.z) == (0.0, 5.0, [0.6, 0.8], [0.0, 0.0])
    with pytest.raises(Exception, match="dimension"):
        K.checked(df.withColumnRenamed("a", "embedding"), VectorConfig(dimension=3)).collect()


def test_fusion(spark):
    kind = "query_id long, doc_id long, rank long, score double"
    s = spark.createDataFrame([(1, 1, 1, 1.0), (1, 2, 2, 0.5)], kind)
    d = spark.createDataFrame([(1, 2, 1, 0.9), (1, 3, 2, 0.9)], kind)
    rows = {r.doc_id: r for r in H.fuse(s, d, HybridConfig()).collect()}
    assert [rows[i].hybrid_score for i in (1, 2, 3)] == [0.5, 0.75, 0.5] and rows[1].dense_rank == 0
    rrf = {r.doc_id: r.hybrid_score for r in H.fuse(s, d, HybridConfig(fusion="rrf")).collect()}
    assert rrf[2] == pytest.approx(0.5 / 62 + 0.5 / 61) and rrf[1] == pytest.approx(0.5 / 61)
    flat = spark.createDataFrame([(1, 1, 1, 1.0), (1, 2, 2, 1.0)], kind)
    for how, want in (("min_max", 0.5), ("z_score", 0.0), ("sum", 0.5)):
        assert {r.hybrid_score for r in H.fuse(flat, flat, HybridConfig(normalization=how)).collect()} == {want}


def test_dedupe(spark):
    docs = spark.createDataFrame([(1, "a b c d"), (2, "a b c d"), (3, "a b c x"), (4, None), (5, "")], "doc_id long, text string")
    rows = spark.createDataFrame([(1, i, 1.0 - i / 10) for i in range(1, 6)], "query_id long, doc_id long, hybrid_score double")
    kept = lambda t: sorted(r.doc_id for r in H.dedupe(rows, docs, HybridConfig(dedupe_threshold=t)).collect())
    assert kept(0.95) == [1, 3, 4, 5] and kept(0.6) == [1, 4, 5]


def test_store(spark):
    df = spark.createDataFrame([(1, "ab", 5), (2, "abc", None), (3, None, 7)], "id long, s string, n long")
    ask = lambda *c, **k: [r.id for r in D.query(df, D.Query(tuple(D.Condition(*x) for x in c), **k)).collect()]
    assert ask(("s", "starts_with", "ab")) == [1, 2] and ask(("n", "greater_than", 5)) == [3] and ask(("zz", "equals", 1)) == []
    assert ask(order_by="n", ascending=False, limit=2) == [3, 1] and ask(offset=9) == []
    assert ask(("n", "in", (5, 7)), ("s", "not_equals", "x")) == [1]
    up = D.upsert(df, spark.createDataFrame([(3, "new", 1), (4, "x", 1)], df.schema))
    assert sorted((r.id, r.s) for r in up.collect()) == [(1, "ab"), (2, "abc"), (3, "new"), (4, "x")]


def test_documents_and_records(spark):
    docs = spark.createDataFrame([(1, "t", "en", None)], "doc_id long, text string, lang string, source string")
    r = D.to_documents(D.to_records(docs)).first()
    assert r.id == "1" and r.metadata == {"lang": "en"}


def test_memory(spark):
    rows = [(1, i, "user" if i % 2 else "assistant", "x" * (4 * i)) for i in range(1, 13)]
    m = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    turns = lambda df: sorted(r.turn for r in df.collect())
    assert turns(M.last_messages(m, MemoryConfig(max_messages=3))) == [10, 11, 12]
    assert turns(M.token_buffer(m, MemoryConfig(max_tokens=24))) == [11, 12] and turns(M.token_buffer(m, MemoryConfig(max_tokens=11))) == []
    assert turns(M.recent(m)) == [11, 12] and M.summaries(m).first().summary.endswith("10 messages.")
    assert M.context(m.filter("turn < 3")).first().context == "[Human]: xxxx\n[AI]: xxxxxxxx\n"
    ten = M.summaries(m.filter("turn <= 10")).first()
    assert ten.n_recent == 0 and ten.summary


def test_prompts(spark):
    df = spark.createDataFrame([("x {b}", "y")], "a string, b string")
    one = lambda c: df.select(c.alias("r")).first().r
    assert one(P.fill("{a}-{b}", {"a": F.col("a"), "b": F.col("b")})) == "x y-y"
    assert one(P.fill("{a}{c}", {"b": F.col("b")}, "keep")) == "{a}{c}" and one(P.fill("{q}!", {}, "empty")) == "!"
    with pytest.raises(ValueError):
        P.fill("{nope}", {})
    assert one(P.chunks(F.lit("abcdefg"), 3)) == ["abc", "def", "g"] and one(P.chunks(F.lit(""), 3)) == []
    assert tuple(one(P.action(F.lit("Action: calc [1+1]")))) == ("calc", "1+1")
    two = C.sequential(df, [C.LLMChain("1 {b}", "o1"), C.LLMChain("2 {o1}", "o2")], return_all=True).first()
    assert two.o2 == "Mock OpenAI response to: 2 Mock OpenAI response to: 1 y" and two.o1.endswith("1 y")


def test_security(spark):
    df = spark.createDataFrame([("Abcdef1!", "a@b.co", "<é'\"ok\n>")], "p string, m string, s string")
    key = X.derive_key(F.lit("k"), F.lit("s"))
    r = df.select(X.is_strong_password(F.col("p")).alias("p"), X.is_valid_email(F.col("m")).alias("m"), X.sanitize_input(F.col("s")).alias("s"), X.decrypt(X.encrypt(F.col("p"), key), key).alias("d"), X.hmac_sha256(b"k", F.col("p")).alias("h")).first()
    import hashlib
    import hmac

    assert (r.p, r.m, r.s, r.d) == (True, True, "ok", "Abcdef1!") and r.h == hmac.new(b"k", b"Abcdef1!", hashlib.sha256).hexdigest()


def test_permissions(spark):
    roles = spark.createDataFrame([(1, 1), (2, 2)], "user_id long, role_id long")
    grants = spark.createDataFrame([(1, "*", "READ"), (2, "doc", "READ")], "role_id long, resource string, type string")
    asked = spark.createDataFrame([(1, "doc", "READ"), (2, "doc", "READ"), (2, "doc", "WRITE")], "user_id long, resource string, type string")
    assert [tuple(r) for r in A.permitted(asked, roles, grants).collect()] == [(2, "doc", "READ")]


def test_collections(spark, tmp_path):
    s = Collections(spark, f"file://{tmp_path}/live")
    assert s.create("a") and not s.create("a")
    s.save("a", spark.range(3))
    assert s.backup(f"file://{tmp_path}/copy") == ["a"] and s.stats().first().files > 0
    assert s.drop("a") and s.names() == []
    assert s.restore(f"file://{tmp_path}/copy") == ["a"] and Counter(r.id for r in s.load("a").collect()) == Counter(range(3))


def test_hashed_embedding(spark):
    df = spark.createDataFrame([(["a", "b", "a"],), ([],)], "t array<string>")
    n = [r[0] for r in df.select(V.magnitude(H.hashed_embedding(F.col("t"), 16))).collect()]
    assert math.isclose(n[0], 1.0) and n[1] == 0.0


def test_hashed_embedding_against_its_definition(spark):
    import xxhash

    def chained(word):  # the hash of (word, 1): the second value is hashed with the first hash as seed
        h = xxhash.xxh64_intdigest(word.encode(), 42)
        return h, xxhash.xxh64_intdigest((1).to_bytes(4, "little"), h)

    signed = lambda h: h - (h >> 63 << 64)
    words = ["erin", "thre", "thre", "é", "of"]
    want = [0.0] * 16
    for w in words:
        h, g = chained(w)
        want[signed(h) % 16] += 1.0 if signed(g) >= 0 else -1.0
    norm = math.sqrt(sum(x * x for x in want))
    got = spark.createDataFrame([(words,)], "t array<string>").select(H.hashed_embedding(F.col("t"), 16)).first()[0]
    assert got == pytest.approx([x / norm for x in want])


@pytest.mark.parametrize("most_bytes", [K.MOST_BYTES, 0])
def test_both_forms_of_knn(spark, monkeypatch, most_bytes):
    """Broadcast queries, and pairs of blocks; ties, sizes that differ, and no rows at all."""
    monkeypatch.setattr(K, "PAIR_ROWS", 20)
    rows = [(i, [float(i % 5), float(i % 3), 1.0]) for i in range(90)] + [(100, [1.0]), (101, None)]
    q = vectors(spark, [(i, [1.0, float(i % 4), 0.5]) for i in range(50)] + [(77, [2.0]), (78, None)]).withColumnRenamed("vec_id", "query_id")
    c = VectorConfig(dimension=3, k=4, normalize=False, metric="dot")
    got = {}
    for x in K.knn(vectors(spark, rows), q, c, most_bytes=most_bytes).collect():
        got.setdefault(x.query_id, []).append((x["rank"], x.vec_id, round(x.score, 6)))
    for i in range(50):
        best = sorted(((-sum(a * b for a, b in zip(v, [1.0, float(i % 4), 0.5], strict=True)), j) for j, v in rows[:90]))[:4]
        assert sorted(got[i]) == [(r + 1, j, round(-s, 6)) for r, (s, j) in enumerate(best)]
    assert got[77] == [(1, 100, 2.0)] and 78 not in got
    assert K.knn(vectors(spark, rows).limit(0), q, c, most_bytes=most_bytes).count() == 0 == K.knn(vectors(spark, rows), q.limit(0), c, most_bytes=most_bytes).count()


def test_vector_store(spark, tmp_path):
    c = VectorConfig(dimension=2, max_vectors=5)
    store = K.stored(vectors(spark, [(3, [3.0, 4.0]), (7, [0.0, 0.0])]), c)
    new = spark.createDataFrame([(i, [1.0, float(i)]) for i in (20, 10, 30)], "place long, embedding array<float>").repartition(3)
    got = {r.vec_id: [round(x, 6) for x in r.embedding] for r in K.add(store, new, c, "place").collect()}
    assert sorted(got) == [3, 7, 8, 9, 10] and got[3] == [0.6, 0.8] and got[7] == [0.0, 0.0] and got[8] == [0.099504, 0.995037]
    with pytest.raises(ConfigError, match="more than 5"):
        K.add(store, new.union(new), c, "place")
    with pytest.raises(Exception, match="dimension"):
        K.add(store, new.withColumn("embedding", F.array(F.lit(1.0))), c, "place").collect()
    with pytest.raises(ConfigError, match="cannot change"):
        K.reconfigured(store, c, VectorConfig(dimension=3))
    assert K.reconfigured(store.limit(0), c, VectorConfig(dimension=3)).dimension == 3 and K.reconfigured(store, c, VectorConfig(dimension=2, k=1)).k == 1
    assert K.add(store.limit(0), new.limit(0), c, "place").count() == 0
    K.save(store, f"file://{tmp_path}/v")
    assert K.load(spark, f"file://{tmp_path}/v").count() == 2
    e = K.embed(spark.createDataFrame([("ab",), (None,), ("c",)], "text string"), lambda t: [[len(x)] for x in t], batch=2).collect()
    assert [r.embedding for r in e] == [[2.0], None, [1.0]]
    assert K.embed(spark.createDataFrame([("ab",)], "text string"), lambda t: F.array(F.length(t))).first().embedding == [2]


def test_documents_with_vectors(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    e = spark.createDataFrame([(1, [1.0]), (2, [2.0])], "doc_id long, embedding array<double>")
    assert H.paired(docs, e).count() == 2
    for bad in (e.filter("doc_id = 1"), e.union(e), e.union(e.withColumn("doc_id", F.col("doc_id") + 9))):
        with pytest.raises(RetrievalError):
            H.paired(docs, bad)


def test_errors_and_settings():
    assert {c: e.code for c, e in ERRORS.items()} == {c: c for c in ("CONFIG_ERROR", "RETRIEVAL_ERROR", "LLM_ERROR", "MEMORY_ERROR")}
    assert changed(HybridConfig(), top_k=3).top_k == 3
    with pytest.raises(ConfigError):
        changed(HybridConfig(), sparse_weight=0.9)
    old = ModelConfig(model="gpt-4", api_key="k")
    new = old.merged(ModelConfig(model="", temperature=0.1))
    assert (new.model, new.api_key, new.temperature) == ("gpt-4", "k", 0.1)
    assert GenerationConfig().is_valid() and not GenerationConfig(temperature=3.0).is_valid() and not GenerationConfig(top_p=0.0).is_valid()
    with pytest.raises(ModelError, match="nosuch"):
        C.MODELS.make("nosuch")


def test_memories_and_saved_conversations(spark, tmp_path):
    m = spark.createDataFrame([(1, i, "user", "x" * 8) for i in range(12)] + [(2, 0, "user", "y")], "conv_id long, turn long, role string, text string")
    assert M.remembered("buffer", m, MemoryConfig(max_messages=2)).count() == 3 and M.remembered("summary", m).count() == 3
    with pytest.raises(MemoryError_, match="graph"):
        M.remembered("graph", m)
    M.save(m, f"file://{tmp_path}/m")
    assert M.load(spark, f"file://{tmp_path}/m").count() == 13 and M.load(spark, f"file://{tmp_path}/m", 2).first().text == "y"


def test_long_conversations_and_hot_metrics(spark, monkeypatch):
    """Totals run over blocks as over the whole; gaps, nulls and ties included."""
    import random

    monkeypatch.setattr(M, "BLOCK", 3)
    r = random.Random(2)
    rows = [(r.choice([1, 1, 2, None]), t, "user", "x" * r.randint(0, 30)) for t in r.sample(range(200), 120)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    want = set()
    for c in (1, 2, None):
        used = 0
        for _, t, _, x in sorted((x for x in rows if x[0] == c), key=lambda x: -x[1]):
            used += (len(x) + 3) // 4
            if used <= 60:
                want.add((c, t))
    assert {(x.conv_id, x.turn) for x in M.token_buffer(df, MemoryConfig(max_tokens=60)).collect()} == want
    events = spark.createDataFrame([("a", i, i % 7, 3600 * r.randint(0, 5) + i) for i in range(80)], "name string, id long, delta long, s long").withColumn("ts", F.timestamp_seconds("s"))
    got = {x.id: x.value for x in N.running_gauge(events, "name", "delta", "ts", "id").collect()}
    total = 0
    for x in sorted(events.collect(), key=lambda x: (x.s, x.id)):
        total += x.delta
        assert got[x.id] == total


def test_entries_of_collections(spark, tmp_path):
    s = Collections(spark, f"file://{tmp_path}/base")
    assert s.entries("configs") == [] and s.config("x") is None and s.names() == []
    s.save_config("a/b c", HybridConfig(top_k=4))
    s.save_config("index", IndexConfig(max_postings_per_term=None, text=TEXT_PRESETS["search"]))
    assert s.config("a/b c") == HybridConfig(top_k=4) and s.config("index") == IndexConfig(max_postings_per_term=None, text=TEXT_PRESETS["search"])
    assert s.entries("configs") == ["a/b c", "index"] and s.discard("configs", "index") and s.entries("configs") == ["a/b c"] and s.is_healthy()


def test_sequence_stops_or_goes_on(spark):
    fails = C.LLMChain("{t}", "a", lambda x: F.when(x != "bad", x))
    after = C.LLMChain("{t}>{a}", "a", lambda x: x)
    df = spark.createDataFrame([("ok",), ("bad",)], "t string")
    run = lambda stop: {r.t: (r.a, r.error) for r in C.sequential(df, [fails, after, after], stop_on_error=stop).collect()}
    assert run(True) == {"ok": ("ok>ok>ok", None), "bad": (None, "Chain 0 failed")}
    assert run(False) == {"ok": ("ok>ok>ok", None), "bad": ("bad>bad>", "Chain 0 failed")}


def test_template_variables_only(spark):
    df = spark.createDataFrame([("keep {this} here", None)], "text string, b string")
    assert C.LLMChain("Repeat {text}", "o", lambda x: x).run(df).first().o == "Repeat keep {this} here"
    assert C.LLMChain("{a.b} {text} {b}{none}!", "o", lambda x: x).run(df).first().o == "keep {this} here !"


def test_json_kinds(spark):
    from quern.functions import json as J

    df = spark.createDataFrame([('{"a": {"b": [1, null]}}',), ("no json",), (None,)], "j string")
    got = df.select(J.kind(F.col("j")).alias("k"), J.kind(F.col("j"), "$.a.b[1]").alias("n"), J.contains(F.col("j"), "$.a.b").alias("c"), J.at(F.col("j"), "$.a.b[0]", "int").alias("v")).collect()
    assert [tuple(r) for r in got] == [("object", "null", True, 1), (None, None, False, None), (None, None, False, None)]


def test_a_cluster_must_name_its_shared_folder():
    from types import SimpleNamespace

    from quern.sources import tables

    session = lambda master, named=None: SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: named), sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: None, setCheckpointDir=lambda d: None))
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError, match="shared|share"):
            tables.shared_folder(session(master))
    assert tables.shared_folder(session("yarn", "hdfs://shared/")) == "hdfs://shared" and "quern-" in tables.shared_folder(session("local[4]"))


def test_only_small_tables_are_dealt(spark, monkeypatch):
    from quern.sources import tables

    df = spark.range(100, numPartitions=1)
    assert tables.dealt(df).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    monkeypatch.setattr(tables, "SMALL_BYTES", 1)
    assert tables.dealt(df).rdd.getNumPartitions() == 1
