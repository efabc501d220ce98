"""The registered queries and the pipeline, against versions that go through the rows one by one."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from quern.llm import bpe, language, mixing, multiset, pii, quality_model, sharding, simhash, site_style
from quern.llm.queries import QUERIES, SURROGATE_KEY
from tests.llm.test_documents import RANKS, WORD, slow_components, slow_simhash

TYPES = {
    "op1_language_id": "doc_id bigint, held_out boolean, lang_pred string, score double, cross_entropy double, rejected boolean",
    "op2_quality_classifier": "doc_id bigint, held_out boolean, score double, predicted int",
    "op3_pii_surrogates": "doc_id bigint, text string, n_entities bigint, n_distinct bigint, n_collisions bigint, spans array<struct<kind:string,start:int,end:int,surrogate:string>>",
    "op4_source_mix": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    "op5_quality_rules": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
    "op6_simhash": "doc_id bigint, fingerprint string, component_id bigint",
    "op7_byte_bpe": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op8_multiset_fingerprint": "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    "op9_main_text": "page_id bigint, url string, text string, n_chars bigint, decided_by string",
    "op10_shards": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Odd documents, hot groups of exact and near copies, a hot source, labels of both kinds, and pages."""
    r = random.Random(11)
    good = "the cat sat on a mat and it was fine while the old dog slept near the warm stove in our house".split()
    prose = lambda n: " ".join(r.choices(good, k=n)).capitalize() + "."
    texts = [prose(r.randint(20, 90)) for _ in range(150)]
    texts += [" ".join(f"{x}###" for x in r.choices("buy now win cash".split(), k=30)) for _ in range(60)]
    texts += [texts[0]] * 60 + [texts[1] + " " + x for x in r.choices(good, k=40)] + [texts[i] + f" Mail a{i}@mail.example.com or Mr. John Smith; Smith waits." for i in range(2, 12)]
    texts += [None, "", " \n\t", "é漢字 ok", "Der Hund und die Katze sind in dem Haus. " * 400]
    rows = [(i, t, "de" if t and "Hund" in t else "en", None if i % 11 == 0 else "hot" if i % 3 else f"s{i % 4}", len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[3], (3, "Other words under an id that another row has, and more of them.", "en", "hot", 60), (None, "A text without an id, but with a source.", "en", "s1", 40)]
    where = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5).write.parquet(f"{where}/documents.parquet")
    labels = [(i, int(not (150 <= i < 210)), 0) for i in range(210)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    page = lambda i: f"<body><nav><ul><li>Home</li><li>Topic {i % 3}</li></ul></nav><div class='ad'>Buy {i % 2}</div><article><h1>Title {i}</h1><p>{texts[i]}</p></article><footer>all rights</footer></body>"
    spark.createDataFrame([(i, f"http://one.org/{i}" if i < 40 else f"http://two.org/{i}", page(i)) for i in range(44)], "page_id long, url string, html string").write.parquet(f"{where}/pages.parquet")
    return str(where)


def documents(spark, tables):
    return spark.read.parquet(f"{tables}/documents.parquet").collect()


@pytest.mark.parametrize("name", sorted(TYPES))
def test_contract_columns(spark, tables, name):
    out = QUERIES[name](spark, tables)
    assert ", ".join(f"{n} {t}" for n, t in out.dtypes) == TYPES[name]
    assert out.count() == (44 if name == "op9_main_text" else len(documents(spark, tables)))


@pytest.mark.parametrize("name", sorted(TYPES))
def test_queries_on_empty_tables(spark, tables, tmp_path, name):
    for t in ("documents", "labels", "pages"):
        spark.read.parquet(f"{tables}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    out = QUERIES[name](spark, str(tmp_path))
    assert out.count() == 0 and ", ".join(f"{n} {t}" for n, t in out.dtypes) == TYPES[name]


def crc(i, m):
    return None if i is None else zlib.crc32(str(i).encode()) % m


def test_held_out_and_null_ids(spark, tables):
    for x in QUERIES["op1_language_id"](spark, tables).collect():
        assert x.held_out == (crc(x.doc_id, 4) == 2) and 0 <= x.score <= 1
    for x in QUERIES["op2_quality_classifier"](spark, tables).collect():
        assert x.held_out == (crc(x.doc_id, 5) == 0) and x.predicted == (x.score >= 0.3) and 0 <= x.score <= 1


def slow_mass(sizes, target, most=3.0):
    """Rates nearest to 1 in relative entropy with this total: the slope by halving, over rows one by one."""
    rate = lambda s, x: min(most, math.exp(min(s * x, 50)))
    low, high = -50.0, 50.0
    for _ in range(200):
        x = (low + high) / 2
        low, high = (x, high) if sum(s * rate(s, x) for s in sizes) < target else (low, x)
    return lambda s: rate(s, (low + high) / 2) if s else 1.0


def check_mix(rows, taken_of):
    """rows: (size, source, copies or words taken); the totals are near and copies follow the rates."""
    by = defaultdict(list)
    for size, source, _ in rows:
        by[source].append(size)
    goal = mixing.targets([(s, sum(v)) for s, v in by.items()])
    for source, sizes in by.items():
        mine = [(size, taken_of(x)) for size, s, x in rows if s == source]
        assert abs(sum(size * n for size, n in mine) - goal[source]) <= max(sizes, default=0)
        if sum(sizes) and goal[source] < 3 * sum(sizes):
            rate = slow_mass(sizes, goal[source])
            for size in set(sizes):
                copies = [n for s, n in mine if s == size]
                assert abs(sum(copies) - len(copies) * rate(size)) < 1 + 1e-3 * len(copies) and max(copies) - min(copies) <= 1


def test_mix_against_an_independent_solution(spark, tables):
    source = Counter((x.doc_id, len(WORD.findall(x.text or "")), x.source) for x in documents(spark, tables))
    got = QUERIES["op4_source_mix"](spark, tables).collect()
    names = {(i, n): s for i, n, s in source}
    check_mix([(x["size"], names[x.doc_id, x["size"]], x.taken // x["size"] if x["size"] else 1) for x in got], lambda n: n)


def test_surrogates_and_tokens_of_queries(spark, tables):
    s = pii.Surrogates(SURROGATE_KEY)
    want = Counter((x.doc_id, None if x.text is None else pii.rewrite(x.text, s)[0]) for x in documents(spark, tables))
    assert Counter((x.doc_id, x.text) for x in QUERIES["op3_pii_surrogates"](spark, tables).collect()) == want
    enc = bpe.Codec(bpe.read_ranks(RANKS), P.PATTERN).encoder
    ids = lambda t: enc.encode_ordinary(t or "")
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = Counter((x.doc_id, len(ids(x.text)), sha(b"".join(i.to_bytes(4, "little") for i in ids(x.text))), sha((x.text or "").encode())) for x in documents(spark, tables))
    assert Counter(map(tuple, QUERIES["op7_byte_bpe"](spark, tables).collect())) == want


def test_components_of_query(spark, tables):
    docs = documents(spark, tables)
    fps = {x.text: slow_simhash(x.text) for x in docs}
    least = {}
    for group in slow_components(set(fps.values())):
        ids = [x.doc_id for x in docs if fps[x.text] in group and x.doc_id is not None]
        least |= {f: min(ids, default=None) for f in group}
    want = Counter((x.doc_id, f"{fps[x.text]:016x}", least[fps[x.text]]) for x in docs)
    assert Counter(map(tuple, QUERIES["op6_simhash"](spark, tables).collect())) == want


def test_shards_follow_the_matrix(spark, tables):
    """Every row once, sizes exact, and over many seeds each row is as often in each shard."""
    got = QUERIES["op10_shards"](spark, tables).collect()
    n = Counter(x.shard for x in got)
    assert sorted(n) == list(range(24)) and max(n.values()) - min(n.values()) <= 1
    assert all(sorted(x.slot for x in got if x.shard == s) == list(range(n[s])) for s in n)
    df = spark.range(12).select(F.col("id").alias("doc_id"), F.lit("t").alias("text")).cache()
    seen = Counter()
    for seed in range(60):
        seen.update((x.doc_id, x.shard) for x in sharding.assign(df, 3, seed=1000 * seed, rows=2, most=4).collect())
    assert all(abs(seen[i, s] - 20) < 5 * (60 * 2 / 9) ** 0.5 for i in range(12) for s in range(3))


def test_large_blocks_are_ordered_in_ranges(spark):
    """With few blocks and chunks, each is cut by hash; the law still holds."""
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("same").alias("text"))
    got = sharding.assign(df, 4, rows=20, most=8).collect()
    by = defaultdict(list)
    for x in got:
        by[x.shard].append(x.slot)
    assert all(sorted(v) == list(range(750)) for v in by.values()) and len({x.doc_id for x in got}) == 3000


def slow_entropy(counts, words, order=5):
    """Mean negative log-probability of interpolated Kneser-Ney, straight from the definition."""
    grams = [defaultdict(Counter) for _ in range(order)]  # by order: context -> character -> count
    for w, n in counts.items():
        t = "\0" + w + "\0"
        for i in range(1, len(t)):
            for k in range(order):
                if i - k >= 0 and (k == 0 or "\0" not in t[i - k + 1 : i]):
                    grams[k][t[i - k : i]][t[i]] += n
    level = [None] * order
    for k in range(order):
        level[k] = defaultdict(dict)
        for context, nexts in grams[k].items():
            for c, n in nexts.items():
                before = {x[0] for x, m in grams[k + 1].items() if x[1:] == context and c in m} if k < order - 1 else None
                starts = k > 0 and context.startswith("\0")
                level[k][context][c] = n if before is None or starts else max(1, len(before))

    def discount(k):
        all_ = [n for m in level[k].values() for n in m.values()]
        n1, n2 = all_.count(1), all_.count(2)
        return n1 / (n1 + 2 * n2) if n1 and n2 else 0.5

    d = [discount(k) for k in range(order)]
    kinds = len(level[0][""])

    def p(k, context, c):
        below = 1 / (kinds + 2) if k == 0 else p(k - 1, context[1:], c)
        m = level[k].get(context)
        if not m:
            return below
        total = sum(m.values())
        return max(m.get(c, 0) - d[k], 0) / total + d[k] * len(m) / total * below

    total, n = 0.0, 0
    for w in words:
        t = "\0" + w + "\0"
        for i in range(1, len(t)):
            context = t[max(0, i - order + 1) : i]
            total -= math.log(p(len(context), context, t[i]))
            n += 1
    return total / n


def test_kneser_ney_against_the_definition():
    r = random.Random(5)
    counted = {k: Counter("".join(r.choices(a, k=r.randint(1, 7))) for _ in range(60)) for k, a in (("aa", "abcde"), ("bb", "cdefg"))}
    scorer = language.Scorer(language.build(counted))
    words = ["".join(r.choices("abcdefgh", k=r.randint(1, 9))) for _ in range(40)] + list(counted["aa"])[:10]
    for w in words:
        got = scorer.entropies([w])[0]
        assert [float(x) for x in got] == pytest.approx([slow_entropy(counted[k], [w]) for k in ("aa", "bb")], rel=2e-5)


@pytest.mark.parametrize("text", ["²³ ½", "Ⅷ", "①②", "123", "_", "", None])
def test_no_letter_is_undetermined(text):
    model = language.build({"x": Counter({"word": 2})})
    model.most = [math.inf]
    assert language.Scorer(model).predict([text])[0][:2] == ("und", 0.0)
    assert language.words_of("x²y ª ñandú Ⅷz") == ["x", "y", "ª", "ñandú", "z"]


def slow_train(texts, labels, p, seed=0):
    """The updates with dictionaries, one weight after another."""
    import numpy as np

    codes = quality_model._Codes()
    rows = []
    for t in texts:
        x = defaultdict(float)
        for at, v in zip(*quality_model.features(t, codes), strict=True):
            x[int(at)] += float(v)
        rows.append(dict(x))
    rate = (sum(labels) + 1) / (len(labels) + 2)
    start, z, n = math.log(rate / (1 - rate)), defaultdict(float), defaultdict(float)
    weight = lambda i, l1, l2: 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((p.beta + math.sqrt(n[i])) / p.alpha + l2)
    rng = np.random.default_rng(seed)
    for _ in range(p.epochs):
        for i in rng.permutation(len(rows)):
            w = {k: weight(k, p.l1, p.l2) for k in rows[i]} | {"b": weight("b", 0.0, 0.0)}
            x = rows[i] | {"b": 1.0}
            error = 1 / (1 + math.exp(-(start + sum(w[k] * x[k] for k in x)))) - labels[i]
            for k, v in x.items():
                g = error * v
                z[k] += g - (math.sqrt(n[k] + g * g) - math.sqrt(n[k])) / p.alpha * w[k]
                n[k] += g * g
    return {k: weight(k, p.l1, p.l2) for k in list(z) if k != "b"}, start + weight("b", 0.0, 0.0)


def test_follow_the_regularised_leader_against_the_definition():
    texts = ["the cat sat here", "buy now ### now", "a dog, a cat", "win cash now now now", "", "the end of it"]
    labels = [1, 0, 1, 0, 0, 1]
    p = quality_model.Training()
    w, b = quality_model.train(texts, labels, p)
    slow, slow_b = slow_train(texts, labels, p)
    assert b == pytest.approx(slow_b) and {i for i in w.nonzero()[0]} == {k for k, v in slow.items() if v}
    assert all(w[k] == pytest.approx(v) for k, v in slow.items())


def test_cross_validation():
    texts = ["the cat sat on the mat"] * 20 + ["buy ### now win"] * 20
    (loss, right), (worse, _) = quality_model.cross_validate(texts, [1] * 20 + [0] * 20, [i % 4 for i in range(40)], [quality_model.Training(), quality_model.Training(alpha=1e-3)])
    assert right == 1 and loss < worse


@pytest.mark.parametrize("names", [True, False])
def test_tree_decides_alone_where_it_can(spark, tables, names):
    pages = spark.read.parquet(f"{tables}/pages.parquet")
    got = {x.page_id: x for x in site_style.extract(pages, names=names).collect()}
    texts = {x.doc_id: x.text for x in documents(spark, tables)}
    for i in range(40):  # without the lists of names too
        body = " ".join((texts[i] or "").split())
        assert got[i].text == f"Title {i}\n\n{body}" and got[i].decided_by == "tree"
    assert all(got[i].decided_by == ("names" if names else "nothing") for i in range(40, 44))


# The pipeline


def stages(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    out = []
    for _, f in corpus_pipeline.STAGES:
        before, docs = docs, f(spark, docs, tables).cache()
        out.append((before.collect(), docs.collect()))
    return out


def wide_components(fps):
    """All pairs: one part differs in three bits at most, all parts together in MOST_WIDE_BITS."""
    fps, parent = sorted(fps), {}

    def find(x):
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[:i]:
            bits = [(x ^ y).bit_count() for x, y in zip(a, b, strict=True)]
            if min(bits) <= 3 and sum(bits) <= simhash.MOST_WIDE_BITS:
                parent[find(a)] = find(b)
    groups = defaultdict(set)
    for x in fps:
        groups[find(x)].add(x)
    return list(groups.values())


def test_near_copies_by_wide_fingerprints(spark):
    """Copies with one word in a hundred replaced are found, texts that share a third of their words are not."""
    r = random.Random(9)
    word = lambda: "".join(r.choices("abcdefghijklmnop", k=r.randint(2, 9)))
    texts, copies = [[word() for _ in range(r.randint(80, 400))] for _ in range(60)], []
    for t in texts:
        c = list(t)
        for i in r.sample(range(len(c)), max(1, len(c) // 100)):
            c[i] = word()
        copies.append(c)
    other = [t[: len(t) // 3] + [word() for _ in range(2 * len(t) // 3)] for t in texts]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)] + [(100 + i, " ".join(t)) for i, t in enumerate(copies)] + [(200 + i, " ".join(t)) for i, t in enumerate(other)]
    rows += [(300, "All The Same"), (301, "all the same"), (302, " all\tthe same "), (303, None), (304, "")]
    kept = {x.doc_id for x in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {*range(60), *range(200, 260), 300, 303} <= kept and not kept & {301, 302, 304}
    assert len(kept & set(range(100, 160))) <= 20


def test_pipeline_against_rows_one_by_one(spark, tables):
    quality, near, private, mix, tokens = stages(spark, tables)
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    labels = spark.read.parquet(f"{tables}/labels.parquet").filter("crc32(cast(cast(doc_id as string) as binary)) % 5 != 0")
    w, b = quality_model.fit(docs, labels)
    codes = quality_model._Codes()

    def passes(t):
        at, v = quality_model.features(t, codes)
        return 1 / (1 + math.exp(-(b + float(w[at] @ v)))) >= 0.3

    assert Counter(quality[1]) == Counter(x for x in quality[0] if passes(x.text))

    fps = {x.text: tuple(simhash.wide_simhash(x.text and x.text.encode())) for x in near[0]}
    assert all(f[0] == slow_simhash(t) for t, f in fps.items())
    want, kept = Counter(), Counter()
    for group in wide_components(set(fps.values())):
        mine = [x for x in near[0] if fps[x.text] in group]
        least = min((x.doc_id is None, x.doc_id or 0) for x in mine)
        want[least] += 1
        now = [x for x in near[1] if fps[x.text] in group]
        assert len(now) == 1 and now[0] in mine
        kept[now[0].doc_id is None, now[0].doc_id or 0] += 1
    assert kept == want

    s = pii.Surrogates(SURROGATE_KEY)
    new = lambda t: None if t is None else pii.rewrite(t, s)[0]
    assert Counter((x.doc_id, x.text, x.n_chars) for x in private[1]) == Counter((x.doc_id, new(x.text), None if x.text is None else len(new(x.text))) for x in private[0])

    times = Counter(mix[1])
    assert set(times) <= set(mix[0])
    check_mix([(len(WORD.findall(x.text or "")), x.source, times[x]) for x in mix[0]], lambda n: n)

    enc = bpe.Codec(bpe.read_ranks(RANKS), P.PATTERN).encoder
    row = lambda x: (x.doc_id, x.source, tuple(enc.encode_ordinary(x.text or "")), hashlib.sha256((x.text or "").encode()).hexdigest())
    assert Counter((x.doc_id, x.source, tuple(x.ids), x.decoded_sha256) for x in tokens[1]) == Counter(map(row, tokens[0]))
    assert all(x.n_tokens == len(x.ids) for x in tokens[1])


def test_pipeline_runs_whole_and_on_empty_tables(spark, tables, tmp_path):
    assert corpus_pipeline.run(spark, tables).count() > 0
    for t in ("documents", "labels"):
        spark.read.parquet(f"{tables}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_one_of_each_group_by_id_and_text(spark):
    """Rows that share an id with a copy, or with each other, are not lost."""
    long = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    other = "wholly other words that nothing else in this table repeats at all"
    for rows, want in [([(1, long), (1, other), (2, long)], {(1, long), (1, other)}), ([(9, long), (3, long), (9, other)], {(3, long), (9, other)}), ([(None, long), (5, long), (None, other)], {(5, long), (None, other)})]:
        for _ in range(2):
            got = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
            assert sorted(map(str, got)) == sorted(f"Row(doc_id={i}, text={t!r})" for i, t in want)


CLASHES = ("unit from gone size source_size target copies taken place start n slope h i t o r p chunk block key x root node fp mask a b u v w l y shard slot first host same rows "
           "_none _source _bucket _order _place _row _copy _t _h _p _block _chunk _host _gone _found _digest _pii _lang _rules _held _id _text _hash _range _peek _a _row_a _row_b")  # fmt: skip


def test_columns_of_any_name_pass_through(spark):
    extra = {f"`{n}`": i for i, n in enumerate(CLASHES.split())}
    df = spark.createDataFrame([(1, "one two three", "en", "s"), (2, "x y z", "de", "q"), (2, None, None, None)], "doc_id long, text string, lang string, source string")
    df = df.select("*", *[F.lit(i).alias(n.strip("`")) for n, i in extra.items()])
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    outs = {
        "mixing": (mixing.mix(df), mixing.RESULTS),
        "repeat": (mixing.repeat_rows(df), ()),
        "sharding": (sharding.assign(df, 2), ("shard", "slot")),
        "keep_one": (simhash.keep_one(df), ()),
        "pii": (pii.pseudonymize(df, b"k"), ()),
        "bpe": (bpe.round_trip(df, RANKS, P.PATTERN, ids="ids"), ()),
        "language": (language.identify(df, language.fit(df)), ()),
        "quality": (quality_model.classify(df, labels), ()),
        "site": (site_style.extract(df, "text", "source"), ()),
    }
    for name, (out, replaced) in outs.items():
        rows = out.collect()
        kept = [n for n in CLASHES.split() if n not in replaced]
        assert rows and all(r[n] == extra[f"`{n}`"] for r in rows for n in kept if n in out.columns), name
        assert set(kept) <= set(out.columns), (name, set(kept) - set(out.columns))
    assert simhash.near_duplicates(df).count() == 3 and multiset.compare_edited(df).count() == 3


def test_operators_leave_the_session_as_it_is(spark, tables):
    before = dict(spark.sparkContext._conf.getAll()), spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for name in ("op6_simhash", "op7_byte_bpe"):
        QUERIES[name](spark, tables).collect()
    assert before == (dict(spark.sparkContext._conf.getAll()), spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))


def test_neighbours_of_hot_and_null_ids(spark):
    """A third of the rows under one id and a third under none: several ranges each, and still every next row."""
    r = random.Random(8)
    rows = [(r.choice([7, None, r.randint(-50, 50)]), f"text {r.randint(0, 10**6)}") for _ in range(600)]
    import xxhash

    signed = lambda t: (lambda h: h - (h >> 63 << 64))(xxhash.xxh64_intdigest(t.encode(), 42))
    order = sorted(rows, key=lambda x: (x[0] is None, -(x[0] or 0), signed(x[1]), x[1]))
    want = Counter((i, hashlib.sha256(multiset.edited(t, order[(k + 1) % len(order)][1]).encode()).hexdigest()) for k, (i, t) in enumerate(order))
    got = multiset.compare_edited(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert Counter((x.doc_id, x.edited_sha256) for x in got) == want
    with pytest.raises(TypeError, match="whole numbers"):
        multiset.compare_edited(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


def test_encoder_is_that_of_the_library():
    c = bpe.Codec(bpe.read_ranks(RANKS), P.PATTERN)
    assert isinstance(c.encoder, tiktoken.Encoding) and bpe.LEAF <= 256
    with pytest.raises(ValueError, match="leaves characters out"):
        bpe.Codec(bpe.read_ranks(RANKS), r"[a-z]+").encode("ab 12")
    assert re.fullmatch(r"[0-9a-f]{64}", hashlib.sha256(c.encode("x" * 1000).tobytes()).hexdigest())


def test_hot_groups_over_many_partitions(spark):
    """A third of the rows are copies of one text, a third near copies of another, in 211 partitions."""
    r = random.Random(21)
    word = lambda: "".join(r.choices("abcdefghijklmnop", k=r.randint(2, 9)))
    near, same = [word() for _ in range(300)], " ".join(word() for _ in range(100))
    rows = [(3 * i, same, "s", "hot") for i in range(400)]
    for i in range(400):
        t = list(near)
        t[r.randrange(300)] = word()
        rows.append((3 * i + 1, " ".join(t), "s", "hot"))
    rows += [(3 * i + 2, " ".join(word() for _ in range(r.randint(20, 60))), "s", r.choice("ab")) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(211)
    for large in (simhash.LARGE, 50):  # as it is, and with blocks that are crowded
        kept = [x.doc_id for x in simhash.keep_one(df, large=large).collect()]
        fps = {x[0]: tuple(simhash.wide_simhash(x[1].encode())) for x in rows}
        groups = wide_components(set(fps.values()))
        assert len(kept) == len(groups) < 500 and {min(i for i, f in fps.items() if f in g) for g in groups} == set(kept)
    got = mixing.mix(df).collect()
    check_mix([(x["size"], x.source, x.copies) for x in got], lambda n: n)
