"""Each operator on odd rows and an empty table, and against brute force on small tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import public_tokenizers as P
import xxhash
from pyspark.sql import functions as F

from quern.llm import bpe, components, language, mixing, multiset, pii, quality_model, quality_rules, sharding, simhash

RANKS = P.path("byte_bpe_50k.tiktoken")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


# Quality rules


def counts(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    seen = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    return len(w), sum(map(len, w)), sum(c in quality_rules.SYMBOLS for c in text), len(lines) - len(set(lines)), len(covered)


def test_rules(spark, odd, empty):
    r = random.Random(5)
    texts = [" ".join(r.choice("ab") for _ in range(r.randint(0, 40))) for _ in range(60)] + ["a\na\n \na|#", "x " * 9 + "\nx y z"]
    df = spark.createDataFrame([(100 + i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for x in quality_rules.apply_rules(df).collect() + quality_rules.apply_rules(odd).collect():
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == counts(x.text)
        assert x.base_failed == (x.n_words < 10 or 100 * x.n_repeat_words > 20 * x.n_words) and not (x.kept and x.base_failed)
    kept = {x.doc_id for x in quality_rules.apply_rules(odd).filter("kept").collect()}
    assert {1, 5} <= kept and not kept & {2, 3, 4, 7}
    assert quality_rules.apply_rules(empty).count() == 0
    plan = quality_rules.apply_rules(odd)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Exchange" not in plan.split("Physical Plan")[-1]


# SimHash


def slow_simhash(text):
    w = WORD.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("text", [None, "", " \t", "One", "one two", "A b C", "x y z w É É", "\x1c a\x85b c d"])
def test_fingerprint(text):
    assert simhash.simhash(None if text is None else text.encode()) == slow_simhash(text)


def slow_components(fps):
    parent = {x: x for x in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in fps:
        for b in fps:
            if (a ^ b).bit_count() <= 3:
                parent[find(a)] = find(b)
    groups = {}
    for x in fps:
        groups.setdefault(find(x), set()).add(x)
    return sorted(map(sorted, groups.values()))


@pytest.mark.parametrize("large", [4096, 8])
def test_links_connect_all_near_pairs(spark, large):
    r = random.Random(large)
    fps = set()
    for _ in range(40):
        x = r.getrandbits(64)
        fps.add(x)
        for _ in range(r.randint(0, 12)):
            x ^= sum(1 << b for b in r.sample(range(64), r.randint(1, 4)))
            fps.add(x)
    hot = r.getrandbits(64)  # many that share most blocks
    fps |= {hot ^ sum(1 << b for b in r.sample(range(20), r.randint(0, 3))) for _ in range(120)}
    signed = lambda x: x - (x >> 63 << 64)
    df = spark.createDataFrame([(2, signed(x)) for x in fps], "part long, fp long")
    edges = simhash.links(df, large)
    assert all(((x.a ^ x.b) & (1 << 64) - 1).bit_count() <= 3 and x.part == 2 for x in edges.collect())
    assert {(x.part, x.a) for x in simhash.links(df.union(df.withColumn("part", F.lit(1).cast("long"))), large).collect()} >= {(p, x.a) for x in edges.collect() for p in (1, 2)}
    got = {}
    for x in components.components(edges).collect():
        got.setdefault(x.root, set()).add(x.node)
    alone = {signed(x) for x in fps} - {n for g in got.values() for n in g}
    want = [[signed(x) for x in g] for g in slow_components(fps)]
    assert sorted(map(sorted, [*got.values(), *({x} for x in alone)])) == sorted(map(sorted, want))


def test_components_of_a_path(spark):
    n = 70
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(200, 201), (201, 200), (5, 5), (None, 3)], "a long, b long")
    got = {r.node: r.root for r in components.components(edges).collect()}
    assert got == {**{i: 0 for i in range(n + 1)}, 200: 200, 201: 200}
    assert components.components(edges.limit(0)).count() == 0


def test_near_duplicates_of_odd_rows(odd, empty):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    by = {r.doc_id: r.component_id for r in got}
    assert by[2] == by[3] == by[4] == 2 and by[1] == 1 and by[None] is None
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.keep_one(odd)
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 5, 6, 7, 8] and kept.columns == odd.columns


# Byte-level BPE


def test_bpe_tree():
    c = bpe.Codec(bpe.read_ranks(RANKS), P.PATTERN)
    r = random.Random(1)
    texts = ["".join(r.choice("ab  \n\t '’sré1!?　​漢") for _ in range(r.randint(0, 300))) for _ in range(300)]
    texts += [" " * 500, "a" * 700, " \n" * 300, "x" * 200 + " " * 300 + "y", "it's " * 100]
    for t in texts:
        for leaf in (3, 40):
            assert c.encode(t, leaf).tolist() == c.encoder.encode_ordinary(t)
        assert c.decode(c.encode(t), 7) == t.encode()


def test_bpe_odd_rows(odd, empty):
    for x in bpe.round_trip(odd, RANKS, P.PATTERN).collect():
        assert x.decoded_sha256 == hashlib.sha256((x.text or "").encode()).hexdigest() and (x.n_tokens == 0) == (not x.text)
    back = bpe.decode(bpe.encode(odd, RANKS, P.PATTERN), RANKS, P.PATTERN)
    assert all(bytes(x.decoded).decode() == (x.text or "") for x in back.collect())
    assert bpe.round_trip(empty, RANKS, P.PATTERN).count() == 0


# Language


def test_language(spark, odd, empty):
    r = random.Random(2)
    words = {"aa": "katu melo sani doru kale mito".split(), "bb": "strng plfft grmph tschk wrzl brxt".split()}
    rows = [(i, " ".join(r.choices(words[k], k=20)), k) for i in range(120) for k in ["aa" if i % 2 else "bb"]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(docs.filter("doc_id < 80"))
    got = language.identify(docs.filter("doc_id >= 80"), model).collect()
    assert all(x.lang_pred == x.lang and 0.5 < x.score <= 1 for x in got)
    other = language.identify(spark.createDataFrame([(1, "öäüß ñçé " * 9)], "doc_id long, text string"), model, reject=True).first()
    assert other.rejected and other.lang_pred == "und"
    rows = {(x.doc_id, x.text): x for x in language.identify(odd, model).collect()}
    for k in ((2, None), (3, ""), (4, "  \n\t "), (7, "1234 !!! ###")):
        assert rows[k].lang_pred == "und" and rows[k].score == 0
    assert language.identify(empty, model).count() == 0
    assert language.fit(empty) is None and {x.lang_pred for x in language.identify(odd, None).collect()} == {"und"}


def test_kneser_ney_adds_up():
    """Over all characters that may follow, probabilities add up to 1 at most and nearly 1 with the unseen ones."""
    words = Counter({"abab": 3, "abba": 2, "ba": 5, "cab": 1})
    m = language.build({"x": words})
    alphabet = ["a", "b", "c"]
    total = lambda w: float(np.exp(m.words([w])[0][0, 0]))
    # the probability of a word is that of its characters and its end; all words of up to four letters
    import itertools

    mass = sum(total("".join(x)) for n in range(1, 8) for x in itertools.product(alphabet, repeat=n))
    assert 0.7 < mass <= 1.0001
    assert total("abab") > total("bbbb")


# Quality classifier


def test_classifier(spark, odd, empty):
    r = random.Random(4)
    good = lambda: " ".join(r.choices("the cat sat on a mat and it was fine".split(), k=30))
    bad = lambda: " ".join(f"{x}###" for x in r.choices("buy now win cash".split(), k=30))
    rows = [(i, good() if i % 2 else bad()) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(140)] + [(3, None, 0), (None, 1, 0), (9999, 1, 0), (5, 7, 0)], "doc_id long, quality int, toxic int")
    got = {x.doc_id: x for x in quality_model.classify(docs, labels).collect()}
    assert all(got[i].predicted == i % 2 and 0 <= got[i].score <= 1 for i in range(140, 200))
    again = {x.doc_id: x.score for x in quality_model.classify(docs.repartition(3), labels).collect()}
    assert all(abs(again[i] - got[i].score) < 1e-9 for i in again)
    assert quality_model.classify(odd, labels).count() == odd.count() and quality_model.classify(empty, labels).count() == 0
    assert {x.score for x in quality_model.classify(odd, labels.limit(0)).collect()} == {0.5}
    bounded = quality_model.classify(docs, labels, p=quality_model.Training(most_rows=40))
    assert bounded.filter("doc_id >= 140 and predicted = doc_id % 2").count() > 50


# Surrogates

PII_TEXT = "Mr. John Smith (john.smith@mail.com, +1 (017) 555-7713) paid with 4111 1111 1111 1111 from 97.51.17.173; Mrs Smith wrote to John.Smith@mail.com. token = \"24be64439e3e49cf46b2d7c90f3602a3d0b907ff\" GB82 WEST 1234 5698 7654 32"


def test_surrogates():
    s = pii.Surrogates(b"key")
    new, found = pii.rewrite(PII_TEXT, s)
    assert Counter(k for k, *_ in found) == {"person": 2, "email": 2, "phone": 1, "card": 1, "ipv4": 1, "secret": 1, "iban": 1}
    assert not any(old in new for *_, old, _ in found) and pii.rewrite(PII_TEXT, pii.Surrogates(b"other"))[0] != new
    pairs = {old: n for *_, old, n in found}
    assert pii.luhn(re.sub(" ", "", pairs["4111 1111 1111 1111"])) and pairs["John Smith"].endswith(pairs["Smith"])
    assert pairs["john.smith@mail.com"].lower() == pairs["John.Smith@mail.com"].lower()  # one entity
    assert pairs["John Smith"].split()[0] in set(pii.GIVEN["latin", "m"].split()) - {"John"}
    assert pii.rewrite(PII_TEXT, pii.Surrogates(b"key"))[0] == new
    plain = "Version 3.5 of chapter 12, in 1999, took 4.0. Mr went."
    assert pii.rewrite(plain, s) == (plain, [])


def test_surrogates_are_distinct():
    s = pii.Surrogates(b"key")
    for kind, values in {"card": [f"{i:016d}" for i in range(3000)], "ipv4": [f"10.0.{i // 250}.{i % 250}" for i in range(3000)], "phone": [f"+1 (555) {i:03d}-0000" for i in range(1000)], "email": [f"a{i}@b.co" for i in range(3000)], "secret": [f"{i:08x}" * 4 for i in range(3000)]}.items():
        new = {s.of(kind, v) for v in values}
        assert len(new) == len(values)
    for (script, gender), names in pii.GIVEN.items():
        assert {s.given(n, gender) for n in names.split()} == set(names.split()) and all(s.given(n, gender) != n for n in names.split())
    r = random.Random(3)
    names = {"".join(r.choice("abcdeimnorst") for _ in range(r.randint(1, 7))).title() for _ in range(4000)} | {"Müller", "Zoë", "Chloé", "Smith"}
    assert len({s.surname(n) for n in names}) == len(names) == len({s.given(n, g) for n in names for g in ["f"]})
    assert len({*(s.surname(n) for n in names), *(s.given(n, "m") for n in names - s.listed - {"Zoë", "Chloé", "Müller"})}) >= 2 * len(names) - 40


def test_composed_names_are_in_no_list():
    s = pii.Surrogates(b"key")
    for script, (_, consonants, vowels) in pii.LETTERS.items():
        for tail in [*pii.TAILS[script].values(), *(["ск" + e for e in pii.ENDINGS if e[0] != "с"] if script == "cyrillic" else [])]:
            pattern = re.compile(f"[{consonants}](?:[{vowels}][{consonants}])*[{vowels}]?{tail}")
            assert not [n for n in s.listed if pattern.fullmatch(n)]
    given = [n.lower() for names in s.lists.values() for n in names]
    assert len(given) == len(set(given)) and not {n.lower() for names in s.surnames.values() for n in names} & set(given)


@pytest.mark.parametrize(
    "text, names",
    [
        ("Mr. John Smith met us. Smith said hello. John left; Smith's dog.", ["John", "Smith"]),
        ("Dr. Anna Weber and Prof. Karl Otto wrote. Then Weber, with Anna.", ["Anna", "Weber", "Karl", "Otto"]),
        ("Herr Prof. Dr. Müller sagte es. Müller ging.", ["Müller"]),
        ("Mrs. Anna-Maria O'Neil", ["Anna", "Maria", "Neil"]),
        ("Господин Петров и Госпожа Петрова. Петров ушёл.", ["Петров", "Петрова"]),
    ],
)
def test_later_mentions_of_a_person(text, names):
    new, found = pii.rewrite(text, pii.Surrogates(b"key"))
    assert not any(re.search(rf"(?<!\w){n}(?!\w)", new) for n in names)
    by = {}
    for _, start, end, old, to in found:
        assert text[start:end] == old and by.setdefault(old, to) == to
    if "Петров" in by:  # one family, in both genders
        assert by["Петрова"] == by["Петров"] + "а"
    if "Karl Otto" in by:  # the gender comes from the given name
        assert by["Anna Weber"].split()[0] in pii.GIVEN["latin", "f"] and by["Karl Otto"].split()[0] in pii.GIVEN["latin", "m"]


def test_numbers_with_spaces_and_ipv6():
    s = pii.Surrogates(b"key")
    new, found = pii.rewrite("Call 555 123 4567, host 2001:db8::1 (also 2001:DB8:0:0:0:0:0:1), fd00::12; at 12:30:45 a::b dead::beef 10 200 300 4000", s)
    assert [k for k, *_ in found] == ["phone", "ipv6", "ipv6", "ipv6"] and "12:30:45 a::b dead::beef 10 200 300 4000" in new
    assert re.search(r"Call \d{3} \d{3} \d{4},", new) and found[1][4].startswith("2001:db8:") and found[3][4].startswith("fd")
    assert found[1][4].lower() == found[2][4].lower()  # one address, spelled in two ways
    assert len({s.ipv6(f"2001:db8::{i:x}") for i in range(2000)}) == 2000


def test_a_collision_is_an_error(spark, monkeypatch):
    df = spark.createDataFrame([(1, "a1@b.co"), (2, "a2@b.co")], "doc_id long, text string")
    assert pii.checked(df, b"key").count() == 2
    assert pii.collisions(df, b"key").count() == 0
    monkeypatch.setattr(pii, "collisions", lambda *a: spark.createDataFrame([("email", "x@y.z", 2)], "kind string, surrogate string, n long"))
    with pytest.raises(ArithmeticError, match="x@y.z"):
        pii.checked(df, b"key")


def test_surrogates_odd_rows(spark, odd, empty):
    df = odd.unionByName(spark.createDataFrame([(50, PII_TEXT)], "doc_id long, text string"), allowMissingColumns=True)
    got = {x.doc_id: x for x in pii.pseudonymize(df, b"key").collect()}
    before = {x.doc_id: x.text for x in odd.collect()}
    assert all(got[i].text == t and got[i].n_entities == 0 for i, t in before.items())
    assert got[50].n_entities == 9 and got[50].n_collisions == 0 and len(got[50].spans) == 9
    assert pii.collisions(df, b"key").count() == 0 and pii.pseudonymize(empty, b"key").count() == 0


# Mixing


def test_targets():
    assert mixing.targets([("b", 100), ("a", 100), (None, 100)]) == {"a": 50.0, "b": 100.0, None: 150.0}
    t = mixing.targets([("a", 1000), ("b", 1), ("c", 1000)])
    assert t["b"] == 3.0 and abs(sum(t.values()) - 2001) < 1e-6 and abs(t["c"] / t["a"] - 3) < 1e-9
    assert mixing.targets([]) == {} and mixing.targets([("a", 0)]) == {"a": 0.0}


def test_mix(spark, odd, empty):
    r = random.Random(6)
    rows = [(i, "w " * r.randint(0, 60), r.choice(["a", "b", None, "b", "b"])) for i in range(900)] + [(5000 + i, "same words here", "b") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows) and all(0 <= x.copies <= 3 and x.taken == x["size"] * x.copies for x in got)
    for s in ("a", "b", None):
        mine = [x for x in got if x.source == s]
        assert abs(sum(x.taken for x in mine) - mine[0].target) <= 60 and sum(x["size"] for x in mine) == mine[0].source_size
    key = lambda rows: sorted((x.doc_id, x.taken) for x in rows)
    assert key(mixing.mix(docs.repartition(7)).collect()) == key(got)
    out = mixing.mix(odd)
    assert out.count() == odd.count() and mixing.mix(empty).count() == 0
    assert mixing.repeat_rows(out.filter("copies > 0")).count() == out.agg(F.sum("copies")).first()[0]


def test_mix_meets_target_beside_one_very_long_text(spark):
    """The long text's source is to give 0.1 of its words, the other 2.8 times its own."""
    r = random.Random(7)
    rows = [(0, "w " * 200_000, "a")] + [(i, "w " * r.randint(60, 140), "a" if i <= 1000 else "b") for i in range(1, 2501)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), weights=(1, 14)).collect()
    for s in ("a", "b"):
        mine = [x for x in got if x.source == s]
        assert abs(sum(x.taken for x in mine) - mine[0].target) <= 140 and (s == "b" or mine[0].target < 0.1 * mine[0].source_size)


def test_slopes_meet_every_target(spark):
    cells, goals = [], {}
    for long in (140, 50_000, 200_000, 10_000_000):
        for part in (1e-6, 0.01, 0.1, 0.2, 0.5, 0.9, 1.0, 1.5, 2.5, 2.8, 2.9999):
            mine = [(n, 1 + n % 7) for n in range(60, 140)] + [(long, 1)]
            words = sum(s * n for s, n in mine)
            cells += [(False, f"{long} {part}", s, n) for s, n in mine]
            goals[False, f"{long} {part}"] = (part * words, words, words / sum(n for _, n in mine))
    slopes = mixing.balance(spark.createDataFrame(cells, "_none boolean, _source string, size long, n long").cache(), goals)
    for key, (target, _, _) in goals.items():
        rates = [(s * n, min(3.0, math.exp(min(slopes[key] * s, 2.0)))) for _, source, s, n in cells if source == key[1]]
        assert sum(a * x for a, x in rates) == pytest.approx(target, rel=1e-6, abs=1e-5)


def test_unreachable_target_raises(spark):
    cells = spark.createDataFrame([(False, "a", 10, 5)], "_none boolean, _source string, size long, n long")
    with pytest.raises(ArithmeticError, match="'a'"):
        mixing.balance(cells, {(False, "a"): (160.0, 100, 10.0)})


# Multiset fingerprints


def test_many_equal_lines_do_not_wrap():
    whole, half = (multiset.Fingerprint.of("the same line\n" * n + "".join(f"other words {i}\n" for i in range(40_000 - n))) for n in (40_000, 20_000))
    assert 0.9 < whole.likeness(half) < 1


def test_group_of_fingerprints():
    of = multiset.Fingerprint.of
    assert of("a\nb\nc") == of("c\na\nb") and of("a\nb") != of("a\nb\nb") and of(None) == of("")
    assert of("a\nb") + of("c") == of("c\nb\na") and of("a\nb\nc") - of("b") == of("a\nc")
    text = "\n".join(f"this is sentence {i}, and it goes on." for i in range(200))
    other = text.replace("sentence 7,", "phrase 7,")
    assert of(text).likeness(of(other)) > 0.9 > 0.3 > of(text).likeness(of("another thing. entirely new, here.")) and of(text).likeness(of(text)) == 1


def test_edited(spark, odd, empty):
    rows = [(3, "abcdef"), (1, "xy"), (2, ""), (7, "q" * 9), (None, "last one"), (3, "abcdef")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = multiset.compare_edited(df).collect()
    order = [(7, "q" * 9), (3, "abcdef"), (3, "abcdef"), (2, ""), (1, "xy"), (None, "last one")]
    want = sorted((d, len(t), hashlib.sha256(multiset.edited(t, order[(i + 1) % 6][1]).encode()).hexdigest()) for i, (d, t) in enumerate(order) if d)
    assert sorted((x.doc_id, x.n_chars, x.edited_sha256) for x in got if x.doc_id) == want and len(got) == 6
    assert multiset.compare_edited(odd).count() == odd.count() and multiset.compare_edited(empty).count() == 0
    one = multiset.compare_edited(df.filter("doc_id = 1")).first()  # alone, a document follows itself
    assert one.edited_sha256 == hashlib.sha256(b"xx").hexdigest() and one.near_next == 1


# Sharding


def test_shards(spark, odd, empty):
    df = spark.range(1000).select(F.col("id").alias("doc_id"), F.lit("same").alias("text"))
    got = sharding.assign(df, 7, rows=50).collect()
    by = {}
    for x in got:
        by.setdefault(x.shard, []).append(x.slot)
    assert sorted(by) == list(range(7)) and all(sorted(v) == list(range(len(v))) for v in by.values()) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert sorted(map(tuple, sharding.assign(df.repartition(5), 7, rows=50).collect())) == sorted(map(tuple, got))
    place = np.array([x.doc_id for x in sorted(got, key=lambda x: (x.shard, x.slot))])
    assert abs(np.corrcoef(place, np.arange(1000))[0, 1]) < 0.12
    d = sharding.digest(odd).collect()
    assert len(d) == odd.count() and all(x.law == "rows" and x.grown_shard is None for x in d)
    texts = {x.doc_id: x.text or "" for x in odd.collect()}
    assert all(x["size"] == len(texts[x.doc_id].encode()) + 8 and x.text_crc32 == zlib.crc32(texts[x.doc_id].encode()) for x in d)
    assert sharding.digest(empty).count() == 0


def test_matrix_and_draws(monkeypatch):
    m = sharding.matrix([50, 0, 30, 20], [40, 35, 25], 1)
    assert m.sum(0).tolist() == [40, 35, 25] and m.sum(1).tolist() == [50, 0, 30, 20]
    monkeypatch.setattr(sharding, "NUMPY_TOTAL", 10)
    m = sharding.matrix([50, 0, 30, 20], [40, 35, 25], 1)
    assert m.sum(0).tolist() == [40, 35, 25] and m.sum(1).tolist() == [50, 0, 30, 20]
    rng = np.random.default_rng(1)
    x = [sharding.hypergeometric(rng, 50, 80, 30) for _ in range(4000)]
    assert abs(np.mean(x) - 30 * 50 / 130) < 0.2 and abs(np.std(x) - 2.34) < 0.15


def test_written_shards(spark, odd, tmp_path):
    sharding.write_shards(odd.drop("score", "fingerprint"), f"file://{tmp_path}/s", 3)
    assert spark.read.parquet(f"file://{tmp_path}/s").count() == odd.count()
