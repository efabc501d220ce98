"""Language identification with interpolated Kneser-Ney character models in sorted hash arrays.

Each language has a model of letters within words: a word is a run of letters, lower-cased, between two borders, and
the probability of a character interpolates orders ``ORDER`` to 1 with one absolute discount for each order. Orders
below the highest count how many different characters precede an n-gram, except for n-grams that begin a word. All
languages share one sorted array of 64-bit n-gram hashes for each order, with a row of log-probabilities beside each
hash and, for contexts, a row of back-off weights; looking up is a binary search. A text's cross-entropy is the mean
over all its characters and borders; the language with the lowest wins.

Learning takes at most ``Training.most_rows`` rows for each language, those with the smallest hash of their id. One in
``Training.fold`` of them is held back to calibrate: a temperature that turns differences of cross-entropy into
probabilities, and for each language the cross-entropy above which a text counts as rejected (no language fits).

A text that is null or has no letter is ``und`` with score 0. Rows whose language is null teach nothing. If nothing
can be learned, every text is ``und``. Ties go to the language that is first by code point. Texts are read whole,
however long; repeated rows get the same result, an empty table gives no rows. Columns with the names of results are
replaced, others pass through.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quern.llm.common import per_worker, small_table, structs, values, with_fields

ORDER, BORDER = 5, 0
_RUN = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"


def words_of(text: str | None) -> list[str]:
    """The runs of letters (Unicode's category L), lower-cased; learning and scoring both take them from here."""
    found = _RUN.findall((text or "").lower())
    if all(map(str.isalpha, found)):
        return found
    # the pattern also takes numbers that are no decimal digits, as superscripts, fractions and Roman numerals
    return [x for w in found for x in "".join(c if c.isalpha() else " " for c in w).split()]


_rng = np.random.default_rng(20240501)
_FACTORS = _rng.integers(0, 2**63, ORDER, np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


#: Languages up to which the table of their shares is broadcast; beyond, it is joined by language.
MOST_BROADCAST = 10_000


@dataclass(frozen=True)
class Training:
    """``most_rows`` bounds the rows of one language; ``quantile`` of the held-back texts are not rejected."""

    most_rows: int = 1000
    fold: int = 5
    quantile: float = 0.995
    slack: float = 1.15


def _spread(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All words one after another as code points, each between borders, and the word that each place belongs to."""
    text = "\0" + "\0".join(words) + "\0"
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    return codes, np.cumsum(codes == BORDER) - 1


def _hashes(codes: np.ndarray) -> list[np.ndarray]:
    """For k = 1 to ORDER, at each place the hash of the k characters that end there; 0 where a border is in between.

    A border may be the first of the k characters or the last, not one in the middle.
    """
    n = len(codes)
    out, run = [], np.zeros(n, np.uint64)
    valid = np.ones(n, bool)
    border = codes == BORDER
    with np.errstate(over="ignore"):
        for k in range(ORDER):
            moved = np.zeros(n, np.uint64)
            moved[k:] = codes[: max(n - k, 0)]
            run = run + (moved + np.uint64(1)) * _FACTORS[k]
            if k:
                valid = valid.copy()
                valid[:k] = False
                if 1 < k < n:
                    valid[k:] &= ~border[1 : n - k + 1]  # the character before last added is now in the middle
            h = run * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
            h = h * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(2 * k + 2)
            out.append(np.where(valid, np.maximum(h, 1), 0))
    return out


@dataclass
class Model:
    """For each order: sorted hashes, log-probabilities and back-off weights (0 where unseen), a column a language."""

    langs: list[str]
    keys: list[np.ndarray] = field(default_factory=list)
    logp: list[np.ndarray] = field(default_factory=list)
    back: list[np.ndarray] = field(default_factory=list)
    floor: np.ndarray | None = None
    temperature: float = 1.0
    most: np.ndarray | None = None

    def _find(self, order: int, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = self.keys[order]
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        return at, keys[at] == h

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Of each word: the sum of log-probabilities of its characters and its end in each language, and their number."""
        codes, word = _spread(words)
        hashes = _hashes(codes)
        places = np.flatnonzero(np.arange(len(codes)) > 0)  # the first border is nobody's
        # a border counts as the end of the word before it
        owner = np.where(codes[places] == BORDER, word[places] - 1, word[places])
        total = np.zeros((len(places), len(self.langs)), np.float32)
        open_ = np.arange(len(places))
        for order in range(ORDER - 1, -1, -1):
            h = hashes[order][places[open_]]
            at, hit = self._find(order, h)
            hit &= h != 0
            total[open_[hit]] += self.logp[order][at[hit]]
            open_ = open_[~hit]
            if not len(open_):
                break
            if order:
                context = hashes[order - 1][places[open_] - 1]
                at, hit = self._find(order - 1, context)
                hit &= (context != 0) & (hashes[order][places[open_]] != 0)
                total[open_[hit]] += self.back[order - 1][at[hit]]
            else:
                total[open_] += self.floor
        sums = np.zeros((len(words), len(self.langs)))
        for j in range(len(self.langs)):
            sums[:, j] = np.bincount(owner, total[:, j], len(words))
        return sums, np.bincount(owner, minlength=len(words))

    def size(self) -> int:
        return sum(a.nbytes for part in (self.keys, self.logp, self.back) for a in part)

    def name(self) -> str:
        """Differs between models; by it a worker knows the one it holds."""
        h = hashlib.blake2b("\0".join(self.langs).encode(), digest_size=16)
        for a in (*self.keys, *self.logp, *self.back, self.most, np.array(self.temperature)):
            h.update(np.ascontiguousarray(a).tobytes())
        return h.hexdigest()


def _language(words: list[str], counts: np.ndarray) -> list[dict]:
    """Kneser-Ney tables of one language: for each order the hashes, probabilities and, by context, back-off weights."""
    codes, word = _spread(words)
    hashes = _hashes(codes)
    place = np.arange(len(codes))
    owner = np.where(codes == BORDER, word - 1, word)
    ok = owner >= 0
    weight = np.where(ok, counts[np.maximum(owner, 0)], 0)
    seen = []
    for k in range(ORDER):
        use = ok & (hashes[k] != 0) & (place > 0)
        h, first, inverse = np.unique(hashes[k][use], return_index=True, return_inverse=True)
        at = place[use][first]
        starts = codes[np.maximum(at - k, 0)] == BORDER if k else np.zeros(len(h), bool)
        seen.append({"h": h, "at": at, "raw": np.bincount(inverse, weight[use], len(h)), "starts": starts})
    tables: list[dict] = []
    lower = None
    for k in range(ORDER):
        s = seen[k]
        if k == ORDER - 1:
            c = s["raw"]
        else:  # how many different n-grams of the next order end in this one
            up = seen[k + 1]
            tail = np.searchsorted(s["h"], hashes[k][up["at"]])
            c = np.where(s["starts"], s["raw"], np.bincount(tail, minlength=len(s["h"])))
            c = np.maximum(c, 1)
        n1, n2 = (c == 1).sum(), (c == 2).sum()
        d = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        context = hashes[k - 1][s["at"] - 1] if k else np.zeros(len(c), np.uint64)
        ctx, inverse = np.unique(context, return_inverse=True)
        total, kinds = np.bincount(inverse, c), np.bincount(inverse)
        rest = d * kinds / total
        below = lower(s["at"]) if lower else np.full(len(c), 1 / (len(c) + 2))
        p = np.maximum(c - d, 0) / total[inverse] + rest[inverse] * below
        tables.append({"h": s["h"], "p": p, "ctx": ctx, "back": rest, "unseen": float(rest[0] / (len(c) + 2)) if k == 0 else 0.0})
        lower = lambda at, h=s["h"], p=p, own=hashes[k]: p[np.searchsorted(h, own[at])]
    return tables


def build(counted: dict[str, Counter]) -> Model:
    """From the words of each language to the joint sorted arrays."""
    langs = sorted(counted)
    model = Model(langs)
    each = []
    for lang in langs:
        words = sorted(counted[lang])
        each.append(_language(words, np.array([counted[lang][w] for w in words], float)))
    model.floor = np.log([t[0]["unseen"] for t in each]).astype(np.float32)
    n = len(langs)
    for k in range(ORDER):
        ctx = [t[k + 1]["ctx"] if k + 1 < ORDER else np.zeros(0, np.uint64) for t in each]
        keys = np.unique(np.concatenate([t[k]["h"] for t in each] + ctx))
        keys = keys[keys != 0]
        logp, back = np.full((len(keys), n), np.nan, np.float32), np.zeros((len(keys), n), np.float32)
        for j, t in enumerate(each):
            logp[np.searchsorted(keys, t[k]["h"]), j] = np.log(t[k]["p"])
            use = ctx[j] != 0
            if use.any():
                back[np.searchsorted(keys, ctx[j][use]), j] = np.log(t[k + 1]["back"][use])
        model.keys.append(keys)
        model.logp.append(logp)
        model.back.append(back)
    _fill(model, counted)
    return model


def _fill(model: Model, counted: dict[str, Counter]) -> None:
    """Where an n-gram is known in some language only, the others' log-probability by backing off."""
    codes, _ = _spread(sorted({w for c in counted.values() for w in c}))
    hashes = _hashes(codes)
    for k in range(ORDER):
        h, at = np.unique(hashes[k], return_index=True)
        keep = (h != 0) & (at > 0)
        h, at = h[keep], at[keep]
        here, hit = model._find(k, h)
        here, at = here[hit], at[hit]
        if k == 0:
            fallback = np.tile(model.floor, (len(here), 1))
        else:
            low, found = model._find(k - 1, hashes[k - 1][at])
            ctx, known = model._find(k - 1, hashes[k - 1][at - 1])
            fallback = np.where(found[:, None], model.logp[k - 1][low], model.floor) + np.where(known[:, None], model.back[k - 1][ctx], 0)
        rows = model.logp[k][here]
        model.logp[k][here] = np.where(np.isnan(rows), fallback, rows)
        model.logp[k] = np.where(np.isnan(model.logp[k]), model.floor, model.logp[k])  # contexts that never end a match


class Scorer:
    """Cross-entropies of texts; words already looked up are kept, up to a number."""

    MOST_WORDS = 150_000

    def __init__(self, model: Model) -> None:
        self.model = model
        self.place: dict[str, int] = {}
        self.sums = np.zeros((0, len(model.langs)))
        self.sizes = np.zeros(0)

    def _learn(self, texts: list[list[str]]) -> None:
        new = list(dict.fromkeys(w for t in texts for w in t if w not in self.place))
        if not new:
            return
        if len(self.place) + len(new) > self.MOST_WORDS and self.place:
            self.place, self.sums, self.sizes = {}, self.sums[:0], self.sizes[:0]
            return self._learn(texts)
        sums, sizes = self.model.words(new)
        start = len(self.place)
        self.place.update((w, start + i) for i, w in enumerate(new))
        self.sums, self.sizes = np.concatenate([self.sums, sums]), np.concatenate([self.sizes, sizes])

    def entropies(self, texts: list[str | None]) -> np.ndarray:
        """A row for each text: the mean negative log-probability in each language; NaN without letters."""
        out = np.full((len(texts), len(self.model.langs)), np.nan)
        cut, chars = [], 0
        for i, t in enumerate(texts):
            cut.append((i, words_of(t)))
            chars += len(t or "")
            if chars > 300_000 or i == len(texts) - 1:
                self._learn([w for _, w in cut])
                for j, w in cut:
                    if w:
                        at = np.fromiter(map(self.place.__getitem__, w), np.int64, len(w))
                        out[j] = -self.sums[at].sum(axis=0) / self.sizes[at].sum()
                cut, chars = [], 0
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, float | None, bool]]:
        """(language, score, cross-entropy, rejected) of each text."""
        m, h = self.model, self.entropies(texts)
        out = []
        for row in h:
            if np.isnan(row[0]):
                out.append((UNKNOWN, 0.0, None, True))
                continue
            best = int(row.argmin())
            e = np.exp(-(row - row[best]) * m.temperature)
            out.append((m.langs[best], float(1 / e.sum()), float(row[best]), bool(row[best] > m.most[best])))
        return out


@F.arrow_udf(T.ArrayType(T.StringType()))
def _words(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for part in values(batches):
        yield pa.array(list(map(words_of, part)), pa.list_(pa.string()))


def fit(docs: DataFrame, p: Training = Training(), text: str = "text", lang: str = "lang", id: str = "doc_id") -> Model | None:
    """Learns from the rows given; the driver gets the words of ``most_rows`` rows for each language, counted."""
    spark = docs.sparkSession
    # a number for each language's rows without gathering them: how many are below a hash that fits the bound
    rows = docs.filter(F.col(lang).isNotNull()).select(F.col(id).alias("i"), F.col(lang).alias("l"), F.xxhash64(F.lit(5), id).alias("h"))
    sizes = {r["l"]: r["n"] for r in rows.groupBy("l").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None
    share = small_table(spark, [(k, min(1.0, 1.2 * p.most_rows / n)) for k, n in sizes.items()], (("l", pa.string()), ("share", pa.float64())))
    # a row for each language: broadcast while they are few, so that no language's rows gather in one task
    near = rows.join(F.broadcast(share) if len(sizes) <= MOST_BROADCAST else share, "l").filter(F.shiftrightunsigned("h", 11) / F.lit(float(1 << 53)) < F.col("share"))
    rank = F.row_number().over(Window.partitionBy("l").orderBy("h", "i"))
    chosen = near.withColumn("r", rank).filter(F.col("r") <= p.most_rows).select("i", "l", (F.col("r") % p.fold == 0).alias("test"))
    sample = docs.filter(F.col(lang).isNotNull()).select(F.col(id).alias("i"), F.col(text).alias("t")).join(F.broadcast(chosen), "i")  # most_rows a language
    learn = sample.filter("not test").select("l", F.explode(_words("t")).alias("w")).groupBy("l", "w").agg(F.count("*").alias("n"))
    counted: dict[str, Counter] = {}
    for r in learn.toLocalIterator():
        counted.setdefault(r["l"], Counter())[r["w"]] = r["n"]
    if not counted:
        return None
    model = build(counted)
    _calibrate(model, sample.filter("test"), p)
    return model


def _calibrate(model: Model, held_back: DataFrame, p: Training) -> None:
    n = len(model.langs)
    model.most = np.full(n, np.inf)
    sent = held_back.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("array<double>")
    def entropies(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        s = Scorer(sent.value)
        for part in values(batches):
            yield pa.array(s.entropies(part).tolist(), pa.list_(pa.float64()))

    got = held_back.select("l", entropies(F.col("t")).alias("h")).collect()
    truth = np.array([model.langs.index(r["l"]) if r["l"] in model.langs else -1 for r in got], int)
    h = np.array([r["h"] for r in got], float).reshape(-1, n)
    use = (truth >= 0) & ~np.isnan(h).any(axis=1)
    truth, h = truth[use], h[use]
    if len(truth):
        gaps = h - h[np.arange(len(h)), truth][:, None]
        loss = lambda b: np.log(np.exp(np.minimum(-gaps * b, 700)).sum(axis=1)).mean()
        model.temperature = float(min((2.0**i for i in range(8)), key=loss))
        for j in range(n):
            if (truth == j).any():
                model.most[j] = np.quantile(h[truth == j, j], p.quantile) * p.slack


def identify(docs: DataFrame, model: Model | None, text: str = "text", reject: bool = False) -> DataFrame:
    """Adds lang_pred, score, cross_entropy and rejected; with ``reject``, rejected texts are ``und``."""
    if model is None:
        return docs.withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0), "cross_entropy": F.lit(None).cast("double"), "rejected": F.lit(True)})
    sent = docs.sparkSession.sparkContext.broadcast(model)  # its size follows the bounded sample
    name = model.name()

    @F.arrow_udf("lang_pred string, score double, cross_entropy double, rejected boolean")
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        s = per_worker(("language", name), lambda: Scorer(sent.value))
        for part in values(batches):
            rows = s.predict(part)
            if reject:
                rows = [(UNKNOWN if r else a, b, c, r) for a, b, c, r in rows]
            yield structs(rows, FIELDS)

    return with_fields(docs, predict(F.col(text)), [n for n, _ in FIELDS])


FIELDS = (("lang_pred", pa.string()), ("score", pa.float64()), ("cross_entropy", pa.float64()), ("rejected", pa.bool_()))
