"""Settings of the operators. All are immutable; ``validate`` raises ValueError on what cannot work."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, replace


class QuernError(Exception):
    """What the package raises on purpose; ``code`` tells the part."""

    code = "ERROR"


class ConfigError(QuernError, ValueError):
    code = "CONFIG_ERROR"


class RetrievalError(QuernError, RuntimeError):
    code = "RETRIEVAL_ERROR"


class ModelError(QuernError, RuntimeError):
    code = "LLM_ERROR"


class MemoryError_(QuernError, RuntimeError):
    code = "MEMORY_ERROR"


ERRORS = {e.code: e for e in (ConfigError, RetrievalError, ModelError, MemoryError_)}


def changed(config, **new):
    """A copy with other settings, validated."""
    return replace(config, **new).validate()


def _check(ok: bool, what: str) -> None:
    if not ok:
        raise ConfigError(what)


@dataclass(frozen=True)
class TextConfig:
    """Analysis of texts into tokens. Lengths are bytes."""

    lowercase: bool = True
    remove_punctuation: bool = True
    remove_numbers: bool = False
    remove_stopwords: bool = True
    stem: bool = False
    min_length: int = 2
    max_length: int = 50
    language: str = "english"

    def validate(self) -> TextConfig:
        _check(0 <= self.min_length <= self.max_length, "token lengths")
        return self


TEXT_PRESETS = {
    "default": TextConfig(),
    "retrieval": TextConfig(stem=True),
    "search": TextConfig(min_length=1),
    "minimal": TextConfig(remove_stopwords=False, min_length=1, max_length=100),
}


@dataclass(frozen=True)
class IndexConfig:
    """TF-IDF index and ranking."""

    min_term_frequency: int = 1
    max_postings_per_term: int | None = 100_000  # None: no cap
    normalize_scores: bool = True
    score_threshold: float = 0.0
    max_results: int = 100
    text: TextConfig = field(default_factory=lambda: TEXT_PRESETS["retrieval"])

    def validate(self) -> IndexConfig:
        _check(self.min_term_frequency >= 1 and (self.max_postings_per_term is None or self.max_postings_per_term >= 1) and self.max_results >= 1, "index limits")
        self.text.validate()
        return self


@dataclass(frozen=True)
class BM25Config(IndexConfig):
    k1: float = 1.2
    b: float = 0.75
    delta: float = 1.0

    def validate(self) -> BM25Config:
        super().validate()
        _check(self.k1 >= 0 and 0 <= self.b <= 1, "k1 and b")
        return self


TFIDF_PRESETS = {
    "retrieval": IndexConfig(score_threshold=0.01, max_results=10),
    "search": IndexConfig(max_postings_per_term=50_000, score_threshold=0.05, max_results=20, text=TEXT_PRESETS["search"]),
    "large_dataset": IndexConfig(2, 1_000_000, True, 0.001, 100),
    "memory_efficient": IndexConfig(3, 10_000, False, 0.1, 5, TEXT_PRESETS["minimal"]),
}
BM25_PRESETS = {
    "standard": BM25Config(),
    "short_document": BM25Config(max_results=50),
    "long_document": BM25Config(max_results=200),
    "precision": BM25Config(min_term_frequency=2, max_postings_per_term=50_000, score_threshold=0.5, max_results=50, k1=2.0),
    "recall": BM25Config(max_postings_per_term=200_000, max_results=500, k1=0.5, delta=0.5),
}

METRICS = ("cosine", "euclidean", "dot")


@dataclass(frozen=True)
class VectorConfig:
    max_vectors: int = 1_000_000
    dimension: int = 384
    normalize: bool = True
    k: int = 10
    threshold: float = 0.0
    metric: str = "cosine"

    def validate(self) -> VectorConfig:
        _check(self.max_vectors > 0 and self.dimension > 0 and self.k > 0, "vector limits")
        _check(self.metric in METRICS, f"metric {self.metric}")
        return self


def vector_preset(use_case: str, dimension: int = 384) -> VectorConfig:
    k, metric = {"search": (20, "cosine"), "clustering": (50, "euclidean"), "recommendation": (10, "dot")}.get(use_case, (10, "cosine"))
    return VectorConfig(dimension=dimension, k=k, metric=metric)


FUSIONS = ("weighted_average", "rrf", "max", "condensation")
NORMALIZATIONS = ("min_max", "z_score", "sum")


@dataclass(frozen=True)
class HybridConfig:
    sparse_weight: float = 0.5
    dense_weight: float = 0.5
    top_k_sparse: int = 20
    top_k_dense: int = 20
    top_k: int = 10
    fusion: str = "weighted_average"
    rrf_k: float = 60.0
    normalization: str = "min_max"
    dedupe: bool = True
    dedupe_threshold: float = 0.95

    def validate(self) -> HybridConfig:
        _check(0 <= self.sparse_weight <= 1 and 0 <= self.dense_weight <= 1, "weights lie between 0 and 1")
        _check(abs(self.sparse_weight + self.dense_weight - 1) <= 1e-6, "weights add up to 1")
        _check(min(self.top_k_sparse, self.top_k_dense, self.top_k) > 0 and self.rrf_k > 0, "positive numbers of results")
        _check(0 <= self.dedupe_threshold <= 1, "threshold")
        _check(self.fusion in FUSIONS and self.normalization in NORMALIZATIONS, "method")
        return self


def hybrid_preset(use_case: str) -> HybridConfig:
    base = HybridConfig()
    return {
        "search": replace(base, sparse_weight=0.6, dense_weight=0.4, top_k_sparse=30),
        "recommendation": replace(base, sparse_weight=0.3, dense_weight=0.7, top_k_sparse=15, top_k_dense=30, fusion="rrf"),
        "qa": replace(base, sparse_weight=0.7, dense_weight=0.3, top_k_sparse=25, top_k_dense=15, top_k=5, fusion="max"),
    }.get(use_case, base)


@dataclass(frozen=True)
class MemoryConfig:
    max_messages: int = 100
    max_tokens: int = 2000
    max_age_seconds: int = 3600
    summary_every: int = 10

    def validate(self) -> MemoryConfig:
        _check(all(getattr(self, f.name) > 0 for f in fields(self)), "positive limits")
        return self


@dataclass(frozen=True)
class RetrievalConfig:
    """Declared limits of a search request; ``mmr_lambda`` and ``fetch_k`` serve the MMR extension."""

    top_k: int = 5
    search_type: str = "similarity"
    mmr_lambda: float = 0.5
    fetch_k: int = 20
    score_threshold: float = 0.0

    def validate(self) -> RetrievalConfig:
        _check(1 <= self.top_k <= 1000 and self.fetch_k >= self.top_k, "top_k and fetch_k")
        _check(0 <= self.score_threshold <= 1 and 0 <= self.mmr_lambda <= 1, "threshold and lambda")
        return self


@dataclass(frozen=True)
class GenerationConfig:
    temperature: float = 0.7
    top_p: float = 1.0
    max_tokens: int = 256

    def validate(self) -> GenerationConfig:
        _check(0 <= self.temperature <= 2 and 0 < self.top_p <= 1 and self.max_tokens > 0, "generation ranges")
        return self

    def is_valid(self) -> bool:
        try:
            return bool(self.validate())
        except ConfigError:
            return False


@dataclass(frozen=True)
class ModelConfig(GenerationConfig):
    """Settings of a model; names that are empty are not given."""

    model: str = "gpt-3.5-turbo"
    api_key: str = ""
    base_url: str = ""

    def validate(self) -> ModelConfig:
        super().validate()
        _check(bool(self.model), "a model's name")
        return self

    def merged(self, new: ModelConfig) -> ModelConfig:
        """The new settings; a name that they lack stays as it was."""
        return replace(new, **{k: getattr(new, k) or getattr(self, k) for k in ("model", "api_key", "base_url")}).validate()


@dataclass(frozen=True)
class AgentConfig:
    max_iterations: int = 10
    max_seconds: int = 300
    stop: str = "Final Answer:"

    def validate(self) -> AgentConfig:
        _check(self.max_iterations > 0 and self.max_seconds > 0 and bool(self.stop), "agent limits")
        return self
