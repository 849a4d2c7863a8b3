"""Configurations: every knob with its default, named presets, and the groups by lifetime."""

from __future__ import annotations

from dataclasses import asdict, dataclass, fields, replace

# The names of retrievers, stores, index types and fusions, and below the fields with their defaults.
RETRIEVERS, STORES, INDEX_TYPES, FUSIONS = ("dense", "bm25", "hybrid"), ("numpy", "faiss", "qdrant"), ("flat", "ivf"), ("rrf", "weighted")


@dataclass(frozen=True)
class Config:
    retriever: str = "dense"
    store: str = "numpy"
    index_type: str = "flat"
    embed_model: str = "all-MiniLM-L6-v2"
    chunk_max_tokens: int = 128
    chunk_overlap: int = 50
    top_k: int = 15
    rerank: bool = False
    hyde: bool = False
    fusion: str = "rrf"
    alpha: float = 0.5
    no_rag: bool = False
    backend: str | None = None
    model: str | None = None
    num_ctx: int | None = None
    source: tuple[str, ...] | None = None

    def __post_init__(self):
        for value, known in ((self.retriever, RETRIEVERS), (self.store, STORES), (self.index_type, INDEX_TYPES), (self.fusion, FUSIONS)):
            if value not in known:
                raise ValueError(f"{value!r} is none of {known}")

    def group(self, names: tuple[str, ...]) -> dict:
        return {n: getattr(self, n) for n in names}


#: What defines an index, what a question can change, and what the answer's model takes.
INDEX = ("retriever", "store", "index_type", "embed_model", "chunk_max_tokens", "chunk_overlap")
RETRIEVAL = ("top_k", "rerank", "hyde", "fusion", "alpha", "source")
GENERATION = ("no_rag", "backend", "model", "num_ctx")

# The presets, in the order in which they are listed.
_BEST = Config(retriever="hybrid", embed_model="BAAI/bge-small-en-v1.5", rerank=True, top_k=20)
_LLAMA = {"backend": "groq", "model": "llama-3.1-8b-instant"}
PRESETS = {
    "no-rag": Config(no_rag=True),
    "no-rag-gpt": Config(no_rag=True, backend="gpt"),
    "baseline": Config(),
    "best": _BEST,
    "gpt": replace(_BEST, backend="gpt"),
    "llama3.1-8b": replace(_BEST, **_LLAMA),
    "no-rag-llama3.1-8b": Config(no_rag=True, **_LLAMA),
    "lightweight": Config(top_k=5, chunk_max_tokens=64),
    "bm25": Config(retriever="bm25"),
    "hybrid": Config(retriever="hybrid"),
    "hyde": Config(hyde=True),
    "faiss": Config(store="faiss", index_type="ivf"),
}


def flat(config: Config | dict) -> dict:
    return asdict(config) if isinstance(config, Config) else dict(config)


def configured(values: Config | dict | str | None) -> Config:
    """A configuration from a preset's name, from some knobs (nulls keep defaults, others are ignored), or the best one."""
    if values is None:
        return PRESETS["best"]
    if isinstance(values, str):
        if values not in PRESETS:
            raise ValueError(f"no preset {values!r}")
        return PRESETS[values]
    if isinstance(values, Config):
        return values
    known = {f.name for f in fields(Config)}
    return Config(**{k: v for k, v in values.items() if k in known and v is not None})


def as_sources(source: str | list[str] | tuple[str, ...] | set[str] | None) -> set[str] | None:
    """None for all sources; an empty list for none of them."""
    return None if source is None else {source} if isinstance(source, str) else set(source)
