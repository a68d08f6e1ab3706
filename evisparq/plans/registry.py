"""The experiment registry and pipeline configurations, with their validation."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, fields
from pathlib import Path

from ..sources.store import stable_hash

# The numbers of arms by tier.
EXPECTED = {"core": 41, "stretch": 13}


def load_registry(path: str | Path = Path(__file__).parent / "registry.json") -> list[dict]:
    """Families of a registry file as dictionaries; arms are numbered within their tier."""
    families = []
    for f in json.loads(Path(path).read_text(encoding="utf-8"))["families"]:
        arms = [{"id": f"{f['id']}.{tier[0].upper()}{i:02d}", "variant": variant, "tier": tier} for tier in ("core", "stretch") for i, variant in enumerate(f[tier], 1)]
        families.append({k: f[k] for k in ("id", "population", "metric", "depends_on")} | {"arms": arms})
    return families


def levels(families: list[dict]) -> list[tuple[int, str]]:
    """Families in the order in which their dependencies are met; unknown names and cycles are errors."""
    names = [f["id"] for f in families]
    if len(set(names)) != len(names):
        raise ValueError("family ids must be unique")
    for f in families:
        if unknown := set(f["depends_on"]) - set(names):
            raise ValueError(f"{f['id']}: unknown dependencies {sorted(unknown)}")
    done: dict[str, int] = {}
    while len(done) < len(names):
        ready = [f["id"] for f in families if f["id"] not in done and all(d in done for d in f["depends_on"])]
        if not ready:
            raise ValueError(f"dependency cycle among {sorted(set(names) - set(done))}")
        level = max(done.values(), default=-1) + 1
        done |= dict.fromkeys(ready, level)
    return sorted((level, name) for name, level in done.items())


def validate_registry(families: list[dict], expected: dict[str, int] | None = EXPECTED) -> dict[str, int]:
    """Arms by tier, after all checks."""
    levels(families)
    arms = [a for f in families for a in f["arms"]]
    if len({a["id"] for a in arms}) != len(arms):
        raise ValueError("arm ids must be unique")
    counts = {t: sum(a["tier"] == t for a in arms) for t in ("core", "stretch")}
    if expected is not None and counts != expected:
        raise ValueError(f"expected {expected} arms, found {counts}")
    return counts


def resolve_arms(families: list[dict]) -> list[dict]:
    """Arms with their family's fields and a hash of both."""
    out = []
    for f in families:
        for arm in f["arms"]:
            value = {k: v for k, v in f.items() if k not in ("arms", "id")} | {"family": f["id"]} | arm
            out.append(value | {"config_hash": stable_hash(value)})
    return out


@dataclass(frozen=True)
class PipelineConfig:
    """One answering pipeline. The defaults are those of the plain sparse pipeline."""

    pipeline_id: str = "bm25_rag"
    bm25_recipe: str = "title_abstract"
    retriever: str = "bm25"
    query_strategy: str = "original"
    evidence_strategy: str = "sentence3"
    context_order: str = "relevance_descending"
    diversity: str = "none"
    retrieval_k: int = 20
    snippet_limit: int = 20
    context_token_budget: int = 1200
    generator_model: str = "extractive"
    max_output_tokens: int = 800

    def __post_init__(self) -> None:
        if not 1 <= len(self.pipeline_id) <= 64 or not all(c.islower() or c.isdigit() or c in "_-" for c in self.pipeline_id):
            raise ValueError("pipeline_id must have 1 to 64 of a-z, 0-9, _ and -")
        if self.retriever not in ("bm25", "dense", "rrf", "rrf_rerank"):
            raise ValueError(f"unknown retriever {self.retriever!r}")

    @property
    def config_hash(self) -> str:
        return stable_hash(asdict(self))


_BEST = {"bm25_recipe": "boosted_title_abstract_mesh", "retriever": "rrf_rerank", "evidence_strategy": "sentence3_cross_encoder", "retrieval_k": 100, "context_token_budget": 600}
PIPELINES = {
    p.pipeline_id: p
    for p in (
        PipelineConfig(),
        PipelineConfig("bm25_mesh_rag", query_strategy="mesh"),
        PipelineConfig("dense_rag", retriever="dense", retrieval_k=100),
        PipelineConfig("rrf_rag", bm25_recipe="boosted_title_abstract_mesh", retriever="rrf", retrieval_k=100),
        PipelineConfig("rrf_rerank_rag", bm25_recipe="boosted_title_abstract_mesh", retriever="rrf_rerank", retrieval_k=100),
        PipelineConfig("best_rag", **_BEST),
        PipelineConfig("preselected_drop_one", **(_BEST | {"retriever": "rrf"})),
        PipelineConfig("gold_evidence_oracle", **_BEST),
        PipelineConfig("closed_book", context_token_budget=600),
    )
}


def load_config(path: str) -> PipelineConfig:
    """A configuration from a YAML file, whose name must be its id; unknown keys are errors."""
    import yaml

    value = yaml.safe_load(Path(path).read_text(encoding="utf-8"))
    if unknown := set(value) - {f.name for f in fields(PipelineConfig)} - {"description"}:
        raise ValueError(f"unknown keys {sorted(unknown)}")
    value.pop("description", None)
    config = PipelineConfig(**value)
    if config.pipeline_id != Path(path).stem:
        raise ValueError("pipeline_id must be the file's name")
    return config
