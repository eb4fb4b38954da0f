"""Configuration and intent files (YAML), read on the driver: small documents
that people write. The keys are those of the format."""

from __future__ import annotations

import os
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..operators import intent as intent_rules
from ..schema import HALF_LIFE
from .files import LANGUAGE, TRACKED

#: Bytes above which an intent document is large, and a warning is due.
LARGE_INTENT = 50 * 1024


@dataclass(frozen=True)
class Config:
    """Areas by name, extensions that are indexed, the embedding, and how notes
    decay."""

    areas: dict[str, str]
    tracked: tuple[str, ...] = TRACKED
    embedding: str = "local"
    half_life: float = HALF_LIFE
    possibly_stale: float = 0.3
    stale: float = 0.1
    warnings: tuple[str, ...] = field(default=(), compare=False)


def _document(path: str) -> dict:
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("configuration files need a YAML parser") from e
    with open(path, encoding="utf-8") as f:
        found = yaml.safe_load(f)
    if found is None:
        return {}
    if not isinstance(found, dict):
        raise ValueError(f"{path}: a mapping is expected")
    return found


def load_config(path: str, embeddings: tuple[str, ...] = ("local", "learned", "none")) -> Config:
    """The configuration, with what is odd about it as warnings. A file that
    lacks areas or extensions, or isn't there, is an error."""
    doc = _document(path)
    missing = [key for key in ("lobes", "tracked_extensions") if key not in doc]
    if missing:
        raise KeyError(missing[0])
    notes = doc.get("memory") or {}
    own = Config(
        {str(k): str(v) for k, v in (doc["lobes"] or {}).items()},
        tuple(doc["tracked_extensions"] or ()),
        str(doc.get("embedding_model", "local")),
        float(notes.get("decay_half_life_days", HALF_LIFE)),
        float(notes.get("possibly_stale_threshold", 0.3)),
        float(notes.get("stale_threshold", 0.1)),
    )
    return Config(**{**own.__dict__, "warnings": tuple(validate(own, embeddings))})


def validate(config: Config, embeddings: tuple[str, ...] = ("local", "learned", "none")) -> list[str]:
    """What is odd, one line each; nothing here is an error."""
    out = []
    if not config.areas:
        out.append("no areas: no folder will be indexed")
    if not config.tracked:
        out.append("no tracked extensions: no file will be parsed")
    out += [f"no parser for {ext}: files with this extension will be skipped" for ext in config.tracked if ext not in LANGUAGE]
    if config.embedding not in embeddings:
        out.append(f"no embedding model {config.embedding!r}")
    return out


def _names(value) -> list[str]:
    return [str(x) for x in value or ()]


def load_intent(spark: SparkSession, path: str) -> tuple[DataFrame | None, list[str]]:
    """The intent document as one row of intent.SCHEMA, and warnings; None where
    there is no file. A large one is loaded too, with a warning."""
    if not os.path.exists(path):
        return None, []
    size = os.path.getsize(path)
    warnings = [f"intent is large ({size} bytes)"] if size > LARGE_INTENT else []
    doc = _document(path)
    sprint, design, team = (doc.get(k) or {} for k in ("sprint", "architecture", "team_context"))
    text = lambda x: None if x is None else str(x)
    incidents = [(text(i.get("id")), text(i.get("description")), text(i.get("severity")), text(i.get("status", "open")), _names(i.get("affected_lobes"))) for i in doc.get("incidents") or ()]
    row = (text(sprint.get("name")), text(sprint.get("goal")), _names(sprint.get("priority_lobes")), _names(sprint.get("deprioritized_lobes")), incidents, _names(design.get("avoid_patterns")), _names(design.get("principles")), _names(team.get("concerns")))
    return spark.createDataFrame([row], intent_rules.SCHEMA), warnings
