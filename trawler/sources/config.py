"""Store configuration files: YAML where it is installed, else JSON.

``collections`` may be a list of items or a map from name to item; it is
written back as a map.
"""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass, field

from trawler.config import Settings
from trawler.plans.store import Collection

try:
    import yaml
except ImportError:
    yaml = None

FIELDS = ("path", "pattern", "include", "ignore", "update", "include_by_default", "context")


@dataclass
class FileConfig:
    store_path: str = ""
    chunk_size: int = 0
    chunk_overlap: float = 0.0
    global_context: str = ""
    models: dict = field(default_factory=dict)
    collections: list[Collection] = field(default_factory=list)

    def settings(self) -> Settings:
        return Settings(chunk_tokens=self.chunk_size, chunk_overlap=self.chunk_overlap)


def _collection(name: str, raw: dict) -> Collection:
    known = {k: v for k, v in (raw or {}).items() if k in FIELDS and v is not None}
    return Collection(name=(raw or {}).get("name") or name, **{"path": "", **known})


def parse_config(text: str) -> FileConfig:
    data = (yaml.safe_load(text) if yaml else json.loads(text)) or {}
    raw = data.get("collections") or []
    if isinstance(raw, dict):
        items = [_collection(name, raw[name]) for name in sorted(raw)]
    else:
        items = [_collection("", item) for item in raw]
    plain = {k: data[k] for k in ("store_path", "chunk_size", "chunk_overlap", "global_context", "models") if data.get(k)}
    return FileConfig(collections=items, **plain)


def load_config(path: str) -> FileConfig:
    with open(path, encoding="utf-8") as f:
        return parse_config(f.read())


def absolute(config: FileConfig, root: str) -> FileConfig:
    """Relative paths taken from the workspace root."""
    for item in config.collections:
        if item.path and "://" not in item.path:
            item.path = os.path.normpath(os.path.join(root, item.path))
    if config.store_path and "://" not in config.store_path:
        config.store_path = os.path.normpath(os.path.join(root, config.store_path))
    return config


def save_config(path: str, config: FileConfig) -> None:
    """Write the map form; only an explicit opt-out of the default is kept."""
    out = {k: v for k, v in asdict(config).items() if k != "collections" and v}
    out["collections"] = {}
    for item in config.collections:
        row = {k: v for k, v in asdict(item).items() if k in FIELDS and v and k != "include_by_default"}
        if item.include_by_default is False:
            row["include_by_default"] = False
        out["collections"][item.name] = row
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    text = yaml.safe_dump(out, sort_keys=False, allow_unicode=True) if yaml else json.dumps(out, indent=2)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def config_of(store, root: str = "") -> FileConfig:
    """The catalog of a store as a file config, paths relative to ``root``."""
    config = FileConfig(
        store_path=store.root,
        chunk_size=store.settings.chunk_tokens,
        chunk_overlap=store.settings.chunk_overlap,
        global_context=store.state.global_context,
    )
    for name in sorted(store.state.collections):
        item = Collection(**store.state.collections[name])
        if root and item.path.startswith(root.rstrip("/") + "/"):
            item.path = os.path.relpath(item.path, root)
        config.collections.append(item)
    return config


def open_store(spark, config: FileConfig, **models):
    """A store with the collections and contexts of a config file."""
    from trawler.plans.store import CorpusStore

    store = CorpusStore(spark, config.store_path, config.settings(), **models)
    for item in config.collections:
        store.add_collection(item)
    if config.global_context:
        store.set_global_context(config.global_context)
    return store
