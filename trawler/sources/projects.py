"""Project files: which wiki workspace a project name stands for."""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass, field

from trawler.sources.config import yaml

SOURCES = {"local": ("path", "url"), "remote": ("url", "path")}


@dataclass
class Project:
    project_name: str = ""
    project_slug: str = ""
    language: str = ""
    active_source: str = ""
    sources: dict[str, dict] = field(default_factory=dict)
    code_repos: list[dict] = field(default_factory=list)

    def check(self) -> None:
        """Raise ValueError for the first thing that is wrong."""
        self.active_source = self.active_source.strip()
        for name in ("project_slug", "project_name", "language", "active_source"):
            if not getattr(self, name).strip():
                raise ValueError(f"{name} is required")
        if self.active_source not in SOURCES:
            raise ValueError(f"unsupported active source {self.active_source!r}")
        if not self.sources.get(self.active_source):
            raise ValueError(f"active {self.active_source} source is not configured")
        for kind, source in self.sources.items():
            needed, forbidden = SOURCES[kind]
            if source.get("type") != kind:
                raise ValueError(f"{kind} source must have type {kind!r}")
            if not source.get(needed, "").strip():
                raise ValueError(f"{kind} source requires {needed}")
            if source.get(forbidden, "").strip():
                raise ValueError(f"{kind} source must not set {forbidden}")
        for repo in self.code_repos:
            for name in ("slug", "path"):
                if not repo.get(name, "").strip():
                    raise ValueError(f"code repo {name} is required")


def _file(root: str, slug: str) -> str:
    return os.path.join(root, slug, "config.yaml")


def save_project(root: str, project: Project) -> None:
    project.check()
    path = _file(root, project.project_slug)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    data = asdict(project)
    with open(path, "w", encoding="utf-8") as f:
        f.write(yaml.safe_dump(data, sort_keys=False, allow_unicode=True) if yaml else json.dumps(data, indent=2))


def load_project(root: str, slug: str) -> Project:
    with open(_file(root, slug), encoding="utf-8") as f:
        text = f.read()
    project = Project(**(yaml.safe_load(text) if yaml else json.loads(text)))
    project.check()
    return project


def list_projects(root: str) -> list[str]:
    if not os.path.isdir(root):
        return []
    return sorted(slug for slug in os.listdir(root) if os.path.isfile(_file(root, slug)))


def resolve_root(config_root: str, root: str = "", project: str = "") -> str:
    """The workspace folder: of the project if one is named, else ``root``."""
    slug = "-".join(filter(None, "".join(c if c.isascii() and c.isalnum() else " " for c in project.lower()).split()))
    if not slug:
        return root.strip() and root or "."
    found = load_project(config_root, slug)
    if found.active_source != "local":
        raise ValueError(f"active source of project {project!r} is not local")
    return found.sources["local"]["path"]
