"""A catalog of saved models: a folder each with metadata, model and preprocessor as JSON."""

from __future__ import annotations

import json
import os
import re
import shutil
from pathlib import Path

DEFAULT_ROOT = Path.home() / ".lumenframe" / "models"
NAME = re.compile(r"[A-Za-z0-9_-][A-Za-z0-9._-]{0,63}")
FILES = ("metadata", "model", "preprocessor")


def check_new_name(name: str) -> str:
    if not isinstance(name, str) or not NAME.fullmatch(name):
        raise ValueError("model_name must be 1-64 letters, digits, '.', '_' or '-', and not start with '.'")
    return name


def model_dir(root: Path, name: str) -> Path:
    """The folder of an existing name: one path component, directly below the root."""
    root = Path(root)
    if not name or name in (".", "..") or "/" in name or "\\" in name or "\0" in name:
        raise ValueError(f"invalid model name {name!r}")
    path = root / name
    if path.exists() and Path(os.path.realpath(path)).parent != Path(os.path.realpath(root)):
        raise ValueError(f"invalid model name {name!r}")
    return path


def save(root: Path, name: str, metadata: dict, model: str, preprocessor: str, *, overwrite: bool = False) -> Path:
    path = model_dir(root, check_new_name(name))
    if (path / "metadata.json").exists() and not overwrite:
        raise ValueError(f"model '{name}' already exists; pass overwrite=True to replace it")
    path.mkdir(parents=True, exist_ok=True)
    (path / "model.json").write_text(model)
    (path / "preprocessor.json").write_text(preprocessor)
    (path / "metadata.json").write_text(json.dumps(metadata, indent=1, default=str))  # last: it marks the model as whole
    return path


def load_metadata(root: Path, name: str) -> dict:
    path = model_dir(root, name)
    if not (path / "metadata.json").is_file():
        raise ValueError(f"model '{name}' not found")
    return json.loads((path / "metadata.json").read_text())


def load(root: Path, name: str) -> tuple[dict, str, str]:
    meta, path = load_metadata(root, name), model_dir(root, name)
    return meta, (path / "model.json").read_text(), (path / "preprocessor.json").read_text()


def list_models(root: Path) -> list[dict]:
    root = Path(root)
    names = sorted(p.name for p in root.iterdir() if (p / "metadata.json").is_file()) if root.is_dir() else []
    return [load_metadata(root, n) for n in names]


def delete(root: Path, name: str) -> dict:
    path = Path(root) / name
    if path.is_symlink() and "/" not in name and name not in (".", ".."):
        path.unlink()  # the link only
        return {"model_name": name, "deleted": True, "path": str(path)}
    path = model_dir(root, name)
    found = path.is_dir()
    if found:
        shutil.rmtree(path)
    return {"model_name": name, "deleted": found, "path": str(path)}
